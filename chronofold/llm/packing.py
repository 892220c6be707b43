"""Cost-balanced packing of whole documents into token sequences."""

from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm._common import bounded_batches

#: Tokens that are packed together; a group leaves less than one sequence of padding.
GROUP_TOKENS = 1 << 20
#: Words that a worker remembers, and characters of a text that are encoded at a time.
WORDS, SLICE = 250_000, 1 << 20
#: The id that ends a document.
END_ID = 1


def default_vocabulary() -> tuple[str, str]:
    """The rank file of the 50k byte-level vocabulary, and the JSON file whose ids these are and that names its added tokens."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Byte-level BPE that remembers words; a text's ids are those of the JSON tokenizer.

    The JSON file's added tokens are cut out of a text first, wherever their strings stand; what is between them is
    encoded by itself. The splitting pattern never joins a blank that follows a non-space to what stands before it, and
    a piece never crosses such a blank if the next character is no space either. So a text falls apart at these blanks
    into words with the same ids as in the whole text. A text with any other blank beside white space is encoded whole.
    """

    def __init__(self, ranks: str, tokenizer: str):
        from public_tokenizers import PATTERN

        with open(ranks, "rb") as lines:
            known = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        with open(tokenizer, encoding="utf-8") as source:
            added = json.load(source)["added_tokens"]
        if any(token[rule] for token in added for rule in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that look at their neighbours are not known here")
        self.added = {token["content"]: int(token["id"]).to_bytes(4, "little") for token in added}
        self.cut = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if added else None
        self.coder = tiktoken.Encoding(os.path.basename(ranks), pat_str=PATTERN, mergeable_ranks=known, special_tokens={})
        self.first, self.inner = _Words(self.coder, ""), _Words(self.coder, " ")

    def ids(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit numbers; an added token's string is that token."""
        found = self.cut.search(text) if self.cut else None
        if not found:
            return self._plain(text)
        out, at = [], 0
        for found in self.cut.finditer(text):
            out += [self._plain(text[at : found.start()]), self.added[found.group()]]
            at = found.end()
        return b"".join([*out, self._plain(text[at:])])

    def _plain(self, text: str) -> bytes:
        out, at = [], 0
        while True:
            end = _cut(text, at + SLICE)
            words = text[at:end].split(" ")
            first = words[0] if at == 0 else None
            try:
                out.append(self.first[first] if first else b"")
                out.append(b"".join(map(self.inner.__getitem__, words[1:])))
            except TypeError:  # None stands for a word that can't be taken alone
                return _packed(self.coder, text)
            if end >= len(text):
                return b"".join(out)
            at = end


class _Words(dict):
    """Ids by word. A word that begins with white space, or an empty one, has None: it may belong to a longer run."""

    def __init__(self, coder: tiktoken.Encoding, lead: str):
        super().__init__()
        self.coder, self.lead = coder, lead

    def __missing__(self, word: str) -> bytes | None:
        unsafe = self.lead and (not word or word[0].isspace())
        ids = None if unsafe else _packed(self.coder, self.lead + word)
        if len(self) >= WORDS:
            self.clear()
        if len(word) < 64:
            self[word] = ids
        return ids


def _packed(coder: tiktoken.Encoding, text: str) -> bytes:
    return np.array(coder.encode_ordinary(text), "<u4").tobytes()


def _cut(text: str, at: int) -> int:
    """The first blank from ``at`` on between two characters that are no spaces, or the text's end."""
    while 0 < (at := text.find(" ", at)) < len(text) - 1:
        if not text[at - 1].isspace() and not text[at + 1].isspace():
            return at
        at += 1
    return len(text)


def assign(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of these lengths.

    A document's cost is ``linear * length + quadratic * length**2``. Whole sequences are cut from longer documents
    first. The rest goes in descending order, each to the sequence of the lowest cost that has room for all of it;
    where none has, it is cut over the sequences with the most room. There are as few sequences as hold all tokens.
    """
    out, sequence = [], 0
    rest, start = lengths % capacity, lengths // capacity * capacity
    for k in np.flatnonzero(start):
        for s in range(0, int(start[k]), capacity):
            out.append((int(k), s, capacity, sequence, 0))
            sequence += 1
    many = -(-int(rest.sum()) // capacity)
    cost, room = np.zeros(many), np.full(many, capacity)
    for k in np.lexsort((np.arange(len(rest)), -rest)):
        left, at = int(rest[k]), int(start[k])
        while left:
            fits = room >= left
            if fits.any():
                to, take = int(np.where(fits, cost, np.inf).argmin()), left
            else:
                to = int(room.argmax())
                take = int(room[to])
            out.append((int(k), at, take, sequence + to, capacity - int(room[to])))
            room[to] -= take
            cost[to] += linear * take + quadratic * take * take
            left, at = left - take, at + take
    return out


_encoders: dict[tuple[str, str], Encoder] = {}


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 2048, vocabulary: tuple[str, str] | None = None, linear: float = 1.0, quadratic: float = 1.0 / 2048) -> DataFrame:
    """One row for each piece: key, start, length, doc_tokens, sequence_id, offset, ids (little-endian 32-bit), cost.

    A document's tokens are its ids and ``END_ID``; each lies in exactly one piece. Documents are packed where they
    are read, in groups of about ``GROUP_TOKENS``, so nothing is shuffled, a task holds one group, and a task that is
    run again makes the same pieces. A sequence id holds the partition and a count, so ids are unique but not gapless.

    A null or empty text is the end id alone; a null key stays null; repeated rows are packed as often as they come;
    an empty table gives no piece; other columns are not read. Equal lengths keep the order of the rows.
    """
    bounded_batches(docs.sparkSession)
    vocabulary = vocabulary or default_vocabulary()
    names = ["key", "start", "length", "doc_tokens", "sequence_id", "offset", "ids", "cost"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _encoders:
            _encoders[vocabulary] = Encoder(*vocabulary)
        encode, end = _encoders[vocabulary].ids, END_ID.to_bytes(4, "little")
        held: list[bytes] = []
        keys: list = []
        base, size = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33, 0

        def emit() -> Iterator[pa.RecordBatch]:
            nonlocal base
            lengths = np.array([len(x) // 4 for x in held], np.int64)
            pieces = np.array(assign(lengths, capacity, linear, quadratic), np.int64).reshape(-1, 5)
            pieces = pieces[np.lexsort((pieces[:, 4], pieces[:, 3]))]
            for at in range(0, len(pieces), 1024):
                doc, start, length, sequence, offset = pieces[at : at + 1024].T
                ids = [held[d][4 * s : 4 * (s + n)] for d, s, n in zip(doc, start, length, strict=True)]
                columns = [pa.array([keys[d] for d in doc], kind), start, length, lengths[doc], base + sequence, offset, pa.array(ids, pa.binary()), linear * length + quadratic * length**2]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)
            base += int(pieces[:, 3].max()) + 1
            held.clear()
            keys.clear()

        for batch in batches:
            kind = batch.column(0).type
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys.append(k)
                held.append(encode(t or "") + end)
                size += len(held[-1]) // 4
                if size >= GROUP_TOKENS:
                    yield from emit()
                    size = 0
        if held:
            yield from emit()

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary, cost double"
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)
