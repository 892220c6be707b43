"""Benchmark decontamination: an FM-index for each training shard, searched backwards for all windows of the test items."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm._common import bounded_batches, columns_of, utf8
from chronofold.llm.fmindex import FMIndex

#: Words of a test window, words of a shard, bytes of a text that are split at a time, and bytes of test texts that go
#: out to the tasks at once; more tests take further turns over the texts.
WINDOW, SHARD, SLICE, TESTS = 10, 1 << 21, 4 << 20, 64 << 20
#: Every so many places of a shard its index keeps one.
SAMPLE = 16
#: Words are runs of 0-9, A-Z, a-z and all bytes beyond ASCII; A-Z count as a-z, any other byte as a blank.
_WORD = [chr(b).isalnum() if b < 128 else True for b in range(256)]
_PLAIN = bytes((b + 32 if 65 <= b <= 90 else b) if _WORD[b] else 32 for b in range(256))
_BREAK = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
#: What stands between the pieces of a shard; words of the tests are numbered from two.
GAP = 1


def plain_slices(text: bytes, most: int) -> Iterator[tuple[int, bytes]]:
    """(place, text of words and blanks) of a UTF-8 text in slices of about ``most`` bytes that end between words."""
    at = 0
    while at < len(text):
        stop = _BREAK.search(text, at + most) if at + most < len(text) else None
        end = stop.start() if stop else len(text)
        yield at, (text if end - at == len(text) else text[at:end]).translate(_PLAIN)
        at = end


class Tests:
    """The distinct windows of some items as numbers of words, and the items of each."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.number: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            words = [w for _, part in plain_slices(text, SLICE) for w in part.split()]
            ids = [self.number.setdefault(w, len(self.number) + 2) for w in words]
            size = min(window, len(ids))
            for k in range(len(ids) - size + 1 if size else 0):
                owners.setdefault(tuple(ids[k : k + size]), set()).add(item)
        self.window = window
        self.lengths = np.array([len(w) for w in owners], np.int64)
        self.windows = np.zeros((len(owners), window), np.int32)
        for k, w in enumerate(owners):
            self.windows[k, window - len(w) :] = w
        self.items = [tuple(sorted(s)) for s in owners.values()]
        self.shortest = int(self.lengths.min(initial=window))


class Shard:
    """Texts that are searched together; ``done`` holds what is known of each, in the order in which they came."""

    def __init__(self, tests: Tests, most: int, part: int):
        self.tests, self.most, self.part = tests, most, part
        self.done: list[dict] = []
        self._empty()

    def _empty(self) -> None:
        self.pieces, self.starts, self.owner, self.offset, self.size = [], [], [], [], 0

    def add(self, row: dict) -> None:
        """Takes in one text; its windows are found at the latest by ``search``."""
        row["n_words"], tail, number = 0, np.zeros(0, np.int64), self.tests.number
        self.done.append(row)
        for _, part in plain_slices(row["text"], self.part):
            words = part.split()
            ids = np.fromiter(map(number.get, words, repeat(0)), np.int64, len(words))
            # a slice begins with the words that a window over its border needs
            piece = np.concatenate([tail, ids])
            self.starts.append(self.size)
            self.owner.append(len(self.done) - 1)
            self.offset.append(row["n_words"] - len(tail))
            self.pieces += [piece, np.zeros(1, np.int64)]
            self.size += len(piece) + 1
            row["n_words"] += len(ids)
            tail = piece[max(0, len(piece) - self.tests.window + 1) :]
            if self.size >= self.most:
                self.search()

    def search(self) -> None:
        """Finds all windows in what was added since the last search, and adds their spans and items to their rows."""
        if self.pieces and len(self.tests.windows):
            self._search(np.concatenate(self.pieces))
        self._empty()

    def _search(self, words: np.ndarray) -> None:
        # No window holds a word that no test has, and none fits into a run of fewer known words than the shortest has
        ends = np.flatnonzero(words == 0)
        begins = np.r_[0, ends[:-1] + 1]
        long = ends - begins >= self.tests.shortest
        begins, ends = begins[long], ends[long]
        if not len(begins):
            return
        sizes = ends - begins + 1
        within = np.cumsum(sizes) - sizes
        taken = np.repeat(begins - within, sizes) + np.arange(int(sizes.sum()))
        symbols = words[taken]
        symbols[symbols == 0] = GAP
        index = FMIndex(symbols, SAMPLE)
        low, high = index.search(self.tests.windows, self.tests.lengths)
        count = high - low
        found = np.flatnonzero(count)
        if not len(found):
            return
        count = count[found]
        rows = np.repeat(low[found] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        place, which = taken[index.locate(rows)], np.repeat(found, count)
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, place, 1)
        np.add.at(change, place + self.tests.lengths[which], -1)
        hit = np.diff(np.r_[0, (np.cumsum(change) > 0).astype(np.int8)])
        starts, owner, offset = np.array(self.starts), np.array(self.owner), np.array(self.offset)
        first, after = np.flatnonzero(hit == 1), np.flatnonzero(hit == -1)
        piece = np.searchsorted(starts, first, side="right") - 1
        for doc, a, b in zip(owner[piece].tolist(), (first - starts[piece] + offset[piece]).tolist(), (after - starts[piece] + offset[piece]).tolist(), strict=True):
            self.done[doc]["spans"].append((a, b))
        pairs = np.unique(owner[np.searchsorted(starts, place, side="right") - 1] * len(self.tests.windows) + which)
        for doc, w in zip((pairs // len(self.tests.windows)).tolist(), (pairs % len(self.tests.windows)).tolist(), strict=True):
            self.done[doc]["items"].update(self.tests.items[w])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words without overlaps, in order; spans that touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def byte_spans(text: bytes, spans: list[tuple[int, int]], part_size: int) -> list[tuple[int, int]]:
    """The bytes from the first to the last word of each merged span, the text being read in slices."""
    if not spans:
        return []
    firsts, lasts = np.array([a for a, _ in spans]), np.array([b - 1 for _, b in spans])
    begin, end, before = np.zeros(len(spans), np.int64), np.zeros(len(spans), np.int64), 0
    for at, part in plain_slices(text, part_size):
        word = np.frombuffer(part, np.uint8) != 32
        edge = np.diff(np.r_[0, word.astype(np.int8), 0])
        starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        for numbers, places, out in ((firsts, starts, begin), (lasts, stops, end)):
            here = (numbers >= before) & (numbers < before + len(places))
            out[here] = at + places[numbers[here] - before]
        before += len(starts)
    return list(zip(begin.tolist(), end.tolist(), strict=True))


SPANS = "array<struct<word:long,words:long,start:long,end:long>>"


def _turn(tests: Broadcast, first: bool, last: bool, cleaned: bool, most: int, part: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Arrow batches (key, text, spans, items) with the finds of ``tests`` added; the last turn gives the result's columns."""
    span = pa.list_(pa.struct([(n, pa.int64()) for n in ("word", "words", "start", "end")]))

    def out(rows: list[dict], kind: pa.DataType) -> pa.RecordBatch:
        columns = [pa.array([r["key"] for r in rows], kind)]
        for r in rows:
            r["spans"] = merged(r["spans"])
        if not last:
            columns.append(pa.array([r["raw"] for r in rows], pa.binary()))
        else:
            columns.append(pa.array([r["n_words"] for r in rows], pa.int64()))
        places = [byte_spans(r["text"], r["spans"], part) if last else [(0, 0)] * len(r["spans"]) for r in rows]
        columns.append(pa.array([[dict(word=a, words=b - a, start=s, end=e) for (a, b), (s, e) in zip(r["spans"], p, strict=True)] for r, p in zip(rows, places, strict=True)], span))
        columns.append(pa.array([sorted(r["items"]) for r in rows], pa.list_(pa.string())))
        names = ["key", "n_words" if last else "text", "spans", "items"]
        if last and cleaned:
            columns.append(pa.array([_without(r["raw"], p) for r, p in zip(rows, places, strict=True)], pa.string()))
            names.append("cleaned")
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, kind, held = Shard(tests.value, most, part), pa.null(), 0
        for batch in columns_of(batches):
            kind = batch.column(0).type
            for k in range(batch.num_rows):
                raw = batch.column(1)[k].as_py()
                row = dict(key=batch.column(0)[k].as_py(), raw=raw, text=raw or b"", spans=[], items=set())
                if not first:
                    row["spans"] = [(s["word"], s["word"] + s["words"]) for s in batch.column(2)[k].as_py()]
                    row["items"] = set(batch.column(3)[k].as_py())
                shard.add(row)
                held += len(row["text"])
                if held >= 6 * most or len(shard.done) >= 1 << 16:  # a word and its blank are about six bytes
                    shard.search()
                    for at in range(0, len(shard.done), 1000):
                        yield out(shard.done[at : at + 1000], kind)
                    shard.done, held = [], 0
        shard.search()
        for at in range(0, len(shard.done), 1000):
            yield out(shard.done[at : at + 1000], kind)

    return run


def _without(text: bytes | None, spans: list[tuple[int, int]]) -> str | None:
    if text is None:
        return None
    edges = [0, *(x for s in spans for x in s), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)).decode()


def scan(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, cleaned: bool = False) -> DataFrame:
    """Every document with its words, the spans that test items cover, and these items: key, n_words, spans, items.

    A window is ``window`` words of an item in a row; an item of fewer words is one window. ``spans`` are the words in
    any occurrence of a window, merged: first word, number of words, and their UTF-8 bytes from ``start`` to before
    ``end``. ``items`` are the ids of the items with such windows, as sorted strings. With ``cleaned`` the text without its
    spans comes as a further column.

    Texts are read where they are; nothing of them is shuffled. A task gathers about two million words into a shard,
    leaves out runs that no window fits into, builds the shard's FM-index, searches all windows backwards at once and
    locates every occurrence. Test texts go out with the tasks in blocks of about ``TESTS`` bytes at most, as their sizes
    are added up before; each further block is one more turn over the texts, whose finds join those of the turns before.

    A null or empty text has no words, spans or items; a null text stays null when cleaned. Repeated rows are judged each.
    Rows that repeat an item id are one item; an item without an id, or without words, takes no part. A long text is split
    in slices that overlap by a window. Other columns are not read. Empty tables give no rows, or no spans.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    items = benchmark.where(F.col(item).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item).cast("string").alias("item"), utf8(item_text).alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text") + F.octet_length("item"))).first()[0] or 0
    turns = 1 if size <= TESTS else 2 * -(-size // TESTS)  # twice as many as would do, as items are dealt by hash
    turn = F.pmod(F.xxhash64("item", "text"), F.lit(turns))
    kind = documents.schema[key].dataType.simpleString()
    state = documents.select(F.col(key).alias("key"), utf8(text).alias("text"))
    for t in range(turns):
        block = [(r.item, bytes(r.text)) for r in items.where(turn == t).collect()]
        tests = spark.sparkContext.broadcast(Tests(block, window))
        last = t == turns - 1
        to = f"key {kind}, " + ("n_words long" if last else "text binary") + f", spans {SPANS}, items array<string>" + (", cleaned string" if last and cleaned else "")
        state = state.mapInArrow(_turn(tests, t == 0, last, cleaned, SHARD, SLICE), to)
    return state.withColumnRenamed("key", key)


def judged(found: DataFrame) -> DataFrame:
    """``scan``'s rows as numbers: n_words, n_hit, n_items, the digest of the items, and whether any word is hit."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["words"])
    return found.select(
        *(c for c in found.columns if c not in ("spans", "items", "cleaned")), hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


#: The query over the views ``documents`` and ``benchmark``.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
s AS (SELECT *, least(10, len(words)) AS n FROM b WHERE len(words) > 0),
w AS (SELECT DISTINCT item_id, n, array_to_string(words[i:i + n - 1], ' ') AS g FROM (SELECT *, unnest(generate_series(1, len(words) - n + 1)) AS i FROM s)),
g AS (
  SELECT r, n, i, array_to_string(words[i:i + n - 1], ' ') AS g
  FROM (SELECT r, words, n, unnest(generate_series(1, len(words) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM s) WHERE len(words) >= n)),
hits AS (SELECT r, i, n, item_id FROM g JOIN w USING (n, g)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS x FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM hits) GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(x, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""
