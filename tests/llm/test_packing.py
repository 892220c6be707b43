import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from chronofold.llm import packing
from tokenizers import Tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, length string, ids int"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(*packing.default_vocabulary())


def texts(n=400, seed=4):
    rng = random.Random(seed)
    parts = ["a", "Word", "été", "don't", "'s", "12", "3.5", "!!", "\n", "\n\n", " ", "  ", "   ", "\t", "\u00a0", "\u3000", "漢字", "🙂", "<|endoftext|>", ".", "\x1c", "e\u0301", "x" * 70]
    return ["".join(rng.choice(parts) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randrange(0, 30))) for _ in range(n)]


def test_ids_are_the_tokenizers(tokenizer, encoder, monkeypatch):
    for text in [*texts(), "", " ", "  a", "a ", "a  ", "\n a", "a \n b", "a\n b", " a", "'s 's"]:
        assert list(np.frombuffer(encoder.ids(text), "<u4")) == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
    monkeypatch.setattr(packing, "SLICE", 7)
    for text in texts(seed=9):
        assert list(np.frombuffer(encoder.ids(text), "<u4")) == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_added_tokens_in_random_texts(tokenizer, encoder):
    rng = random.Random(12)
    parts = ["<|endoftext|>", "<|endoftext|>", "<|endof", "text|>", " ", "  ", "a", "word", "\n", "'s", "é", "9", "\t", "<"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 14))) for _ in range(20_000)]
    for text, want in zip(made, tokenizer.encode_batch(made, add_special_tokens=False), strict=True):
        assert list(np.frombuffer(encoder.ids(text), "<u4")) == want.ids, repr(text)
    assert 50256 in np.frombuffer(encoder.ids("a <|endoftext|> b"), "<u4")


def plain_greedy(lengths, capacity, linear, quadratic):
    """The same rule, one sequence after another in plain Python."""
    out, used = [], 0
    rest = []
    for k, n in enumerate(lengths):
        for s in range(0, n // capacity * capacity, capacity):
            out.append((k, s, capacity, used, 0))
            used += 1
        rest.append((-(n % capacity), k, n // capacity * capacity))
    bins = [[0.0, capacity] for _ in range(-(-sum(-r[0] for r in rest) // capacity))]
    for left, k, at in sorted(rest):
        left = -left
        while left:
            fit = [(cost, i) for i, (cost, room) in enumerate(bins) if room >= left]
            i = min(fit)[1] if fit else max(range(len(bins)), key=lambda j: (bins[j][1], -j))
            take = min(left, bins[i][1])
            out.append((k, at, take, used + i, capacity - bins[i][1]))
            bins[i][0] += linear * take + quadratic * take * take
            bins[i][1] -= take
            left, at = left - take, at + take
    return out


def test_assignment_is_the_plain_greedy():
    for seed in range(25):
        rng = np.random.default_rng(seed)
        lengths = [int(n) for n in rng.integers(1, rng.choice([40, 300, 3000]), rng.integers(1, 120))]
        quadratic = float(rng.choice([0.0, 1 / 2048, 1.0]))
        capacity = int(rng.choice([64, 256, 2048]))
        assert [tuple(map(int, p)) for p in packing.assign(np.array(lengths), capacity, 1.0, quadratic)] == plain_greedy(lengths, capacity, 1.0, quadratic)


def test_words_are_forgotten_in_time(encoder, monkeypatch):
    monkeypatch.setattr(packing, "WORDS", 3)
    made = packing.Encoder(*packing.default_vocabulary())
    for text in texts(50):
        assert made.ids(text) == encoder.ids(text)
    assert len(made.inner) <= 3


def test_assignment():
    rng = np.random.default_rng(0)
    lengths = np.concatenate([rng.integers(1, 3000, 200), [1, 2048, 4096, 2049, 10_000]])
    pieces = packing.assign(lengths, 2048, 1.0, 1 / 2048)
    assert len({s for *_, s, _ in pieces}) == -(-int(lengths.sum()) // 2048) or len({s for *_, s, _ in pieces}) <= lengths.sum() // 2048 + 1
    for k, n in enumerate(lengths):
        own = sorted((start, length) for d, start, length, *_ in pieces if d == k)
        assert own[0][0] == 0 and sum(x for _, x in own) == n and all(a + b == c for (a, b), (c, _) in zip(own, own[1:], strict=False))
    for s in {p[3] for p in pieces}:
        own = sorted((offset, length) for *_, length, q, offset in pieces if q == s)
        assert own[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(own, own[1:], strict=False)) and sum(x for _, x in own) <= 2048
    # the costs of full sequences are balanced: few are far from the mean
    cost = {}
    for _, _, n, s, _ in packing.assign(np.full(1000, 100), 2048, 1.0, 1 / 2048):
        cost[s] = cost.get(s, 0) + n + n * n / 2048
    assert max(cost.values()) < 1.2 * np.mean(list(cost.values()))


def test_round_trip(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_TOKENS", 5000)
    rows = [(k, t) for k, t in enumerate(texts(300))] + [(None, "null key"), (5, None), (5, ""), (6, "long text " * 4000), (7, "same"), (7, "same")]
    df = spark.createDataFrame([(k, t, "en", "s", 1, "x", 2) for k, t in rows], SCHEMA)
    pieces = packing.pack(df).toPandas()
    for _, part in pieces.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert list(part.offset) == [0, *np.cumsum(part.length)[:-1]] and part.length.sum() <= 2048
    want = sorted(zlib.crc32(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for _, t in rows)
    # pieces of one text, whole ones and cut ones, put together again
    whole, cut = [], {}
    for r in pieces.itertuples():
        if r.length == r.doc_tokens:
            whole.append(zlib.crc32(r.ids))
        else:
            cut.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.ids))
    for parts in cut.values():
        parts.sort()
        starts = [s for s, _ in parts]
        if len(set(starts)) == len(starts):
            whole.append(zlib.crc32(b"".join(x for _, x in parts)))
    assert sorted(whole) == want
    assert packing.pack(df.limit(0)).count() == 0
