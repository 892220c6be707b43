import hashlib
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from chronofold.llm import decontam
from chronofold.llm.fmindex import FMIndex, suffix_array

DOCS = "doc_id long, text string, item_id int, key string, n_words int"
ITEMS = "item_id long, text string, doc_id int"


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(docs, items, window=10):
    tests = []
    for item, text in items:
        words = words_of(text) if item is not None else []
        n = min(window, len(words))
        tests += [(item, words[k : k + n]) for k in range(len(words) - n + 1) if n]
    out = []
    for key, text in docs:
        words, hit, found = words_of(text), set(), set()
        for item, w in tests:
            for k in range(len(words) - len(w) + 1):
                if words[k : k + len(w)] == w:
                    hit |= set(range(k, k + len(w)))
                    found.add(str(item))
        out.append((key, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def run(spark, docs, items, **how):
    found = decontam.scan(spark.createDataFrame([(*d, 1, "x", 2) for d in docs], DOCS), spark.createDataFrame([(*i, 1) for i in items], ITEMS), **how)
    judged = decontam.judged(found)
    assert [f.dataType.simpleString() for f in judged.schema] == ["bigint"] * 4 + ["string", "boolean"]
    return sorted(map(tuple, judged.collect()), key=repr)


def sql(docs, items):
    con = duckdb.connect()
    for name, rows, column in (("documents", docs, "doc_id"), ("benchmark", items, "item_id")):
        con.register(name, pa.table({column: pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}))
    return sorted(con.sql(decontam.SQL).fetchall(), key=repr)


def corpus(seed):
    rng = np.random.default_rng(seed)
    word = lambda n, kinds: [f"w{k}" for k in rng.integers(0, kinds, n)]
    items = [(k, " ".join(word(int(rng.integers(1, 30)), 6))) for k in range(25)]
    items += [(30, "Übung macht, den MEISTER!"), (31, "only two"), (31, "x y z"), (32, ""), (33, None), (None, "w1 w2"), (34, " ".join(f"u{k}" for k in range(23)))]
    docs = [(k, " ".join(word(int(rng.integers(0, 300)), 7))) for k in range(60)]
    long = items[-1][1]
    docs += [(100, long), (101, f"before {long} after. {long.upper()}"), (102, long[:30]), (103, "übung macht den meister"), (104, "Übung  macht\nden-meister, only TWO. x y"), (105, ""), (106, None), (106, "x;y;z"), (106, "x;y;z"), (None, "only two"), (107, "u" * 100)]
    return docs, items


def test_matches_brute_force_and_sql(spark):
    docs, items = corpus(1)
    want = brute(docs, items)
    assert run(spark, docs, items) == want
    assert sql(docs, items) == want
    assert sum(row[-1] for row in want) > 40


@pytest.mark.parametrize(("shard", "cut", "tests"), [(50, 1 << 20, 1 << 20), (1 << 20, 37, 1 << 20), (120, 64, 300)])
def test_shards_slices_and_turns_change_nothing(spark, monkeypatch, shard, cut, tests):
    """Shards that close within a text, slices of a few words, and tests that take many turns."""
    docs, items = corpus(2)
    want = brute(docs, items)
    for name, value in (("SHARD", shard), ("SLICE", cut), ("TESTS", tests)):
        monkeypatch.setattr(decontam, name, value)
    assert run(spark, docs, items) == want
    assert run(spark, [], items) == []
    assert run(spark, docs, []) == brute(docs, [])


def test_spans_point_at_the_bytes_and_cleaning_removes_them(spark):
    passage = "Eins zwei drei vier fünf sechs sieben acht neun zehn elf"
    text = f"Vorher é: {passage}! Nachher, {passage.upper()}"
    docs = spark.createDataFrame([(1, text), (2, "clean"), (3, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in decontam.scan(docs, spark.createDataFrame([(9, passage)], "item_id long, text string"), cleaned=True).collect()}
    # the capital of an accented letter is another word, so of the second passage only what lies beside it counts
    (span,) = rows[1].spans
    assert text.encode()[span.start : span.end].decode() == passage
    assert (span.word, span.words) == (2, 11)
    assert rows[1].cleaned == text.replace(passage, "")
    assert (rows[2].cleaned, rows[3].cleaned, rows[3].spans) == ("clean", None, [])


def test_index_finds_every_place():
    rng = np.random.default_rng(4)
    for trial in range(60):
        s = rng.integers(1, 4 if trial % 2 else 40, int(rng.integers(0, 60)))
        s = np.tile(s, 3) if trial % 5 == 0 else s
        t = np.append(s, 0)
        assert suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
        index = FMIndex(s, every=int(rng.integers(1, 9)))
        some = [s[a : a + n] for a, n in zip(rng.integers(0, max(1, len(s)), 20), rng.integers(1, 6, 20), strict=True) if a + n <= len(s)] + [np.array([77]), np.array([1, 60])]
        patterns = np.zeros((len(some), 6), int)
        for k, p in enumerate(some):
            patterns[k, 6 - len(p) :] = p
        low, high = index.search(patterns, np.array([len(p) for p in some]))
        for p, a, b in zip(some, low, high, strict=True):
            assert sorted(index.locate(np.arange(a, b)).tolist()) == [k for k in range(len(s) - len(p) + 1) if (s[k : k + len(p)] == p).all()]
