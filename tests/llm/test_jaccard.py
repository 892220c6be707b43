"""The pipeline's near-dedup stage against Jaccard similarities of all pairs."""

import random

import corpus_pipeline
import numpy as np
import pytest
from chronofold.llm import jaccard

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words_set(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([tuple(words)] if words else [])


def brute(rows):
    """{doc_id: component} by all pairs of 5-word Jaccard 0.8 or more."""
    label = {k: k for k, _ in rows if k is not None}
    sets = [(k, words_set(t)) for k, t in rows if k is not None]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if (x == y or 10 * len(x & y) >= 8 * len(x | y)) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
    return label


def made(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(400)]
    line = " ".join(rng.choice(words) for _ in range(12))
    rows = []
    for k in range(220):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 150)))
        kind = rng.random()
        if rows and kind < 0.5:
            own = rng.choice(rows)[1].split()
            for _ in range(rng.randrange(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(words)
            text = " ".join(own + [rng.choice(words)] * rng.randrange(0, 3))
        elif kind < 0.6:
            text = f"{line} {text[: rng.randrange(60)]}"
        rows.append((k, text))
    edge = " ".join(f"w{k}" for k in range(12))  # 8 shingles; with two words more 10, so exactly 0.8
    return [*rows, (500, edge), (501, edge + " p q"), (502, edge + " p q r"), (600, ""), (601, None), (602, " \n"), (None, edge), (3, rows[3][1]), (4, "another text of this id")]


@pytest.mark.parametrize("seed, common", [(1, 3), (2, 3), (3, 1 << 30)])
def test_components_are_brute_force(spark, monkeypatch, seed, common):
    monkeypatch.setattr(jaccard, "COMMON", common)
    rows = made(seed)
    want = brute(rows)
    df = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in jaccard.near_duplicates(df).collect()]
    assert sorted(got, key=str) == sorted(((k, want.get(k)) for k, _ in rows), key=str)
    assert len(set(want.values())) < len(want) - 40


def test_stage_drops_near_copies_beyond_two_bits(spark):
    """Copies with a word added or changed: most have fingerprints over two bits apart."""
    rng = random.Random(5)
    rows = []
    for k in range(0, 80, 2):
        own = [f"w{rng.randrange(500)}" for _ in range(80)]
        rows += [(k, " ".join(own)), (k + 1, " ".join(own[:40] + ["new"] + own[41:]))]
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], SCHEMA), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(0, 80, 2))


def test_empty_table(spark):
    assert jaccard.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("first, repeated", [(64, False), (2, False), (2, True)])
def test_a_pair_of_many_buckets_is_made_once(spark, monkeypatch, first, repeated):
    """Rows of 30 buckets with the same near copies, in small blocks and batches that cut through the leads of a block."""
    monkeypatch.setattr(jaccard, "WIDE", 4)
    monkeypatch.setattr(jaccard, "FIRST", first, raising=False)
    rng = np.random.default_rng(11)
    core = rng.integers(0, 1 << 63, 60, np.uint64)
    sets = {}
    for k in range(40):
        for more in {0, 7 * (repeated and k % 10 == 3)}:
            own = np.concatenate([rng.permutation(core)[: rng.integers(52, 61)], rng.integers(0, 1 << 63, int(rng.integers(0, 9)) + more, np.uint64)])
            sets[k, len(own)] = jaccard.sketch(np.unique(own))
    held = {h: [key for key in sets if rng.random() < 0.4] for h in range(30)}
    component = {k: 0 if k < 12 else k for k, _ in sets}
    rows = []
    for h, keys in held.items():
        parts = [component[k] for k, _ in keys]
        base = max(set(parts), key=lambda c: (parts.count(c), c))
        rows += [(h, k, n, component[k], len(keys), base, len(keys) - parts.count(base)) for k, n in keys]
    want = set()
    for keys in held.values():
        for a in keys:
            for b in keys:
                one, other = (np.array([i]) for i in (0, 1))
                if a[0] > b[0] and component[a[0]] != component[b[0]] and min(a[1], b[1]) >= 0.8 * max(a[1], b[1]) - 1e-9:
                    if jaccard.may_reach([sets[a], sets[b]], one, other, np.array([a[1]]), np.array([b[1]]), 0.8)[0]:
                        want.add((a[0], b[0]))
    assert 100 < len(want) < 700
    left = spark.createDataFrame(rows, "h long, node long, n long, component long, size long, base long, others long")
    marks = spark.createDataFrame([(k, n, m) for (k, n), m in sets.items()], "node long, n long, sketch binary")
    monkeypatch.setattr(type(left), "distinct", lambda df: df)  # what the tasks make, before copies of a pair are dropped
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = [tuple(r) for r in jaccard.compared(left, marks, 0.8).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert set(got) == want
    if first == 64:
        assert len(got) == len(want)
