import numpy as np
import pytest
from chronofold.llm import topk
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int, block string, is_query int, n int"


def brute(rows, k=5, every=50):
    best = {}
    for key, vector in rows:
        if key is None or vector is None or any(x is None or not np.isfinite(np.float32(x)) for x in vector):
            continue
        v = [int(np.floor(256 * float(np.float32(x)))) for x in vector]
        if key not in best or v < best[key]:
            best[key] = v
    out = []
    for q in (k_ for k_ in best if k_ % every == 0):
        scored = sorted((-sum(a * b for a, b in zip(best[q], v)), key) for key, v in best.items() if key != q and len(v) == len(best[q]))
        out += [(q, r + 1, key, -s) for r, (s, key) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame([(k, v, 1, "x", 2, 3) for k, v in rows], SCHEMA)
    found = topk.search(df, F.col("vec_id") % 50 == 0)
    assert [f.dataType.simpleString() for f in found.schema] == ["bigint", "int", "bigint", "bigint"]
    return sorted(map(tuple, found.collect()))


def test_matches_brute_force_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = np.random.default_rng(2)
    rows = [(k, [float(x) for x in rng.normal(0, 0.2, 12).astype(np.float32)]) for k in range(400)]
    rows[100:130] = [(k, rows[50][1]) for k in range(100, 130)]  # ties
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize(("width", "n"), [(64, 1500), (256, 3000), (768, 1500)])
def test_wide_vectors_fill_several_blocks(spark, monkeypatch, width, n):
    """A drawn block is closed by its bytes from 129 components on: a query still meets one of them only."""
    if width == 64:
        monkeypatch.setattr(topk, "BYTES", 1 << 17)
    rng = np.random.default_rng(width)
    given = np.round(rng.normal(0, 1, (n, width)), 3).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(given)], "vec_id long, embedding array<float>")
    found = sorted(map(tuple, topk.search(df, F.col("vec_id") % 50 == 0).collect()))
    whole = np.floor(256 * given.astype(float)).astype(np.int64)
    want = []
    for q in range(0, n, 50):
        scores = whole @ whole[q]
        best = sorted((-int(s), i) for i, s in enumerate(scores) if i != q)[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert found == want


def test_several_lengths_draw_a_block_each(spark, monkeypatch):
    monkeypatch.setattr(topk, "GROUPS", 2)
    rng = np.random.default_rng(9)
    rows = [(k, [float(x) for x in rng.normal(0, 0.3, 3 + k % 4).astype(np.float32)]) for k in range(300)]
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    one = [0.5, -0.25]
    rows = [(0, one), (1, one), (2, [0.5, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, None), (None, one), (50, []), (51, []), (100, [1.0]), (7, [0.0, 0.0]), (1, [0.1, 0.1]), (8, [2.0, 3.0]), (150, [0.0, 0.0]), (8, [2.0, 3.0])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_exact_type_follows_the_reach():
    assert topk.exact(np.array([[100, -100]]))[0].dtype == np.float32
    assert topk.exact(np.array([[1 << 20, 1]]))[0].dtype == np.float64
    assert topk.exact(np.array([[1 << 29, 1]]), np.array([[1, 1]]))[0].dtype == np.int64
    with pytest.raises(OverflowError):
        topk.exact(np.array([[1 << 40, 1]]))


def best_of(vectors, query, own, k):
    scored = sorted((-int(v @ query), i) for i, v in enumerate(vectors) if i != own)[:k]
    return [(i, -s) for s, i in scored]


@pytest.mark.parametrize("shape", ["sparse", "few heavy dimensions", "even"])
def test_lists_are_exact_and_stop(shape):
    """Scored shares: the lists stop where few components are large, and never on even random vectors of 64 dimensions."""
    rng = np.random.default_rng(3)
    vectors = rng.normal(0, 40, (4000, 64))
    if shape == "sparse":
        vectors = np.abs(vectors) ** 2 * (rng.random((4000, 64)) < 0.06)
    if shape == "few heavy dimensions":
        vectors *= np.where(np.arange(64) < 2, 60, 0.05)
    vectors = np.floor(vectors)
    lists = topk.Lists(np.arange(4000), vectors)
    queries, own = vectors[::100], np.arange(0, 4000, 100)
    want = [best_of(vectors, q, o, 5) for q, o in zip(queries, own, strict=True)]
    floors = np.array([w[-1][1] for w in want], float)
    place, ids, scores = lists.top(queries, own, 5, floors)
    got = [[] for _ in own]
    for p, i, s in zip(place, ids, scores, strict=True):
        got[p].append((int(i), int(s)))
    assert got == want
    share = lists.scored / (len(queries) * len(vectors))
    assert share == 1 if shape == "even" else share < 0.5, share
    # floors that say nothing give the same
    assert [int(i) for i in lists.top(queries, own, 5, np.full(40, -np.inf))[1]] == [i for w in want for i, _ in w]
