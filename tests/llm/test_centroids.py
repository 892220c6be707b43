import hashlib

import duckdb
import numpy as np
import pytest
from chronofold.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, id string, v int, cluster long"


def brute(rows, k=8, rounds=10, width=64):
    kept = []
    for key, vector in rows:
        if vector is not None and len(vector) == width and all(x is not None and np.isfinite(np.float32(x)) for x in vector):
            kept.append((key, [int(np.floor(1024 * float(np.float32(x)))) for x in vector]))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    at = [v for _, v in order[:k]]

    def nearest():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(at)) for _, v in kept]

    for _ in range(rounds):
        found = nearest()
        for j in range(len(at)):
            own = [v for (_, v), (_, c) in zip(kept, found, strict=True) if c == j]
            if own:
                at[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = nearest()
    inertia = [sum(d for d, c in found if c == j) for j in range(len(at))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted(((key is None, key or 0), c, d, inertia[c], sum(inertia), digest[c]) for (key, _), (d, c) in zip(kept, found, strict=True))


def run(spark, rows, **how):
    found = centroids.cluster(spark.createDataFrame([(k, v, "x", 1, 2) for k, v in rows], SCHEMA), **how)
    assert [f.dataType.simpleString() for f in found.schema] == ["bigint", "int", "bigint", "bigint", "bigint", "string"]
    return sorted(((r[0] is None, r[0] or 0), *r[1:]) for r in map(tuple, found.collect()))


def sql(rows):
    import pyarrow as pa

    con = duckdb.connect()
    con.register("embeddings", pa.table({"vec_id": pa.array([k for k, _ in rows], pa.int64()), "embedding": pa.array([v for _, v in rows], pa.list_(pa.float32()))}))
    return sorted(((r[0] is None, r[0] or 0), *r[1:]) for r in con.sql(centroids.sql()).fetchall())


def vectors(seed, n, size=0.2):
    return [[float(x) for x in v] for v in np.random.default_rng(seed).normal(0, size, (n, 64)).astype(np.float32)]


def test_matches_brute_force_and_sql(spark):
    rows = list(enumerate(vectors(1, 300)))
    rows[100:140] = [(k, rows[7][1]) for k in range(100, 140)]
    want = brute(rows)
    assert run(spark, rows) == want
    assert sql(rows) == want


def test_odd_rows(spark):
    some = vectors(2, 12)
    bad = [float("nan"), *some[0][1:]], [float("inf"), *some[0][1:]], [None, *some[0][1:]], some[0][:63], some[0] + [0.0], [], None
    rows = list(enumerate(some)) + [(100 + k, v) for k, v in enumerate(bad)] + [(None, some[3]), (None, some[4]), (5, some[6]), (5, some[6])]
    assert run(spark, rows) == brute(rows) == sql(rows)
    few = rows[:3] + [(None, some[9])]
    assert run(spark, few) == brute(few) == sql(few)
    assert run(spark, []) == []
    equal = [(k, some[0]) for k in range(20)]  # all centroids alike: the first takes all, the others are empty
    assert run(spark, equal) == brute(equal) == sql(equal)
    with pytest.raises(Exception, match="may not fit"):
        run(spark, [(1, [3e38] * 64)])


@pytest.mark.parametrize(("size", "spread"), [(200, 150), (1 << 26, 1 << 10), (1 << 26, 3), (1 << 26, 1 << 26)])
def test_intervals_are_exact_at_every_size(size, spread):
    """Near 2**26 float32 sums are off by thousands of millions; the nearest centroid stays right to one."""
    rng = np.random.default_rng(size + spread)
    middle = rng.integers(-size, size, 64)
    v = (middle + rng.integers(-spread, spread + 1, (2000, 64))).astype(np.int32)
    at = middle + rng.integers(-spread, spread + 1, (8, 64))
    at[5] = at[2]  # ties
    screen = centroids.Screen(at)
    got = screen.nearest(v)
    apart = ((v.astype(object)[:, None, :] - at.astype(object)[None, :, :]) ** 2).sum(axis=2)
    assert got.tolist() == [min(range(8), key=lambda j: (row[j], j)) for row in apart]


def test_screening_decides_nearly_all():
    """On vectors like the given table's under a few in a hundred need the integers."""
    rng = np.random.default_rng(5)
    v = np.floor(1024 * rng.normal(0, 0.12, (5000, 64))).astype(np.int32)
    screen = centroids.Screen(v[:8].astype(np.int64))
    screen.nearest(v)
    assert screen.again < 0.05 * len(v)
