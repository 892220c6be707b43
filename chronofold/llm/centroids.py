"""Centroid clustering in whole numbers: float32 products shortlist centroids, exact integers decide what they cannot."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm._common import bounded_batches, cut
from chronofold.llm.topk import whole

#: Largest size of a whole component. Up to it a squared distance of ``MOST_WIDTH`` components fits into 64 bits.
REACH, MOST_WIDTH = 1 << 27, 64
#: Spacing of float32 and float64 numbers at one, halved: the largest relative error of one rounding.
U32, U64 = 2.0**-24, 2.0**-53


class Screen:
    """The centroids of one round, and the nearest of them to whole-number vectors.

    The squared distance is |v|^2 - 2 v.c + |c|^2, of which |v|^2 is the same for all centroids. The products v.c come
    from one float32 matrix product. With n components a float32 sum of products, in any order and with or without
    fused steps, is off by at most g |v| |c| with g = m u / (1 - m u), u = 2**-24 and m = n + 2, of which two are for
    rounding v and c to float32 (Higham, Accuracy and Stability of Numerical Algorithms, 3.1). So each distance lies in an
    interval. A centroid whose interval begins above the least upper end is not the nearest one. Where one is left it is the
    nearest; where more are left, these alone are computed again in 64-bit integers, and the smallest number wins ties.
    ``again`` counts those computed again.
    """

    def __init__(self, centroids: np.ndarray):
        self.exact = centroids.astype(np.int64)
        n = self.exact.shape[1]
        self.g = (n + 2) * U32 / (1 - (n + 2) * U32)
        self.single = self.exact.astype(np.float32)
        self.squares = (self.exact * self.exact).sum(axis=1)
        self.norms = np.sqrt(self.squares.astype(np.float64)) * (1 + 8 * U64)
        self.again = 0

    def nearest(self, vectors: np.ndarray) -> np.ndarray:
        """The number of the nearest centroid for each row of 32-bit whole numbers."""
        wide = vectors.astype(np.float64)
        norms = np.sqrt((wide * wide).sum(axis=1)) * (1 + (len(self.exact[0]) + 8) * U64)
        products = (vectors.astype(np.float32) @ self.single.T).astype(np.float64)
        middle = self.squares.astype(np.float64)[None, :] - 2 * products
        # the second part holds the roundings of the doubles here
        slack = 2 * self.g * norms[:, None] * self.norms[None, :] * (1 + 16 * U64) + 16 * U64 * (self.squares.astype(np.float64)[None, :] + 2 * np.abs(products))
        left = middle - slack <= (middle + slack).min(axis=1)[:, None]
        out = left.argmax(axis=1)
        open_rows = np.flatnonzero(left.sum(axis=1) > 1)
        if len(open_rows):
            self.again += int(left[open_rows].sum())
            apart = np.full((len(open_rows), len(self.exact)), np.iinfo(np.int64).max)
            for c in range(len(self.exact)):
                some = left[open_rows, c]
                apart[some, c] = self.squared(vectors[open_rows[some]], c)
            out[open_rows] = apart.argmin(axis=1)  # the first of equal ones
        return out

    def squared(self, vectors: np.ndarray, number: np.ndarray | int) -> np.ndarray:
        """Exact squared distances of rows to one centroid, or to one for each row."""
        apart = vectors.astype(np.int64) - self.exact[number]
        return np.einsum("ij,ij->i", apart, apart)


def _whole(stored: np.ndarray) -> np.ndarray:
    """Whole numbers of their stored form, which sorts as bytes as they sort: big-endian, 2**31 above."""
    return stored.astype(np.int64) - (1 << 31)


def _rows_of(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a binary column, a row each."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return _whole(np.frombuffer(column.buffers()[2], ">u4")[at[0] // 4 : at[-1] // 4]).astype(np.int32).reshape(-1, width)


def kept_vectors(vectors: DataFrame, key: str, vector: str, scale: int, width: int) -> DataFrame:
    """Rows (id, v) of the vectors that take part, with v as ``width`` whole numbers in their stored form."""
    v = whole(F.col(vector), scale)
    fine = vectors.where(F.size(vector) == width).select(F.col(key).cast("long").alias("id"), v.alias("v")).where("v IS NOT NULL")
    far = F.exists("v", lambda x: (x < -REACH) | (x > REACH))
    small = F.when(far, F.raise_error(F.lit(f"a component reaches over {REACH} after scaling; its distances may not fit into 64 bits"))).otherwise(F.col("v").cast("array<int>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(1).offsets.to_numpy()
            flat = batch.column(1).values.to_numpy(zero_copy_only=False)[at[0] : at[-1]].astype(np.int64) + (1 << 31)
            offsets = pa.py_buffer((np.arange(batch.num_rows + 1, dtype=np.int32) * (4 * width)).tobytes())
            packed = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, offsets, pa.py_buffer(flat.astype(">u4").tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), packed], ["id", "v"])

    return fine.select("id", small.alias("v")).mapInArrow(run, "id long, v binary")


def _round(held: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: a task returns a sum for each centroid and component, never its rows."""
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen = Screen(centroids)
        totals, counts = np.zeros((k, width), object), np.zeros(k, np.int64)
        for batch in batches:
            if batch.num_rows:
                v = _rows_of(batch.column(0), width)
                number = screen.nearest(v)
                order = np.argsort(number, kind="stable")
                here = np.bincount(number, minlength=k)
                some = np.flatnonzero(here)
                # a batch's sums fit into 64 bits, a task's need not
                totals[some] += np.add.reduceat(v[order].astype(np.int64), (np.cumsum(here) - here)[some], axis=0).astype(object)
                counts += here
        for c in np.flatnonzero(counts):
            yield pa.RecordBatch.from_arrays([pa.array([c] * width, pa.int32()), pa.array(range(width), pa.int32()), pa.array([int(counts[c])] * width, pa.int64()), pa.array([str(x) for x in totals[c]])], ["c", "d", "n", "t"])

    parts = held.select("v").mapInArrow(run, "c int, d int, n long, t string")
    sums = parts.groupBy("c", "d").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("t").cast("decimal(38,0)")).alias("t"))
    after = centroids.copy()
    for row in sums.collect():  # k times the width
        after[row.c, row.d] = int(row.t) // int(row.n)
    return after


def cluster(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 8, rounds: int = 10, scale: int = 1024, width: int = 64, seed: int = 3) -> DataFrame:
    """Every kept vector with its cluster: vec_id (named as ``key``), cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly ``width`` components, none null or non-finite; each component x counts as floor(scale * x).
    The centroids 0, 1, ... start as the ``k`` kept vectors with the smallest SHA-256 of ``seed:key``. A round assigns
    all vectors to the nearest centroid (ties: the smaller number) and moves each centroid that has vectors to their
    floored mean; all of it is exact. Rows are read and made whole once; each round reads them where they are and
    shuffles ``k * width`` sums a task. Only the centroids reach the driver and go out with the tasks.

    Repeated rows count each. A null key is kept; it hashes to null and so comes last among the starts, and of rows that
    repeat a key the smaller vector comes first. With fewer than ``k`` vectors there are as many centroids; an empty table
    gives no rows. A component over 2**27 once scaled is an error, as its distances may not fit. Other columns are not read.
    """
    if not 0 < width <= MOST_WIDTH:
        raise ValueError(f"width must be 1 to {MOST_WIDTH}")
    bounded_batches(vectors.sparkSession)
    held = cut(kept_vectors(vectors, key, vector, scale, width))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    starts = held.select(digest.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    centroids = np.stack([_whole(np.frombuffer(r.v, ">u4")) for r in starts]) if starts else np.zeros((0, width), np.int64)
    for _ in range(rounds if starts else 0):
        centroids = _round(held, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen = Screen(centroids)
        for batch in batches:
            if batch.num_rows:
                v = _rows_of(batch.column(1), width)
                number = screen.nearest(v)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number.astype(np.int32)), pa.array(screen.squared(v, number))], ["id", "cluster", "distance"])

    found = cut(held.select("id", "v").mapInArrow(run, "id long, cluster int, distance long"))
    sums = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digest_of = [hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest() for row in centroids]
    known = [(c, s, sum(sums.values()), digest_of[c]) for c, s in sums.items()]
    totals = vectors.sparkSession.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows at most
    return found.join(F.broadcast(totals), "cluster").select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(k: int = 8, rounds: int = 10, scale: int = 1024, width: int = 64, seed: int = 3) -> str:
    """The query over the view ``embeddings``, its rounds one after another."""
    numbers = f"generate_series(1, {width})"
    steps = [
        f"""WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cells AS MATERIALIZED (SELECT r, unnest({numbers}) AS d, unnest(v) AS x FROM kept),
c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, v) - 1)::INTEGER AS c, v FROM kept
  QUALIFY row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, v) <= {k})"""
    ]
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS MATERIALIZED (
  SELECT r, min_by(c, (s, c)) AS c, min(s) AS s FROM (
    SELECT r, c, list_sum(list_transform(list_zip(kept.v, c{n}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS s FROM kept, c{n}) GROUP BY r)""")
        if n < rounds:
            steps.append(f"""m{n} AS MATERIALIZED (
  SELECT c, list(CASE WHEN t % n < 0 THEN t // n - 1 ELSE t // n END ORDER BY d)::BIGINT[] AS v
  FROM (SELECT c, d, sum(x)::HUGEINT AS t, count(*)::HUGEINT AS n FROM a{n} JOIN cells USING (r) GROUP BY c, d) GROUP BY c),
c{n + 1} AS MATERIALIZED (SELECT c{n}.c, coalesce(m{n}.v, c{n}.v) AS v FROM c{n} LEFT JOIN m{n} USING (c))""")
    return ",\n".join(steps) + f"""
SELECT vec_id, c AS cluster, s AS distance, (sum(s) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(s) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN c{rounds} USING (c)"""
