"""Exact top-k search by inner product: Fagin's threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.llm._common import bounded_batches, cut, fresh

#: Rows of a block with its sorted lists, queries of a group, and bytes of vectors from which either is closed.
BLOCK, QUERIES, BYTES = 4096, 2048, 4 << 20
#: Query groups that are broadcast at a time, which bounds a broadcast to so many times ``BYTES``.
GROUPS = 16
#: Places of every list that are read before the first look at the bound.
FIRST_DEPTH = 4


class Lists:
    """A block's vectors, with one list of its rows for each dimension, sorted by that component.

    A list read from the front falls, read from the back it rises: a query takes each from the end where its own
    component's sign makes the products largest. ``scored`` counts the rows whose scores were computed.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[by_id], vectors[by_id]
        self.order = np.argsort(-self.vectors, axis=0, kind="stable").astype(np.int32)
        self.falling = np.take_along_axis(self.vectors, self.order, axis=0)
        self.scored = 0

    def top(self, queries: np.ndarray, own: np.ndarray, k: int, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's place, id, score) of the best ``k`` rows for each query but its own; only scores of its floor or more.

        A query's floor is its kth result so far. All lists are read to the same depth; what no list has shown by then
        scores no more than the bound, the sum of the products at that depth. A query ends at the first depth where the
        bound is below its floor, and only the rows shown by then are scored. Queries whose bound never falls score all
        rows at once.
        """
        n = len(self.vectors)
        out, active = [], np.arange(len(queries))
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        depth = FIRST_DEPTH
        while len(active) and depth < n:
            bound = up[active] @ self.falling[depth - 1] + down[active] @ self.falling[n - depth]
            ended = bound < floors[active]
            for q in active[ended]:
                shown = np.zeros(n, bool)
                shown[self.order[:depth, queries[q] > 0]] = True
                shown[self.order[n - depth :, queries[q] < 0]] = True
                out.append(self._best(np.array([q]), np.flatnonzero(shown), queries, own, k, floors))
            active, depth = active[~ended], depth * 2
        every = np.arange(n)
        for at in range(0, len(active), 256):
            out.append(self._best(active[at : at + 256], every, queries, own, k, floors))
        return tuple(np.concatenate([x[j] for x in out]) if out else np.zeros(0, np.int64) for j in range(3))

    def _best(self, some: np.ndarray, rows: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.scored += len(some) * len(rows)
        scores = queries[some] @ self.vectors[rows].T
        fine = (scores >= floors[some][:, None]) & (self.ids[rows][None, :] != own[some][:, None])
        q, r = np.nonzero(fine)
        value = scores[q, r]
        order = np.lexsort((r, -value, q))  # rows are by id, so ties go to the smaller
        q, r, value = q[order], r[order], value[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < k
        return some[q[keep]], self.ids[rows[r[keep]]], value[keep]


def exact(*vectors: np.ndarray) -> list[np.ndarray]:
    """Whole numbers in the smallest type in which their products and sums are exact: float, double or 64 bits."""
    reach = max((max(abs(int(x.min())), abs(int(x.max()))) for x in vectors if x.size), default=0) ** 2 * max(1, vectors[0].shape[1])
    if reach >= 1 << 63:
        raise OverflowError("a score may not fit into 64 bits")
    return [x.astype(np.float32 if reach < 1 << 24 else np.float64 if reach < 1 << 53 else np.int64) for x in vectors]


def whole(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null for a null vector or one with a null, infinite or undefined component."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(vector.isNotNull() & fine, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


PACKED = "n int, ids binary, vectors binary, floors binary"


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Rows (id, v) as rows (n, ids, vectors, floors) of up to ``size`` vectors of n components each; the floors are open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, np.ndarray]]] = {}

        def emit(n: int) -> pa.RecordBatch:
            own = held.pop(n)
            ids, vectors = np.array([k for k, _ in own], "<i8"), np.stack([v for _, v in own])
            parts = [ids.tobytes(), vectors.astype("<i8").tobytes(), np.full(len(own), -np.inf).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), *(pa.array([x], pa.binary()) for x in parts)], ["n", "ids", "vectors", "floors"])

        for batch in batches:
            values, at = batch.column(1).values.to_numpy(zero_copy_only=False), batch.column(1).offsets.to_numpy()
            for k, start, end in zip(batch.column(0).to_pylist(), at[:-1], at[1:], strict=True):
                n = int(end - start)
                held.setdefault(n, []).append((k, values[start:end]))
                if len(held[n]) >= size or len(held[n]) * n * 8 >= BYTES:
                    yield emit(n)
        for n in list(held):
            yield emit(n)

    return rows.select("id", "v").mapInArrow(run, PACKED)


def _unpacked(batch: pa.RecordBatch, row: int, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, vectors, floors = (np.frombuffer(batch.column(first + j)[row].as_py(), kind) for j, kind in enumerate(("<i8", "<i8", "<f8")))
    return ids, vectors.reshape(len(ids), batch.column(0)[row].as_py()), floors


def _probe(rows: DataFrame) -> DataFrame:
    """One block (n, i, w, f) for each of the ``GROUPS`` lengths with the most rows among ``BLOCK`` drawn ones.

    A block closes at ``BYTES``, so wide vectors make several of a length; only the fullest stays, as each query group
    must meet one. Lengths without a block have no floors, which loses nothing but speed.
    """
    drawn = packed(rows.orderBy(F.xxhash64("id"), "id").limit(BLOCK).coalesce(1), BLOCK)
    first = drawn.groupBy("n").agg(F.max_by(F.struct("ids", "vectors", "floors"), F.struct(F.length("ids"), "ids")).alias("b"))
    most = first.orderBy(F.desc(F.length("b.ids")), "n").limit(GROUPS)
    return most.select("n", F.col("b.ids").alias("i"), F.col("b.vectors").alias("w"), F.col("b.floors").alias("f"))


def search(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 5) -> DataFrame:
    """The ``k`` rows of the highest integer inner products with each query row: query_id, rank, vec_id, score.

    Rows are packed where they are into blocks of up to ``BLOCK``, queries into groups of up to ``QUERIES``; neither is
    shuffled. First the groups search one block drawn from all rows: a query's kth score there is its floor, below
    which the search of every block ends. Then ``GROUPS`` groups at a time are broadcast to the blocks. A block returns
    ``k`` rows a query at most, and the rank keeps ``k`` a task before anything is shuffled. Every query still meets
    every block, as an exact search must where the bound does not fall; what grows with rows times queries is
    arithmetic and the reading of blocks, once for ``GROUPS`` groups.

    Keys name rows: of rows that repeat one, the smallest vector counts. Vectors meet only those of their length.
    Null keys, and vectors that are null or hold a null or non-finite component, take no part; a vector of no
    components scores nothing. Ties go to the smaller key. Other columns are not read. An empty table gives no rows.
    """
    bounded_batches(vectors.sparkSession)
    q = fresh(vectors, "is_query")
    rows = vectors.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), whole(F.col(vector)).alias("v"), F.coalesce(is_query, F.lit(False)).alias(q))
    rows = cut(rows.where("v IS NOT NULL").groupBy("id").agg(F.min("v").alias("v"), F.max(q).alias("q")))
    blocks = cut(packed(rows, BLOCK))
    probe = _probe(rows)

    def floors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in range(batch.num_rows):
                ids, asked, floors = _unpacked(batch, row, 1)
                if batch.column(4)[row].is_valid:
                    theirs, held, _ = _unpacked(batch, row, 4)
                    asked, held = exact(asked, held)
                    place, _, score = Lists(theirs, held).top(asked, ids, k, floors)
                    # a floor of doubles would not be exact beyond 2**53: there the search goes without one
                    full = (np.bincount(place, minlength=len(ids)) == k) & (np.abs(score).max(initial=0) < 1 << 53)
                    floors = np.where(full, np.inf, -np.inf)
                    np.minimum.at(floors, place[full[place]], score[full[place]].astype(np.float64))
                found.append(floors.astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(j) for j in range(3)), pa.array(found, pa.binary())], ["n", "ids", "vectors", "floors"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, last = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                ids, held, _ = _unpacked(batch, row, 1)
                theirs, asked, floors = _unpacked(batch, row, 4)
                held, asked = exact(held, asked)
                here = (batch.column(1)[row].as_py(), held.dtype)
                if here != last:  # a block's groups follow each other
                    lists, last = Lists(ids, held), here
                place, found, score = lists.top(asked, theirs, k, floors)
                yield pa.RecordBatch.from_arrays([pa.array(theirs[place]), pa.array(found, pa.int64()), pa.array(score.astype(np.int64))], ["query_id", "vec_id", "score"])

    opened = packed(rows.where("q"), QUERIES).join(F.broadcast(probe), "n", "left").select("n", "ids", "vectors", "floors", "i", "w", "f")
    groups = cut(opened.mapInArrow(floors_of, PACKED).select("n", F.col("ids").alias("i"), F.col("vectors").alias("w"), F.col("floors").alias("f")))
    turns = max(1, -(-groups.count() // GROUPS))
    turn = F.pmod(F.xxhash64("i"), F.lit(turns))
    met = [blocks.join(F.broadcast(groups.where(turn == t)), "n").select("n", "ids", "vectors", "floors", "i", "w", "f").mapInArrow(visit, "query_id long, vec_id long, score long") for t in range(turns)]
    every = met[0]
    for more in met[1:]:
        every = every.unionByName(more)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The query over the view ``embeddings``: vectors by 256, queries by 50, five rows each.
SQL = """
WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
rows AS (SELECT vec_id, min(v) AS v FROM fine GROUP BY vec_id),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM rows q JOIN rows c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
