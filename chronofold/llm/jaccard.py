"""SimHash near-dedup for a Jaccard threshold: vantage-point trees first, then an exact join over prefixes of shingle sets."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest, xxh64_intdigest

from chronofold.llm._common import blob_values, bounded_batches, cut, utf8
from chronofold.llm.graph import components
from chronofold.llm.simhash import links, majority, word_lists

#: Documents that are sampled for the first order of the shingles, documents of the sample from which a shingle counts as
#: common, and the most common ones that are sent along. They set the cost alone: any order gives the same pairs.
SAMPLE, COMMON, SENT = 4096, 3, 100_000
#: The most keys that are broadcast to choose rows; with more, the rows are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
#: Rows of a bucket that one comparison takes, and from which its texts are ordered anew; larger buckets go in blocks.
WIDE, DEEP = 64, 256
#: The buckets of a set that its rows have along, by which a pair is compared once.
FIRST = 64
#: The fewest counters of a sketch, and the shingles for each of a larger set.
CELLS, EACH = 128, 8


def shingles(text: bytes, shingle: int = 5) -> np.ndarray:
    """The distinct shingles of a text's words as sorted 64-bit hashes; all words are one where they are fewer, and none give none."""
    found, few = [], []
    for words in word_lists(text, shingle - 1):
        few = words
        if len(words) >= shingle:
            joined = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
            found.append(np.fromiter(map(xxh64_intdigest, joined, repeat(42)), np.uint64, len(words) - shingle + 1))
    if not found:
        return np.array([xxh64_intdigest(b" ".join(few), 42)] if few else [], np.uint64)
    return np.unique(np.concatenate(found))


def prefix(own: np.ndarray, least: float, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """So many of a set's rarest shingles that every set of Jaccard ``least`` or more has one of them in its own prefix.

    Such a set shares ``least * len(own)`` shingles or more, so the first in the order of all shared ones is among the first
    ``len(own) - ceil(least * len(own)) + 1`` of both sets.
    """
    if len(common):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        own = own[np.lexsort((own, np.where(common[at] == own, counts[at], 0)))]
    return own[: len(own) - int(np.ceil(least * len(own) - 1e-9)) + 1] if len(own) else own


def sketch(own: np.ndarray) -> bytes:
    """How many of a set's hashes have each value of their lowest bits; 255 stands for so many or more.

    A larger set has more counters, a power of two, so that it is told from others as well as a small one is.
    """
    cells = max(CELLS, 1 << (len(own) // EACH).bit_length())
    return np.minimum(np.bincount((own & np.uint64(cells - 1)).astype(np.int64), minlength=cells), 255).astype(np.uint8).tobytes()


def may_reach(marks: list[bytes], a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, least: float) -> np.ndarray:
    """False where sets of n and m shingles, with the sketches at ``a`` and ``b``, share too few for a Jaccard of ``least``."""
    sizes = np.array(list(map(len, marks)), np.int64)
    small, both = np.minimum(sizes[a], sizes[b]), np.empty(len(a), np.int64)
    for cells in np.unique(small):
        able = np.flatnonzero(sizes >= cells)
        place = np.empty(len(marks), np.int64)
        place[able] = np.arange(len(able))
        # the counters of a larger sketch that fall together, added up
        held = np.stack([np.minimum(np.frombuffer(marks[k], np.uint8).reshape(-1, cells).sum(axis=0, dtype=np.int64), 255) for k in able]).astype(np.uint8)
        for at in np.array_split(np.flatnonzero(small == cells), max(1, np.count_nonzero(small == cells) * cells >> 24)):
            low = np.minimum(held[place[a[at]]], held[place[b[at]]])
            both[at] = np.where((low == 255).any(axis=1), np.minimum(n, m)[at], low.sum(axis=1, dtype=np.int64))
    return both >= least * (n + m - both) - 1e-9


def ready(keys: DataFrame) -> DataFrame:
    """``keys`` computed once, to be broadcast where they are few."""
    keys = cut(keys)
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def chosen(rows: DataFrame, keys: DataFrame, how: str = "left_semi", by: str = "node") -> DataFrame:
    """``rows`` whose ``by`` is in ``keys`` (node), or (``left_anti``) not in them or null; keys are broadcast where they are few."""
    return rows.join(ready(keys.select(F.col("node").alias(by))), by, how)


def both_nodes(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()


def likely(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The ``pairs`` (u, v) that the sketches of ``sets`` (node, n, sketch) leave open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other, at = batch.column(3).to_pylist(), batch.column(5).to_pylist(), np.arange(batch.num_rows)
            good = pa.array(may_reach(one + other, at, at + len(at), batch.column(2).to_numpy(), batch.column(4).to_numpy(), least), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(good) for k in (0, 1)], ["u", "v"])

    sets = chosen(sets, both_nodes(pairs))
    first = pairs.join(sets.select(F.col("node").alias("u"), F.col("n").alias("n1"), F.col("sketch").alias("s1")), "u")
    second = first.join(sets.select(F.col("node").alias("v"), F.col("n").alias("n2"), F.col("sketch").alias("s2")), "v")
    return second.select("u", "v", "n1", "s1", "n2", "s2").mapInArrow(run, "u long, v long").distinct()


def similar(pairs: DataFrame, texts: DataFrame, least: float, shingle: int) -> DataFrame:
    """The ``pairs`` (u, v) of which a text (node, t) of one and a text of the other have a Jaccard similarity of ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[bytes, np.ndarray]] = {}

        def own(side: int, text: bytes) -> np.ndarray:
            if side not in held or held[side][0] != text:  # rows of one text often follow each other
                held[side] = text, shingles(text, shingle)
            return held[side][1]

        for batch in batches:
            good = []
            for a, b in zip(blob_values(batch.column(2)), blob_values(batch.column(3)), strict=True):
                x, y = own(0, a), own(1, b)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= least * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(good, pa.bool_())) for k in (0, 1)], ["u", "v"])

    pairs = cut(pairs)
    asked = F.broadcast(pairs) if pairs.count() <= BROADCAST_KEYS else pairs
    first = texts.select(F.col("node").alias("u"), F.col("t").alias("a")).join(asked, "u")
    second = chosen(texts, pairs.select(F.col("v").alias("node")).distinct()).select(F.col("node").alias("v"), F.col("t").alias("b"))
    both = first.join(second, "v").select("u", "v", "a", "b")
    return both.mapInArrow(run, "u long, v long").distinct()


def apart(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The ``rows`` (h, node, n) of buckets h that hold several components, with component and the bucket's size.

    ``base`` is the bucket's largest component, and ``others`` counts the rows outside it. Of buckets with the same
    nodes one stays: shingles of a passage name the same documents over and over.
    """
    placed = rows.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mark = lambda k: F.sum(F.xxhash64("node", F.lit(k)).cast("decimal(38,0)"))
    parts = placed.groupBy("h", "component").agg(F.count("*").alias("m"), mark(1).alias("x"), mark(2).alias("y"))
    buckets = parts.groupBy("h").agg(F.max(F.struct("m", "component")).alias("base"), F.sum("m").alias("size"), F.count("*").alias("many"), F.sum("x").alias("x"), F.sum("y").alias("y")).where("many > 1")
    kept = buckets.groupBy("size", "x", "y").agg(F.min(F.struct("h", "base")).alias("b")).select("b.h", "b.base.component", "size", (F.col("size") - F.col("b.base.m")).alias("others"))
    return placed.join(kept.withColumnRenamed("component", "base"), "h").select("h", "node", "n", "component", "size", "base", "others")


def compared(rows: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs (u, v) of a bucket's ``rows`` that are apart and that sizes and sketches leave open; ``rows`` as ``apart`` gives them.

    The rows outside a bucket's largest component lead in blocks of about ``WIDE``: a task holds one block and lets the
    bucket's rows pass by it. So what is copied grows with the rows outside, no bucket is held whole, and only likely
    pairs are returned. Near copies share most of their buckets, and what a pair comes to does not depend on the bucket: it
    is compared in the least bucket of both alone, and from one end of it. For that a row has the ``FIRST`` least buckets of its
    set along; a pair that shares none of those is compared in each later bucket that it shares, so none is lost.
    """

    def met(leads: list[np.ndarray], others: list[np.ndarray], h: int, before: int) -> tuple[np.ndarray, np.ndarray]:
        node, n, component, marks, met_in = leads[2:]
        lead2, outside2, node2, n2, component2, marks2, met_in2 = others
        fine = (component[:, None] != component2[None, :]) & (np.minimum(n[:, None], n2[None, :]) >= least * np.maximum(n[:, None], n2[None, :]) - 1e-9)
        # two leads of this block meet when the later one comes, and those of two blocks in the block of the larger node
        place = np.where(lead2, before + np.cumsum(lead2) - 1, len(node))
        fine &= (np.arange(len(node))[:, None] < place[None, :]) & (lead2 | ~outside2 | (node[:, None] > node2[None, :]))
        a, b = np.nonzero(fine)
        if len(a):
            earlier, earlier2 = [set(x[: bisect_left(x, h)]) for x in met_in], [x[: bisect_left(x, h)] for x in met_in2]
            new = np.array([earlier[i].isdisjoint(earlier2[j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)], bool)
            a, b = a[new], b[new]
        good = may_reach([*marks, *marks2], a, b + len(marks), n[a], n2[b], least)
        return node[a[good]], node2[b[good]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, leads = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            h, block, *columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(7)]
            columns += [np.array([*batch.column(k).to_pylist(), None], object)[:-1] for k in (7, 8)]
            starts = [0, *(np.flatnonzero((h[1:] != h[:-1]) | (block[1:] != block[:-1])) + 1).tolist(), len(h)]
            out = []
            for s, e in zip(starts, starts[1:], strict=False):
                own = [c[s:e] for c in columns]
                if key != (h[s], block[s]):
                    key, leads = (h[s], block[s]), [c[:0] for c in own]
                before = len(leads[0])
                leads = [np.concatenate([x, c[own[0]]]) for x, c in zip(leads, own, strict=True)]
                out.append(met(leads, own, int(h[s]), before))
            u, v = (np.concatenate([x[k] for x in out]) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v), pa.int64()), pa.array(np.minimum(u, v), pa.int64())], ["u", "v"])

    blocks = F.ceil(F.col("others") / WIDE).cast("int")
    own = F.when(F.col("component") != F.col("base"), F.pmod(F.xxhash64("node"), blocks).cast("int"))
    dealt = rows.withColumn("own", own).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    lead = F.coalesce(F.col("own") == F.col("block"), F.lit(False)).alias("lead")
    dealt = dealt.select("h", "block", lead, F.col("own").isNotNull().alias("outside"), "node", "n", "component")
    # by node and size, so that a key's sets of other sizes, which may fare otherwise, have buckets of their own
    met_in = rows.groupBy("node", "n").agg(F.slice(F.array_sort(F.collect_set("h")), 1, FIRST).alias("met_in"))
    carried = sets.select("node", "n", "sketch").distinct().join(met_in, ["node", "n"])
    marked = dealt.join(carried, ["node", "n"]).select("h", "block", "lead", "outside", "node", "n", "component", "sketch", "met_in")
    return marked.repartition("h", "block").sortWithinPartitions("h", "block", F.desc("lead")).mapInArrow(run, "u long, v long").distinct()


def by_frequency(texts: DataFrame, least: float, shingle: int) -> DataFrame:
    """Rows (h, node, n) of each text's prefix in the order of the shingles' true document frequency among ``texts``.

    Shingles of one text alone come first in that order and can't be shared, so they only use the prefix up; a text
    with more of them than its prefix is long has no rows at all. Texts of one node with as many shingles are taken
    together, which makes their prefix longer, never shorter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, shingle) for t in blob_values(batch.column(1))]
            many = np.array(list(map(len, sets)), np.int64)
            h = np.concatenate([*(s.view(np.int64) for s in sets), np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), many)), pa.array(np.repeat(many, many)), pa.array(h)], ["node", "n", "h"])

    rows = texts.select("node", "t").mapInArrow(run, "node long, n long, h long").repartition("h")
    # all columns are asked for, so that both sides of the join read one exchange
    common = rows.groupBy("h").agg(F.count("*").alias("c"), F.min(F.struct("node", "n")).alias("low"), F.max("node").alias("high")).where("low.node < high AND low.n > 0")
    lists = rows.join(common.select("h", "c"), "h").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("c", "h"))).alias("l"))
    length = F.expr(f"n - cast(ceil({least} * n - 1e-9) as bigint) + 1 - (n - size(l))")
    return lists.select("node", "n", F.explode(F.slice("l", F.lit(1), F.greatest(length, F.lit(0)).cast("int"))).alias("x")).select("x.h", "node", "n")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.8, shingle: int = 5, near: int = 3) -> DataFrame:
    """One row (key, component_id) for each row of ``docs``; a component joins all pairs of Jaccard ``least`` or more.

    First come the pairs that SimHash fingerprints of the sets, linked within ``near`` bits by the vantage-point trees
    of ``simhash``, propose. No radius that a tree can prune holds all pairs of that similarity, so an exact join
    completes them: sets of ``shingle`` words meet where their prefixes share a shingle. Each is compared with the
    smallest key of its bucket, which takes the groups of near copies together; then the pairs of a bucket that are
    still apart are. The texts of buckets of over ``DEEP`` rows are ordered anew by true document frequencies, where
    what many texts share comes last. Sketches leave out candidates that share too few in any case; every other is
    compared by its whole set, so no pair is lost and none is wrong.

    Equal sets are one node. A null or blank text has no shingle and is like others of its kind alone. A row with a
    null key has a null component; rows that repeat a key are one document. An empty table gives no rows. Other
    columns are not read.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("node"), utf8(text).alias("t"))
    every = max(1, docs.count() // SAMPLE)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, shingle).view(np.int64) for t in blob_values(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*sets, np.zeros(0, np.int64)]))], ["h"])

    drawn = texts.where(F.pmod(F.xxhash64("node"), F.lit(every)) == 0).select("t").mapInArrow(spell, "h long")
    often = drawn.groupBy("h").count().where(F.col("count") >= COMMON).orderBy(F.desc("count"), "h").limit(SENT).collect()
    common, counts = np.array([r[0] for r in often], np.int64).view(np.uint64), np.array([r[1] for r in often], np.int64)
    order = np.argsort(common)
    common, counts = common[order], counts[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, shingle) for t in blob_values(batch.column(1))]
            firsts = [prefix(s, least, common, counts).view(np.int64) for s in sets]
            ends = np.cumsum([0, *map(len, firsts)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*firsts, np.zeros(0, np.int64)])))
            prints = np.array([majority(s) for s in sets], np.uint64).view(np.int64)
            digests = pa.array([xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), digests, pa.array(prints), pa.array(list(map(len, sets)), pa.int64()), pa.array(list(map(sketch, sets)), pa.binary()), lists], ["node", "digest", "fingerprint", "n", "sketch", "firsts"])

    sets = cut(texts.select("node", "t").mapInArrow(run, "node long, digest binary, fingerprint long, n long, sketch binary, firsts array<long>"))
    heads = cut(sets.groupBy("digest").agg(F.min("node").alias("head"), F.max("node").alias("last"), F.min("fingerprint").alias("fingerprint")))
    # copies, but for nodes that are the head of another set
    copies = sets.select("node").join(heads.select(F.col("head").alias("node")), "node", "left_anti").distinct()
    first = chosen(sets, copies, "left_anti")
    # a key with several sets links their heads
    repeated = sets.groupBy("node").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b").select("node")
    own = sets.join(repeated, "node", "left_semi").join(heads, "digest").select(F.col("node").alias("u"), F.col("head").alias("v"))

    points = cut(heads.groupBy("fingerprint").agg(F.min("head").alias("node")))
    proposed = heads.join(points, "fingerprint").where("head <> node").select(F.col("head").alias("u"), F.col("node").alias("v")).unionByName(links(points, near))

    rows = first.select("node", "n", F.explode("firsts").alias("h")).repartition("h")
    centres = rows.groupBy("h").agg(F.min(F.struct("node", "n")).alias("c"), F.max("node").alias("last")).where("c.node < last").select("h", F.col("c.node").alias("centre"), F.col("c.n").alias("m"))
    shared = cut(rows.join(centres, "h"))
    near_centre = shared.where((F.col("node") != F.col("centre")) & _fits("n", "m", least)).select(F.col("node").alias("u"), F.col("centre").alias("v"))
    tried = cut(proposed.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).unionByName(near_centre).distinct())
    linked = cut(similar(likely(tried, sets, least), texts, least, shingle).unionByName(own))
    found = cut(components(linked))

    left = cut(apart(shared.select("h", "node", "n"), found))
    more = compared(left.where(F.col("size") <= DEEP), sets, least)
    wide = left.where(F.col("size") > DEEP).select("node").distinct()
    again = cut(apart(by_frequency(chosen(texts, wide), least, shingle), found))
    more = more.unionByName(compared(again, sets, least)).distinct().join(tried, ["u", "v"], "left_anti")
    # what is joined already is joined as found: its stars take fewer steps than its links
    linked = found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(similar(more, texts, least, shingle))

    named = heads.join(components(linked).withColumnRenamed("node", "head"), "head", "left").select("digest", F.coalesce("component", "head").alias("component_id"))
    out = sets.select("node", "digest").join(named, "digest").select("node", "component_id")
    lost = docs.where(F.col(key).isNull()).select(F.lit(None).cast("long").alias("node"), F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(lost).withColumnRenamed("node", key)


def _fits(a: str, b: str, least: float) -> Column:
    return F.least(a, b) >= least * F.greatest(a, b) - 1e-9
