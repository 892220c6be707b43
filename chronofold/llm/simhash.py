"""SimHash near-duplicates: exact linking of fingerprints by vantage-point trees."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from chronofold.llm._common import blob_values, bounded_batches, cut, utf8
from chronofold.llm.graph import components

#: Fingerprints that a shard should hold, the most shards, and the fingerprints sampled for each shard's border.
SHARD, MOST_SHARDS, SAMPLE_EACH = 8192, 1 << 16, 16
LEAF = 64
#: Pairs of fingerprints that are compared at a time; where all of them are near, each takes some dozens of bytes.
PAIRS = 1 << 18
#: Bytes of a text that are split into words at a time.
SLICE = 4 << 20
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"


# ---- fingerprints


def word_lists(text: bytes, keep: int) -> Iterator[list[bytes]]:
    """The lower-case words of a text, slice by slice; each list repeats the last ``keep`` words of the one before."""
    held: list[bytes] = []
    at = 0
    while at < len(text):
        end = min(at + SLICE, len(text))
        while end < len(text) and text[end] not in SPACE:
            end += 1
        words = held + text[at:end].lower().split()  # bytes.lower() changes A-Z only, bytes.split() splits at SPACE only
        yield words
        held, at = words[max(0, len(words) - keep) :], end


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The SimHash of a UTF-8 text over shingles of words, repeats included; 0 where it has no word."""
    counts, n, few = np.zeros(64, np.int64), 0, []
    for words in word_lists(text, shingle - 1):
        few = words
        if len(words) >= shingle:
            joined = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
            size = len(words) - shingle + 1
            for done in range(0, size, 1 << 16):
                part = np.fromiter(map(xxh64_intdigest, (next(joined) for _ in range(min(1 << 16, size - done))) if size > 1 << 16 else joined, repeat(seed)), np.uint64, min(1 << 16, size - done))
                counts += bit_counts(part)
            n += size
    if not n:
        return xxh64_intdigest(b" ".join(few), seed) if few else 0
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def majority(hashes: np.ndarray) -> int:
    """The SimHash of a set of 64-bit hashes; 0 for none."""
    return int(np.packbits(2 * bit_counts(hashes) > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """Rows (key, fingerprint long) for every row of ``docs``; a null text counts as empty, a null key stays null."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in blob_values(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["key", "fingerprint"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), utf8(text).alias("t")).mapInArrow(run, f"key {kind}, fingerprint long").withColumnRenamed("key", key)


# ---- vantage-point trees


class Tree:
    """A vantage-point tree over a sample: node k has the children 2k + 1 (inside its radius) and 2k + 2 (outside)."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.point = np.zeros((1 << depth) - 1, np.uint64)
        self.radius = np.full((1 << depth) - 1, 32, np.int64)
        self._fill(0, sample, np.random.default_rng(7))

    def _fill(self, k: int, held: np.ndarray, rng: np.random.Generator) -> None:
        if k >= len(self.point):
            return
        if len(held):
            self.point[k], self.radius[k] = choose(held, rng)
        d = distance(held, self.point[k])
        self._fill(2 * k + 1, held[d <= self.radius[k]], rng)
        self._fill(2 * k + 2, held[d > self.radius[k]], rng)

    def route(self, prints: np.ndarray, near: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, indexes of its members, indexes of those that only query it); see ``split``."""
        todo = [(0, np.arange(len(prints)), np.zeros(0, np.int64))]
        while todo:
            k, members, queries = todo.pop()
            if k >= len(self.point):
                if len(members) or len(queries):
                    yield k - len(self.point), members, queries
                continue
            inside, outside = split(distance(prints[members], self.point[k]), distance(prints[queries], self.point[k]), int(self.radius[k]), near)
            todo.append((2 * k + 1, members[inside[0]], queries[inside[1]]))
            todo.append((2 * k + 2, members[outside[0]], np.concatenate([queries[outside[1]], members[outside[2]]])))


def distance(prints: np.ndarray, point: np.uint64) -> np.ndarray:
    return np.bitwise_count(prints ^ point).astype(np.int64)


def choose(held: np.ndarray, rng: np.random.Generator, tries: int = 4) -> tuple[np.uint64, int]:
    """Of a few fingerprints, the one and the radius that split ``held`` with the fewest in the border band."""
    best = None
    some = held[:: len(held) // (1 << 14) + 1]
    for point in held[rng.integers(0, len(held), tries)]:
        d = distance(some, point)
        radius = int(np.median(d))
        inside = np.count_nonzero(d <= radius) / len(d)
        cost = abs(inside - 0.5) + np.count_nonzero((d >= radius - 1) & (d <= radius)) / len(d)
        if best is None or cost < best[0]:
            best = cost, point, radius
    return best[1], best[2]


def split(own: np.ndarray, asked: np.ndarray, radius: int, near: int):
    """Masks of members and queries for the inside and the outside, by the triangle inequality.

    A member's partners within ``near`` differ from it by ``near`` at most in their distance to the vantage point.
    So an inside member in the border band also queries the outside (as a query: the third mask). Outside members
    need not query the inside: that pair is found from its inside end. Queries go to both sides where both may hold
    a partner.
    """
    return (own <= radius, asked <= radius + near), (own > radius, asked > radius - near, (own <= radius) & (own > radius - near))


class Forest:
    """Union of indexes 0 to n - 1 by arrays of links; holds a label for each and so no list of links."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            open_ = x != y
            if not open_.any():
                return
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while (self.label[self.label] != self.label).any():
                self.label = self.label[self.label]


def link(prints: np.ndarray, members: np.ndarray, queries: np.ndarray, near: int, forest: Forest) -> None:
    """Joins in ``forest`` every member with the members and queries within ``near`` of it, by a local tree."""
    rng = np.random.default_rng(len(members))
    todo = [(members, queries)]
    while todo:
        own, asked = todo.pop()
        if not len(own):
            continue
        if len(own) > LEAF:
            point, radius = choose(prints[own], rng)
            d, e = distance(prints[own], point), distance(prints[asked], point)
            inside, outside = split(d, e, radius, near)
            if max(np.count_nonzero(inside[0]), np.count_nonzero(outside[0])) <= 0.9 * len(own):
                todo.append((own[inside[0]], asked[inside[1]]))
                todo.append((own[outside[0]], np.concatenate([asked[outside[1]], own[outside[2]]])))
                continue
        # a leaf, or a ball too dense to split: every query against every member, in blocks
        every = np.concatenate([own, asked])
        block = max(1, PAIRS // len(own))
        for at in range(0, len(every), block):
            part = every[at : at + block]
            i, j = np.nonzero(np.bitwise_count(prints[part][:, None] ^ prints[own][None, :]) <= near)
            forest.join(part[i], own[j])


def links(nodes: DataFrame, near: int = 2) -> DataFrame:
    """Links (u, v) that connect the rows of ``nodes`` (fingerprint long, node long) within ``near`` bits.

    The links join exactly what all pairs within ``near`` bits join, with fewer than one link for each row of each
    shard: a shard returns its links' spanning forest. The shards are the leaves of a vantage-point tree whose
    points and radii come from a bounded sample (``SAMPLE_EACH`` fingerprints a shard, ``MOST_SHARDS`` shards); a
    fingerprint goes to its own leaf and, as a query, to those leaves that may hold a partner beyond a border.
    """
    depth = max(0, int(np.ceil(np.log2(max(1, nodes.count() / SHARD)))))
    depth = min(depth, int(np.log2(MOST_SHARDS)))
    drawn = nodes.select("fingerprint").orderBy(F.xxhash64("fingerprint"), "fingerprint").limit(SAMPLE_EACH << depth) if depth else nodes.limit(0)
    tree = Tree(np.array([r[0] for r in drawn.select("fingerprint").collect()], np.int64).view(np.uint64), depth)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for leaf, members, queries in tree.route(prints, near):
                rows = pa.array(np.concatenate([members, queries]))
                own = np.arange(len(rows)) < len(members)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), leaf)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(own)], ["shard", "fingerprint", "node", "own"])

    def join(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node", ignore_index=True)  # so the smallest index of a component is its smallest node
        prints, own = group["fingerprint"].to_numpy(np.int64).view(np.uint64), group["own"].to_numpy(bool)
        forest = Forest(len(group))
        link(prints, np.flatnonzero(own), np.flatnonzero(~own), near, forest)
        moved = np.flatnonzero(forest.label != np.arange(len(group)))
        node = group["node"].to_numpy(np.int64)
        return pd.DataFrame({"u": node[moved], "v": node[forest.label[moved]]})

    dealt = nodes.select("fingerprint", "node").mapInArrow(deal, "shard long, fingerprint long, node long, own boolean")
    return dealt.groupBy("shard").applyInPandas(join, "u long, v long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", near: int = 2, shingle: int = 3) -> DataFrame:
    """One row (key, fingerprint, component_id) for each row of ``docs``; the class is named by its smallest key.

    Nulls and odd rows: a null or blank text has fingerprint 0 and links like any other. A row with a null key is
    returned with a null component and links nothing. Rows that repeat a key are one document with several
    fingerprints. Equal fingerprints are one node, so a group of copies costs one row beyond its first aggregate.
    An empty table gives an empty result. Other columns are not read, whatever their names.
    """
    prints = cut(fingerprints(docs, key, text, shingle).select(F.col(key).cast("long").alias("key"), "fingerprint"))
    nodes = cut(prints.where("key IS NOT NULL").groupBy("fingerprint").agg(F.min("key").alias("node")))
    # a key with several fingerprints links them: its other nodes hang on its rows
    repeated = prints.where("key IS NOT NULL").groupBy("key").agg(F.min("fingerprint").alias("a"), F.max("fingerprint").alias("b")).where("a <> b").select("key")
    own = prints.join(repeated, "key", "left_semi").join(nodes.select("fingerprint", "node"), "fingerprint").select(F.col("key").alias("u"), F.col("node").alias("v"))
    found = components(links(nodes, near).unionByName(own))
    named = nodes.join(found, "node", "left").select("fingerprint", F.coalesce("component", "node").alias("component_id"))
    out = prints.join(named, "fingerprint", "left")
    return out.select(F.col("key").alias(key), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), F.when(F.col("key").isNotNull(), F.col("component_id")).alias("component_id"))
