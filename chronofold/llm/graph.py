"""Connected components of an edge table, by alternating star contractions over DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.llm._common import cut


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Rows (node, component) for every node of ``edges``; a component is named by its smallest node.

    Alternates the large-star and small-star steps of the published MapReduce method (Kiveris et al. 2014) until
    every component is a star around its smallest node; every step is an aggregate by node with map-side minima and one
    join, so neither a node's links nor a component ever meet in one task's memory, and no row reaches the driver but one
    flag. Edges with a null end are ignored. An edge from a node to itself only makes that node known.
    """
    known = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    links = cut(known.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    loops = links.where("u = v").select(F.col("u").alias("node"))
    links = links.where("u > v")
    while not _stars(links):
        links = cut(_small_star(_large_star(links)))
    named = _both_ends(links, F.col("v"), F.col("v")).select("node", F.col("x").alias("component"))
    return named.unionByName(loops.select("node", F.col("node").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))


def _both_ends(links: DataFrame, larger: Column, smaller: Column) -> DataFrame:
    """Rows (node, x) for both ends of every link, with ``larger`` and ``smaller`` as x; links are read once."""
    ends = F.array(F.struct(F.col("u").alias("node"), larger.alias("x")), F.struct(F.col("v").alias("node"), smaller.alias("x")))
    return links.select(F.inline(ends))


def _stars(links: DataFrame) -> bool:
    """Whether no node has two smaller neighbours, or both a smaller and a larger one: then no step changes a link."""
    held = _both_ends(links, F.lit(1), F.lit(0)).groupBy("node").agg(F.sum("x").alias("smaller"), F.min("x").alias("least"))
    return not held.agg(F.max((F.col("smaller") > 1) | ((F.col("smaller") > 0) & (F.col("least") == 0)))).first()[0]


def _parents(links: DataFrame) -> DataFrame:
    """Every node's smallest neighbour, where that is smaller than itself."""
    return links.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour or itself instead."""
    least = _parents(links).withColumnRenamed("u", "v")
    return links.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the node's smallest neighbour."""
    moved = links.join(_parents(links), "u")
    return _both_ends(moved, F.col("m"), F.col("m")).select(F.col("node").alias("u"), F.col("x").alias("v")).where("u > v").distinct()
