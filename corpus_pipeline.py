"""The corpus pipeline: documents are scored, deduplicated, mixed and packed, each stage over what the last one kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from chronofold.llm import jaccard, mixing, packing, quality
from chronofold.llm._common import bounded_batches, cut, fresh
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier scores 0.5 or more.

    A null text is scored as an empty one; equal texts score alike, so repeated rows stay or go together; a row without
    an id is scored like any other and teaches nothing. Without labels all stay or all go. Empty tables give no rows.
    """
    net = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    to = fresh(docs, "score")
    return quality.scored(docs, net, to=to).where(F.col(to) >= 0.5).drop(to)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id; rows without an id stay.

    Near duplicates have a Jaccard similarity of 0.8 or more over five-word shingles: operator 4's fingerprints and
    vantage-point trees propose pairs, and an exact join completes them. Null and blank texts are one group. Of rows
    that repeat an id the least by its other columns, in their order, stays. Empty tables give no rows.
    """
    found = cut(jaccard.near_duplicates(docs, least=0.8, shingle=5).where("doc_id IS NOT NULL"))
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("node")).distinct()
    twice = found.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("node"))
    node = fresh(docs, "node_id")
    kept = jaccard.chosen(docs.withColumn(node, F.col("doc_id").cast("long")), gone, "left_anti", node)
    twice = jaccard.ready(twice.withColumnRenamed("node", node))
    rest = [c for c in docs.columns if c != "doc_id"]
    once = kept.join(twice, node, "left_anti").select(docs.columns)
    least = kept.join(twice, node, "left_semi").groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("row"))
    return once.unionByName(least.select("doc_id", *(F.col("row")[c].alias(c) for c in rest)).select(docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, each as often as the mixture uses it.

    A null source is a source of its own; null and empty texts have no words and take no part of a budget; repeated
    rows are used each. Empty tables give no rows.
    """
    return mixing.realise(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences with their ids, and a check sum of these beside them.

    A null or empty text is its end id alone; repeated rows are packed as often as they come; a null id stays null.
    """
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_filter),
    ("simhash near-dedup", near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack),
]

#: Neither the classifier nor the tokenizer can be said in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared checkpoint folder and read again."""
    import tempfile

    bounded_batches(spark)
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = f"{shared or tempfile.mkdtemp(prefix='chronofold-')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
