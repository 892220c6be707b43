"""Writers of the library's outputs. Spark's commit protocol makes each write whole or not there."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def log(ops: DataFrame, path: str, by: str = "law_year") -> None:
    """The operation log as Parquet, laws of a year together, so that a law's scan prunes files."""
    ops.withColumn(by, F.substring("law", 1, 4)).repartition(by, F.pmod(F.xxhash64("law"), F.lit(16))).sortWithinPartitions("law", "date").write.mode("overwrite").partitionBy(by).parquet(path)


def json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path, compression="gzip")


def recovered(rows: DataFrame, good: str, unresolved: str, reason: str = "reason") -> None:
    """Rows without a reason to one place, the others to another; a row goes to exactly one of them."""
    rows.where(F.col(reason).isNull()).drop(reason).write.mode("overwrite").parquet(good)
    rows.where(F.col(reason).isNotNull()).write.mode("overwrite").parquet(unresolved)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store it is."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def not_in_other_batches(rows: DataFrame, path: str, key: list[str], batch: str) -> DataFrame:
    """The rows whose key no batch but ``batch`` has under ``path``."""
    spark = rows.sparkSession
    if not exists(spark, path):
        return rows
    others = spark.read.parquet(path).where(F.col("batch").cast("string") != batch).select(*key).distinct()
    return rows.join(others, key, "left_anti")


def append_missing(rows: DataFrame, path: str, key: list[str], batch: str) -> int:
    """Writes the rows whose key no other batch has as a batch of their own, and says how many there are.

    A batch is a folder ``batch=<name>`` that Spark commits as a whole and a repeated run writes anew, so a job that
    failed or was retried leaves neither gaps nor repeats. Batches that run at the same time must not share keys.
    """
    own = f"{path}/batch={batch}"
    written = Observation()
    not_in_other_batches(rows, path, key, batch).observe(written, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(own)
    return written.get["n"]


def bucketed(rows: DataFrame, table: str, key: list[str], buckets: int, path: str | None = None) -> None:
    """A table whose files hold rows by the hash of ``key``, sorted: what groups or joins by it, with as many buckets, moves no row."""
    writer = rows.repartition(buckets, *key).write.mode("overwrite").bucketBy(buckets, *key).sortBy(*key)
    (writer if path is None else writer.option("path", path)).saveAsTable(table)


def histories(rows: DataFrame, path: str) -> None:
    """A JSON line for each provision's history, a folder for each law."""
    rows.write.mode("overwrite").partitionBy("law").json(path)


def history_index(rows: DataFrame) -> DataFrame:
    """One row (law, n_provisions, n_amended, n_hifi) for each law, the largest first."""
    return rows.groupBy("law").agg(F.count("*").alias("n_provisions"), F.count(F.when(F.size("versions") > 1, 1)).alias("n_amended"), F.count(F.when(F.col("fidelity") >= 0.98, 1)).alias("n_hifi")).orderBy(F.desc("n_provisions"), "law")
