"""Pages from files into a table as they come, so that a run that was killed goes on where it was.

A batch is a set of new files. Its pages, its broken lines and its counts are each a folder of their own, named by the
batch, which a repeated batch writes anew; the stream's checkpoint names the batch to go on with. So every page is there
once, however often a run is killed, and no line is lost without a trace.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chronofold.operators import oplog
from chronofold.sources import writers

LINE = "urn string, page int, text string, _broken string"


def parsed(lines: DataFrame) -> DataFrame:
    """Lines (value) as (urn, page, text, line, reason): the reason is null for a page, else why the line is none."""
    row = F.from_json("value", LINE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    rows = lines.select(row.alias("r"), F.col("value").alias("line"))
    reason = F.when(F.col("r").isNull() | F.col("r._broken").isNotNull(), "no-json").when(F.col("r.urn").isNull() | F.col("r.page").isNull(), "no-page")
    return rows.select("r.urn", "r.page", F.coalesce("r.text", F.lit("")).alias("text"), "line", reason.alias("reason"))


def write_batch(lines: DataFrame, folder: str, batch: int) -> dict[str, int]:
    """One batch of lines into ``folder``: pages, dead letters and progress; the counts are those seen while it was written.

    A page that another batch has is not written again; of a page that a batch has twice a text with letters holds, then
    the least. The progress of a batch is written last, so a batch without it was not finished.
    """
    spark = lines.sparkSession
    seen, out = Observation(f"in-{batch}"), Observation(f"out-{batch}")
    rows = parsed(lines).observe(seen, F.count(F.lit(1)).alias("lines"), F.count("reason").alias("dead"))
    rows.where("reason IS NOT NULL").select("line", "reason").write.mode("overwrite").parquet(f"{folder}/dead/batch={batch}")
    pages = oplog.keep_first(parsed(lines).where("reason IS NULL").select("urn", "page", "text"), ["urn", "page"], [F.trim("text") == "", F.col("text")])
    new = writers.not_in_other_batches(pages, f"{folder}/pages", ["urn", "page"], str(batch)).observe(out, F.count(F.lit(1)).alias("pages"), F.count(F.when(F.trim("text") == "", 1)).alias("empty"))
    new.write.mode("overwrite").parquet(f"{folder}/pages/batch={batch}")
    counts = {"batch": batch, **seen.get, **out.get}
    spark.createDataFrame([tuple(counts.values())], ", ".join(f"{c} long" for c in counts)).write.mode("overwrite").json(f"{folder}/progress/batch={batch}")
    return counts


def harvest(spark: SparkSession, source: str, folder: str, files: int | None = None) -> StreamingQuery:
    """Starts taking in all files of ``source`` that are new, ``files`` of them a batch; ends when there are none left."""
    reader = spark.readStream.format("text")
    lines = (reader if files is None else reader.option("maxFilesPerTrigger", files)).load(source)

    def each(batch: DataFrame, number: int) -> None:
        write_batch(batch, folder, number)

    return lines.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def progress(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (batch, lines, dead, pages, empty) of the batches that were finished."""
    return spark.read.schema("batch long, lines long, dead long, pages long, empty long").json(f"{folder}/progress/*")
