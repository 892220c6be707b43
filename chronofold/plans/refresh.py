"""The state of all laws as a table that is kept up to date: only laws whose log or base changed are folded again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.operators import fold
from chronofold.operators.numbering import kept
from chronofold.sources.writers import exists

#: Folders that laws are dealt out to; a folder with a changed law is written anew, its other laws' rows as they are.
PARTS = 64


def digests(bases: DataFrame, ops: DataFrame) -> DataFrame:
    """Rows (law, digest): sums of two hashes of a law's rows and their number, whatever their order, summed in the tasks first."""

    def hashed(rows: DataFrame, kind: str) -> DataFrame:
        columns = sorted(c for c in rows.columns if c != "law")
        # a null is not skipped: it would hash as if the column were not there
        values = [F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), F.lit(kind)]
        return rows.select("law", F.xxhash64(*values).alias("h"), F.xxhash64(F.lit("second"), *values).alias("g"))

    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).cast("string")
    both = hashed(bases, "base").unionByName(hashed(ops, "op"))
    return both.where("law IS NOT NULL").groupBy("law").agg(F.concat_ws(":", total("h"), total("g"), F.count("*").cast("string")).alias("digest"))


def refresh(spark: SparkSession, bases: DataFrame, ops: DataFrame, folder: str, parts: int = PARTS) -> dict[str, int]:
    """Brings ``folder``/state, rows (law, para, text, part), up to the bases (law, para, text) and the log; says what was done.

    ``folder``/digests has what each law was folded from. Laws that are new, changed or gone are stale, and only the
    parts that hold one are written, by dynamic overwrite; in these, other laws keep their rows. Digests are written after
    the state, under a name of their own, so a run that was killed between the two does its work again. A folder is
    written by one run at a time. ``parts`` stays what it was when the folder began.
    """
    state, known = f"{folder}/state", f"{folder}/digests"
    now = kept(digests(bases, ops))
    last = _last(spark, known)
    before = spark.read.parquet(f"{known}/run={last}") if last is not None else now.where("false")
    apart = now.withColumnRenamed("digest", "new").join(before.withColumnRenamed("digest", "old"), "law", "full_outer").where(~F.col("new").eqNullSafe(F.col("old")))
    part = F.pmod(F.xxhash64("law"), F.lit(parts)).cast("int")
    stale = kept(apart.select("law", part.alias("part")))
    touched = stale.select("part").distinct()
    laws = stale.select("law")
    folded = fold.state_at(bases.join(laws, "law", "left_semi"), ops.join(laws, "law", "left_semi")).withColumn("part", part)
    changed = sorted(r["part"] for r in touched.collect())  # at most ``parts``
    if changed:
        out = folded
        if last is not None and exists(spark, state):
            out = out.unionByName(spark.read.parquet(state).where(F.col("part").isin(changed)).join(laws, "law", "left_anti").select("law", "para", "text", "part"))
        out = kept(out)  # read before its parts are written
        # a part that lost its last row would not be overwritten: it keeps one row without a law, which readers leave out
        left = out.select("part").distinct()
        empty = touched.join(left, "part", "left_anti").select(*(F.lit(None).cast("string").alias(c) for c in ("law", "para", "text")), "part")
        out.unionByName(empty).repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(state)
    now.write.mode("overwrite").parquet(f"{known}/run={(last or 0) + 1}")
    return {"stale": stale.count(), "parts": len(changed), "run": (last or 0) + 1}


def state(spark: SparkSession, folder: str) -> DataFrame:
    """The rows (law, para, text) that ``refresh`` keeps."""
    return spark.read.schema("law string, para string, text string, part int").parquet(f"{folder}/state").where("law IS NOT NULL").select("law", "para", "text")


def _last(spark: SparkSession, known: str) -> int | None:
    """The newest finished run."""
    if not exists(spark, known):
        return None
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(known)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    runs = [f.getPath() for f in files.listStatus(path)]
    done = [int(p.getName().split("=")[1]) for p in runs if p.getName().startswith("run=") and exists(spark, f"{known}/{p.getName()}/_SUCCESS")]
    return max(done, default=None)
