"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Limits of one Arrow batch that goes to Python, so that a worker's memory does not follow the partition's size.
ARROW_ROWS = 1000
ARROW_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session by rows and bytes, for every operator alike.

    A plan reads these settings when it runs, so they stay set; smaller limits that the session has stay as they are.
    """
    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        own = spark.conf.get(f"spark.sql.execution.arrow.{name}").lower().removesuffix("b")
        size = int(own.rstrip("kmg")) << {"k": 10, "m": 20, "g": 30}.get(own[-1], 0)
        if not 0 < size <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the reliable checkpoint folder, which survives lost executors.

    The folder is the session's ``spark.checkpoint.dir``. Where that is unset, a local master gets a temporary
    folder, and any other master is an error, as its machines would not see each other's files.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="chronofold-"))
    return df.checkpoint()


def utf8(text: Column | str) -> Column:
    """A string column as its UTF-8 bytes, so that Arrow hands Python one buffer and no string objects."""
    return (F.col(text) if isinstance(text, str) else text).cast("binary")


def blob_values(column: pa.Array) -> list[bytes]:
    """The values of a binary Arrow column, a null as empty."""
    return [v if v is not None else b"" for v in column.to_pylist()]


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary Arrow column end to end, and the n + 1 offsets of its values (a null is empty)."""
    column = column.fill_null(b"") if column.null_count else column
    if pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def columns_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The non-empty batches."""
    for batch in batches:
        if batch.num_rows:
            yield batch


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    name, taken = stem, {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def positions(df: DataFrame, order: list[Column], to: str) -> DataFrame:
    """``df`` with its rows' gapless places from 0 in the order of ``order`` as column ``to``, all by DataFrame operations.

    ``df`` should be narrow: it is kept, dealt out by range (a row number breaks ties, so equal rows do not meet
    in one task), sorted within the ranges and kept again. Only one count for each range reaches a window.
    """
    tie, row, part = (fresh(df, c) for c in ("tie", "row", "part"))
    df = cut(df.withColumn(tie, F.monotonically_increasing_id()))
    spread = df.repartitionByRange(*order, F.col(tie)).sortWithinPartitions(*order, F.col(tie))
    held = cut(spread.withColumn(row, F.monotonically_increasing_id()).drop(tie))
    # the id holds the partition in its upper 31 bits and the place in it in the lower 33
    held = held.withColumn(part, F.shiftright(row, 33)).withColumn(row, F.col(row).bitwiseAND(F.lit((1 << 33) - 1)))
    return held.join(F.broadcast(starts(held, part, to, F.lit(1))), part).withColumn(to, F.col(to) + F.col(row)).drop(part, row)


def starts(df: DataFrame, part: str, to: str, amount: Column) -> DataFrame:
    """The sum of ``amount`` over the parts before each part: a row for each partition, which bounds its size."""
    from pyspark.sql import Window

    sums = df.groupBy(part).agg(F.sum(amount).alias(to))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn(to, F.coalesce(F.sum(to).over(before), F.lit(0)).cast("long"))


def running(df: DataFrame, order: list[Column], amount: str, to: str) -> DataFrame:
    """``df`` with the sum of ``amount`` over all rows before each row in the order of ``order`` as column ``to``.

    As ``positions``, but within a range the sum is a window over that range, which the range's size bounds.
    """
    from pyspark.sql import Window

    tie, row, part = (fresh(df, c) for c in ("tie", "row", "part"))
    df = cut(df.withColumn(tie, F.monotonically_increasing_id()))
    spread = df.repartitionByRange(*order, F.col(tie)).sortWithinPartitions(*order, F.col(tie))
    held = cut(spread.withColumn(row, F.monotonically_increasing_id()).drop(tie)).withColumn(part, F.shiftright(row, 33))
    before = Window.partitionBy(part).orderBy(row).rowsBetween(Window.unboundedPreceding, -1)
    summed = held.withColumn(fresh(df, "inner"), F.coalesce(F.sum(amount).over(before), F.lit(0)))
    out = summed.join(F.broadcast(starts(held, part, to, F.col(amount))), part)
    return out.withColumn(to, F.col(to) + F.col(fresh(df, "inner"))).drop(part, row, fresh(df, "inner"))
