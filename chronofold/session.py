"""A session with the settings that the library's plans are made for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive execution splits hot join partitions and joins small ones; time zones and Arrow do not depend on the machine.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


def session(name: str = "chronofold", **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for key, value in (SETTINGS | more).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Limits of one Arrow batch that goes to Python, so that a worker's memory does not follow the partition's size.
ARROW_ROWS, ARROW_BYTES = 1000, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session by rows and bytes, for every operator alike.

    A plan reads these settings when it runs, so they stay set; smaller limits that the session has stay as they are.
    """
    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        own = spark.conf.get(f"spark.sql.execution.arrow.{name}").lower().removesuffix("b")
        size = int(own.rstrip("kmg")) << {"k": 10, "m": 20, "g": 30}.get(own[-1], 0)
        if not 0 < size <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))
