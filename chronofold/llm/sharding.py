"""Sharding by jump consistent hashing: no ring table, and more shards take only the rows they need."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.llm._common import positions

#: Fixed values of the published algorithm: the multiplier of its generator, and the scale of its draws.
STEP, SCALE = 2862933555777941757, float(1 << 31)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key, from 0 to ``shards`` - 1 (Lamping and Veach 2014)."""
    state = keys.astype(np.uint64)
    shard, to = np.full(len(state), -1, np.int64), np.zeros(len(state), np.int64)
    moving = np.arange(len(state))
    while len(moving):
        shard[moving] = to[moving]
        state[moving] = state[moving] * np.uint64(STEP) + np.uint64(1)
        draw = (state[moving] >> np.uint64(33)).astype(np.float64) + 1
        to[moving] = ((shard[moving] + 1) * (SCALE / draw)).astype(np.int64)
        moving = moving[to[moving] < shards]
    return shard


def stable_key(key: Column) -> Column:
    """A non-negative 60-bit number from a key's text; a null counts as empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a key column as int."""
    if shards < 1:
        raise ValueError("there must be a shard")

    @F.pandas_udf("int")
    def of(hashed: pd.Series) -> pd.Series:
        return pd.Series(jump(hashed.to_numpy(np.int64), shards).astype(np.int32))

    return of(stable_key(key))


def place(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text", overhead: int = 16) -> DataFrame:
    """One row for each document: key, size, text_crc32, law, shard, slot, grown_shard.

    A row's shard follows from its key and the number of shards alone, so rows with one key share a shard, and with
    one shard more (``grown_shard``) rows move into the new shard only. ``size`` is the text's UTF-8 bytes (null:
    none) plus ``overhead``; ``text_crc32`` is null for a null text. ``slot`` numbers the rows of a shard from 0 in
    the order of key (null first), check sum and size; rows equal in all of these take neighbouring slots in either
    order. A null key is placed like empty text. Empty tables give no rows; other columns are not read.
    """
    rows = docs.select(
        F.col(key).alias("key"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"),
        F.crc32(F.col(text).cast("binary")).alias("text_crc32"),
    )
    rows = rows.withColumns({"shard": shard_of(F.col("key"), shards), "grown_shard": shard_of(F.col("key"), shards + 1)})
    placed = positions(rows, [F.col("shard"), F.col("key").asc_nulls_first(), F.col("text_crc32").asc_nulls_first(), F.col("size")], "slot")
    sizes = placed.groupBy("shard").agg(F.min("slot").alias("first"))  # a row for each shard
    out = placed.join(F.broadcast(sizes), "shard") if shards <= 1 << 16 else placed.join(sizes, "shard")
    return out.select(F.col("key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("slot") - F.col("first")).alias("slot"), "grown_shard")


#: The same in DuckDB's SQL over the view ``documents``: check sums by bytes, and the jumps of all rows step by step.
SQL = f"""
WITH RECURSIVE remainders AS (
  SELECT list(r ORDER BY n) AS tab FROM (
    SELECT n, list_reduce(range(8), lambda r, i: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, n) AS r FROM (SELECT unnest(range(256)) AS n))),
base AS (
  SELECT row_number() OVER () AS id, doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 16 AS size,
         CASE WHEN text IS NOT NULL THEN xor(list_reduce(
           list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT),
           lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) END AS text_crc32,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::HUGEINT AS key
  FROM documents, remainders),
jumps AS (
  SELECT id, shards, key AS state, -1::BIGINT AS shard, 0::BIGINT AS next FROM base, (SELECT unnest([40, 41]) AS shards)
  UNION ALL
  SELECT id, shards, drawn, next, floor((next + 1) * (2147483648.0::DOUBLE / ((drawn // 8589934592)::DOUBLE + 1)))::BIGINT
  FROM (SELECT id, shards, next, (state * {STEP} + 1) % 18446744073709551616 AS drawn FROM jumps WHERE next < shards)),
landed AS (SELECT id, shards, max(shard)::INTEGER AS shard FROM jumps GROUP BY id, shards),
placed AS (
  SELECT b.*, x.shard, y.shard AS grown_shard FROM base b JOIN landed x ON x.id = b.id AND x.shards = 40 JOIN landed y ON y.id = b.id AND y.shards = 41)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32 NULLS FIRST, size) - 1 AS slot, grown_shard
FROM placed
"""
