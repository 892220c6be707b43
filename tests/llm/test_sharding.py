import zlib

import duckdb
import numpy as np
import pandas as pd
from chronofold.llm import sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, slot string, tie int"


def plain_jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", 1, 2, "x", 3) for k, t in rows], SCHEMA)


def test_jump_matches_the_loop_and_moves_only_to_the_new_shard():
    keys = np.random.default_rng(1).integers(0, 1 << 60, 2000, dtype=np.uint64)
    for n in (1, 2, 39, 40, 41):
        assert list(sharding.jump(keys, n)) == [plain_jump(int(k), n) for k in keys]
    before, after = sharding.jump(keys, 40), sharding.jump(keys, 41)
    assert set(after[before != after]) == {40} and 20 < (before != after).sum() < 90


ROWS = [(k, f"text é {k % 7}") for k in range(500)] + [(None, "n"), (None, None), (7, "text é 0"), (7, None), (7, ""), (3, "x" * 9000)] + [(77, "same")] * 50


def test_matches_sql(spark):
    documents = pd.DataFrame(ROWS, columns=["doc_id", "text"])  # noqa: F841
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    want = duckdb.sql("SELECT doc_id, size, text_crc32, law, shard, slot, grown_shard FROM (" + sharding.SQL + ")").fetchall()
    assert sorted(map(tuple, sharding.place(frame(spark, ROWS)).collect()), key=str) == sorted(want, key=str)


def test_columns_and_law(spark):
    got = sharding.place(frame(spark, ROWS)).toPandas()
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert got.groupby("doc_id").shard.nunique().max() == 1
    assert ((got.grown_shard == got.shard) | (got.grown_shard == 40)).all()
    row = got[(got.doc_id == 3) & (got["size"] == 9016)].iloc[0]
    assert row.text_crc32 == zlib.crc32(b"x" * 9000)
    assert sharding.place(frame(spark, [])).count() == 0
