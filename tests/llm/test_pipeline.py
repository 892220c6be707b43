"""The pipeline against a plain version of each stage, over the stage's own input."""

import random

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from chronofold.llm import mixing, quality

from tests.llm.test_jaccard import brute


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgé") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    rows, labels = [], []
    for k in range(260):
        good = rng.random() < 0.75
        if rows and rng.random() < 0.3:
            text = rng.choice(rows)[1]
            if rng.random() < 0.5:
                text += " " + rng.choice(words)
            good = "***" not in text
        else:
            text = " ".join(rng.choice(words) + ("" if good else "***") for _ in range(rng.randrange(8, 160)))
        rows.append((k, text, "en", "hot" if rng.random() < 0.5 else f"s{rng.randrange(4)}", len(text)))
        labels.append((k, int(good), 0))
    rows += [(900, "", "en", "s1", 0), (901, None, None, None, None), (None, "lost id " * 9, "de", "s2", 72), (5, *rows[5][1:]), (6, "another text of the same id " * 4, "fr", "s3", 9)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_match_plain_versions(spark, folder, tmp_path, monkeypatch):
    monkeypatch.setattr(quality, "STEPS", 120)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    held = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        held.append([tuple(r) for r in docs.collect()])
        columns = docs.columns
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 3:
            assert docs.columns == columns
    first, second, third, fourth = held

    net = quality.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))

    def good(text):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        return quality.score(net, net.pairs(), raw, np.array([0, len(raw)]))[0] >= 0.5

    assert sorted(second, key=str) == sorted((r for r in first if good(r[1])), key=str)
    assert 0 < len(second) < len(first)

    kept = {k for k, c in brute([(r[0], r[1]) for r in second]).items() if k == c}
    assert {r[0] for r in third} == kept | ({None} if any(r[0] is None for r in second) else set())
    assert set(third) <= set(second) and len({r[0] for r in third}) == len(third) < len(second)

    documents = spark.createDataFrame(third, "doc_id long, text string, lang string, source string, n_chars long").toPandas()
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    uses = duckdb.sql(f"SELECT CAST(doc_id AS BIGINT), count(*) FROM ({mixing.SQL}) GROUP BY 1").fetchall()
    got = {}
    for r in fourth:
        got[r[0]] = got.get(r[0], 0) + 1
    assert got == dict(uses)

    from chronofold.llm import packing

    encoder = packing.Encoder(*packing.default_vocabulary())
    tokens = sum(len(encoder.ids(r[1] or "")) // 4 + 1 for r in fourth)
    pieces = docs.toPandas()
    assert pieces.length.sum() == tokens and (pieces.groupby("sequence_id").length.sum() <= 2048).all()
    assert sorted(set(pieces.doc_id.dropna())) == sorted({r[0] for r in fourth} - {None})


def test_run_is_the_stages_in_a_row(spark, folder, monkeypatch):
    monkeypatch.setattr(quality, "STEPS", 120)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "simhash near-dedup", "mixing sources to target weights", "packing"]
    rows = corpus_pipeline.run(spark, folder)
    assert rows.count() > 0 and {"doc_id", "sequence_id", "ids_crc32"} <= set(rows.columns)


def test_empty_documents(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
