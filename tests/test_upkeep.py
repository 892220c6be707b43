"""Sinks that go on after a kill, results that are kept up to date, and guards inside plans."""

import json
import os

import pytest
from chronofold.operators import fold, segment
from chronofold.plans import refresh
from chronofold.sources import readers, writers
from chronofold.streaming import page_sink
from pyspark.sql import functions as F

OPS = "law string, para string, act string, date string, change_type string, instruction string, new_text string, stream_rank int, line_no long, piece_no int"


def lines(*pages, broken=()):
    return "\n".join([json.dumps({"urn": u, "page": p, "text": t}) for u, p, t in pages] + list(broken))


def test_harvest_goes_on_after_a_kill(spark, tmp_path, monkeypatch):
    source, folder = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "1.jsonl").write_text(lines(("u", 1, "en"), ("u", 2, ""), ("u", 2, "to"), broken=['{"urn": "u", "pa']), "utf-8")
    (source / "2.jsonl").write_text(lines(("u", 2, "igjen"), ("u", 3, "tre"), broken=['{"urn": "u"}', "[]"]), "utf-8")
    os.utime(source / "1.jsonl", (1, 1))
    os.utime(source / "2.jsonl", (2, 2))
    real, done = page_sink.write_batch, []

    def killed(rows, where, batch):
        out = real(rows, where, batch)
        done.append(batch)
        if batch == 1 and done.count(1) == 1:
            raise RuntimeError("killed after the write, before the stream knows")
        return out

    monkeypatch.setattr(page_sink, "write_batch", killed)
    with pytest.raises(Exception, match="killed"):
        page_sink.harvest(spark, str(source), folder, files=1).awaitTermination()
    page_sink.harvest(spark, str(source), folder, files=1).awaitTermination()
    (source / "3.jsonl").write_text(lines(("u", 3, "sen"), ("v", 1, "")), "utf-8")
    page_sink.harvest(spark, str(source), folder, files=1).awaitTermination()
    assert done == [0, 1, 1, 2]
    pages = spark.read.parquet(f"{folder}/pages")
    assert sorted((r["urn"], r["page"], r["text"], r["batch"]) for r in pages.collect()) == [("u", 1, "en", 0), ("u", 2, "to", 0), ("u", 3, "tre", 1), ("v", 1, "", 2)]
    dead = spark.read.parquet(f"{folder}/dead")
    assert sorted((r["batch"], r["line"], r["reason"]) for r in dead.collect()) == [(0, '{"urn": "u", "pa', "no-json"), (1, "[]", "no-json"), (1, '{"urn": "u"}', "no-page")]
    assert sorted(map(tuple, page_sink.progress(spark, folder).collect())) == [(0, 4, 1, 2, 0), (1, 4, 2, 1, 0), (2, 2, 0, 1, 1)]


def ops_of(spark, rows):
    return spark.createDataFrame([(law, para, "", f"200{k}", change, "i", text, 0, k, 0) for k, (law, para, change, text) in enumerate(rows)], OPS)


def files_of(folder):
    return {f"{part}/{name}" for part in os.listdir(f"{folder}/state") if part.startswith("part=") for name in os.listdir(f"{folder}/state/{part}") if name.endswith(".parquet")}


def test_only_stale_laws_are_folded_again(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "kept")
    base = spark.createDataFrame([(f"L{k}", "§1", f"base {k}") for k in range(20)], "law string, para string, text string")
    rows = [(f"L{k}", "§2", "change", f"§ 2. ny {k}") for k in range(0, 20, 2)]

    def check(b, o):
        want = sorted(map(tuple, fold.provisions(fold.fold(b, o)).collect()))
        assert sorted(map(tuple, refresh.state(spark, folder).collect())) == want

    assert refresh.refresh(spark, base, ops_of(spark, rows), folder, 8)["stale"] == 20
    check(base, ops_of(spark, rows))
    before = files_of(folder)
    assert refresh.refresh(spark, base, ops_of(spark, rows[::-1]), folder, 8)["stale"] in (0, 10)  # an order of its own is a change of line numbers
    more = [*rows[::-1], ("L3", "§1", "repeal", None), ("L4", "§2", "change", "§ 2. enda nyere"), ("X", "§1", "add", "§ 1. ny lov")]
    before = files_of(folder)
    folded = []
    real = fold.state_at
    monkeypatch.setattr(fold, "state_at", lambda b, o, *rest: folded.append({r["law"] for r in o.select("law").distinct().collect()}) or real(b, o, *rest))
    done = refresh.refresh(spark, base, ops_of(spark, more), folder, 8)
    assert done["stale"] == 3 and folded == [{"L3", "L4", "X"}]
    check(base, ops_of(spark, more))
    touched = {f"part={r['p']}" for r in spark.createDataFrame([("L3",), ("L4",), ("X",)], "law string").select(F.pmod(F.xxhash64("law"), F.lit(8)).alias("p")).collect()}
    after = files_of(folder)
    assert {f for f in before if f.split("/")[0] not in touched} == {f for f in after if f.split("/")[0] not in touched} != set()
    assert not {f for f in before if f.split("/")[0] in touched} & after
    # a law that is gone goes from the state, also where its part has no other
    gone = base.where("law = 'L0'")
    refresh.refresh(spark, gone, ops_of(spark, []), folder, 8)
    check(gone, ops_of(spark, []))
    assert refresh.refresh(spark, gone, ops_of(spark, []), folder, 8) == {"stale": 0, "parts": 0, "run": 5}


def test_a_fabricated_body_fails_the_build(spark, tmp_path):
    texts = spark.createDataFrame([("L", "§ 1. En\nto\n§ 2. Tre")], "law string, text string")
    marks = spark.createDataFrame([("L", "§1", 1), ("L", "§2", 3)], "law string, para string, line int")
    good = segment.sliced_provisions(texts, marks, ["law"])
    segment.guarded(good, ["law"]).write.parquet(str(tmp_path / "good"))
    assert spark.read.parquet(str(tmp_path / "good")).count() == 2
    bad = good.withColumn("verbatim", F.col("para") != "§2")
    with pytest.raises(Exception, match="not in its source: L §2"):
        segment.guarded(bad, ["law"]).write.parquet(str(tmp_path / "bad"))
    assert not [f for f in os.listdir(tmp_path / "bad") if f.endswith(".parquet") or f == "_SUCCESS"] if (tmp_path / "bad").exists() else True


def test_bucketed_tables_are_folded_where_they_are(spark, tmp_path):
    key = ["law", "para"]
    base = spark.createDataFrame([(f"L{k % 7}", f"§{k}", f"base {k}") for k in range(40)], "law string, para string, text string")
    ops = ops_of(spark, [(f"L{k % 7}", f"§{k % 50}", "change", f"§ {k}. ny {k}") for k in range(90)])
    for name, rows in (("base_by_key", base), ("log_by_key", ops)):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        writers.bucketed(rows, name, key, 4, str(tmp_path / name))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        folded = fold.fold(spark.table("base_by_key"), spark.table("log_by_key"), keyed=True)
        plan = folded._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        assert sorted(map(tuple, fold.provisions(folded).collect())) == sorted(map(tuple, fold.provisions(fold.fold(base, ops)).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 << 20))
        for name in ("base_by_key", "log_by_key"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_broken_lines_go_to_the_dead_letters(spark, tmp_path):
    (tmp_path / "o.jsonl").write_text('{"act_refid": "lov/2001-01-01-1", "target_law": "lov/1999-01-01-1"}\n{"broken', "utf-8")
    good, dead = readers.op_lines(spark, str(tmp_path / "o.jsonl"), 3)
    assert good.count() == 1
    assert [(r["stream_rank"], r["line"]) for r in dead.collect()] == [(3, '{"broken')]


@pytest.mark.parametrize(("answer", "urn"), [
    ('{"a": {"b": "URN:NBN:1"}, "c": "URN:NBN:2"}', "URN:NBN:1"), ('{"z": "x URN:NBN:0", "URN:NBN:k": {"y": ["URN:NBN:l", {"d": "\\u0055RN:NBN:3"}]}}', "URN:NBN:3"), ("[]", None), ('{"a": "URN:NBN:', None), (None, None), ('"URN:NBN:4"', "URN:NBN:4"),
])
def test_first_urn_walks_the_document(answer, urn):
    assert readers._first_urn(answer) == urn
