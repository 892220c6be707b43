"""Forms of operators that hold where one key has most of the rows: the same results as the plain ones, in bounded memory."""

import itertools
import random
import tracemalloc

import pytest
from chronofold.operators import fold, history

OPS = "law string, para string, act string, date string, change_type string, instruction string, new_text string, stream_rank int, line_no long, piece_no int"
STATUTE = "Tittel\n(1) Alfa en. Alfa to.\n(2) Beta en.\n(3) Gamma a) første b) andre"


def random_log(seed, n):
    rng = random.Random(seed)
    said = [
        ("change", "§ 1 skal lyde:", "§ 1. Ny  tekst {k}."), ("change", "§ 1 skal lyde:", " \t§ 1 a. Annen {k}"), ("repeal", "§ 1 oppheves", None), ("repeal", "§ 1 andre ledd oppheves", None),
        ("change", "§ 1 første ledd andre punktum skal lyde:", "Alfa {k}."), ("add", "§ 1 nytt tredje ledd skal lyde:", "(3) Nytt {k}"), ("change", "overskrift skal lyde", "§ 1. Hode"), ("add", "ny § 1 skal lyde:", "uten paragraf {k}"),
        ("renumber", "§ 1 blir § 2", None), (None, "noe", "§ 1. Uten type {k}"), ("repeal", None, "§ 1. x"), ("change", "§ 1 skal lyde:", "\x1c§ 1. Skilt\x1d tegn {k}"), ("move", "flyttes", "§ 4. Annen \x1f vei {k}"), ("change", "bokstav b skal lyde:", "b) {k}"), ("add", "§ 1", ""),
    ]
    rows = []
    for k in range(n):
        change, instruction, payload = rng.choice(said)
        rows.append((rng.choice(["L1", "L2", None]), rng.choice(["§1", "§1", "§2", "", None]), f"a{rng.randrange(3)}", rng.choice(["2001", "2002", "2003", "", None]), change, instruction, payload and payload.format(k=k), rng.randrange(2), k, 0))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_compacted_fold_is_the_fold(spark, seed):
    ops = spark.createDataFrame(random_log(seed, 120 if seed < 3 else 12), OPS)
    base = spark.createDataFrame([("L1", "§1", STATUTE), ("L2", "§2", "gammel"), ("L2", "§2", "eldre"), ("L3", "§9", "urørt"), (None, "§1", STATUTE), ("L1", "§7", None)], "law string, para string, text string")
    from chronofold.operators.oplog import as_of

    for date in (None, "2001", "2002"):
        want = sorted(map(repr, map(tuple, fold.provisions(fold.fold(base, as_of(ops, date))).collect())))
        assert sorted(map(repr, map(tuple, fold.state_at(base, ops, date).select("law", "para", "text").collect()))) == want


def test_compacted_fold_by_kind(spark):
    rng = random.Random(5)
    rows = [("L", f"§{rng.randrange(3)}", "a", f"200{rng.randrange(9)}", rng.choice(["replace", "add", "repeal", "subprovision", "other", None]), rng.choice(["§ 1 andre ledd oppheves", "i", None]), rng.choice(["tekst", STATUTE, "", None]), 0, k, 0) for k in range(40)]
    ops = spark.createDataFrame(rows, OPS.replace("change_type", "kind"))
    base = spark.createDataFrame([("L", "§1", STATUTE)], "law string, para string, text string")
    want = sorted(map(tuple, fold.provisions(fold.fold(base, ops, by_kind=True)).collect()))
    assert sorted(map(tuple, fold.state_at(base, ops, by_kind=True).select("law", "para", "text").collect())) == want


def test_hot_provision_of_a_million_operations(spark):
    """One provision has them all: overwrites are compacted in the tasks, and the edits behind the last one are streamed."""
    from pyspark.sql import functions as F

    n, last = 1_000_000, 980_000
    k = F.col("id")
    said = F.when(k <= last, F.lit("§ 1 skal lyde:")).otherwise(F.concat(F.lit("§ 1 andre ledd skal lyde:")))
    payload = F.when(k <= last, F.concat(F.lit("§ 1. Tittel "), k.cast("string"))).when(k < n - 50, F.lit(None).cast("string")).otherwise(F.lit("(2) x"))
    ops = spark.range(n).select(F.lit("L").alias("law"), F.lit("§1").alias("para"), F.lit("a").alias("act"), F.lit("2001").alias("date"), F.lit("change").alias("change_type"), said.alias("instruction"), payload.alias("new_text"), F.lit(0).alias("stream_rank"), k.alias("line_no"), F.lit(0).alias("piece_no"))
    base = spark.createDataFrame([("L", "§1", STATUTE)], "law string, para string, text string")
    assert [r["text"] for r in fold.state_at(base, ops).collect()] == [f"Tittel {last}"]


def test_as_of_with_most_rows_on_one_key(spark):
    """Nine tenths on one key over many ranges, versions only at some of them: the last one is carried through the others."""
    rng = random.Random(3)
    at = lambda: rng.randrange(1000)
    asked = [("hot" if k % 10 else rng.choice(["a", "b", None]), k, at()) for k in range(3000)] + [("hot", 5000 + k, 700) for k in range(300)]
    held = [("hot", f"v{k}", t) for k, t in enumerate([5, 5, 40, 41, 900])] + [(key, f"w{key}{t}", t) for key in ("a", None) for t in (100, 600)]
    q = spark.createDataFrame(asked, "key string, id int, t int").repartition(8)
    v = spark.createDataFrame(held, "key string, version string, starts int")
    want = []
    for key, k, t in asked:
        best = max(((s, name) for other, name, s in held if other == key and s <= t), default=(None, None))
        want.append((k, best[1]))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        found = history.as_of_join(q, v, ["key"], "t", "starts", ["version"])
        assert sorted((r["id"], r["version"]) for r in found.collect()) == sorted(want)
        assert found.columns == ["key", "id", "t", "version", "starts"]
        empty = history.as_of_join(q, v.where("false"), ["key"], "t", "starts", ["version"])
        assert {r["version"] for r in empty.collect()} == {None}
        assert history.as_of_join(q.where("false"), v, ["key"], "t", "starts", ["version"]).count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def table_steps(a, b):
    """The steps by the whole table of lengths."""
    start = len(list(itertools.takewhile(lambda p: p[0] == p[1], zip(a, b, strict=False))))
    x, y = a[start:], b[start:]
    size = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in reversed(range(len(x))):
        for j in reversed(range(len(y))):
            size[i][j] = size[i + 1][j + 1] + 1 if x[i] == y[j] else max(size[i + 1][j], size[i][j + 1])
    out, i, j = [("same", t) for t in a[:start]], 0, 0
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i] == y[j]:
            out.append(("same", x[i]))
            i, j = i + 1, j + 1
        elif j == len(y) or (i < len(x) and size[i + 1][j] >= size[i][j + 1]):
            out.append(("gone", x[i]))
            i += 1
        else:
            out.append(("new", y[j]))
            j += 1
    return out


def test_redline_steps_are_those_of_the_whole_table(monkeypatch):
    rng = random.Random(8)
    for trial in range(400):
        monkeypatch.setattr(history, "OFTEN", rng.choice([1, 3, 64]))
        letters = "abcdefghijklmnop"[: rng.choice([2, 3, 16])]
        a, b = ([rng.choice(letters) for _ in range(rng.randrange(40))] for _ in range(2))
        b = b if trial % 2 else [t for t in a if rng.random() < 0.8] + b[: trial % 5]
        assert history.longest_common(a, b) == table_steps(a, b)


def test_redline_of_a_hundred_thousand_words():
    rng = random.Random(9)
    a = [f"w{rng.randrange(20_000)}" for _ in range(100_000)]
    b = [t for t in a if rng.random() < 0.97]
    b[50_000:50_000] = [f"n{k}" for k in range(500)]
    tracemalloc.start()
    steps = history.longest_common(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [t for op, t in steps if op != "new"] == a
    assert [t for op, t in steps if op != "gone"] == b
    assert peak < 200 << 20


def test_state_moves_each_text_twice_at_most(spark):
    """An exchange for the log's first rows, one for whole texts and one for edits; nothing is written in between, no snapshot or recovery moves the log."""
    from chronofold.plans.reconstruct import state

    raw = spark.createDataFrame(
        [("a1", "L", "§ 1", "change", "§ 1 andre ledd skal lyde:", "(2) Ny en.", "2001", None, None, 0, 1), ("a2", "L", "§ 2", "change", "§ 2 skal lyde:", "§ 2. Ny", "2002", None, None, 0, 2), ("a3", None, "§ 1", "change", "§ 1 skal lyde:", "§ 1. Uten lov", "2002", None, None, 0, 3)],
        "act_refid string, target_law string, paragraph string, change_type string, instruction string, new_text string, date_in_force_resolved string, date_in_force string, target string, stream_rank int, line_no long",
    )
    bases = spark.createDataFrame([("L", "§1", STATUTE, None), ("L", "§2", "gammel", None), ("L", "§3", "urørt", None), (None, "§4", "uten lov", None)], "law string, para string, text string, base_as_of string")
    made = state(bases, [raw])
    got = {(r["law"], r["para"]): r["text"] for r in made.collect()}
    assert got == {("L", "§1"): STATUTE.replace("(2) Beta en.", "(2) Ny en."), ("L", "§2"): "Ny", ("L", "§3"): "urørt", (None, "§1"): "Uten lov", (None, "§4"): "uten lov"}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1  # edits and what they are applied to
    assert "checkpoint" not in made._jdf.queryExecution().toRdd().toDebugString().lower()
