import ast
import itertools
import pathlib
import random

import chronofold
import pytest
from chronofold.core import wording
from chronofold.core.replay import outcome
from chronofold.evaluate import score
from chronofold.operators import align, fold, history, numbering, oplog, register, segment
from chronofold.plans.reconstruct import reconstruct
from chronofold.sources import readers, writers
from pyspark.sql import functions as F

RAW = "act_refid string, target_law string, paragraph string, target string, change_type string, instruction string, new_text string, date_in_force_resolved string, date_in_force string, stream_rank int, line_no int"


def raw(spark, rows):
    """rows: (act, law, para, change, instruction, text, date, rank)."""
    return spark.createDataFrame([(a, law, p, None, c, i, n, d, None, rank, k) for k, (a, law, p, c, i, n, d, rank) in enumerate(rows)], RAW)


def state(df):
    return {(r["law"], r["para"]): r["text"] for r in df.collect()}


def test_fold_is_the_sequential_replay(spark):
    rng = random.Random(3)
    statute = "T\n(1) A one. A two.\n(2) B."
    base = [("L", f"§{k}", rng.choice([statute, "plain"])) for k in range(1, 6)]
    kinds = [("change", "skal lyde:", "§ {p}. New {k}."), ("repeal", "oppheves", None), ("repeal", "andre ledd oppheves", None), ("add", "ny skal lyde:", "bare {k}"), ("change", "første ledd første punktum skal lyde:", "Changed {k}."), ("renumber", "blir", None)]
    ops = []
    for k in range(60):
        p, (change, said, new) = rng.randrange(1, 8), rng.choice(kinds)
        ops.append((f"2000-01-01-{k}", "L", f"§ {p}", change, f"§ {p} {said}", new and new.format(p=p, k=k), rng.choice([None, "2001-01-01", "2002-01-01", "2003-01-01"]), 1))
    doc, flags = {p: x for _, p, x in base}, []
    for act, _, p, change, said, new, date, _ in sorted(ops, key=lambda o: (o[6] or "", o[0])):
        if date and date > "2002-06-01":
            continue
        p = p.replace(" ", "")
        text, why = outcome(doc.get(p), p, change, said, new)
        flags += [(p, why)] if why is not None else []
        doc.pop(p, None)
        if text is not None:
            doc[p] = text
    bases = spark.createDataFrame([(*b, None) for b in base], "law string, para string, text string, base_as_of string")
    provisions, flagged = reconstruct(bases, [raw(spark, ops)], "2002-06-01", recovery=2)
    assert state(provisions) == {("L", p): x for p, x in doc.items()}
    assert sorted((r["para"], r["why"]) for r in flagged.collect()) == sorted(flags)
    # whole-provision operations alone need no log in one place
    whole = [o for o in ops if o[3] in ("repeal",) and "ledd" not in o[4] or o[5] and o[5].startswith("§")]
    log = oplog.load(raw(spark, whole), 2)
    quick = fold.whole_state(log.withColumn("body", F.regexp_replace("new_text", r"^§ \d+\. ", "")), ["law", "para"], oplog.order_struct(), F.col("change_type") == "change", F.lit(False), F.col("change_type") == "repeal", "body", bases.select("law", "para", F.col("text").alias("body")))
    slow, _ = reconstruct(bases, [raw(spark, whole)], recovery=2)
    assert {(r["law"], r["para"]): r["body"] for r in quick.collect()} == state(slow)


def test_log_algebra(spark):
    ops = [
        ("a1", "L", "§ 1", "change", "i", "first", "2001", 1), ("a1", "L", "§ 1", "change", "i", "second", "2001", 2), ("a2", "L", "§ 1", "change", "r", "dropped", "1985", 4), ("a2", "L", "§ 2", "change", "r", "kept", "1985", 4),
        ("a3", "L", None, "unknown", "no id", "text", None, 4), ("a4", "L", None, "add", "Kapittel 2 skal lyde", "§ 3. En.\njf. § 9. x\n§ 4 a. To.", "2002", 1), ("a5", "L", None, "add", "k", "Kapittel 3 Navn § 5. Tre. § 6. Fire se § 7 her.", "2003", 1),
    ]
    got = sorted((r["act"], r["para"], r["new_text"]) for r in oplog.load(raw(spark, ops), 4).collect() if r["para"])
    assert got == [("a1", "§1", "first"), ("a2", "§2", "kept"), ("a4", "§3", "§ 3. En.\njf. § 9. x"), ("a4", "§4a", "§ 4 a. To."), ("a5", "§5", "§ 5. Tre."), ("a5", "§6", "§ 6. Fire se § 7 her.")]
    assert oplog.load(raw(spark, ops), 4).where("para IS NULL").count() == 1
    kinds = {r["act"]: r["kind"] for r in oplog.load_by_kind(raw(spark, [("k1", "L", None, None, "§ 1 oppheves", None, "2001", 1), ("k2", "L", None, None, "§ 1 skal lyde", "x", "2002", 1)])).collect()}
    assert kinds == {"k1": "repeal", "k2": "replace"}
    snapshots = spark.createDataFrame([("L", "2001")], "law string, base_as_of string")
    log = oplog.load(raw(spark, [("b", "L", "§ 1", "change", str(d), "x", d, 1) for d in ("2000", "2001", "2002", None)]), 4)
    assert sorted(str(r["date"]) for r in oplog.since_snapshot(log, snapshots).collect()) == ["2001", "2002", "None"]
    assert sorted(str(r["date"]) for r in oplog.as_of(log, "2001").collect()) == ["2000", "2001", "None"]


def test_reforms_follow_dates_and_end_at_the_bound(spark):
    provisions = spark.createDataFrame([("L", "§1", "ab"), ("M", "§1", "ab")], "law string, para string, text string")
    rows = [("L", "b", "c", "2002", None, 1), ("L", "a", "b", "2001", None, 2), ("L", "c", "z", "2009", None, 3), ("L", "b", "q", None, None, 4)]
    reforms = spark.createDataFrame(rows, "target_law string, term_old string, term_new string, date_in_force_resolved string, date_in_force string, line_no int")
    assert state(fold.reform(provisions, reforms, "2005")) == {("L", "§1"): "cq", ("M", "§1"): "ab"}


def test_histories_and_redlines(spark):
    bases = spark.createDataFrame([("L", "§1", "One."), ("L", "§2", "Two.")], "law string, para string, text string")
    ops = oplog.load(raw(spark, [("1999-01-01-1", "L", "§ 1", "change", "a", "§ 1. One b.", "2001", 1), ("1999-01-01-2", "L", "§ 1", "repeal", "§ 1 oppheves", None, "2002", 1), ("1999-01-01-3", "L", "§ 1", "add", "c", "§ 1. One b.", "2003", 1)]), 4)
    folded = fold.fold(bases, ops)
    assert state(fold.provisions(folded)) == {("L", "§1"): "One b.", ("L", "§2"): "Two."}
    made = history.histories(folded, spark.createDataFrame([("L", "1990-01-01")], "law string, enacted string"), bases)
    versions = {r["para"]: [(v["date"], v["text"]) for v in r["versions"]] for r in made.collect()}
    assert versions == {"§1": [("1990-01-01", "One."), ("2001", "One b."), ("2003", "One b.")], "§2": [("1990-01-01", "Two.")]}
    assert history.redline_of("a b c", "a x c") == [("same", "a"), ("gone", "b"), ("new", "x"), ("same", "c")]
    assert history.redline_of("hello worlds", "hello world") == [("same", "hello"), ("same", "world"), ("gone", "s")]
    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(8))] for _ in range(2))
        steps = history.longest_common(a, b)
        assert [x for op, x in steps if op != "new"] == a and [x for op, x in steps if op != "gone"] == b
        best = max(n for n in range(len(a) + 1) if any(_within(c, b) for c in itertools.combinations(a, n)))
        assert sum(op == "same" for op, _ in steps) == best


def _within(part, whole):
    rest = iter(whole)
    return all(x in rest for x in part)


def test_pruned_similarity_is_brute_force(spark):
    rng = random.Random(2)
    words = ["alfa", "beta", "gamma", "delta", "epsilon"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 9))) for _ in range(30)] + ["", "", "Alfa  beta", "alfa beta"]
    texts += [x + " x" for x in texts[:10]]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {(r["a_id"], r["b_id"]): r["score"] for r in align.pairs(df, df, 0.9).collect()}
    want = {(i, j): s for i, a in enumerate(texts) for j, b in enumerate(texts) if (s := wording.similarity(a, b)) >= 0.9}
    assert got == pytest.approx(want)
    left, right = df.where("id % 2 = 0"), df.where("id % 2 = 1")
    a, b = ({k: x for k, x in enumerate(texts) if k % 2 == m} for m in (0, 1))
    mutual = set()
    for i, x in a.items():
        s, j = max((wording.similarity(x, y), -k) for k, y in b.items())
        if s >= 0.9 and max((wording.similarity(b[-j], y), -k) for k, y in a.items())[1] == -i:
            mutual.add((i, -j))
    assert {(r["a_id"], r["b_id"]) for r in align.mutual_best(left, right, 0.9).collect()} == mutual


def test_segmentation(spark):
    pages = spark.createDataFrame([("i", 1, '<Page WIDTH="100"><TextBlock HPOS="60" VPOS="1"><TextLine><String CONTENT="right &amp; up"/></TextLine></TextBlock><TextBlock HPOS="1" VPOS="9"><TextLine><String CONTENT="left"/><String CONTENT="low"/></TextLine></TextBlock><TextBlock HPOS="1" VPOS="2"/></Page>')], "issue string, page int, xml string")
    assert segment.reflow(segment.alto_blocks(pages, ["issue", "page"], "xml"), ["issue", "page"]).first()["text"] == "left low\nright & up"
    toc = "Nr. 3 - 1991\nInnhold\nmai 3. Lov nr. 7 om endringer i lov 3. mai 1980 nr. 2 om x\njuni 5. Lov nr. 9 om vern\nmai 3. Lov nr. 7 om noe annet\n"
    body = "Lov nr. 9 \nfor tidlig\nLov nr. 7 \nen\nLov nr. 7 \nhode igjen\nLov nr. 9 \nto"
    issues = spark.createDataFrame([("i", toc, 1991, body)], "issue string, toc string, year int, text string")
    acts = segment.contents(issues, ["issue"], "toc", "year")
    assert sorted((r["nr"], r["date"], r["klass"], r["target"]) for r in acts.collect()) == [(7, "1991-05-03", "amend", "1980-05-03-2"), (9, "1991-06-05", "original", None)]
    assert {r["nr"]: r["body"] for r in segment.bodies(issues, ["issue"], "text", acts).collect()} == {7: "Lov nr. 7 \nen\nLov nr. 7 \nhode igjen\n", 9: "Lov nr. 9 \nto"}
    marks = spark.createDataFrame([("d", 5, "§ 1"), ("d", 5, "§ 2"), ("d", 7, "§1"), ("d", 8, "§"), ("d", 9, "S3")], "doc string, line int, para string")
    assert [(r["para"], r["kept"]) for r in segment.repaired_boundaries(marks, ["doc"]).collect()] == [("§1", True), ("§2", False), ("§1", False), ("§", False), ("§3", True)]
    text = spark.createDataFrame([("x" * 40, "forord Lov om A\ninnhold" + " fyll" * 12 + "\n3. mai Lov nr. 4\nLov om B")], "a string, b string")
    assert text.select(segment.law_text(F.col("b"), "Lov om A")).first()[0].rstrip().endswith("fyll")
    ocr = spark.createDataFrame([("L", "§ 1. Førstë tekst se § 9.\n§ 2 (tittel) Andre.\n§ 1. igjen")], "law string, text string")
    assert {r["para"]: r["text"] for r in segment.ocr_provisions(ocr, ["law"], "text").collect()} == {"§1": "Første tekst se § 9.", "§2": "(tittel) Andre. § 1. igjen"}
    cut = segment.windows(spark.createDataFrame([(1, "abcdefghij"), (2, "abc"), (3, "")], "k int, text string"), "text", 4, 2)
    assert [(r["k"], r["start"], r["chunk"]) for r in cut.orderBy("k", "start").collect()] == [(1, 0, "abcd"), (1, 2, "cdef"), (1, 4, "efgh"), (1, 6, "ghij"), (2, 0, "abc")]


def test_register(spark):
    html = '<title>Lov A</title><a data-lovdata-URL="NL/lov/2000-01-01-1/§1"></a><article class="changesToParent">Endret ved <a href="lov/2001-01-01-2">x</a> (ikr. 1 juli 2002 iflg. <a href="forskrift/2002-05-9">r</a>)</article><a data-lovdata-URL="NL/lov/1999-09-09-9/§7"></a><article class="changesToParent">Opphevet ved <a href="lov/2000-01-01-1">selv</a>, <a href="lov/2003-01-01-3">y</a></article>'
    sources = spark.createDataFrame([("2000-01-01-1", html), ("2001-01-01-2", "<title>Lov B</title>")], "law string, raw string")
    edges = register.edges(sources)
    got = sorted((r["act_id"], r["act_title"], r["provision"], r["change_type"], r["in_force"], r["source_ref"]) for r in edges.collect())
    assert got == [("lov/2001-01-01-2", "Lov B", "§1", "change", "1 juli 2002 iflg. r", "forskrift/2002-05-9"), ("lov/2003-01-01-3", None, "§1", "repeal", None, None)]
    assert {r["act_id"]: (r["n_laws"], r["n_ops"]) for r in register.index(edges).collect()} == {"lov/2001-01-01-2": (1, 1), "lov/2003-01-01-3": (1, 1)}
    texts = spark.createDataFrame([(1, "lov 3. mai 2000 nr. 7, lov 3. mai 2000 nr. 7"), (2, "lov 3. mai 2000 nr. 8")], "k int, text string")
    assert [tuple(r) for r in register.citing(texts, spark.createDataFrame([("2000-05-03-7",)], "law string"), "k", "text", 2).collect()] == [(1, "2000-05-03-7", 2)]


def test_scores_and_negative_controls(spark):
    schema = "law string, para string, text string"
    current = spark.createDataFrame([("L", "§1", "ny tekst"), ("L", "§2", "(Opphevet)"), ("L", "§a1", "annex"), ("L", "§3", "helt annet innhold")], schema)
    ocr = spark.createDataFrame([("L", False)], "law string, is_ocr boolean")
    # a reconstruction that gives today's text always converges, and fails at any past date
    row = score.convergence(current, current, ocr).first()
    assert (row["matched"], row["total"], row["annex"], row["repealed"]) == (2, 2, 1, 1) and score.verdict(row) == 0
    past = spark.createDataFrame([("L", "2001", "§1", "gammel ordlyd"), ("L", "2001", "§3", "helt annet innhold")], "law string, date string, para string, text string")
    naive = current.join(spark.createDataFrame([("2001",)], "date string"))
    assert score.point_in_time(naive, past, ocr).first()["rate"] == 0.5
    # a base that has today's text where it was amended came from the answer
    ops = spark.createDataFrame([("L", "§1", "2005"), ("L", "§3", None)], "law string, para string, date string")
    none = spark.createDataFrame([], "law string, base_as_of string")
    assert sorted(r["para"] for r in score.contaminated(current, current, ops, none).collect()) == ["§1", "§3"]
    assert score.contaminated(past.select("law", "para", "text").where("para = '§1'"), current, ops, none).count() == 0
    scored = score.compared(past.select("law", "para", "text"), current.where("para IN ('§1', '§3')"), ["law", "para"])
    log = spark.createDataFrame([("L", "§1", "subprovision", "§ 1 første ledd")], "law string, para string, kind string, instruction string")
    missed = score.misses(scored, current, log, spark.createDataFrame([("L", "§1")], "law string, para string"), F.lit(0.98))
    assert [(r["para"], r["bucket"]) for r in missed.collect()] == [("§1", "engine-gap:ledd")]
    assert {(r["law"], r["n"]) for r in score.miss_table(missed).collect()} == {("L", 1), (None, 1)} and score.examples(missed).count() == 1


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"datokode": "1999-01-01-1", "source": {"lti": "x"}, "provisions": {"§1": "a", "§2": "b"}}', "utf-8")
    assert [(r["law"], r["para"], r["ordinal"], r["is_ocr"]) for r in readers.bases(spark, str(tmp_path / "b.json")).orderBy("ordinal").collect()] == [("1999-01-01-1", "§1", 0, False), ("1999-01-01-1", "§2", 1, False)]
    (tmp_path / "o.jsonl").write_text('{"act_refid": "lov/2001-01-01-1", "target_law": "lov/1999-01-01-1", "instruction": "i"}\n{"broken', "utf-8")
    assert [(r["act_refid"], r["target_law"], r["stream_rank"]) for r in readers.op_stream(spark, str(tmp_path / "o.jsonl"), 3).collect()] == [("2001-01-01-1", "1999-01-01-1", 3)]
    rows = spark.createDataFrame([(1, "a", None), (2, "b", "anchor-not-found")], "k int, v string, reason string")
    writers.recovered(rows, str(tmp_path / "good"), str(tmp_path / "lost"))
    assert spark.read.parquet(str(tmp_path / "good")).count() == spark.read.parquet(str(tmp_path / "lost")).count() == 1
    assert [writers.append_missing(rows.drop("reason"), str(tmp_path / "t"), ["k"], b) for b in ("a", "a", "b")] == [2, 2, 0]
    catalogue = spark.createDataFrame([("a", "Norsk Lovtidend Avd. I 1991", "1991", 5, True), ("b", "Norsk Lovtidend Avd. II", "1991", 5, True), ("c", "Norsk Lovtidend Avd. I", "1875", 5, True), ("d", "Norsk Lovtidend Avd. I", "1995", 2, True)], "id string, title string, issued string, pageCount int, isDigital boolean")
    assert [(r["id"], r["year"]) for r in readers.worklist(catalogue).collect()] == [("d", 1995), ("a", 1991)]


def test_numbering(spark):
    rows = spark.range(1000).repartition(7)
    assert [r["place"] for r in numbering.numbered(rows, ["id"]).orderBy("id").collect()] == list(range(1000))
    assert sorted(r[0] for r in numbering.systematic_sample(rows, ["id"], 100, 3).collect()) == [0, 100, 200]


def test_reconstruction_never_imports_the_evaluation_nor_the_corpus_operators():
    root = pathlib.Path(chronofold.__file__).parent
    for path in root.rglob("*.py"):
        parts = path.relative_to(root).parts
        for node in ast.walk(ast.parse(path.read_text("utf-8"))):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or "", *(f"{node.module}.{a.name}" for a in node.names)] if isinstance(node, ast.ImportFrom) else []
            if parts[0] in ("core", "functions", "operators", "sources", "streaming") or parts == ("plans", "reconstruct.py"):
                assert not any(n.startswith("chronofold.evaluate") for n in names), path
            if parts[0] != "llm":
                assert not any(n.startswith("chronofold.llm") for n in names), path


def test_live_fold(spark, tmp_path):
    from chronofold.streaming.live_fold import live

    schema = "law string, para string, seq int, change_type string, instruction string, new_text string"
    spark.createDataFrame([("L", "§1", 1, "change", "§ 1 skal lyde:", "§ 1. One."), ("L", "§1", 2, "renumber", "blir", None)], schema).coalesce(1).write.json(str(tmp_path / "in"))
    stream = live(spark.readStream.schema(schema).json(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("live").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    run.processAllAvailable()
    run.stop()
    assert [tuple(r) for r in spark.sql("SELECT * FROM live").collect()] == [("L", "§1", "One.", 1)]


@pytest.mark.parametrize("sent", [0, 10_000])
def test_verbatim_passages(spark, monkeypatch, sent):
    monkeypatch.setattr(align, "SENT", sent)
    passages = [(1, "one two three four five six seven"), (2, "two words"), (3, "b c d e f g h"), (4, "nowhere to be found in any of these texts")]
    texts = [(1, "x one two three four five six seven y"), (2, "zone two three four five six sevens"), (3, "one two three four five six"), (4, "a b c d e f g\nh"), (5, "xb c d e f g hi two words"), (6, None)]
    got = align.verbatim(spark.createDataFrame(texts, "k int, text string"), spark.createDataFrame(passages, "item int, text string"), "k", "item")
    assert sorted(map(tuple, got.collect())) == sorted((i, k) for i, p in passages for k, t in texts if t and p in t)
