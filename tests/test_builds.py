"""Building bases, truth and the log from files; issues; replacement blocks; the gate."""

import duckdb
import pytest
from chronofold.core import acts, issue, subdoc
from chronofold.evaluate import score
from chronofold.operators import oplog, segment
from chronofold.plans import builds, queries
from chronofold.sources import readers


def test_contents_by_words():
    toc = "jan. 1. Lov nr. 1 før\nInnhold\nMAI 3.\nLov nr 7 om endr. x\nsept. 12. LOV  nr. 8\nLov nr. 9 uten dag\nx 3. Lov nr. 10 om\nmai 333. Lov nr. 11\nmai 4. Lov nr. 12 om y mai 5. Lov nr. 13 samme linje"
    assert issue.entries(toc) == [(7, 5, 3, "om endr. x"), (8, 9, 12, ""), (12, 5, 4, "om y mai 5. Lov nr. 13 samme linje")]
    assert issue.entries("") == [] and issue.chosen_heads("ingen", [1]) == []


def test_a_law_ends_at_the_next_act():
    body = "Lov om A\n" + "fyll " * 12
    for tail in ("\n3. mai Lov nr. 4\nLov om B", "\nmai. Lov nr 4 \n 12 \n\nLov um B"):
        assert issue.law_text("x " + body + tail, "Lov om A").rstrip() == body.rstrip()
    for tail in ("\n3. mai Lov nr. 4 og mer\nLov om B", "\n3. mai Lov nr. 4\nLov ombord", "\nse 3. mai Lov nr. 4\nLov om B", "\n3. mai Lov nr. 4"):
        assert issue.law_text(body + tail, "Lov om A") == body + tail
    assert issue.law_text(body + " slutt her", "Lov om A", "slutt") == body + " slutt" and issue.law_text(body, "Lov om C") is None


def test_marks_and_runs():
    assert subdoc.marks("nr", "Lead 1. en (2) to 3) tre 4.") == [(5, 7, "1", "."), (18, 20, "3", ")")]
    assert subdoc.marks("bokstav", "a) en bb) to B) tre c. d)") == [(0, 2, "a", ")"), (13, 15, "B", ")")] and subdoc.marks("nr", "") == []
    assert subdoc.new_run("§ 1 nytt tredje til femte ledd skal lyde") == ("tredje", "femte") and subdoc.new_run("§ 1 tredje ledd skal lyde") is None


def test_sliced_bases(spark):
    texts = spark.createDataFrame([(1, "§ 1. En\nto\n§ 2 a. Tre\n§ 9 Fire"), (2, None)], "k int, text string")
    marks = spark.createDataFrame([(1, 1, "§ 1"), (1, 3, "§2a"), (1, 4, "§ 8"), (1, 4, "§ 7"), (2, 1, "§ 1")], "k int, line int, para string")
    got = {(r["k"], r["para"]): (r["text"], r["verbatim"], r["heading_fits"]) for r in segment.sliced_provisions(texts, marks, ["k"]).collect()}
    assert got == {(1, "§1"): ("En to", True, True), (1, "§2a"): ("Tre", True, True), (1, "§7"): ("Fire", True, False), (2, "§1"): ("", True, False)}


_BLOCKS = (
    '<article class="defaultP">§ 1 skal\n lyde:</article><article class="futureLegalArticle" data-name="§ 1-1" id="a"><span class="legalArticleTitle">Om</span>'
    '<article class="legalP" id="a-ledd-1">Ord &amp; <ul><li data-li-identifier="a)">en</li></ul></article><article class="numberedLegalP" id="a-nummer-2"> to&#xa0;tre </article>'
    '<article class="legalP" id="a-ledd-1-x">ikke</article></article><article class="futureLegalArticle" data-name="§2" id="b"></article><h2 >Over</h2><article class="legalP" id="b-ledd-1">bak</article>'
    '<article class="defaultP">§ 1 skal lyde:</article><section>'
)


def test_replacement_blocks():
    assert acts.replacement_blocks(_BLOCKS) == [("§ 1 skal lyde:", "§ 1-1.Om\nOrd &en\nto\xa0treikke\n§ 2."), ("§ 1 skal lyde:", "")]
    assert acts.replacement_blocks("") == acts.replacement_blocks("<a <b") == []


def test_rederived(spark):
    sources = spark.createDataFrame([("x", _BLOCKS)], "act string, raw string")
    ops = spark.createDataFrame([("x", "L", " § 1 skal lyde:", "§ 1-1"), ("x", "L", "§ 2", "§ 1-1"), ("x", "M", "§ 1 skal lyde:", "§ 1-2"), ("y", "L", "§ 1", "12345"), ("y", "L", "§ 1", "short"), ("x", "L", None, None), ("y", "L", "§ 1", "1234")], "act string, law string, instruction string, new_text string")
    got = oplog.rederived(ops, sources, segment.replacement_blocks(sources, ["act"], "raw"), 5)
    assert sorted((r["act"], r["law"], r["instruction"].strip(), (r["new_text"] or "")[:9], r["reason"]) for r in got.collect()) == [("x", "L", "§ 1 skal lyde:", "§ 1-1.Om\n", None), ("x", "L", "§ 2", "", "instruction-not-found"), ("x", "M", "§ 1 skal lyde:", "", "no-block-fits"), ("y", "L", "§ 1", "", "no-source")]


def test_dated_operations(spark):
    ops = spark.createDataFrame([("a", None), ("a", "2001-01-01"), ("b", ""), (None, None)], "act_refid string, date_in_force_resolved string")
    index = spark.createDataFrame([("a", "1999-01-01"), ("b", None)], "datokode string, resolved string")
    assert sorted(map(str, (tuple(r) for r in oplog.dated(ops, index).collect()))) == sorted(map(str, [("a", "1999-01-01"), ("a", "2001-01-01"), ("b", None), (None, None)]))


def test_whole_files(spark, tmp_path):
    (tmp_path / "nl-19990101-001.xml").write_text("<p>å</p>", "utf-8")
    assert [r["raw"] for r in readers.whole_files(spark, str(tmp_path)).collect()] == ["<p>å</p>"]


def test_truth_from_a_folder(spark, tmp_path):
    (tmp_path / "L1").mkdir()
    (tmp_path / "L1" / "2001-01-01.html").write_text('<a name="_1"></a>§ 1. fra html', "utf-8")
    (tmp_path / "L1" / "2001-01-01.txt").write_text("§ 1 fra txt", "utf-8")
    (tmp_path / "L1" / "2002-01-01.txt").write_text("forord § 1 ny\ntekst § 2a to § 1 igjen", "utf-8")
    index = spark.createDataFrame([("L1", d) for d in ("2001-01-01", "2002-01-01", "2002-01-01", "2003-01-01")], "datokode string, valid_from_date string")
    got = readers.truth_versions(readers.versioned_files(spark, str(tmp_path)), index)
    assert sorted(map(tuple, got.collect())) == [("L1", "2001-01-01", "§1", "fra html"), ("L1", "2002-01-01", "§1", "ny tekst"), ("L1", "2002-01-01", "§2a", "to")]


def test_gate(spark):
    clean, leaks = spark.createDataFrame([], "law string, para string, sim double"), spark.createDataFrame([("L", "§1", 1.0)], "law string, para string, sim double")
    good = {"fold": "import json\nfrom chronofold.core import scan"}
    bad = {"fold": "def f():\n    from chronofold.evaluate import score"}
    assert score.guards(good, clean) == {"import": [], "base": []} and score.guards(bad, leaks) == {"import": ["fold"], "base": ["L §1"]}
    row = {"matched_rate": 0.99, "matched": 99, "total": 100}
    assert score.verdict(row, score.guards(good, clean)) == 0 and score.verdict(row, {"import": ["x"]}) == 3 and score.verdict({"matched_rate": 0.1}) == 1
    laws = spark.createDataFrame([("L", 0.95), ("M", 1.0)], "law string, rate double")
    status = score.snapshot(row, {"import": []}, laws, {"ops": laws})
    assert status["exit"] == 0 and status["sources"] == {"ops": 2} and (status["laws"]["at_90"], status["laws"]["at_98"]) == (2, 1)


@pytest.mark.parametrize("name", ["rederived_blocks", "gazette_log", "issue_boundaries", "truth_from_files", "bases_by_source", "sliced_bases"])
def test_queries_against_sql_with_odd_texts(spark, tmp_path, name):
    texts = [None, "", "   ", "<b>&amp; & ]] §", "En linje\n\nto  tre\nfire\nfem", "ord " * 200, "A. b. C " * 90 + "&lt;", "x" * 500, "se § 1 skal lyde: noe\n2 to"]
    spark.createDataFrame([(k, x, "no", "s", len(x or "")) for k, x in enumerate(texts * 3)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = getattr(builds, name)(spark, str(tmp_path))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        found = db.execute(queries.SQL[name])
        columns = sorted(c[0] for c in found.description)
        want = [dict(zip([c[0] for c in found.description], row, strict=True)) for row in found.fetchall()]
    assert sorted(got.columns) == columns
    rows = lambda rs: sorted(str([r[c] for c in columns]) for r in rs)
    assert rows(got.collect()) == rows(want)
