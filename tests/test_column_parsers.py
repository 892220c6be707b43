"""Parsers that are column expressions: edge by edge, and no Python in their plans."""

import pytest
from chronofold.functions import text as t
from chronofold.operators import segment
from pyspark.sql import functions as F

WORDED = "I lov 3. mai 2000 nr. 7 endres «A» til «B». Uttrykket «C» endres til «D». «§ 5» erstattes med «§ 6». «A» erstattes med «B»"
LAW = "2000-05-03-7"


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "k int, x string")


def found(df):
    return sorted(tuple(r)[:1] + tuple(r)[2:] for r in df.collect())


@pytest.mark.parametrize("parser", [segment.plain_provisions, segment.act_sections, segment.term_reforms, segment.amending_laws])
def test_no_python_and_nothing_of_nothing(spark, parser):
    made = parser(rows(spark, ["", None, "ingen", "§", "§§ x", "lov", "«", "I lov"]), ["k"], "x")
    assert made.collect() == []
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Exchange" not in plan


def test_plain_provisions(spark):
    made = segment.plain_provisions(rows(spark, ["før § 1 En\n to § x § 2a. Tre §3-4fire § 1 igjen", "§ 7", "§ 12- x §"]), ["k"], "x")
    assert sorted(map(tuple, made.collect())) == [(0, 0, "§1", "En to § x"), (0, 1, "§2a", ". Tre"), (0, 2, "§3-4f", "ire"), (1, 0, "§7", ""), (2, 0, "§12", "- x §")]


def test_sections_begin_at_their_i(spark):
    texts = [f"Fyll. {WORDED} i  LOV\n21. november 1952 nr. 2 mer", "XI lov 3. mai 2000 nr. 7", "I lov av 3. mai 2000 nr. 7", "(I lov 3. mai 2000 nr. 7)", "I lovlov 3. mai 2000 nr. 7"]
    assert found(segment.act_sections(rows(spark, texts), ["k"], "x")) == [(0, "1952-11-21-2", "i  LOV\n21. november 1952 nr. 2 mer"), (0, LAW, WORDED + " "), (3, LAW, "I lov 3. mai 2000 nr. 7)")]


def test_terms_by_form(spark):
    more = "I lov 3. mai 2000 nr. 7 ordet«A» endres til «B» «C»erstattes med «D» «E» erstattes med«F» «G» erstattes med «G» « » erstattes med «H» i lov 3. mai 2000 nr. 8 «K» erstatte\nmed « L »"
    made = segment.term_reforms(rows(spark, [WORDED, more]), ["k"], "x")
    assert sorted(map(tuple, made.collect())) == [(0, 0, LAW, "C", "D"), (0, 1, LAW, "A", "B"), (1, 0, LAW, "E", "F"), (1, 1, "2000-05-03-8", "K", "L")]


def test_amending_laws_by_date(spark):
    texts = ["Endret ved lover 3 mai 2000 nr. 7 (ikr. iflg. res. 4 juni 2000 nr. 9), 2 jan 1999 nr. 1", "3 mai 2000 nr. 21 mai 2000 nr. 3", "x12 sept. 2003 nr.44, <a>12 Juni</a> 1990 nr 4", "forskrift 1 jan 2000 nr. 1", "forskrift av samme dag 1 jan 2000 nr. 1", "3 mars 2000 nr", "3 fjor 2000 nr. 1", "3 mai 2000 nr. 7 og 3 mai 2000 nr. 7"]
    made = segment.amending_laws(rows(spark, texts), ["k"], "x")
    want = [(0, 0, "1999-01-02-1"), (0, 1, LAW), (1, 0, "2000-05-03-21"), (2, 0, "1990-06-12-4"), (2, 1, "2003-09-12-44"), (4, 0, "2000-01-01-1"), (7, 0, LAW)]
    assert sorted(map(tuple, made.collect())) == want


def test_rules_by_words(spark):
    cases = [
        (t.act_class, {"om opph. av lov": "repeal", "om  opphør": "repeal", "lov om opphør": "original", "lov (om endr.)": "amend", "ombud": "original", "": "original"}),
        (t.issue_year, {"Nr. 3 - 1991 og 1850": 1991, "Nr. 3 – 1850": 1850, "uten 1799 men 1801": 1801, "12345": None, "Nr. x - 1991, 2001": 1991}),
        (t.is_first_division, {"Norsk Lovtidend Avd. I 1991": True, "Avd. II": False, "1ste Afdeling": True, "1. ste afdeling": True, "2den Afdeling": False, "Avd. I Register": False, "noe": False}),
        (t.without_heading, {"§ 5-8 a. Tekst": "Tekst", "§ 27 første": "første", "§ 9a Tekst  to": "Tekst to", "§ x": "§ x", "tekst § 1": "tekst § 1"}),
        (t.repaired_headings, {"§ 1 — 3 a": "§1-3. a", " §1~3b. Tekst – to": " §1-3b.  Tekst – to", "se § 1 — 3": "se § 1 — 3", "§ 1 3": "§ 1 3"}),
        (t.without_running_headers, {"44\nmai. Lov nr. 5\n12 jan nr.5\ntekst 44\n12345\n44.": "tekst 44\n12345\n44."}),
    ]
    for rule, wanted in cases:
        df = spark.createDataFrame([(x,) for x in wanted], "x string")
        assert {r[0]: r[1] for r in df.select("x", rule(F.col("x"))).collect()} == wanted, rule.__name__
