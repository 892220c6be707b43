import pytest
from chronofold.core import acts, wording
from chronofold.functions import text as t
from pyspark.sql import functions as F

CASES = [
    (t.law_id, "lov 21. november 1952 nr. 2om x", "1952-11-21-2"), (t.law_id, "Lov av 3 SEPT. 1999 nr 14", "1999-09-03-14"), (t.law_id, "noe", None),
    (t.law_id_of_name, "nl-20190315-006.xml", "2019-03-15-6"), (t.name_of_law_id, "2019-03-15-6", "nl-20190315-006.xml"), (t.law_of_ref, "lov/2019-03-15-6", "2019-03-15-6"), (t.law_of_ref, "2019-03-15-6", "2019-03-15-6"),
    (t.in_force_date, '<dd class="dateInForce"> 2021-02-01, 2022</dd>', "2021-02-01"), (t.in_force_date, '<dd class="dateInForce">Kongen bestemmer</dd>', None), (t.in_force_date, "", None),
    (t.act_class, "om opphevelse av lov", "repeal"), (t.act_class, "om endr. i lov", "amend"), (t.act_class, "om vern", "original"),
    (t.op_kind, "§ 3 oppheves", "repeal"), (t.op_kind, "Ny § 3 skal lyde", "add"), (t.op_kind, "§ 3 første ledd skal lyde", "subprovision"), (t.op_kind, "§ 3 skal lyde", "replace"), (t.op_kind, "noe", "other"), (t.op_kind, None, "other"),
    (t.change_of_instruction, "OPPHEVES", "repeal"), (t.change_of_instruction, "Nytt kapittel", "add"), (t.change_of_instruction, "§ 2 skal lyde", "change"),
    (t.note_verb, "Opphevet ved lov", "repeal"), (t.note_verb, "Kapitlet tilføyd, ved", "add"), (t.note_verb, "noe helt annet endret", "change"),
    (t.bare_id, "jf. § 5-8 a.", "§5-8"), (t.bare_id, "uten", None), (t.heading_id, " § 5-8 a.Text", "§5-8a"), (t.heading_id, "§ 27 første", None), (t.leading_id, "§ 27 første", "§27"), (t.leading_id, "jf. § 2", None),
    (t.spaced_id, "§ 5 a skal", "§5a"), (t.repaired_id, "§ l4 — 2", "§14-2"), (t.quoted_id, " S 4 a ", "§4a"), (t.quoted_id, "§ 4", "§4"),
    (t.chapter_of, "§10-2", "10"), (t.chapter_of, "x", "?"), (t.act_label, "lov/1952-11-21-2", "Lov 21. november 1952 nr. 2"), (t.act_label, "x", "x"), (t.act_label, None, "amendment"),
    (t.without_heading, "§ 5-8 a. Tekst  her", "Tekst her"), (t.without_heading, "§ 27 første", "første"), (t.without_running_headers, "12\nTekst\n 3 mai nr. 4 \nmai Lov nr. 2\nSlutt", "Tekst\nSlutt"),
    (t.is_annex, "§a1", True), (t.is_annex, "§1a", False), (t.is_annex, "§cisg/a1", True), (t.is_repealed_stub, ". (Opphevet) Opphevet ved", True), (t.is_repealed_stub, "(Opphevelse eller", False), (t.is_repealed_stub, None, False),
    (t.is_failed_extraction, ", 3)", True), (t.is_failed_extraction, "§ 3 Jfr. § 4 og § 5.", True), (t.is_failed_extraction, "En hel bestemmelse med ord.", False),
    (t.markup_text, '<p>x</p><li data-li-identifier="a)">en</li>&nbsp;&amp;', "x a) en &"), (t.joined_text, "a<b>c</b> d", "ac d"), (t.tag_text, "a<b> c</b>", "a c"),
    (t.ocr_folded, "generalförsamling", "generalforsamling"), (t.repaired_headings, "§ 1 — 3 Tekst\njf. § 2 - 4", "§1-3. Tekst\njf. § 2 - 4"), (t.repaired_payload, "// a  b /", "a b"), (t.repaired_unit, "anne t  ledd", "annet ledd"),
    (t.issue_year, "Nr. 3 - 1991 og 1850", 1991), (t.issue_year, "i 1850", 1850), (t.is_first_division, "Avd. I nr 2", True), (t.is_first_division, "Avd. II", False), (t.is_first_division, "1ste Afdeling", True), (t.is_first_division, "Register Avd. I", False),
    (t.is_renumbering, "Nåværende § 5 blir § 6", True), (t.is_renumbering, "§ 5 skal lyde", False), (t.is_amendatory, "§ 1 skal LYDE", True), (t.is_amendatory, "ingenting", False), (t.bare_law_id, "se 2000-01-02-3", "2000-01-02-3"),
    (t.display_text, ". Tittel ", "Tittel"), (t.is_clean_id, "§38b", True), (t.is_clean_id, "§kapittel4", False), (t.is_note_table, "<table><tr><td>1</td><td>Se</td></tr></table>", True), (t.is_note_table, "<table><tr><td>x</td><td>Se</td></tr></table>", False),
]


def test_scalars(spark):
    rows = spark.createDataFrame([(k, c[1]) for k, c in enumerate(CASES)], "k int, x string").coalesce(1)
    made = rows.select("k", *(F.when(F.col("k") == k, c[0](F.col("x"))).alias(f"c{k}") for k, c in enumerate(CASES))).collect()
    got = {r["k"]: r[f"c{r['k']}"] for r in made}
    assert {k: got[k] for k in got if got[k] != CASES[k][2]} == {}


def test_canonical_is_that_of_the_editor(spark):
    texts = ["§ 5 Første ledd. Endret ved lov 1", "A (ikr. 1 juli 2011 iflg. res. 3) B", "x 1 1 Fra 28 des 2009 iflg. res. 19 juni 2009 nr. 672. y", "Denne lov trer i kraft straks", "se Lov nr. 5 her", "ÆØÅ éü", "", " nbsp "]
    rows = spark.createDataFrame([(x,) for x in texts], "x string")
    assert [r[0] for r in rows.select(t.canonical(F.col("x"))).collect()] == [wording.canonical(x) for x in texts]


@pytest.mark.parametrize("text", ["lov 3. mai 2000 nr. 7 og lov av 2 jan. 1999 nr 1", ""])
def test_citations(spark, text):
    got = spark.createDataFrame([(text,)], "x string").select(t.cited_laws(F.col("x"))).first()[0]
    assert got == ([acts.law_id(x) for x in text.split(" og ")] if text else [])
