"""Golden cases: small literal statutes, acts and gazette pages through the library's operators, with their rows in SQL."""

from __future__ import annotations

from collections.abc import Callable

from chronofold.evaluate import score
from chronofold.functions import text as t
from chronofold.operators import fold, history, oplog, register, segment
from chronofold.plans.reconstruct import reconstruct
from chronofold.sources import readers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
CASES: dict[str, tuple[Query, str]] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        CASES[f.__name__] = (f, sql)
        return f

    return add


_STATUTE = "Tittel\n(1) Alfa en. Alfa to.\n(2) Beta en.\n(3) Gamma a) første b) andre"
_BASES = [("1999-01-01-1", "§1", "gammel en", None), ("1999-01-01-1", "§2", "gammel to", None), ("1999-01-01-1", "§4", _STATUTE, None), ("1993-01-01-2", "§1", "øyeblikk", "1993-01-01")]
_OPS = [
    ("2001-05-05-7", "1999-01-01-1", "§ 1", "change", "§ 1 skal lyde:", "§ 1. Ny en.", "2001-06-01"),
    ("2002-05-05-8", "1999-01-01-1", "§ 2", "repeal", "§ 2 oppheves", None, "2002-06-01"),
    ("2003-05-05-9", "1999-01-01-1", None, "add", "ny § 9a skal lyde:", "nytt innhold", "2003-06-01"),
    ("2004-05-05-10", "1999-01-01-1", "§ 4", "repeal", "§ 4 tredje ledd oppheves", None, "2004-06-01"),
    ("2005-05-05-11", "1999-01-01-1", "§ 4", "change", "§ 4 første ledd andre punktum skal lyde:", "Alfa endret.", "2005-06-01"),
    ("2006-05-05-12", "1999-01-01-1", "§ 1", "renumber", "§ 1 blir § 3", None, "2006-06-01"),
    ("2007-05-05-13", "1993-01-01-2", "§ 1", "unknown", "Kapittel 1 skal lyde:", "§ 1. Øyeblikket.\n§ 2. Det neste.", "1993-01-01"),
]


def _statutes(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    bases = spark.createDataFrame(_BASES, "law string, para string, text string, base_as_of string")
    raw = spark.createDataFrame([(a, law, p, c, i, n, d, None, None, 1, k) for k, (a, law, p, c, i, n, d) in enumerate(_OPS)], "act_refid string, target_law string, paragraph string, change_type string, instruction string, new_text string, date_in_force_resolved string, date_in_force string, target string, stream_rank int, line_no int")
    return bases, raw


@query("""
SELECT * FROM (VALUES
  ('1999-01-01-1', '§1', 'Ny en.'), ('1999-01-01-1', '§9a', 'nytt innhold'), ('1993-01-01-2', '§1', 'Øyeblikket.'), ('1993-01-01-2', '§2', 'Det neste.'),
  ('1999-01-01-1', '§4', 'Tittel' || chr(10) || '(1) Alfa en. Alfa endret.' || chr(10) || '(2) Beta en.')) AS v(law, para, text)""")
def subdoc_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    bases, raw = _statutes(spark)
    return reconstruct(bases, [raw], recovery=2)[0]


@query("SELECT '1999-01-01-1' AS law, '§1' AS para, 'renumber' AS why, '2006-06-01' AS date, '§ 1 blir § 3' AS instruction")
def statute_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    bases, raw = _statutes(spark)
    return reconstruct(bases, [raw], recovery=2)[1]


@query("""
SELECT * FROM (VALUES ('p1', 'title' || chr(10) || 'left top' || chr(10) || 'left low' || chr(10) || 'right top' || chr(10) || 'right low'), ('p2', 'b' || chr(10) || 'a')) AS v(page, text)""")
def issue_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("p1", 100.0, 60.0, 10.0, 0, "right top"), ("p1", 100.0, 5.0, 90.0, 1, "left low"), ("p1", 100.0, 0.0, 1.0, 2, "title"), ("p1", 100.0, 50.0, 80.0, 3, "right low"), ("p1", 100.0, 5.0, 10.0, 4, "left top"), ("p1", 100.0, 5.0, 50.0, 5, ""), ("p2", None, 5.0, 9.0, 0, "a"), ("p2", None, 90.0, 1.0, 1, "b")]
    return segment.reflow(spark.createDataFrame(rows, "page string, width double, hpos double, vpos double, seq int, txt string"), ["page"])


@query("""
SELECT * FROM (VALUES (1, '1952-11-21-2', 'amend'), (2, '1999-03-26-14', 'repeal'), (3, NULL, 'original')) AS v(id, law, class)""")
def law_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, "om endringer i lov 21. november 1952 nr. 2om x"), (2, "om opphevelse av Lov av 26 mars 1999 nr 14"), (3, "om noe annet")]
    df = spark.createDataFrame(rows, "id int, title string")
    return df.select("id", t.law_id(F.col("title")).alias("law"), t.act_class(F.col("title")).alias("class"))


def values(columns: str, rows: list[tuple]) -> str:
    """A SELECT of literal rows; a column's type stands behind its name."""

    def literal(x: object) -> str:
        return "NULL" if x is None else str(x).upper() if isinstance(x, bool) else repr(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'"

    named = [c.strip().split(" ") for c in columns.split(",")]
    body = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    return "SELECT " + ", ".join(f'CAST("{n}" AS {k}) AS "{n}"' for n, k in named) + f" FROM (VALUES {body}) AS v(" + ", ".join(f'"{n}"' for n, _ in named) + ")"


def golden(columns: str, rows: list[tuple]):
    def add(f: Query) -> Query:
        return query(values(columns, rows))(f)

    return add


_ISSUE = "Nr. 3 - 1991\nInnhold\nmai 3. Lov nr. 7 om endringer i lov 3. mai 1980 nr. 2 om x\njuni 5. Lov nr. 9 om vern\nmai 3. Lov nr. 7 om noe annet\n"
_BODY = "Lov nr. 9 \nfor tidlig\nLov nr. 7 \nen\nLov nr. 7 \nhode igjen\nLov nr. 9 \nto"


def _issues(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame([("i", _ISSUE, _BODY)], "issue string, toc string, text string")
    return df.withColumn("year", t.issue_year(F.col("toc")))


@golden("issue VARCHAR, nr INTEGER, date VARCHAR, klass VARCHAR, target VARCHAR, title VARCHAR", [("i", 7, "1991-05-03", "amend", "1980-05-03-2", "om endringer i lov 3. mai 1980 nr. 2 om x"), ("i", 9, "1991-06-05", "original", None, "om vern")])
def issue_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.contents(_issues(spark), ["issue"], "toc", "year")


@golden("issue VARCHAR, nr INTEGER, body VARCHAR", [("i", 7, "Lov nr. 7 \nen\nLov nr. 7 \nhode igjen\n"), ("i", 9, "Lov nr. 9 \nto")])
def issue_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = _issues(spark)
    return segment.bodies(issues, ["issue"], "text", segment.contents(issues, ["issue"], "toc", "year"))


@golden(
    "act VARCHAR, n INTEGER, para VARCHAR, unit VARCHAR, action VARCHAR, new_text VARCHAR, instruction VARCHAR, change VARCHAR",
    [
        ("a", 0, "§4", "Frister nytt pkt. a", "set", "Som regel settes fristen.", "§4 Frister nytt pkt. a skal lyde", "ENDR"), ("a", 1, "§4", "pkt. b", "repeal", None, "§4 pkt. b oppheves", "OPPH"),
        ("b", 0, "", "hele loven", "repeal", None, "hele loven oppheves", "OPPH"), ("c", 0, "§14", "annet ledd", "set", "Ny tekst", "§14 annet ledd skal lyde", "ENDR"),
    ],
)
def gazette_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("a", "§ 4 Frister nytt pkt. a skal lyde:\nSom regel settes fristen.\n§ 4 pkt. b oppheves.\nEndringene trer i kraft straks."), ("b", "Lov 3. mai 1950 nr. 2 om ting oppheves."), ("c", "I loven skal § l4 anne t ledd lyde: Ny tekst /\nII\n")]
    ops = segment.free_text_ops(spark.createDataFrame(rows, "act string, text string"), ["act"], "text")
    return ops.withColumn("instruction", t.instruction_of(F.col("para"), F.col("unit"), F.col("action"))).withColumn("change", t.change_of_action(F.col("action"), F.col("unit")))


_ACT = """<p>I lov 13. juni 1997 nr. 44 gjøres følgende endringer:</p>
<article class="defaultP">§ 1-1 Skal lyde:</article><article class="legalP">Ny tekst <li data-li-identifier="a)">en</li></article>
<article class="defaultP">§ 2-2 annet ledd oppheves.</article>
<p>Lov av 3 mai 2000 nr 7 gjøres følgende endringer:</p><article class="defaultP">Ny § 9: Skal lyde:</article><article>Helt ny.</article>"""


@golden(
    "act VARCHAR, n INTEGER, target_law VARCHAR, change_type VARCHAR, instruction VARCHAR, new_text VARCHAR",
    [("x", 0, "1997-06-13-44", "change", "§ 1-1 Skal lyde:", "§ 1-1. Ny tekst a) en"), ("x", 1, "1997-06-13-44", "repeal", "§ 2-2 annet ledd oppheves.", None), ("x", 2, "2000-05-03-7", "add", "Ny § 9: Skal lyde:", "§ 9. Helt ny.")],
)
def act_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.structured_ops(spark.createDataFrame([("x", _ACT)], "act string, raw string"), ["act"], "raw")


@golden("act VARCHAR, n INTEGER, target_law VARCHAR, term_old VARCHAR, term_new VARCHAR", [("x", 0, "2000-05-03-7", "C", "D"), ("x", 1, "2000-05-03-7", "A", "B")])
def act_term_reforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "I lov 3. mai 2000 nr. 7 endres «A» til «B». Uttrykket «C» endres til «D». «§ 5» erstattes med «§ 6». «A» erstattes med «B»"
    return segment.term_reforms(spark.createDataFrame([("x", text)], "act string, text string"), ["act"], "text")


@golden("law VARCHAR, n INTEGER, amending VARCHAR", [("x", 0, "1999-01-02-1"), ("x", 1, "2000-05-03-7")])
def annotation_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "<p>Endret ved lover 3 mai 2000 nr. 7 (ikr. iflg. res. 4 juni 2000 nr. 9), 2 jan 1999 nr. 1</p>"
    return segment.amending_laws(spark.createDataFrame([("x", text)], "id string, text string"), ["id"], "text").select(F.col("id").alias("law"), "n", F.col("law").alias("amending"))


_CURRENT = '<title>Lov A</title><a data-lovdata-URL="NL/lov/2000-01-01-1/§1"></a><article class="changesToParent">Endret ved <a href="lov/2001-01-01-2">x</a> (ikr. 1 juli 2002 iflg. <a href="forskrift/2002-05-9">r</a>)</article><a data-lovdata-URL="NL/lov/1999-09-09-9/§7"></a><article class="changesToParent">Opphevet ved <a href="lov/2000-01-01-1">selv</a>, <a href="lov/2003-01-01-3">y</a></article>'


@golden(
    "act_id VARCHAR, act_title VARCHAR, target_law VARCHAR, provision VARCHAR, change_type VARCHAR, in_force VARCHAR, source_ref VARCHAR",
    [("lov/2001-01-01-2", "Lov B", "lov/2000-01-01-1", "§1", "change", "1 juli 2002 iflg. r", "forskrift/2002-05-9"), ("lov/2003-01-01-3", None, "lov/2000-01-01-1", "§1", "repeal", None, None)],
)
def register_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = spark.createDataFrame([("2000-01-01-1", _CURRENT), ("2001-01-01-2", "<title>Lov B</title>")], "law string, raw string")
    return register.edges(sources).select("act_id", "act_title", "target_law", "provision", "change_type", "in_force", "source_ref")


@golden("act INTEGER, law VARCHAR, n BIGINT", [(1, "2000-05-03-7", 2)])
def citing_acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = spark.createDataFrame([(1, "lov 3. mai 2000 nr. 7 og lov 3. mai 2000 nr. 7"), (2, "lov 3. mai 2000 nr. 8, lov 3. mai 2000 nr. 7")], "act int, text string")
    return register.citing(texts, spark.createDataFrame([("2000-05-03-7",)], "law string"), "act", "text", 2)


@golden(
    "s VARCHAR, para VARCHAR, change_type VARCHAR, instruction VARCHAR, new_text VARCHAR, flag VARCHAR",
    [("s", "§1", "change", "§ 1 skal lyde:", "Ny tekst her.", None), ("s", "§2", "repeal", "§ 2 oppheves", None, None), ("s", "§3", "add", "§ 3 første ledd skal lyde:", None, "anchor-not-found")],
)
def verified_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = spark.createDataFrame([("s", "§ 1 skal  lyde:\nNy\ttekst  her. § 2 oppheves.")], "s string, section string")
    quoted = spark.createDataFrame([("s", 0, "1", "", "replace", "Ny tekst", "her."), ("s", 1, "2", "", "repeal", "", ""), ("s", 2, "3", "første ledd", "insert", "finnes", "ikke")], "s string, n int, para string, unit string, kind string, head string, tail string")
    return segment.verified_ops(sections, quoted, ["s"])


@golden(
    "act VARCHAR, target_law VARCHAR, section VARCHAR, reason VARCHAR, anchor VARCHAR, cite VARCHAR",
    [("a", "2000-05-03-7", "I lov  3. mai 2000 nr. 7 endres. ", None, None, None), ("a", "2000-05-03-8", "I lov 2000-05-03-8 endres.", None, None, None), ("a", None, None, "cite-not-in-anchor", "I lov x", "y"), ("a", None, None, "anchor-not-found", "mangler helt", "mangler")],
)
def located_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = spark.createDataFrame([("a", "Innledning. I lov  3. mai 2000 nr. 7 endres. I lov 2000-05-03-8 endres.")], "act string, text string")
    mentions = [("I lov 3. mai 2000 nr. 7", "3. mai 2000 nr. 7"), ("I lov 2000-05-03-8 endres.", "2000-05-03-8"), ("I lov x", "y"), ("mangler helt", "mangler")]
    return segment.located_targets(texts, spark.createDataFrame([("a", k, *m) for k, m in enumerate(mentions)], "act string, n int, anchor string, cite string"), ["act"]).drop("place")


@golden("doc VARCHAR, para VARCHAR, line BIGINT, kept BOOLEAN", [("d", "§1", 5, True), ("d", "§2", 5, False), ("d", "§1", 7, False), ("d", "§", 8, False), ("d", "§3", 9, True)])
def boundary_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = spark.createDataFrame([("d", 5, "§ 1"), ("d", 5, "§ 2"), ("d", 7, "§1"), ("d", 8, "§"), ("d", 9, "S3")], "doc string, line int, para string")
    return segment.repaired_boundaries(marks, ["doc"])


@golden("law VARCHAR, n INTEGER, para VARCHAR, text VARCHAR", [("x", 0, "§1", "Formål\n(1) En\n(2) To"), ("x", 1, "§3a", "Tekst")])
def xml_provisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = '<article class="legalArticle" data-name="§1" id="P1"><h3 class="legalArticleHeader">§ 1 Formål</h3><article class="legalP" id="P1-ledd-1">(1) En</article><article class="legalP" id="P1-ledd-2">(2) To</article></article><article class="futureLegalArticle" data-name="§2" id="P2">x</article><article class="legalArticle" data-name="§ 3 a" id="P3">§ 3a Tekst</article>'
    return segment.structured_provisions(spark.createDataFrame([("x", raw)], "law string, raw string"), ["law"], "raw")


@golden("law VARCHAR, n INTEGER, para VARCHAR, text VARCHAR", [("x", 0, "§1-2", "Tekst her"), ("x", 1, "§3", "Mer Sats 5")])
def html_provisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = '<a name="_1-2">§ 1-2. Tekst&#xa0;her</a><table><tr><td>1</td><td>Se § 5</td></tr></table><a name="_3">§ 3.1 Mer<table><tr><td>Sats</td><td>5</td></tr></table><a name="_1-2">igjen'
    return segment.anchored_provisions(spark.createDataFrame([("x", page)], "law string, page string"), ["law"], "page")


@golden("law VARCHAR, n INTEGER, para VARCHAR, text VARCHAR", [("x", 0, "§1-1", "Forste tekst."), ("x", 1, "§1-2", "Andre se § 1 her.")])
def ocr_provisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "§ 1 — 1. Förste  tekst.\n§1- 2 Andre se § 1 her."
    return segment.ocr_provisions(spark.createDataFrame([("x", text)], "law string, text string"), ["law"], "text", repair=True)


@golden("law VARCHAR, para VARCHAR, date VARCHAR, text VARCHAR, acts INTEGER", [("1999-01-01-1", "§1", "1999-01-01", "gammel en", 0), ("1999-01-01-1", "§1", "2001-06-01", "Ny en.", 1), ("1999-01-01-1", "§2", "1999-01-01", "gammel to", 0), ("1999-01-01-1", "§4", "1999-01-01", _STATUTE, 0), ("1999-01-01-1", "§4", "2004-06-01", "Tittel\n(1) Alfa en. Alfa to.\n(2) Beta en.", 1), ("1999-01-01-1", "§4", "2005-06-01", "Tittel\n(1) Alfa en. Alfa endret.\n(2) Beta en.", 1), ("1999-01-01-1", "§9a", "2003-06-01", "nytt innhold", 1)])
def version_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    bases, raw = _statutes(spark)
    folded = fold.fold(bases.select("law", "para", "text"), oplog.load(raw, 2)).where("law = '1999-01-01-1'")
    made = history.histories(folded, spark.createDataFrame([("1999-01-01-1", "1999-01-01")], "law string, enacted string"), bases)
    return made.select("law", "para", F.explode("versions").alias("v")).select("law", "para", "v.date", "v.text", F.size("v.src").alias("acts"))


def _scored(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    schema = "law string, para string, text string"
    current = spark.createDataFrame([("L", "§1", "ny tekst"), ("L", "§2", "(Opphevet)"), ("L", "§a1", "annex"), ("L", "§3", "helt annet innhold"), ("M", "§1", "samme ord")], schema)
    recon = spark.createDataFrame([("L", "§1", "gammel ordlyd"), ("L", "§3", "Helt annet  innhold. Endret ved lov"), ("M", "§1", "samme orð")], schema)
    return recon, current, spark.createDataFrame([("L", False), ("M", True)], "law string, is_ocr boolean")


@golden("matched BIGINT, strict BIGINT, total BIGINT, annex BIGINT, repealed BIGINT, matched_rate DOUBLE, strict_rate DOUBLE", [(2, 1, 3, 1, 1, 0.666667, 0.333333)])
def convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = score.convergence(*_scored(spark))
    return row.withColumn("matched_rate", F.round("matched_rate", 6)).withColumn("strict_rate", F.round("strict_rate", 6))


@golden("law VARCHAR, para VARCHAR, bucket VARCHAR", [("L", "§1", "engine-gap:ledd"), ("L", "§2", "base-missing"), ("L", "§a1", "base-missing")])
def miss_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    recon, current, ocr = _scored(spark)
    scored = score.compared(recon, current, ["law", "para"])
    ops = spark.createDataFrame([("L", "§1", "subprovision", "§ 1 første ledd")], "law string, para string, kind string, instruction string")
    return score.misses(scored, current, ops, spark.createDataFrame([("L", "§1")], "law string, para string"), F.lit(score.OCR)).select("law", "para", "bucket")


@golden("law VARCHAR, para VARCHAR", [("L", "§1")])
def contaminated_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, current, _ = _scored(spark)
    ops = spark.createDataFrame([("L", "§1", "2005"), ("M", "§1", "1990")], "law string, para string, date string")
    snapshots = spark.createDataFrame([("M", "1995")], "law string, base_as_of string")
    return score.contaminated(current, current, ops, snapshots).select("law", "para")


@golden("id VARCHAR, year INTEGER, pages INTEGER", [("d", 1995, 2), ("a", 1991, 5)])
def catalogue_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("a", "Norsk Lovtidend Avd. I 1991", "1991", 5, True), ("b", "Norsk Lovtidend Avd. II", "1991", 5, True), ("c", "Norsk Lovtidend Avd. I", "1875", 5, True), ("d", "Norsk Lovtidend Avd. I", "1995", 2, True), ("e", "Norsk Lovtidend Avd. I", "1995", 0, True)]
    return readers.worklist(spark.createDataFrame(rows, "id string, title string, issued string, pageCount int, isDigital boolean")).select("id", "year", "pages")


@golden("issue VARCHAR, page INTEGER, text VARCHAR", [("i", 2, "her står Lov om X § 1")])
def find_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.createDataFrame([("i", 1, "Lov om X uten"), ("i", 3, "Lov om X § 2"), ("i", 2, "her står Lov om X § 1")], "issue string, page int, text string")
    return segment.find_page(pages, ["issue"], "Lov om X", "§")


@golden("x INTEGER, para VARCHAR, new_text VARCHAR", [(1, "§1-1", "§ 1-1. En."), (1, "§1-2", "§ 1-2. To jf. § 9. x"), (2, "§5", "§ 5. Tre."), (2, "§6", "§ 6. Fire se § 7 her."), (3, None, "bare tekst")])
def block_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, "§ 1-1. En.\n§ 1-2. To jf. § 9. x"), (2, "Kapittel 3 Navn § 5. Tre. § 6. Fire se § 7 her."), (3, "bare tekst")], "x int, payload string")
    whole = F.array(F.struct(F.lit(None).cast("string").alias("para"), F.col("payload").alias("new_text")))
    return rows.select("x", F.explode(F.coalesce(oplog.pieces_of(F.col("payload")), whole)).alias("p")).select("x", "p.para", "p.new_text")
