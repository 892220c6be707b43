"""Queries of what builds bases, truth and the log: every document becomes a source file by expression, whole.

``WORDS`` keeps a text's letters only, so that what the parsers take as their own marks cannot stand in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.operators import oplog, segment
from chronofold.plans.queries import query, table
from chronofold.sources import readers

WORDS = "trim(regexp_replace(lower(coalesce(text, '')), '[^a-z]+', ' ', 'g'))"
TITLE = "Lov om ting og tang og andre saker som denne loven gjelder"


def _words() -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+", " "))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "text", _words().alias("words"))


def digest(column: str) -> Column:
    return F.md5(F.col(column).cast("binary"))


CUT = 400
_WHOLE = r"'§ ' || doc_id || '.Tittel' || chr(10) || trim(regexp_replace(text, '[ \t\r\n\f\v]+', ' ', 'g'))"


@query(f"""
WITH acts AS (SELECT doc_id, source, {_WHOLE} AS whole FROM documents WHERE length({_WHOLE}) >= {CUT})
SELECT doc_id, source AS law, CASE WHEN reason IS NULL THEN md5(whole) END AS digest, reason FROM (
  SELECT *, CASE WHEN doc_id % 5 = 0 THEN 'no-source' WHEN doc_id % 7 = 0 THEN 'instruction-not-found' WHEN doc_id % 11 = 0 THEN 'no-block-fits' END AS reason FROM acts)""")
def rederived_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is an act that replaces a provision; its operation was cut at 400 characters."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    number = F.col("doc_id").cast("string")
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    said = F.concat(F.lit("§ "), number, F.lit(" skal lyde:"))
    raw = F.concat(
        F.lit('<section><article class="defaultP">'), F.when(F.col("doc_id") % 7 == 0, F.lit("Noe annet:")).otherwise(said), F.lit('</article><article class="futureLegalArticle" data-name="§'), number,
        F.lit('" id="p"><span class="legalArticleTitle">Tittel</span><article class="legalP" id="p-ledd-1">'), escaped, F.lit("</article></article></section><section>"),
    )
    acts = docs.where("doc_id % 5 <> 0").select(number.alias("act"), raw.alias("raw"))
    squeezed = F.trim(F.regexp_replace("text", r"[ \t\r\n\f\x0B]+", " "))
    whole = F.concat(F.lit("§ "), number, F.lit(".Tittel\n"), squeezed)
    head = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("X"), F.substring(whole, 2, CUT - 1))).otherwise(F.substring(whole, 1, CUT))
    ops = docs.select(number.alias("act"), F.col("source").alias("law"), said.alias("instruction"), head.alias("new_text"))
    found = oplog.rederived(ops, acts, segment.replacement_blocks(acts, ["act"], "raw"), CUT)
    return found.select(F.col("act").cast("long").alias("doc_id"), "law", digest("new_text").alias("digest"), "reason")


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An issue for each document: an amending act that words a paragraph by it, and a new law, whose body two in three have."""
    listed = "Innhold\nmai 3. Lov nr. 7 om endringer i lov 3. mai 1980 nr. 2 om x\njuni 5. Lov nr. 9 om vern"
    last = F.when(F.col("doc_id") % 3 > 0, F.lit("\nLov nr. 9 \n§ 1 er ny.")).otherwise(F.lit(""))
    body = F.concat(F.lit("Lov nr. 7 \n§ 4 annet ledd skal lyde:\n"), "words", last)
    return _documents(spark, sf_dir).select("doc_id", F.lit(1991).alias("year"), F.lit(listed).alias("toc"), body.alias("text"))


@query(f"""
SELECT doc_id, 'lov/1991-05-03-7' AS act_refid, 'lov/1980-05-03-2' AS target_law, 'annet ledd' AS target, '§4' AS paragraph, 'ENDR' AS change_type,
       '§4 annet ledd skal lyde' AS instruction, md5({WORDS}) AS digest, '1991-05-03' AS date FROM documents WHERE {WORDS} <> ''""")
def gazette_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    acts = segment.issue_acts(_issues(spark, sf_dir), ["doc_id"], "toc", "text", "year")
    rows = segment.gazette_rows(acts, ["doc_id"])
    return rows.select("doc_id", "act_refid", "target_law", "target", "paragraph", "change_type", "instruction", digest("new_text").alias("digest"), F.col("date_in_force_resolved").alias("date"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN 2 ELSE 1 END AS n, true AS increasing, 0 AS bleeding, true AS ok FROM documents")
def issue_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = _issues(spark, sf_dir)
    checked = segment.boundary_check(issues, ["doc_id"], "text", segment.contents(issues, ["doc_id"], "toc", "year"))
    return checked.select("doc_id", "n", "increasing", F.size("bleed").alias("bleeding"), "ok")


@query(f"""
SELECT doc_id, para, md5(CASE WHEN para = '§2' THEN 'slutt' WHEN doc_id % 2 = 0 THEN {WORDS} ELSE trim('tekst ' || {WORDS}) END) AS digest
FROM documents, (VALUES ('§1'), ('§2')) AS v(para) WHERE doc_id % 3 <> 0""")
def truth_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is a version of a law as plain text, every other one as an export too, which holds before it."""
    docs = _documents(spark, sf_dir).withColumn("law", F.col("doc_id").cast("string")).withColumn("date", F.lit("2001-01-01"))
    page = F.concat(F.lit('<p><a name="_1"></a>§ 1. '), "words", F.lit('</p><a name="_2"></a><b>§ 2.</b> slutt'))
    plain = F.concat(F.lit("§ 1 tekst "), "words", F.lit("\n§ 2 slutt § 1 igjen"))
    files = docs.where("doc_id % 2 = 0").select("law", "date", F.lit("html").alias("kind"), page.alias("raw")).unionByName(docs.select("law", "date", F.lit("txt").alias("kind"), plain.alias("raw")))
    index = docs.where("doc_id % 3 <> 0").select(F.col("law").alias("datokode"), F.col("date").alias("valid_from_date"))
    return readers.truth_versions(files, index).select(F.col("law").cast("long").alias("doc_id"), "para", digest("text").alias("digest"))


@query(f"""
WITH laws AS (SELECT doc_id, {WORDS} AS words, CASE WHEN doc_id % 3 = 0 THEN 'act' WHEN doc_id % 3 = 1 THEN 'booklet' ELSE 'issue' END AS kind FROM documents)
SELECT doc_id, para, md5(CASE WHEN para = '§1' AND kind = 'act' THEN chr(10) || words WHEN para = '§1' THEN words ELSE 'slutt' END) AS digest, kind <> 'act' AS is_ocr,
       CASE WHEN kind = 'booklet' THEN '1993-01-01' END AS base_as_of
FROM laws, (VALUES ('§1'), ('§2')) AS v(para) WHERE CASE kind WHEN 'act' THEN para = '§1' AND words <> '' ELSE para = '§2' OR words <> '' END""")
def bases_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is a law in an issue, two in three are booklets too, one in three of them is a clean act as well."""
    docs = _documents(spark, sf_dir).withColumn("law", F.col("doc_id").cast("string"))
    act = F.concat(F.lit('<article class="legalArticle" data-name="§1" id="p"><article class="legalP" id="p-ledd-1">'), "words", F.lit("</article></article>"))
    acts = readers.act_bases(docs.where("doc_id % 3 = 0 AND words <> ''").select("law", act.alias("raw")))
    page = lambda n, text: docs.select(F.col("law").alias("urn"), F.lit(n).alias("page"), text.alias("text"))
    first = F.concat(F.lit(f"forord\n{TITLE}\n§ 1. "), "words")
    pages = page(1, first).unionByName(page(2, F.lit("§ 2. slutt"))).unionByName(page(4, F.lit("3. mai Lov nr. 4\n12\nLov om noe annet\n§ 3. etter")))
    spot = lambda rows, span: rows.select("law", F.col("law").alias("urn"), F.lit(1).alias("page"), F.lit(span).alias("span"), F.lit(TITLE).alias("title_needle"))
    booklets = readers.booklet_bases(pages, spot(docs.where("doc_id % 3 = 1"), 3).withColumn("base_as_of", F.lit("1993-01-01")))
    issues = readers.issue_bases(pages, spot(docs.where("doc_id % 3 <> 0"), 4).withColumn("end_needle", F.lit(None).cast("string")))
    found = readers.first_base(acts, booklets, issues)
    return found.select(F.col("law").cast("long").alias("doc_id"), "para", digest("text").alias("digest"), "is_ocr", "base_as_of")


@query(r"""
WITH cut AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
marked AS (SELECT doc_id, parts, unnest([1, 2, 3]) AS k FROM cut),
sliced AS (SELECT doc_id, k, trim(regexp_replace(array_to_string(CASE k WHEN 1 THEN parts[1:1] WHEN 2 THEN parts[2:3] ELSE parts[4:] END, ' '), '\s+', ' ', 'g')) AS body, coalesce(parts[CASE k WHEN 3 THEN 4 ELSE k END], '') AS head FROM marked)
SELECT doc_id, (k - 1)::INTEGER AS n, '§' || k AS para, md5(body) AS digest, true AS verbatim, contains(head, k::VARCHAR) AS heading_fits FROM sliced""")
def sliced_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines 1, 2 and 4 of every document begin a provision; a second mark on line 2 and a second ``§1`` are repaired away."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text")
    marks = F.array(*(F.struct(F.lit(line).alias("line"), F.lit(para).alias("para")) for line, para in ((1, "§ 1"), (2, "§ 2"), (2, "§ 5"), (3, "§1"), (4, "3"))))
    boundaries = docs.select("doc_id", F.explode(marks).alias("m")).select("doc_id", "m.line", "m.para")
    found = segment.sliced_provisions(docs, boundaries, ["doc_id"])
    return found.select("doc_id", "n", "para", digest("text").alias("digest"), "verbatim", "heading_fits")
