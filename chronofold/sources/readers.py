"""Readers of the library's inputs. Schemas are declared, so nothing is read twice to guess them."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofold.core import schema
from chronofold.functions import text as t
from chronofold.operators import segment


def bases(spark: SparkSession, path: str) -> DataFrame:
    """Base documents (law, para, ordinal, text, is_ocr, base_as_of) from JSON files of one law each."""
    raw = spark.read.schema(schema.BASE).json(path, multiLine=True)
    rows = raw.select(t.law_of_ref(F.col("datokode")).alias("law"), F.col("source.lti").isNull().alias("is_ocr"), "base_as_of", F.posexplode("provisions").alias("ordinal", "para", "text"))
    return rows.select("law", "para", "ordinal", "text", "is_ocr", "base_as_of")


def by_line(raw: DataFrame) -> DataFrame:
    """Rows of text files with ``line_no``, which rises with the file's name and the place in it, however files are split or packed.

    A row's number in its task rises with the line within each piece of a file; the pieces, a row for each split, are
    numbered by name and start.
    """
    placed = raw.withColumns({"_file": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start"), "_row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    order = Window.orderBy("_file", "_start")
    pieces = placed.select("_file", "_start").distinct().withColumn("_piece", F.row_number().over(order))
    return placed.join(F.broadcast(pieces), ["_file", "_start"]).withColumn("line_no", F.shiftleft(F.col("_piece").cast("long"), 33) + F.col("_row")).drop("_file", "_start", "_row", "_piece")


def op_lines(spark: SparkSession, path: str, rank: int) -> tuple[DataFrame, DataFrame]:
    """(raw operations, lines that are none) of a JSON-lines file (plain or gz): with the stream's rank and their lines' order.

    The second, (stream_rank, line_no, line), is for a dead-letter place: a broken tail of an interrupted write is there.
    """
    lines = by_line(spark.read.text(path)).where("trim(value) <> ''")
    row = F.from_json("value", schema.RAW_OP + ", _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    parsed = lines.select(row.alias("r"), "value", "line_no", F.lit(rank).alias("stream_rank"))
    broken = F.col("r").isNull() | F.col("r._broken").isNotNull()
    good = parsed.where(~broken).select("r.*", "line_no", "stream_rank").drop("_broken").withColumn("target_law", t.law_of_ref(F.col("target_law"))).withColumn("act_refid", t.law_of_ref(F.col("act_refid")))
    return good, parsed.where(broken).select("stream_rank", "line_no", F.col("value").alias("line"))


def op_stream(spark: SparkSession, path: str, rank: int) -> DataFrame:
    """The raw operations of ``op_lines`` alone."""
    return op_lines(spark, path, rank)[0]


def overrides(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.OVERRIDE).json(path)


def reforms(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(schema.REFORM).json(path)
    return by_line(raw).withColumn("target_law", t.law_of_ref(F.col("target_law")))


def pages(spark: SparkSession, path: str) -> DataFrame:
    """OCR pages (issue_id, urn, page, text); a gz file cannot be split and is one task."""
    raw = spark.read.schema("urn string, page int, text string").json(path)
    return raw.withColumn("issue_id", F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1)).select("issue_id", "urn", "page", "text")


def catalogue(spark: SparkSession, path: str, first: int = 1877, last: int = 2000) -> DataFrame:
    """The worklist (id, year, title, pages): digital volumes of the gazette's first division, newest first."""
    raw = spark.read.schema(schema.CATALOGUE).json(path, multiLine=True)
    return worklist(raw, first, last)


def worklist(rows: DataFrame, first: int = 1877, last: int = 2000) -> DataFrame:
    year = t.catalogue_year(F.col("issued"), F.col("title"))
    wanted = F.lower("title").contains("lovtiden") & F.col("isDigital") & t.is_first_division(F.col("title")) & year.between(first, last) & (F.col("pageCount") > 0)
    return rows.where(wanted).select("id", year.alias("year"), "title", F.col("pageCount").alias("pages")).orderBy(F.desc("year"), "id")


def whole_files(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Files (law, name, raw), one row each, the law's id from the name."""
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(t.law_id_of_name(name).alias("law"), name.alias("name"), F.decode("content", encoding).alias("raw"))


def truth_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.TRUTH_INDEX).csv(path, header=True)


URN = "URN:NBN"


def first_urn(answer: Column | str) -> Column:
    """The first value that begins with ``URN:NBN`` in a catalogue's JSON answer, however deep; null without one.

    Values are looked at in the order of the document, each with what lies inside it before the next; names of members
    and strings that stand in a list are none. A column's variant sorts its members by name, so the document is walked.
    """

    @F.pandas_udf("string")
    def of(answers: pd.Series) -> pd.Series:
        return answers.map(_first_urn)

    return of(answer)


def _first_urn(answer: str | None) -> str | None:
    try:
        todo = [json.loads(answer or "null")]
    except ValueError:
        return None
    while todo:  # a stack with the next value on top
        value = todo.pop()
        if isinstance(value, str):
            if value.startswith(URN):
                return value
        elif isinstance(value, dict):
            todo.extend(reversed(value.values()))
        elif isinstance(value, list):
            todo.extend(x for x in reversed(value) if not isinstance(x, str))
    return None


def page_count(manifest: str):
    """The pages of a manifest: the canvases of its first sequence."""
    return F.size(F.from_json(F.col(manifest), "sequences array<struct<canvases: array<string>>>")["sequences"][0]["canvases"])


def candidates(current: DataFrame, structured: DataFrame, held: DataFrame) -> DataFrame:
    """Laws (law) with current text and a structured act, without those held out."""
    return current.select("law").intersect(structured.select("law")).join(held.select("law"), "law", "left_anti")


# ---- bases and truth out of files


def versioned_files(spark: SparkSession, path: str) -> DataFrame:
    """Truth files (law, date, kind, raw) at ``<path>/<law>/<date>.html`` or ``.txt``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    return files.select(F.element_at(parts, -2).alias("law"), F.regexp_replace(name, "[.][^.]*$", "").alias("date"), F.element_at(F.split(name, "[.]"), -1).alias("kind"), F.decode("content", "UTF-8").alias("raw")).where("kind IN ('html', 'txt')")


def truth_versions(files: DataFrame, index: DataFrame) -> DataFrame:
    """Provisions (law, date, para, text) of the versions that an index (datokode, valid_from_date) lists.

    Of a version's files (law, date, kind, raw) the export in HTML holds before the plain text. A version without a file
    is left out, one listed twice counts once, and the first text of an id holds.
    """
    listed = index.select(F.col("datokode").alias("law"), F.col("valid_from_date").alias("date")).distinct()
    best = files.join(listed, ["law", "date"]).groupBy("law", "date").agg(F.min_by(F.struct("kind", "raw"), F.struct(F.col("kind") != "html", "kind")).alias("f")).select("law", "date", "f.*")
    key = ["law", "date"]
    exported = segment.anchored_provisions(best.where("kind = 'html'"), key, "raw")
    plain = segment.plain_provisions(best.where("kind = 'txt'"), key, "raw")
    return exported.unionByName(plain).select(*key, "para", "text")


def act_bases(files: DataFrame) -> DataFrame:
    """Bases out of clean acts (law, raw XML)."""
    rows = segment.structured_provisions(files, ["law"], "raw")
    return _as_base(rows, ocr=False)


def booklet_bases(pages: DataFrame, places: DataFrame) -> DataFrame:
    """Bases out of booklets: ``places`` has (law, urn, page, span, title_needle, base_as_of), ``pages`` (urn, page, text).

    The text begins at the title; a page that failed counts as empty; a booklet without its title has no base. What a
    booklet prints is the law as of ``base_as_of``.
    """
    text = _spans(pages, places)
    at = F.expr("instr(text, title_needle)")
    found = text.where(at > 0).select("law", "base_as_of", F.substring(F.col("text"), at, F.length("text")).alias("text"))
    return _as_base(segment.ocr_provisions(found, ["law", "base_as_of"], "text", repair=True), ocr=True)


def issue_bases(pages: DataFrame, places: DataFrame) -> DataFrame:
    """Bases out of gazette issues: ``places`` has (law, urn, page, span, title_needle, end_needle)."""
    text = segment.law_texts(_spans(pages, places), ["law"], "text", "title_needle", "end_needle")
    return _as_base(segment.ocr_provisions(text, ["law"], "text"), ocr=True)


def first_base(*ranked: DataFrame) -> DataFrame:
    """Every law's base from the first source that has one; sources are given in order of trust."""
    out = ranked[0]
    for more in ranked[1:]:
        out = out.unionByName(more.join(out.select("law").distinct(), "law", "left_anti"))
    return out


def _spans(pages: DataFrame, places: DataFrame) -> DataFrame:
    """Places with the text of their pages, one page below the other."""
    rest = [c for c in places.columns if c not in ("law", "urn", "page", "span")]
    wanted = places.select("law", "urn", *rest, F.explode(F.sequence(F.col("page"), F.col("page") + F.col("span") - 1)).alias("page"))
    return segment.issue_text(wanted.join(pages.select("urn", "page", "text"), ["urn", "page"], "left"), ["law", *rest])


def _as_base(rows: DataFrame, ocr: bool) -> DataFrame:
    when = F.col("base_as_of") if "base_as_of" in rows.columns else F.lit(None).cast("string")
    return rows.select("law", "para", F.col("n").alias("ordinal"), "text", F.lit(ocr).alias("is_ocr"), when.alias("base_as_of"))
