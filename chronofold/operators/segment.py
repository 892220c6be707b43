"""Texts into parts: lines, sentences, windows, slices between marks, columns, provisions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.core import acts, issue, subdoc
from chronofold.core.wording import MONTHS, SHORT_MONTHS
from chronofold.functions import text as t


def split_into(rows: DataFrame, text: str, pattern: str, to: str = "part", at: str = "at") -> DataFrame:
    """A row for each piece between matches of a pattern."""
    return rows.select(*[c for c in rows.columns if c != text], F.posexplode(F.split(text, pattern)).alias(at, to))


def windows(rows: DataFrame, text: str, size: int = 18_000, overlap: int = 1_500, to: str = "chunk") -> DataFrame:
    """Overlapping windows of a text as rows with ``start``; a window that would begin within the last overlap is none."""
    step = size - overlap
    n = F.length(text)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step)), lambda c: (n > 0) & ((c == 0) | (c + overlap < n)))
    cut = rows.where(F.length(text) > 0).withColumn("start", F.explode(starts))
    return cut.withColumn(to, F.substring(F.col(text), F.col("start") + 1, F.lit(size))).drop(text)


def slices(marks: DataFrame, key: list[str], position: str, length: Column, order: list[str] | None = None) -> DataFrame:
    """``marks`` with ``slice_end``: the key's next mark, else the text's length."""
    line = Window.partitionBy(*key).orderBy(*(order or [position]))
    return marks.withColumn("slice_end", F.coalesce(F.lead(position).over(line), length))


def marker_ids(text: Column) -> Column:
    """Ids ``§N`` in order of their first appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"§\s*(\d+(?:-\d+)?[a-z]?)"), F.lit(1)), lambda x: F.concat(F.lit("§"), x)))


def numbered_parts(text: Column) -> Column:
    """The parts (n, text) of ``(1) ... (2) ...``; none without a marker."""
    numbers = F.regexp_extract_all(text, F.lit(r"\((\d+)\)\s*"), F.lit(1))
    parts = F.slice(F.split(text, r"\(\d+\)\s*"), 2, F.greatest(F.size(numbers), F.lit(0)))
    return F.zip_with(numbers, parts, lambda n, p: F.struct(n.cast("int").alias("n"), F.trim(p).alias("text")))


def first_of_each(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The key's first row by ``order``."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*key, "r.*").select(rows.columns)


def nearest_before(marks: DataFrame, points: DataFrame, key: list[str], position: str, value: str) -> DataFrame:
    """Each point with ``value`` of the last mark before it under the same key, in one sorted pass; null without one."""
    rest = [c for c in points.columns if c not in (*key, position)]
    left = points.select(*key, position, F.lit(1).alias("_side"), F.struct(*(rest or [position])).alias("_r"), F.lit(None).cast(marks.schema[value].dataType).alias("_v"))
    right = marks.select(*key, position, F.lit(0).alias("_side"), F.lit(None).cast(points.select(F.struct(*(rest or [position]))).schema[0].dataType).alias("_r"), F.col(value).alias("_v"))
    line = Window.partitionBy(*key).orderBy(position, F.desc("_side")).rowsBetween(Window.unboundedPreceding, -1)
    held = left.unionByName(right).withColumn(value, F.last("_v", ignorenulls=True).over(line)).where("_side = 1")
    return held.select(*key, position, *(F.col(f"_r.{c}").alias(c) for c in rest), value)


def reflow(blocks: DataFrame, page: list[str], two_columns: bool = True) -> DataFrame:
    """A page's text from blocks (page, width, hpos, vpos, seq, txt): the left column, then the right one, from the top.

    A block is in the right column from half the page's width on. Without a width, or with ``two_columns`` off, blocks
    go by height, then from the left. Blocks without words are left out.
    """
    right = F.coalesce((F.col("hpos") >= F.col("width") / 2) & F.lit(two_columns), F.lit(False))
    plain = F.col("width").isNull() | ~F.lit(two_columns)
    item = F.struct(right.alias("right"), "vpos", F.when(plain, F.col("hpos")).alias("h"), "seq", "txt")
    return blocks.where("txt IS NOT NULL AND txt <> ''").groupBy(*page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["txt"]), "\n").alias("text"))


def alto_blocks(pages: DataFrame, key: list[str], xml: str) -> DataFrame:
    """Text blocks (key, width, hpos, vpos, seq, txt) of page XML: a line for each text line, its words by blanks."""
    attribute = lambda source, name: F.nullif(F.regexp_extract(source, rf'\b{name}="([^"]*)"', 1), F.lit("")).try_cast("double")
    width = attribute(F.regexp_extract(xml, r"<(?:\w+:)?Page\b[^>]*>", 0), "WIDTH")
    blocks = F.regexp_extract_all(xml, F.lit(r"(?s)<(?:\w+:)?TextBlock\b.*?</(?:\w+:)?TextBlock>"), F.lit(0))
    rows = pages.select(*key, width.alias("width"), F.posexplode(blocks).alias("seq", "b"))
    lines = F.regexp_extract_all("b", F.lit(r"(?s)<(?:\w+:)?TextLine\b.*?</(?:\w+:)?TextLine>"), F.lit(0))
    worded = F.transform(lines, lambda line: F.array_join(F.filter(F.regexp_extract_all(line, F.lit(r'<(?:\w+:)?String\b[^>]*?\bCONTENT="([^"]*)"'), F.lit(1)), lambda w: w != ""), " "))
    text = F.array_join(F.filter(worded, lambda line: line != ""), "\n")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    head = F.regexp_extract("b", r"<(?:\w+:)?TextBlock\b[^>]*>", 0)
    return rows.select(*key, "width", F.coalesce(attribute(head, "HPOS"), F.lit(0.0)).alias("hpos"), F.coalesce(attribute(head, "VPOS"), F.lit(0.0)).alias("vpos"), "seq", text.alias("txt"))


def issue_text(pages: DataFrame, key: list[str], page: str = "page", text: str = "text") -> DataFrame:
    """An issue's pages one after another. An issue is some hundred pages."""
    return pages.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(page, F.coalesce(text, F.lit("")).alias("t")))), lambda x: x["t"]), "\n").alias("text"))


def find_page(pages: DataFrame, key: list[str], needle: str, pattern: str | None = None) -> DataFrame:
    """The first page (page, text) of each key that holds the needle, and the pattern if there is one."""
    hits = pages.where(F.col("text").contains(needle) & (F.col("text").rlike(pattern) if pattern else F.lit(True)))
    return hits.groupBy(*key).agg(F.min("page").alias("page"), F.min_by("text", "page").alias("text"))


def all_pages(wanted: DataFrame, pages: DataFrame, key: list[str]) -> DataFrame:
    """Wanted pages with their text, empty where a page failed."""
    return wanted.join(pages.select(*key, "text"), key, "left").withColumn("text", F.coalesce("text", F.lit("")))


def contents(issues: DataFrame, key: list[str], toc: str, year: str) -> DataFrame:
    """Acts (key, nr, date, klass, target, title) of issues' tables of contents; the first entry of a number holds."""
    listed = _mapped(issues, [*key, year], toc, "nr int, month int, day int, rest string", issue.entries)
    klass = t.act_class(F.col("rest"))
    rows = listed.select(
        *key, "nr", "n",
        F.when(F.col(year).isNotNull(), F.format_string("%s-%02d-%02d", F.col(year).cast("string"), "month", "day")).alias("date"),
        klass.alias("klass"), F.when(klass.isin("amend", "repeal"), t.law_id(F.col("rest"))).alias("target"), F.substring(t.squeeze(F.col("rest")), 1, 200).alias("title"),
    )
    return first_of_each(rows, [*key, "nr"], "n").drop("n")


def _with_numbers(issues: DataFrame, key: list[str], text: str, listed: DataFrame) -> DataFrame:
    """Issues (key, _text) with the numbers that their contents list; some dozens each."""
    return issues.select(*key, F.col(text).alias("_text")).join(listed.groupBy(*key).agg(F.array_sort(F.collect_set("nr")).alias("_nrs")), key)


def bodies(issues: DataFrame, key: list[str], text: str, listed: DataFrame) -> DataFrame:
    """Acts' bodies (key, nr, body): each listed number, in order, from its first heading behind the one chosen before."""

    @F.pandas_udf("array<struct<nr: int, body: string>>")
    def cut(texts: pd.Series, numbers: pd.Series) -> pd.Series:
        return pd.Series([[{"nr": nr, "body": x[a:b]} for nr, a, b in issue.chosen_heads(x or "", list(ns))] for x, ns in zip(texts, numbers, strict=True)])

    return _with_numbers(issues, key, text, listed).select(*key, F.explode(cut("_text", "_nrs")).alias("x")).select(*key, "x.*")


def boundary_check(issues: DataFrame, key: list[str], text: str, listed: DataFrame) -> DataFrame:
    """Issues (key, n, increasing, bleed, ok): how many bodies they have, whether their starts rise, and which acts' bodies
    hold the next act's heading, as an array (nr, next). An issue without a body is ok."""

    @F.pandas_udf("struct<starts: array<struct<nr: int, start: int>>, bleed: array<struct<nr: int, next: int>>>")
    def look(texts: pd.Series, numbers: pd.Series) -> pd.DataFrame:
        rows = []
        for x, ns in zip(texts, numbers, strict=True):
            heads = issue.chosen_heads(x or "", list(ns))
            over = [{"nr": a[0], "next": b[0]} for a, b in zip(heads, heads[1:], strict=False) if issue.bleeds(x, a[1], a[2], b[0])]
            rows.append(([{"nr": nr, "start": start} for nr, start, _ in heads], over))
        return pd.DataFrame(rows, columns=["starts", "bleed"])

    seen = _with_numbers(issues, key, text, listed).select(*key, look("_text", "_nrs").alias("x"))
    rising = F.forall(F.zip_with("x.starts", F.slice("x.starts", 2, F.greatest(F.size("x.starts"), F.lit(1))), lambda a, b: b.isNull() | (a["start"] < b["start"])), lambda y: y)
    return seen.select(*key, F.size("x.starts").alias("n"), rising.alias("increasing"), "x.bleed").withColumn("ok", F.col("increasing") & (F.size("bleed") == 0))


def issue_acts(issues: DataFrame, key: list[str], toc: str, text: str, year: str) -> DataFrame:
    """All acts (key, nr, date, klass, target, title, body) that issues list; the body is empty where no heading is found."""
    listed = contents(issues, key, toc, year)
    return listed.join(bodies(issues, key, text, listed), [*key, "nr"], "left").withColumn("body", F.coalesce("body", F.lit("")))


def gazette_rows(acts_of_issues: DataFrame, key: list[str]) -> DataFrame:
    """The log's raw rows of amending and repealing acts with a target and a body, one for each operation.

    The date of an act is the first guess at when it came into force.
    """
    wanted = acts_of_issues.where("klass IN ('amend', 'repeal') AND target IS NOT NULL AND body <> ''")
    ops = free_text_ops(wanted, [*key, "nr", "date", "title", "target"], "body")
    act = F.concat(F.lit("lov/"), F.coalesce("date", F.lit("?")), F.lit("-"), F.col("nr").cast("string"))
    return ops.select(
        *key, "n", act.alias("act_refid"), F.col("title").alias("act_title"), F.concat(F.lit("lov/"), "target").alias("target_law"),
        F.coalesce(F.nullif("unit", F.lit("")), F.nullif("para", F.lit(""))).alias("target"), F.nullif("para", F.lit("")).alias("paragraph"),
        t.change_of_action(F.col("action"), F.col("unit")).alias("change_type"), t.instruction_of(F.col("para"), F.col("unit"), F.col("action")).alias("instruction"),
        "new_text", F.col("date").alias("date_in_force_resolved"), F.col("date").alias("date_published"),
    )


def law_text(text: Column, needle: str, end_needle: str | None = None) -> Column:
    """One law out of an issue: from its title to an end phrase, or to the next act's heading; null without the title."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else issue.law_text(x, needle, end_needle))

    return cut(text)


def law_texts(issues: DataFrame, key: list[str], text: str, needle: str, end_needle: str) -> DataFrame:
    """``law_text`` with each row's own title and end phrase (null or empty: none); rows without the title go."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, needles: pd.Series, stops: pd.Series) -> pd.Series:
        return pd.Series([issue.law_text(x or "", n, e or None) if n else None for x, n, e in zip(texts, needles, stops, strict=True)], dtype=object)

    return issues.select(*key, cut(F.col(text), F.col(needle), F.coalesce(F.col(end_needle), F.lit(""))).alias(text)).where(F.col(text).isNotNull())


def _numbered_rows(rows: DataFrame, key: list[str], found: Column) -> DataFrame:
    """A row (key, n, fields) for each struct of an array, by its place."""
    return rows.select(*key, F.posexplode(found).alias("n", "x")).select(*key, "n", "x.*")


def plain_provisions(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    """Provisions (key, n, para, text) of a plain text: from each ``§ N`` to the next, the first of an id; white space squeezed.

    The text is split at its signs; a part that no number opens goes on with the one before. A letter right behind the
    number belongs to it.
    """
    number = lambda p: F.regexp_extract(F.ltrim(p), "^[0-9]+(?:-[0-9]+)?[a-z]?", 0)

    def step(a: Column, x: Column) -> Column:
        last = F.element_at(a, -1)
        body = F.ltrim(x["p"])
        opened = F.struct(x["head"].alias("head"), F.substring(body, F.length(x["head"]) + 1, F.length(body)).alias("text"))
        longer = F.struct(last["head"].alias("head"), F.concat(last["text"], F.lit("§"), x["p"]).alias("text"))
        return F.when(x["head"] != "", F.array_append(a, opened)).otherwise(F.concat(F.slice(a, 1, F.size(a) - 1), F.array(longer)))

    # what a step needs is made for each part once; a function within a function would make the whole array anew each time
    marked = F.transform(F.split(t.squeeze(F.coalesce(F.col(text), F.lit(""))), "§"), lambda p, k: F.struct(p.alias("p"), F.when(k > 0, number(p)).otherwise(F.lit("")).alias("head")))
    pieces = F.filter(F.aggregate(marked, F.array(F.struct(F.lit("").alias("head"), F.lit("").alias("text"))), step), lambda x: x["head"] != "")
    named = F.transform(pieces, lambda x: F.struct(F.concat(F.lit("§"), x["head"]).alias("para"), F.trim(x["text"]).alias("text")))
    first = lambda p: F.filter(p, lambda x, k: F.array_position(p["para"], x["para"]) == k + 1)
    return _numbered_rows(rows.select(*key, t.once(named, first).alias("_p")), key, F.col("_p"))


def _cited_sections(text: Column) -> Column:
    """Sections (law, section) of an act as an array: each from the ``I`` before a law that is cited by date to the next.

    The text is split before each ``lov``; a part whose beginning cites a law by date, behind an ``I`` that stands alone,
    opens a section, and the ``I`` with the white space behind it moves there from the part before.
    """
    parts = F.split(text, "(?i)(?=lov)", -1)
    lead = lambda p: F.regexp_extract(p, r"(?U)(?:^|\W)([Ii]\s+)\z", 1)
    second = lambda p: F.coalesce(F.get(F.split(t.squeeze(F.lower(F.substring(p, 1, 80))), " "), F.lit(1)), F.lit(""))
    law = lambda p: F.when(t.begins_with_citation(p) & (second(p) != "av"), t.law_id(F.substring(p, 1, 200)))
    pairs = F.zip_with(F.slice(parts, F.lit(2), F.size(parts)), F.slice(parts, F.lit(1), F.size(parts)), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    marked = F.transform(F.filter(pairs, lambda z: z["p"].isNotNull()), lambda z: F.struct(z["p"].alias("p"), lead(z["p"]).alias("tail"), F.when(lead(z["q"]) != "", law(z["p"])).alias("law")))

    def step(a: Column, x: Column) -> Column:
        last = F.element_at(a, -1)
        closed = F.struct(last["law"].alias("law"), F.left(last["section"], F.length(last["section"]) - F.length(last["tail"])).alias("section"), F.lit("").alias("tail"))
        opened = F.struct(x["law"].alias("law"), F.concat(last["tail"], x["p"]).alias("section"), x["tail"].alias("tail"))
        longer = F.struct(last["law"].alias("law"), F.concat(last["section"], x["p"]).alias("section"), x["tail"].alias("tail"))
        return F.concat(F.slice(a, 1, F.size(a) - 1), F.when(x["law"].isNotNull(), F.array(closed, opened)).otherwise(F.array(longer)))

    first = F.array(F.struct(F.lit(None).cast("string").alias("law"), parts[0].alias("section"), lead(parts[0]).alias("tail")))
    return F.filter(F.aggregate(marked, first, step), lambda s: s["law"].isNotNull())


#: What names a term before its quotation (fixed values).
TERM_WORDS = ("ordet", "uttrykket", "uttrykkene", "betegnelsen")


def _terms_of(law: Column, section: Column) -> Column:
    """The (law, old, new) of a section's quotations, form by form.

    The forms: a word for terms, «A», "endres til", «B»; "endres", «A», "til", «B»; «A», "erstattes med", «B».
    """
    words = lambda g: F.split(t.squeeze(F.lower(g)), " ")
    spaced = lambda g, side: g.rlike(r"(?U)\s\z" if side else r"(?U)^\s")
    bare = lambda q: F.regexp_replace(q, r"(?U)^\s+|\s+\z", "")

    def told(cut: Column) -> Column:
        quotes, gaps = cut["quotes"], cut["gaps"]

        def pair(k: Column) -> Column:
            ahead, behind = F.get(gaps, k), F.get(gaps, k + 1)
            word, said = F.element_at(words(F.when(k > 0, F.concat(F.lit("»"), ahead)).otherwise(ahead)), -1), F.array_join(words(behind), " ")
            named = reduce(or_, (word.endswith(w) for w in TERM_WORDS))
            apart = spaced(ahead, True) & spaced(behind, False) & spaced(behind, True)
            form = F.when(apart & named & said.isin("endre til", "endres til"), 0).when(apart & word.isin("endre", "endres") & (said == "til"), 1).when(spaced(behind, False) & said.isin("erstatte med", "erstattes med"), 2)
            return F.struct(form.alias("form"), k.alias("k"), cut["law"].alias("target_law"), bare(F.get(quotes, k)).alias("term_old"), bare(F.get(quotes, k + 1)).alias("term_new"))

        pairs = F.when(F.size(quotes) > 1, F.transform(F.sequence(F.lit(0), F.size(quotes) - 2), pair))
        fits = F.filter(pairs, lambda x: x["form"].isNotNull() & (x["term_old"] != "") & ~x["term_old"].startswith("§") & (x["term_old"] != x["term_new"]))
        return F.transform(F.array_sort(fits), lambda x: F.struct(x["target_law"].alias("target_law"), x["term_old"].alias("term_old"), x["term_new"].alias("term_new")))

    cut = F.struct(law.alias("law"), F.regexp_extract_all(section, F.lit("«([^»]+)»"), F.lit(1)).alias("quotes"), F.split(section, "«[^»]+»", -1).alias("gaps"))
    return t.once(cut, told)


def repaired_boundaries(rows: DataFrame, key: list[str], line: str = "line", para: str = "para") -> DataFrame:
    """Boundaries with ``kept``: sorted by line, those on a line taken already or of an id kept before are not kept.

    A boundary that is dropped does not claim its id, so this is a scan of each key's boundaries in order.
    """
    item = F.struct(F.col(line).alias("line"), t.quoted_id(F.col(para)).alias("para"))
    lists = rows.groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("b"))
    empty = F.struct(F.lit(0).cast("long").alias("last"), F.array().cast("array<string>").alias("seen"), F.array().cast("array<struct<para:string,line:bigint,kept:boolean>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        keep = (x["line"] > a["last"]) & ~F.array_contains(a["seen"], x["para"]) & (F.replace(x["para"], F.lit("§")) != "")
        entry = F.struct(x["para"].alias("para"), x["line"].cast("long").alias("line"), keep.alias("kept"))
        return F.struct(F.when(keep, x["line"].cast("long")).otherwise(a["last"]).alias("last"), F.when(keep, F.array_append(a["seen"], x["para"])).otherwise(a["seen"]).alias("seen"), F.array_append(a["out"], entry).alias("out"))

    return lists.select(*key, F.explode(F.aggregate("b", empty, step, lambda a: a["out"])).alias("x")).select(*key, "x.para", "x.line", "x.kept")


# ---- rules that need a text as a whole: Arrow functions over the rows


def _mapped(rows: DataFrame, key: list[str], text: str, schema: str, of: Callable[[str], list[tuple]]) -> DataFrame:
    """The rows that a pure function makes of each text, under the text's key; an Arrow batch at a time."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in key)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(*row[:-1], n, *made) for row in frame[[*key, text]].itertuples(index=False) for n, made in enumerate(of(row[-1] or ""))]
            yield pd.DataFrame(out, columns=[*key, "n", *names])

    return rows.select(*key, text).mapInPandas(run, f"{kinds}, n int, {schema}")


def sentences(text: Column) -> Column:
    """A text's sentences as an array, as the sub-document editor counts them; null stays null."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else subdoc.sentences(x))

    return cut(text)


def free_text_ops(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    """Operations (key, n, para, unit, action, new_text) of gazette acts."""
    return _mapped(rows, key, text, "para string, unit string, action string, new_text string", acts.free_text_ops)


def structured_ops(rows: DataFrame, key: list[str], raw: str, whole_only: bool = True) -> DataFrame:
    """Operations (key, n, target_law, change_type, instruction, new_text) of act XML."""
    return _mapped(rows, key, raw, "target_law string, change_type string, instruction string, new_text string", lambda x: acts.structured_ops(x, whole_only))


def replacement_blocks(rows: DataFrame, key: list[str], raw: str) -> DataFrame:
    """Replacement blocks (key, n, instruction, block) of act XML, in the acts' order."""
    return _mapped(rows, key, raw, "instruction string, block string", acts.replacement_blocks)


def act_sections(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    """Sections (key, n, target_law, section) ``I lov <citation>`` of acts, each up to the next."""
    found = F.transform(_cited_sections(F.coalesce(F.col(text), F.lit(""))), lambda s: F.struct(s["law"].alias("target_law"), s["section"].alias("section")))
    return _numbered_rows(rows, key, found)


def term_reforms(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    """Distinct (key, n, target_law, term_old, term_new) of acts' sections; references to provisions are no terms."""
    cut = rows.select(*key, _cited_sections(F.coalesce(F.col(text), F.lit(""))).alias("_s"))
    return _numbered_rows(cut, key, F.array_distinct(F.flatten(F.transform("_s", lambda s: F.coalesce(_terms_of(s["law"], s["section"]), F.array().cast("array<struct<target_law:string,term_old:string,term_new:string>>"))))))


def amending_laws(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    """The laws (key, n, law) whose dates a provenance text gives, but no resolutions or regulations, by date and number.

    The text's words are read in order: a day, a month, a year, and a number behind ``nr``. What a date has used is no
    part of another, and 14 characters before it must not name a resolution or regulation.
    """

    def found(words: Column) -> Column:
        word = lambda k: F.coalesce(F.get(words, k), F.lit(""))
        table = F.create_map(*(F.lit(x) for m in SHORT_MONTHS for x in (m, MONTHS[m])))

        def dated(k: Column) -> Column:
            day = F.regexp_extract(word(k), r"([0-9]{1,2})\z", 1)
            name = F.lower(F.when(word(k + 1).endswith("."), F.left(word(k + 1), F.length(word(k + 1)) - 1)).otherwise(word(k + 1)))
            month = F.coalesce(F.try_element_at(table, F.left(name, F.lit(4))), F.try_element_at(table, F.left(name, F.lit(3))))
            glued = ~word(k + 3).isin("nr", "nr.")
            number = F.regexp_extract(F.when(~glued, word(k + 4)).when(word(k + 3).startswith("nr"), F.regexp_replace(word(k + 3), "^nr[.]?", "")).otherwise(""), "^[0-9]+", 0)
            ahead = F.concat(F.array_join(F.slice(words, F.greatest(k - 14, F.lit(1)), F.least(k, F.lit(15))), " "), F.lit(" "), F.left(word(k), F.length(word(k)) - F.length(day)))
            near = F.lower(F.right(F.when(k > 0, ahead).otherwise(F.left(word(k), F.length(word(k)) - F.length(day))), F.lit(14)))
            whole = (day != "") & (number != "") & word(k + 2).rlike(r"^[0-9]{4}\z") & name.rlike(r"(?U)^[\p{L}\p{N}]+\z") & (word(k + 3) != "")
            law = F.when(month.isNotNull() & ~near.contains("res.") & ~near.contains("forskrift"), F.struct(word(k + 2).cast("int").alias("y"), month.alias("m"), day.cast("int").alias("d"), number.cast("decimal(38,0)").alias("n")))
            used = F.length(number) + F.when(glued, F.length(F.regexp_extract(word(k + 3), "^nr[.]?", 0))).otherwise(0)
            place = lambda word_, at: F.struct(word_.alias("word"), at.alias("at"))
            return F.when(whole, F.struct(place(k, F.length(word(k)) - F.length(day)).alias("start"), place(F.when(glued, k + 3).otherwise(k + 4), used).alias("end"), law.alias("law")))

        dates = F.filter(F.transform(words, lambda _, k: dated(k)), lambda x: x.isNotNull())
        empty = F.struct(F.struct(F.lit(-1).alias("word"), F.lit(0).alias("at")).alias("free"), F.array().cast("array<struct<y:int,m:int,d:int,n:decimal(38,0)>>").alias("laws"))
        taken = F.aggregate(dates, empty, lambda a, x: F.when(x["start"] >= a["free"], F.struct(x["end"].alias("free"), F.array_append(a["laws"], x["law"]).alias("laws"))).otherwise(a), lambda a: a["laws"])
        named = F.array_sort(F.array_distinct(F.filter(taken, lambda x: x.isNotNull())))
        return F.transform(named, lambda x: F.struct(F.format_string("%s-%02d-%02d-%s", x["y"].cast("string"), x["m"], x["d"], x["n"].cast("string")).alias("law")))

    words = F.split(t.squeeze(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "<[^>]+>", " ")), " ")
    return _numbered_rows(rows.select(*key, t.once(words, found).alias("_l")), key, F.col("_l"))


def register_acts(rows: DataFrame, key: list[str], block: str) -> DataFrame:
    return _mapped(rows, key, block, "act string, source_ref string, in_force string", acts.register_acts)


def structured_provisions(rows: DataFrame, key: list[str], raw: str) -> DataFrame:
    return _mapped(rows, key, raw, "para string, text string", lambda x: list(acts.structured_provisions(x).items()))


def anchored_provisions(rows: DataFrame, key: list[str], page: str) -> DataFrame:
    return _mapped(rows, key, page, "para string, text string", lambda x: list(acts.anchored_provisions(x).items()))


def ocr_provisions(rows: DataFrame, key: list[str], text: str, repair: bool = False) -> DataFrame:
    """Provisions of a law's OCR text: headings at line starts, walked in order, bodies squeezed and folded; empty ones go."""
    from chronofold.core.wording import without_provenance

    prepared = rows.withColumn(text, t.repaired_headings(F.col(text)) if repair else F.col(text))

    def of(body: str) -> list[tuple]:
        return list(acts.walked_provisions(body, acts.opened_ids(body), without_provenance).items())

    found = _mapped(prepared, key, text, "para string, text string", of)
    body = t.ocr_folded(t.squeeze(F.regexp_replace("text", r"^(?U)\s*\.\s*", "")))
    return found.withColumn("text", body).where("text <> ''")


def sliced_provisions(texts: DataFrame, boundaries: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Provisions (key, n, para, text, verbatim, heading_fits) that a table of boundaries (key, para, line) marks.

    Boundaries are repaired first, so those left rise by line. ``verbatim`` says whether a body is the source's own
    words; a base with any that isn't must not be built. Lines count from 1.
    """
    kept = repaired_boundaries(boundaries, key).where("kept").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("line", "para"))).alias("_marks"))

    @F.pandas_udf("array<struct<para: string, text: string, verbatim: boolean, heading_fits: boolean>>")
    def cut(bodies: pd.Series, marked: pd.Series) -> pd.Series:
        names = ("para", "text", "verbatim", "heading_fits")
        return pd.Series([[dict(zip(names, row, strict=True)) for row in issue.sliced(x or "", [(m["para"], m["line"]) for m in ms])] for x, ms in zip(bodies, marked, strict=True)])

    both = texts.select(*key, F.col(text).alias("_text")).join(kept, key)
    return both.select(*key, F.posexplode(cut("_text", "_marks")).alias("n", "x")).select(*key, "n", "x.*")


def guarded(sliced: DataFrame, key: list[str]) -> DataFrame:
    """Sliced provisions as a base's rows; a job that writes one whose text is not its source's own words fails.

    The guard is part of the plan, so nothing that a later step makes of a row can get past it.
    """
    said = F.concat_ws(" ", F.lit("not in its source:"), *(F.col(c).cast("string") for c in key), F.col("para"))
    return sliced.select(*key, "n", "para", F.when(F.col("verbatim"), F.col("text")).otherwise(F.raise_error(said)).alias("text"))


def window_marks(rows: DataFrame, marks: DataFrame, key: list[str], text: str = "text", size: int = 18_000, overlap: int = 1_500, head: str = "lov nr") -> DataFrame:
    """Acts (key, nr, at, date, title, body) out of headings that were quoted window by window.

    ``marks`` has (key, start, n, nr, date, title, anchor), an anchor being the words of a heading in the window that
    begins at ``start``. An anchor must hold ``head`` in lower case with single blanks; its place in the window, blanks being alike,
    becomes a place in the text. The same place quoted by two windows is one heading, the first by window and order; of a
    number's headings the first place holds, as later ones are running heads. A body ends where the next one begins.
    """
    cut = windows(rows.select(*key, F.col(text).alias("_text")), "_text", size, overlap, "_window")
    quoted = marks.where(t.squeeze(F.lower("anchor")).contains(head)).select(*key, "start", F.struct("n", "nr", "date", "title", "anchor").alias("m"))
    both = cut.join(quoted.groupBy(*key, "start").agg(F.array_sort(F.collect_list("m")).alias("_marks")), [*key, "start"])

    @F.pandas_udf("array<long>")
    def places(texts: pd.Series, asked: pd.Series) -> pd.Series:
        out = []
        for x, ms in zip(texts, asked, strict=True):
            source = acts.Source(x or "")
            out.append([source.locate(m["anchor"] or "") for m in ms])
        return pd.Series(out)

    found = both.withColumn("_at", places("_window", "_marks")).select(*key, "start", F.explode(F.arrays_zip("_marks", "_at")).alias("z"))
    located = found.where("z._at >= 0").select(*key, (F.col("start") + F.col("z._at")).alias("at"), F.struct("start", "z._marks.n").alias("_order"), "z._marks.nr", "z._marks.date", "z._marks.title")
    by_place = first_of_each(located, [*key, "at"], "_order")
    by_number = first_of_each(by_place, [*key, "nr"], "at")
    ends = slices(by_number.join(rows.select(*key, F.col(text).alias("_text")), key), key, "at", F.length("_text"))
    return ends.select(*key, "nr", "at", "date", "title", F.substring(F.col("_text"), (F.col("at") + 1).cast("int"), (F.col("slice_end") - F.col("at")).cast("int")).alias("body"))


def verified_ops(sections: DataFrame, quoted: DataFrame, key: list[str]) -> DataFrame:
    """Operations (key, para, change_type, instruction, new_text, flag) whose payloads are the section's own words.

    ``quoted`` has (key, n, para, unit, kind, head, tail); a section's quotes are looked up in order, each behind the
    last. A payload that isn't found flags its operation, which then carries none.
    """
    lists = quoted.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("n", "para", "unit", "kind", "head", "tail"))).alias("ops"))
    both = sections.select(*key, "section").join(lists, key)
    kinds = ", ".join(f"`{c}` {sections.schema[c].dataType.simpleString()}" for c in key)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(*row[:-2], *made) for row in frame[[*key, "section", "ops"]].itertuples(index=False) for made in acts.verified_payloads(row[-2] or "", [(o["para"], o["unit"] or "", o["kind"], o["head"] or "", o["tail"] or "") for o in row[-1]])]
            yield pd.DataFrame(out, columns=[*key, "para", "change_type", "instruction", "new_text", "flag"])

    return both.mapInPandas(run, f"{kinds}, para string, change_type string, instruction string, new_text string, flag string")


def located_targets(texts: DataFrame, mentions: DataFrame, key: list[str]) -> DataFrame:
    """Sections (key, target_law, section, place, reason, anchor, cite) of quoted mentions (key, n, anchor, cite).

    Found ones have a section and its place among the key's, from 0; the others a reason.
    """
    lists = mentions.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("n", "anchor", "cite"))).alias("mentions"))
    both = texts.select(*key, "text").join(lists, key)
    kinds = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in key)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame[[*key, "text", "mentions"]].itertuples(index=False):
                found, lost = acts.located_targets(row[-2] or "", [(m["anchor"] or "", m["cite"] or "") for m in row[-1]])
                out += [(*row[:-2], law, section, k, None, None, None) for k, (law, section) in enumerate(found)]
                out += [(*row[:-2], None, None, None, *why) for why in lost]
            frame = pd.DataFrame(out, columns=[*key, "target_law", "section", "place", "reason", "anchor", "cite"])
            yield frame.astype({"place": "Int32"})

    return both.mapInPandas(run, f"{kinds}, target_law string, section string, place int, reason string, anchor string, cite string")
