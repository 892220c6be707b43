"""The amendment register: which act changes which law, and what a log has of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.functions import text as t
from chronofold.operators.segment import nearest_before, register_acts

_ANCHOR = r'data-lovdata-URL="NL/lov/([0-9]{4}-[0-9]{2}-[0-9]{2}-[0-9]+)(?:/([^"]+))?"'
_NOTE = r'(?s)<article class="changesToParent">(.*?)</article>'


def title_map(sources: DataFrame) -> DataFrame:
    """Rows (law, title) of sources (law, raw), from the first 4000 characters."""
    title = F.regexp_extract(F.substring("raw", 1, 4000), r"(?s)<title[^>]*>(.*?)</title>", 1)
    return sources.select("law", t.tag_text(F.nullif(title, F.lit(""))).alias("title")).where("title IS NOT NULL")


def _places(sources: DataFrame, pattern: str) -> DataFrame:
    """Rows (law, pos, hit): the matches of a pattern, with where they begin."""
    parts = F.split("raw", rf"(?={pattern})")
    ends = F.aggregate(parts, F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<pos:int,hit:string>>").alias("hits")), lambda a, p: F.struct((a["n"] + F.length(p)).alias("n"), F.when(F.regexp_extract(p, f"^(?:{pattern})", 0) != "", F.array_append(a["hits"], F.struct(a["n"].alias("pos"), F.regexp_extract(p, f"^(?:{pattern})", 0).alias("hit")))).otherwise(a["hits"]).alias("hits")))
    return sources.select("law", F.explode(ends["hits"]).alias("x")).select("law", "x.pos", "x.hit")


def edges(sources: DataFrame) -> DataFrame:
    """The register's edges from current sources (law, raw): each act that a change note names, under the nearest anchor of its own law before the note."""
    anchors = _places(sources, _ANCHOR).withColumn("owner", F.regexp_extract("hit", _ANCHOR, 1)).where("owner = law")
    anchors = anchors.select("law", "pos", F.nullif(F.regexp_extract("hit", _ANCHOR, 2), F.lit("")).alias("provision"))
    notes = _places(sources, _NOTE).select("law", "pos", F.regexp_extract("hit", _NOTE, 1).alias("block"))
    # an anchor of the whole law hides those before it, so its missing provision counts as a value
    placed = nearest_before(anchors.withColumn("provision", F.struct("provision")), notes, ["law"], "pos", "provision").withColumn("provision", F.col("provision.provision"))
    named = register_acts(placed.withColumn("note", F.col("block")), ["law", "pos", "provision", "block"], "note")
    titles = title_map(sources)
    note = t.tag_text(F.col("block"))
    rows = named.where("act <> law").select("law", "act", "provision", t.note_verb(note).alias("change_type"), F.substring(note, 1, 40).alias("verb_raw"), "in_force", "source_ref")
    out = rows.join(titles.select(F.col("law").alias("act"), F.col("title").alias("act_title")), "act", "left").join(titles.select("law", F.col("title").alias("target_law_title")), "law", "left")
    return out.select(
        F.concat(F.lit("lov/"), "act").alias("act_id"), "act_title", F.col("act").alias("act_date"), F.concat(F.lit("lov/"), "law").alias("target_law"), "target_law_title", "provision",
        "change_type", "verb_raw", "in_force", F.concat(F.lit("forskrift/"), "source_ref").alias("source_ref"), F.lit("nlod-current").alias("provenance"),
    )


def index(edges_: DataFrame, act: str = "act_id", law: str = "target_law", title: str = "act_title") -> DataFrame:
    """One row (act, title, n_laws, n_ops, affected_laws) for each act. Laws are first counted once each."""
    pairs = edges_.groupBy(act, law).agg(F.count("*").alias("n"), F.max(title).alias("t"))
    return pairs.groupBy(act).agg(F.max("t").alias(title), F.count("*").alias("n_laws"), F.sum("n").alias("n_ops"), F.array_sort(F.collect_list(law)).alias("affected_laws"))


def gaps(register: DataFrame, captured: DataFrame, law: str = "law", act: str = "act") -> DataFrame:
    """One row (law, edges, hit, mistargeted, absent) for each law of the register.

    An edge is a distinct (law, act). It is hit where the log has it, mistargeted where the log has its act under
    other laws only, else absent.
    """
    want, have = register.select(law, act).distinct(), captured.select(law, act).distinct()
    state = want.join(have.withColumn("_hit", F.lit(1)), [law, act], "left").join(captured.select(act).distinct().withColumn("_known", F.lit(1)), act, "left")
    count = lambda c: F.count(F.when(c, 1))
    hit, known = F.col("_hit").isNotNull(), F.col("_known").isNotNull()
    return state.groupBy(law).agg(F.count("*").alias("edges"), count(hit).alias("hit"), count(~hit & known).alias("mistargeted"), count(~hit & ~known).alias("absent"))


def gap_totals(per_law: DataFrame) -> DataFrame:
    """The sums over all laws, with whole percentages rounded down."""
    sums = per_law.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("edges", "hit", "mistargeted", "absent")))
    share = lambda c: F.floor(100 * F.col(c) / F.greatest("edges", F.lit(1))).cast("long").alias(f"{c}_pct")
    return sums.select("*", share("hit"), share("mistargeted"), share("absent"))


def select_acts(acts: DataFrame, register: DataFrame, key: str = "act") -> DataFrame:
    return acts.join(register.select(key).distinct(), key, "left_semi")


def citing(texts: DataFrame, targets: DataFrame, key: str, text: str, least: int = 1) -> DataFrame:
    """Pairs (key, law, n) of texts and the target laws that they cite ``least`` times at least.

    Citations are read from each text once and joined on the law's id, so no text meets every target.
    """
    cited = texts.select(key, F.explode(t.cited_laws(F.col(text))).alias("law")).where("law IS NOT NULL")
    counts = cited.groupBy(key, "law").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return counts.join(targets.select("law").distinct(), "law", "left_semi").select(key, "law", "n")
