"""Point-in-time state: the fold of an operation log over base texts, provision by provision."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.core.replay import outcome, outcome_by_kind, replay
from chronofold.core.wording import body_of
from chronofold.functions.text import without_heading
from chronofold.operators.oplog import ORDER, as_of, order_struct, union
from chronofold.session import bounded_batches


def whole_state(ops: DataFrame, key: list[str], order: Column, is_set: Column, is_insert: Column, is_delete: Column, value: str, base: DataFrame | None = None) -> DataFrame:
    """Rows (key, ``value``) after overwrites, inserts where absent, and deletes, in order; other operations change nothing.

    These transitions compose, so no log is collected: the last overwrite or delete decides, and after a delete (or
    where nothing was) the first insert behind it. Both are aggregates with map-side combine; a key of any size is
    one row for each task. ``base`` has rows (key, ``value``) to begin with.
    """
    rows = ops.select(*key, order.alias("_at"), F.when(is_set, "s").when(is_delete, "d").when(is_insert, "i").alias("_do"), F.col(value).alias("_v")).where("_do IS NOT NULL")
    firm = rows.where("_do <> 'i'").groupBy(*key).agg(F.max(F.struct("_at", "_do", "_v")).alias("_last"))
    late = rows.where("_do = 'i'").join(firm, key, "left").where("_last IS NULL OR (_last._do = 'd' AND _at > _last._at)")
    first = late.groupBy(*key).agg(F.min(F.struct("_at", "_v")).alias("_first"))
    every = firm.join(first, key, "full_outer")
    if base is not None:
        every = every.join(base.select(*key, F.col(value).alias("_base")), key, "full_outer")
        kept = F.when(F.col("_last").isNull(), F.coalesce("_base", "_first._v")).when(F.col("_last._do") == "s", F.col("_last._v")).otherwise(F.col("_first._v"))
    else:
        kept = F.when(F.col("_last._do") == "s", F.col("_last._v")).otherwise(F.col("_first._v"))
    return every.select(*key, kept.alias(value)).where(F.col(value).isNotNull())


#: Groups that a law's operations without a provision are dealt out to.
NOWHERE = 64

_RESULT = "law string, para string, text string, flags array<struct<why: string, date: string, instruction: string>>, versions array<struct<date: string, text: string, act: string, instruction: string, new_text: string>>"


def fold(base: DataFrame, ops: DataFrame, by_kind: bool = False, keyed: bool = False) -> DataFrame:
    """Rows (law, para, text, flags, versions) of every provision that the base (law, para, text) or the log names.

    One exchange by (law, para) brings a provision and its log together; no transition reads another provision. The
    log is sorted in the array; edits below the provision need the sub-document editor, so this runs in Arrow
    batches of whole provisions. Provisions without operations never leave the JVM. ``text`` is null where a
    provision is absent. Operations without a provision are flagged under a null para. Of a provision that the base
    repeats the first by ``ordinal`` holds, or the least text where there is no such column. With ``keyed`` the law and
    provision of every row are given; two tables in as many buckets by (law, para) are then folded where they are.
    """
    change = "kind" if by_kind else "change_type"
    item = order_struct(F.col(change).alias("change"), "instruction", "new_text")
    # operations without a provision are only flagged, each by itself, so they need not meet
    salt = F.when(F.col("para").isNull(), F.pmod(F.xxhash64("act", "date", "line_no", "piece_no"), F.lit(NOWHERE)))
    logs = (ops.groupBy("law", "para") if keyed else ops.groupBy("law", "para", salt.alias("salt"))).agg(F.array_sort(F.collect_list(item)).alias("log"))
    first = F.min_by("text", "ordinal") if "ordinal" in base.columns else F.min("text")
    own = base.groupBy("law", "para").agg(first.alias("text"))
    on = (own["law"] == logs["law"]) & (own["para"] == logs["para"]) if keyed else own["law"].eqNullSafe(logs["law"]) & own["para"].eqNullSafe(logs["para"])
    both = own.join(logs, on, "full_outer").select(F.coalesce(own["law"], logs["law"]).alias("law"), F.coalesce(own["para"], logs["para"]).alias("para"), own["text"].alias("text"), "log")
    still = both.where("log IS NULL").select("law", "para", "text", F.lit(None).cast("array<struct<why: string, date: string, instruction: string>>").alias("flags"), F.lit(None).cast(_RESULT.split("versions ")[1]).alias("versions"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for law, para, text, log in frame[["law", "para", "text", "log"]].itertuples(index=False):
                log = list(log)
                done = replay(text, para, [(x["date"], x["change"], x["instruction"], x["new_text"]) for x in log], by_kind)
                flags = [{"why": why or None, "date": log[k]["date"] or None, "instruction": log[k]["instruction"]} for why, k in done.flags]
                versions = [{"date": date, "text": new, "act": log[k]["act"], "instruction": log[k]["instruction"], "new_text": log[k]["new_text"]} for date, new, k in done.versions]
                rows.append((law, para, done.text, flags, versions))
            yield pd.DataFrame(rows, columns=["law", "para", "text", "flags", "versions"])

    return still.unionByName(both.where("log IS NOT NULL").mapInPandas(run, _RESULT))


def _effect(by_kind: bool) -> Column:
    """What an operation does to a text, where that can be told from itself: set, del or none; else edit.

    Each of the first three is told only where the transition of ``core.replay`` is sure to do the same.
    """
    said, payload, named = F.coalesce("instruction", F.lit("")), F.coalesce("new_text", F.lit("")), F.col("para") != ""
    if by_kind:
        kind = F.coalesce("kind", F.lit(""))
        whole = kind.isin("replace", "add")
        return F.when(whole & (payload != ""), "set").when(kind == "repeal", "del").when(kind == "subprovision", "edit").otherwise("none")
    change = F.coalesce("change_type", F.lit(""))
    part = said.contains("ledd") | said.contains("punktum") | said.contains("bokstav") | said.contains("nr")
    heading, headed = said.contains("overskrift"), payload.rlike(r"^[ \t\r\n\f\x0B]*§")
    idle = ~payload.rlike(r"^(?U)[\s\x1C-\x1F]*§") & (~change.isin("add", "change", "repeal") | (change.isin("add", "change") & ((payload == "") | heading)))
    return F.when((change == "repeal") & named & ~part, "del").when((change != "repeal") & named & headed & ~heading, "set").when(idle, "none").otherwise("edit")


def state_at(base: DataFrame, ops: DataFrame, date: str | None = None, by_kind: bool = False) -> DataFrame:
    """Rows (law, para, text) of the provisions that are there after the log up to ``date``: ``fold``'s texts without flags and versions.

    The log is compacted before it is folded. The last operation that gives or removes a whole provision is a maximum,
    taken in the tasks first; what came before it no longer matters, and operations that change no text are left out.
    Only what is behind it goes to the editor: sorted by provision and order, and read as a stream that holds one text
    at a time, so a provision's log may be of any length. Provisions without such a tail never leave the JVM.

    Texts are moved once: base texts and last whole texts meet in one aggregate, and edits come to where these are.
    """
    change = "kind" if by_kind else "change_type"
    # a law may be null: with keys that are not, the join finds both sides dealt out by them already
    place, key = [F.coalesce("law", F.lit("")).alias("_law"), F.col("law").isNull().alias("_none"), F.col("para")], ["_law", "_none", "para"]
    order = lambda at: F.struct(*(F.col(f"{at}.{c}") for c in ORDER))
    rows = as_of(ops, date).where("para IS NOT NULL").select(*place, order_struct(F.col(change).alias("change"), "instruction", "new_text").alias("_at"), _effect(by_kind).alias("_do")).where("_do <> 'none'")
    edits = rows.where("_do = 'edit'")
    first = F.min_by("text", "ordinal") if "ordinal" in base.columns else F.min("text")
    known = base.where("para IS NOT NULL").select(*place, *(c for c in ("text", "ordinal") if c in base.columns))
    every = union(known, rows.where("_do <> 'edit'").select(*key, F.struct("_at", "_do").alias("_whole")), edits.select(*key, order("_at").alias("_edit")))
    heads = every.groupBy(*key).agg(first.alias("text"), F.max("_whole").alias("_last"), F.max("_edit").alias("_edit"))
    seeds = heads.withColumn("text", F.when(F.col("_last").isNull(), F.col("text")).when(F.col("_last._do") == "set", F.col("_last._at.new_text"))).withColumn("set", F.coalesce(F.col("_last._do") == "set", F.lit(False)))
    tailed = F.col("_edit").isNotNull() & (F.col("_last").isNull() | (F.col("_edit") >= order("_last._at")))
    # blanks that only Python takes for such
    python = tailed | (F.col("set") & F.col("text").rlike("[\x1C-\x1F]"))
    law = F.when(~F.col("_none"), F.col("_law")).alias("law")
    done = seeds.where(~python).select(law, "para", F.when(F.col("set"), F.col("text") if by_kind else without_heading(F.col("text"))).otherwise(F.col("text")).alias("text"))
    # a provision's first line has its text, whether its edit is behind the last whole one or not
    lined = edits.select(*key, "_at", F.lag("_at").over(Window.partitionBy(*key).orderBy("_at")).isNull().alias("_first"))
    begins, behind = F.coalesce("_first", F.lit(True)), F.col("_at").isNotNull() & (F.col("_last").isNull() | (F.col("_at") > F.col("_last._at")))
    lines = seeds.where(python).join(lined, key, "left").select(*key, begins.alias("begins"), behind.alias("behind"), F.when(begins, F.col("text")).alias("text"), "set", "_at")
    sent = lines.where("begins OR behind").sortWithinPartitions(*key, F.col("_at").asc_nulls_first()).select(law, "para", "begins", "behind", "text", "set", "_at.change", "_at.instruction", "_at.new_text")
    bounded_batches(base.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, text, out = None, None, []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.string()) for k in range(3)], ["law", "para", "text"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["begins"]:
                    if here is not None:
                        out.append((*here, text))
                    here, text = (row["law"], row["para"]), row["text"]
                    if row["set"] and not by_kind:
                        text = body_of(text)
                if not row["behind"]:
                    continue
                if by_kind:
                    text = outcome_by_kind(text, row["change"], row["instruction"], row["new_text"])[0]
                else:
                    text = outcome(text, row["para"], row["change"], row["instruction"], row["new_text"])[0]
            if out:
                yield made()
                out = []
        if here is not None:
            out.append((*here, text))
            yield made()

    return done.unionByName(sent.mapInArrow(run, "law string, para string, text string")).where("text IS NOT NULL")


def flags(folded: DataFrame) -> DataFrame:
    return folded.select("law", "para", F.explode("flags").alias("f")).select("law", "para", "f.why", "f.date", "f.instruction")


def provisions(folded: DataFrame) -> DataFrame:
    return folded.where("text IS NOT NULL AND para IS NOT NULL").select("law", "para", "text")


def reform(provisions_: DataFrame, reforms: DataFrame, date: str | None = None) -> DataFrame:
    """Provisions with their law's term reforms, in order of date: plain replacements of text, without word boundaries.

    Reforms are (target_law, term_old, term_new, date_in_force_resolved, date_in_force, line_no).
    """
    dated = reforms.withColumn("_date", F.coalesce(F.nullif("date_in_force_resolved", F.lit("")), "date_in_force"))
    due = dated if date is None else dated.where(F.col("_date").isNull() | (F.col("_date") <= date))
    item = F.struct(F.coalesce("date_in_force_resolved", F.lit("")).alias("at"), "line_no", "term_old", "term_new")
    lists = due.groupBy(F.col("target_law").alias("law")).agg(F.array_sort(F.collect_list(item)).alias("_terms"))
    joined = provisions_.join(lists, "law", "left")
    done = F.aggregate("_terms", F.col("text"), lambda text, r: F.replace(text, r["term_old"], r["term_new"]))
    return joined.withColumn("text", F.when(F.col("_terms").isNull(), F.col("text")).otherwise(done)).select(provisions_.columns)
