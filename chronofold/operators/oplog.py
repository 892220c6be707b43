"""The operation log: streams into one ordered log. Everything here is built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.core.wording import LETTERS
from chronofold.functions import text as t

ORDER = ["date", "act", "stream_rank", "line_no", "piece_no"]


def order_struct(*more: str) -> Column:
    """What sorts a log: missing dates and acts first, then as they came in."""
    return F.struct(F.coalesce("date", F.lit("")).alias("date"), F.coalesce("act", F.lit("")).alias("act"), "stream_rank", "line_no", "piece_no", *more)


def union(*streams: DataFrame) -> DataFrame:
    """Streams under one another; missing columns are null."""
    out = streams[0]
    for more in streams[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def universe(*sources: DataFrame, law: str = "law") -> DataFrame:
    """Every law that a stream or the bases name, once; each source is made distinct in its tasks before they meet."""
    return union(*(s.select(law).where(F.col(law).isNotNull()).distinct() for s in sources)).distinct()


def keep_first(rows: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in the order given; null keys are keys.

    The survivor is a minimum, so a hot key shrinks before the shuffle; no window sorts it.
    """
    rest = [c for c in rows.columns if c not in key]
    first = F.min(F.struct(*(F.struct(*order),), F.struct(*rest).alias("row"))).alias("first")
    return rows.groupBy(*key).agg(first).select(*key, "first.row.*").select(rows.columns)


def override(rows: DataFrame, blocks: DataFrame, key: list[str], column: str) -> DataFrame:
    """``rows`` with ``column`` from ``blocks`` where these have the key and a value."""
    new = blocks.groupBy(*key).agg(F.max(column).alias("_full"))
    return rows.join(new, key, "left").withColumn(column, F.coalesce("_full", column)).select(rows.columns)


def gap_fill(primary: DataFrame, recovery: DataFrame, key: list[str]) -> DataFrame:
    """``primary`` and those rows of ``recovery`` whose key no primary row has; a null in a key is never in primary."""
    owned = primary.select(*key).dropna().distinct()
    return primary.unionByName(recovery.join(owned, key, "left_anti").select(primary.columns), allowMissingColumns=True)


def missing_pairs(rows: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(existing.select(*key).distinct(), key, "left_anti").select(rows.columns)


#: Endings of ordinals before the word for a chapter, as OCR leaves them, and that word's two spellings (fixed values).
ORDINAL_ENDINGS, CHAPTER_WORDS = ("de", "te", "dje", "ne", "nde"), ("kapitel", "kapittel")


def opens_chapter(payload: Column) -> Column:
    """Whether a payload begins with a chapter's heading: ``3dje kapittel``, ``Kapittel 3`` or ``Nytt kapittel 3``."""
    words = F.split(t.squeeze(F.lower(F.substring(payload, 1, 200))), " ")
    word = lambda k: F.coalesce(F.get(words, F.lit(k)), F.lit(""))
    spelled = lambda k: word(k).startswith(CHAPTER_WORDS[0]) | word(k).startswith(CHAPTER_WORDS[1])
    numbered = lambda k: (word(k) == CHAPTER_WORDS[1]) & word(k + 1).rlike("^[0-9]")
    bare, ending = F.rtrim(word(0), F.lit(".")), F.rtrim(word(1), F.lit("."))
    ordinal = bare.rlike("^[0-9]+$") | F.regexp_extract(bare, "^[0-9]+([a-z]+)$", 1).isin(*ORDINAL_ENDINGS)
    return numbered(0) | (word(0).isin("ny", "nyt", "nytt") & numbered(1)) | (ordinal & spelled(1)) | (bare.rlike("^[0-9]+$") & ending.isin(*ORDINAL_ENDINGS) & spelled(2))


def _gathered(parts: Column, opens: Callable[[Column], Column], joint: str) -> Column:
    """Parts put together into pieces: each that opens one, with those behind it that don't."""
    empty = F.array().cast("array<string>")
    grow = lambda a, x: F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.concat(F.element_at(a, -1), F.lit(joint), x)))
    return F.aggregate(parts, empty, lambda a, x: F.when(opens(x) | (F.size(a) == 0), F.array_append(a, x)).otherwise(grow(a, x)))


def _titled(part: Column) -> Column:
    """Whether what follows a ``§`` is a number with a letter at most, a full stop, and a word with a capital."""
    words = F.split(t.squeeze(F.substring(part, 1, 200)), " ")
    word = lambda k: F.coalesce(F.get(words, F.lit(k)), F.lit(""))
    number = lambda x: F.regexp_replace(x, "^[0-9]+", "")
    letters = F.array(*map(F.lit, ["", *LETTERS]))
    capital = lambda x: F.array_contains(F.array(*(F.lit(c.upper()) for c in LETTERS)), F.substring(x, 1, 1))
    ends = lambda x: F.array_contains(F.transform(letters, lambda c: F.concat(c, F.lit("."))), x)
    counted = number(word(0)) != word(0)
    at_once = counted & ends(number(word(0))) & capital(word(1))
    apart = counted & (number(word(0)) == "") & (word(1) != ".") & ends(word(1)) & capital(word(2))
    dotted = counted & (number(word(0)) == "") & (word(1) == ".") & capital(word(2))
    return at_once | apart | dotted


def pieces_of(payload: Column) -> Column:
    """A payload's provisions as an array (para, new_text): by line-start headings, or inline ones in a whole chapter.

    An inline heading is a number with a full stop before a capital. Null where the payload opens with neither, or has
    no heading at all.
    """
    lines = _gathered(F.split(payload, "\n"), lambda x: t.heading_id(x).isNotNull(), "\n")
    inline = F.transform(_gathered(F.split(payload, "§"), _titled, "§"), lambda x, k: F.when(k > 0, F.concat(F.lit("§"), x)).otherwise(x))
    parts = F.when(opens_chapter(payload), inline).when(t.strip_left(payload).startswith("§"), lines)
    named = F.transform(parts, lambda p: F.struct(t.heading_id(p).alias("para"), F.regexp_replace(t.strip_left(p), r"(?U)\s+$", "").alias("new_text")))
    kept = F.filter(named, lambda x: x["para"].isNotNull())
    return F.when(F.size(kept) > 0, kept)


def normalise(raw: DataFrame) -> DataFrame:
    """Raw operations (with stream_rank and line_no) as the log's rows, one for each provision of a payload."""
    whole = F.array(F.struct(t.op_id(F.col("paragraph"), F.col("target"), F.col("instruction"), F.col("new_text")).alias("para"), F.col("new_text").alias("new_text")))
    rows = raw.select(
        F.col("target_law").alias("law"), F.col("act_refid").alias("act"), "change_type", "instruction",
        F.coalesce(F.nullif("date_in_force_resolved", F.lit("")), "date_in_force").alias("date"), "stream_rank", "line_no",
        F.posexplode(F.coalesce(pieces_of(F.col("new_text")), whole)).alias("piece_no", "piece"),
    )
    return rows.select("law", "act", "piece.para", "change_type", "instruction", "piece.new_text", "date", "stream_rank", "line_no", "piece_no")


def load(raw: DataFrame, first_recovery_rank: int) -> DataFrame:
    """The log of all laws: primary streams, and recovery streams (ranks from the given one) where these leave a gap.

    Of operations with the same act, provision, date and instruction the first holds, by stream and line.
    """
    rows = normalise(raw)
    primary, recovery = rows.where(F.col("stream_rank") < first_recovery_rank), rows.where(F.col("stream_rank") >= first_recovery_rank)
    # payloads are taken apart once more for the provisions that are owned, so only where something could fill a gap
    alone = not raw.isStreaming and raw.where(F.col("stream_rank") >= first_recovery_rank).isEmpty()
    return keep_first(primary if alone else gap_fill(primary, recovery, ["law", "para"]), ["law", "act", "para", "date", "instruction"], ["stream_rank", "line_no", "piece_no"])


def load_by_kind(raw: DataFrame) -> DataFrame:
    """The older log of two streams: rows typed by ``kind``, payloads not taken apart."""
    rows = raw.select(
        F.col("target_law").alias("law"), F.col("act_refid").alias("act"), t.bare_id(F.col("instruction")).alias("para"), t.op_kind(F.col("instruction")).alias("kind"),
        "instruction", "new_text", F.coalesce(F.nullif("date_in_force_resolved", F.lit("")), "date_in_force").alias("date"), "stream_rank", "line_no", F.lit(0).alias("piece_no"),
    )
    return keep_first(rows, ["law", "act", "para", "date", "instruction"], ["stream_rank", "line_no"])


def as_of(ops: DataFrame, date: str | None = None) -> DataFrame:
    """Operations up to a date; without a date they always count."""
    return ops if date is None else ops.where(F.col("date").isNull() | (F.col("date") == "") | (F.col("date") <= date))


def since_snapshot(ops: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Operations on or after their law's snapshot (law, base_as_of); all of those without a date or a snapshot.

    Where no snapshot has a date there is nothing to compare, and the log is not moved for it.
    """
    if not snapshots.isStreaming and snapshots.where("base_as_of <> ''").isEmpty():
        return ops
    joined = ops.join(snapshots.select("law", "base_as_of"), "law", "left")
    return joined.where("base_as_of IS NULL OR base_as_of = '' OR date IS NULL OR date = '' OR date >= base_as_of").select(ops.columns)


def in_force(acts: DataFrame, triggers: DataFrame) -> DataFrame:
    """Rows (datokode, own_date, trigger_dates, resolved, status): an act's own date, else its first triggering resolution's."""
    dates = triggers.where("date IS NOT NULL").groupBy("datokode").agg(F.array_sort(F.collect_list("date")).alias("dates"))
    joined = acts.join(dates, "datokode", "left").withColumn("trigger_dates", F.coalesce("dates", F.array().cast("array<string>")))
    status = F.when(F.col("own_date").isNotNull(), "concrete").when(F.size("trigger_dates") > 0, "triggered").otherwise("deferred_untriggered")
    return joined.select("datokode", "own_date", "trigger_dates", F.coalesce("own_date", F.try_element_at("trigger_dates", F.lit(1))).alias("resolved"), status.alias("status"))


def last_kind(ops: DataFrame, key: list[str], kind: str, order: Column) -> DataFrame:
    """The kind of each key's last operation."""
    return ops.groupBy(*key).agg(F.max_by(kind, order).alias(kind))


def reconstructable(ops: DataFrame) -> DataFrame:
    """Provisions whose last operation gives their whole text."""
    return last_kind(ops.where("para IS NOT NULL"), ["law", "para"], "kind", order_struct()).where("kind IN ('replace', 'add')")


def rederived(ops: DataFrame, acts: DataFrame, blocks: DataFrame, limit: int = 4_000) -> DataFrame:
    """Operations whose payload was cut at ``limit`` characters, with the whole one out of their acts' replacement blocks.

    ``ops`` has (act, law, instruction, new_text), ``acts`` the column act of all acts there are, ``blocks`` (act, n,
    instruction, block). One row (act, law, instruction, new_text, reason) for each cut (act, law, instruction): the
    first block that goes on from the payload as it is, else a null text and why. Blocks that several operations name
    meet them by act and instruction, so an act's markup is read once, whatever the number of its operations.
    """
    cut = ops.where(F.length("new_text") == limit).select("act", "law", "instruction", F.col("new_text").alias("head"), F.regexp_replace("instruction", r"(?U)^\s+|\s+$", "").alias("_said")).distinct()
    whole = blocks.select("act", F.col("instruction").alias("_said"), "n", "block")
    seen = cut.join(whole, ["act", "_said"], "left").withColumn("_fits", F.col("block").startswith(F.col("head")))
    best = seen.groupBy("act", "law", "instruction").agg(F.min_by("block", F.when(F.col("_fits"), F.col("n"))).alias("new_text"), F.count("block").alias("_n"))
    there = acts.select("act").distinct().withColumn("_there", F.lit(True))
    reason = F.when(F.col("new_text").isNotNull(), F.lit(None)).when(F.col("_there").isNull(), "no-source").when(F.col("_n") == 0, "instruction-not-found").otherwise("no-block-fits")
    return best.join(there, "act", "left").select("act", "law", "instruction", "new_text", reason.alias("reason"))


def dated(ops: DataFrame, resolved: DataFrame) -> DataFrame:
    """Raw operations with ``date_in_force_resolved`` from an in-force index (datokode, resolved) where they have none."""
    index = resolved.where("resolved IS NOT NULL").groupBy("datokode").agg(F.min("resolved").alias("_resolved"))
    joined = ops.join(index, ops["act_refid"] == index["datokode"], "left")
    return joined.withColumn("date_in_force_resolved", F.coalesce(F.nullif("date_in_force_resolved", F.lit("")), "_resolved")).select(ops.columns)


def defer_parts(ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(operations on whole provisions, those on a unit below, left for later)."""
    part = F.coalesce(F.col("unit"), F.lit("")) != ""
    return ops.where(~part), ops.where(part)
