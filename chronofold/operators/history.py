"""Version histories: what changed when, what held at a date, and what differs between two texts."""

from __future__ import annotations

import html
import itertools
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.functions.text import act_label, display_text
from chronofold.operators.numbering import kept


def changes_only(rows: DataFrame, key: list[str], order: list[Column | str], value: str) -> DataFrame:
    """Rows whose value differs from the key's row before; the first always does."""
    before = Window.partitionBy(*key).orderBy(*order)
    marked = rows.withColumn("_n", F.row_number().over(before)).withColumn("_before", F.lag(value).over(before))
    return marked.where((F.col("_n") == 1) | ~F.col("_before").eqNullSafe(F.col(value))).drop("_n", "_before")


def validity(rows: DataFrame, key: list[str], start: str, order: list[Column | str]) -> DataFrame:
    """``rows`` with ``valid_to``: the start of the key's next row, null for the last."""
    return rows.withColumn("valid_to", F.lead(start).over(Window.partitionBy(*key).orderBy(*order)))


def as_of_join(queries: DataFrame, versions: DataFrame, key: list[str], at: str, start: str, order: list[str]) -> DataFrame:
    """Each query row with the last version of its key that starts at or before ``at``; versions' columns are null without one.

    Both sides are sorted together by key and time, in ranges that do not end with a key: a key with most of the rows is
    the work of many tasks. Each range carries its own last version along, and what the ranges before it leave for its
    first key comes from a table of one row a range. A key with many queries and many versions makes no pairs.
    """
    columns = [c for c in versions.columns if c not in key]
    orders = [f"_o{k}" for k in range(len(order))]
    tie = F.monotonically_increasing_id().alias("_tie")  # rows alike in all else do not meet in one range
    left = queries.select(*key, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.struct(*queries.columns).alias("_q"), F.lit(None).cast(versions.select(F.struct(*columns)).schema[0].dataType).alias("_v"), *(F.lit(None).cast(versions.schema[c].dataType).alias(o) for o, c in zip(orders, order, strict=True)), tie)
    right = versions.select(*key, F.col(start).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(queries.select(F.struct(*queries.columns)).schema[0].dataType).alias("_q"), F.struct(*columns).alias("_v"), *(F.col(c).alias(o) for o, c in zip(orders, order, strict=True)), tie)
    line = [*key, "_t", "_side", *orders, "_tie"]
    dealt = left.unionByName(right).repartitionByRange(*line).sortWithinPartitions(*line)
    held = kept(dealt.select(F.struct(*key).alias("_k"), "_side", "_q", "_v", F.monotonically_increasing_id().alias("_row"))).withColumn("_range", F.shiftright("_row", 33))
    own = Window.partitionBy("_range", "_k").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    local = held.withColumn("_last", F.last("_v", ignorenulls=True).over(own)).where("_side = 1")
    version = F.when(F.col("_side") == 0, F.col("_row"))
    ends = held.groupBy("_range").agg(F.min_by("_k", "_row").alias("_first"), F.max_by("_k", "_row").alias("_end"), F.max_by(F.struct("_k", "_v"), version).alias("_had"))
    left_over = F.when(F.col("_had._k").eqNullSafe(F.col("_end")), F.col("_had._v"))
    so_far = F.last(left_over, ignorenulls=True).over(Window.partitionBy("_end").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0))
    before = Window.orderBy("_range")  # a row for each range
    carried = ends.withColumn("_left", so_far).select("_range", "_first", F.lag("_end").over(before).alias("_before"), F.lag("_left").over(before).alias("_carry"))
    carried = carried.where(F.col("_before").eqNullSafe(F.col("_first")) & F.col("_carry").isNotNull()).select("_range", F.col("_first").alias("_k"), "_carry")
    found = local.join(F.broadcast(carried), (local["_range"] == carried["_range"]) & local["_k"].eqNullSafe(carried["_k"]), "left").select("_q", F.coalesce("_last", "_carry").alias("_last"))
    return found.select("_q.*", *(F.col(f"_last.{c}").alias(c if c not in queries.columns else f"version_{c}") for c in columns))


def histories(folded: DataFrame, base_dates: DataFrame, bases: DataFrame) -> DataFrame:
    """Rows (law, para, versions) of a fold: the baseline, then each date's last text that differs from the one before.

    ``base_dates`` has (law, enacted), ``bases`` (law, para, text) what the fold began with; operations up to the law's
    enactment belong to the baseline. A version has ``date``, ``text`` and ``src``, the operations that made it; a baseline
    has none. A text that comes back after a repeal is a version again, the absence between is not.
    """
    own = bases.groupBy("law", "para").agg(F.min("text").alias("base"))
    rows = folded.where("para IS NOT NULL").join(own, ["law", "para"], "left").join(base_dates, "law").select("law", "para", "enacted", F.posexplode(F.concat(F.array(F.struct(F.lit("").alias("date"), F.col("base").alias("text"), *(F.lit(None).cast("string").alias(c) for c in ("act", "instruction", "new_text")))), F.coalesce("versions", F.array()))).alias("n", "v"))
    late = F.col("v.date") > F.col("enacted")
    src = F.struct("n", act_label(F.col("v.act")).alias("act"), F.trim(F.coalesce("v.instruction", F.lit(""))).alias("ins"), display_text(F.col("v.new_text")).alias("txt"))
    dated = rows.groupBy("law", "para", F.when(late, F.col("v.date")).otherwise(F.col("enacted")).alias("date")).agg(
        display_text(F.max_by(F.coalesce("v.text", F.lit("")), "n")).alias("text"), F.array_sort(F.collect_list(F.when(late, src))).alias("src"))
    changed = changes_only(dated, ["law", "para"], ["date"], "text").where("text <> ''")
    return changed.groupBy("law", "para").agg(F.array_sort(F.collect_list(F.struct("date", "text", F.transform("src", lambda s: F.struct(s["act"].alias("act"), s["ins"].alias("ins"), s["txt"].alias("txt"))).alias("src")))).alias("versions"))


#: A token of at least so many places in a text keeps them as one number between rows.
OFTEN = 64


def longest_common(a: list[str], b: list[str]) -> list[tuple[str, str]]:
    """Steps (same, gone or new, token) of a longest common subsequence; of equal ways the one that drops from ``a`` first.

    A row of the table of lengths is one whole number, with a zero wherever the length grows, so a row of 100,000 tokens
    is 12 kB. Rows are made from the end, but only one in each stretch of about the square root of their number is kept;
    the way through the table is walked from the front, a stretch at a time, for which its rows are made again.
    """
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    x, y = a[start:], b[start:]
    n, m = len(x), len(y)
    places: dict[str, list[int]] = {}
    for j, token in enumerate(y):
        places.setdefault(token, []).append(m - 1 - j)
    whole, often = (1 << m) - 1, {}

    def mask(token: str) -> int:
        if token in often:
            return often[token]
        at = places.get(token, ())
        bits = bytearray(m // 8 + 1) if at else b""
        for p in at:
            bits[p >> 3] |= 1 << (p & 7)
        made = int.from_bytes(bits, "little")
        if len(at) >= OFTEN:
            often[token] = made
        return made

    def above(row: int, token: str) -> int:
        hit = row & mask(token)
        return ((row + hit) | (row - hit)) & whole

    # row i tells the lengths for x[i:]: for y[j:] the zeros among its lowest m - j bits
    stretch = max(1, math.isqrt(n))
    saved, row = {n: whole}, whole
    for i in range(n - 1, -1, -1):
        row = above(row, x[i])
        if i % stretch == 0:
            saved[i] = row
    out, i, j, low, rows = [("same", t) for t in a[:start]], 0, 0, -1, []
    while i < n and j < m:
        if x[i] == y[j]:
            out.append(("same", x[i]))
            i, j = i + 1, j + 1
            continue
        if i // stretch != low:
            low = i // stretch
            top = min((low + 1) * stretch, n)
            rows = [saved[top]]
            for k in range(top - 1, low * stretch - 1, -1):
                rows.append(above(rows[-1], x[k]))
            rows.reverse()
        width = m - j
        here = i - low * stretch
        below = width - (rows[here + 1] & ((1 << width) - 1)).bit_count()
        right = width - 1 - (rows[here] & ((1 << (width - 1)) - 1)).bit_count()
        if below >= right:
            out.append(("gone", x[i]))
            i += 1
        else:
            out.append(("new", y[j]))
            j += 1
    return out + [("gone", t) for t in x[i:]] + [("new", t) for t in y[j:]]


def _runs(steps: list[tuple[str, str]], between: str) -> list[tuple[str, str]]:
    return [(op, between.join(t for _, t in part)) for op, part in itertools.groupby(steps, key=lambda s: s[0])]


def redline_of(old: str, new: str) -> list[tuple[str, str]]:
    """Runs (same, gone or new) of words between two texts; a run that little replaces is shown by characters."""
    words = _runs(longest_common(old.split(), new.split()), " ")
    out: list[tuple[str, str]] = []
    k = 0
    while k < len(words):
        op, text = words[k]
        after = words[k + 1] if k + 1 < len(words) else ("", "")
        if op == "gone" and after[0] == "new":
            steps = longest_common(list(text), list(after[1]))
            alike = 2 * sum(s[0] == "same" for s in steps) / (len(text) + len(after[1]))
            out += _runs(steps, "") if alike >= 0.75 else [words[k], after]
            k += 2
        else:
            out.append(words[k])
            k += 1
    return out


def redline(rows: DataFrame, old: str, new: str, to: str = "redline") -> DataFrame:
    """``rows`` with the runs between two text columns as an array (op, text); null counts as empty."""

    @F.pandas_udf("array<struct<op: string, text: string>>")
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[{"op": op, "text": x} for op, x in redline_of(p or "", q or "")] for p, q in zip(a, b, strict=True)])

    return rows.withColumn(to, of(F.col(old), F.col(new)))


def as_html(runs: list[tuple[str, str]]) -> str:
    mark = {"same": "{}", "gone": "<del>{}</del>", "new": "<ins>{}</ins>"}
    return " ".join(mark[op].format(html.escape(text, quote=False)) for op, text in runs)

