"""Temperature mixing of sources, with DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.llm._common import cut, fresh

#: Blocks of a source, and parts of a block; a power of two.
BLOCKS = 1024
#: Halvings of the exponent's range, and how many are looked up in one pass over the sources.
HALVINGS, AHEAD = 40, 5
#: The most sources whose plan is broadcast; with more it is joined by a shuffle.
BROADCAST_SOURCES = 10_000
#: Characters that part words.
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """The words of a text (null: none), which stand for its tokens."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(*parts: Column) -> Column:
    """A 60-bit number that follows from the parts' texts."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def turn_of(block: Column, source: Column, epoch: Column, seed: int, level: str) -> Column:
    """The block's place in the source's permutation of that epoch: an odd multiple plus an offset, modulo BLOCKS."""
    drawn = draw(F.lit(seed), F.lit(level), source, epoch)
    odd, offset = (drawn % (BLOCKS // 2)) * 2 + 1, F.shiftright(drawn, 20) % BLOCKS
    return (odd * block + offset) % BLOCKS


def bisect(measure: Callable[[list[float]], list[bool]], halvings: int = HALVINGS, ahead: int = AHEAD) -> float:
    """Of the exponents from 0 (where ``measure`` holds) to 1 (where it does not), the largest for which it held.

    Every pass asks for all exponents that the next ``ahead`` halvings may reach.
    """
    low, high = 0.0, 1.0
    for at in range(0, halvings, ahead):
        steps = 1 << min(ahead, halvings - at)
        asked = [low + (high - low) * k / steps for k in range(1, steps)]
        holds = [True, *measure(asked), False]
        a, b = 0, steps
        while b - a > 1:
            a, b = ((a + b) // 2, b) if holds[(a + b) // 2] else (a, (a + b) // 2)
        low, high = low + (high - low) * a / steps, low + (high - low) * b / steps
    return low


def exponent(sources: DataFrame, total: int, budget: int, target_entropy: float | None, max_repeats: float | None) -> float:
    """The exponent of the token shares.

    The largest, of 1 at most, at which the weights' entropy is ``target_entropy`` times the logarithm of the number
    of sources; but at least so large that no source is used more than ``max_repeats`` times. Sources without tokens
    do not count. A budget that even the natural shares can only fill with more repeats is an error.
    """
    some = sources.where("tokens > 0")
    n, least = some.agg(F.count("*"), F.min("tokens")).first()
    share = F.col("tokens") / F.lit(float(total))
    if n <= 1:
        return 1.0

    def sums(exponents: list[float]) -> list[tuple[float, float]]:
        """For each exponent the sum of powers of the shares, and that of powers times logarithms (exact decimals, so in any order)."""
        columns = []
        for e in exponents:
            power = F.pow(share, F.lit(e))
            columns += [F.sum(power.cast("decimal(30,20)")), F.sum((power * F.log(share)).cast("decimal(30,20)"))]
        row = some.agg(*columns).first()
        return [(float(row[2 * k]), float(row[2 * k + 1])) for k in range(len(exponents))]

    def flat(exponents: list[float]) -> list[bool]:
        return [math.log(z) - e * logs / z >= target_entropy * math.log(n) for e, (z, logs) in zip(exponents, sums(exponents), strict=True)]

    def repeats(exponents: list[float]) -> list[bool]:
        return [budget / total * (least / total) ** (e - 1) / z > max_repeats for e, (z, _) in zip(exponents, sums(exponents), strict=True)]

    by_entropy = by_repeats = None
    if target_entropy is not None:
        by_entropy = 1.0 if flat([1.0])[0] else bisect(flat) if flat([0.0])[0] else 0.0
    if max_repeats is not None:
        if budget > max_repeats * total:
            raise ValueError("the budget needs more repeats than are allowed")
        by_repeats = bisect(repeats) + 0.5**HALVINGS if repeats([0.0])[0] else 0.0
    return min(1.0, max(x for x in (by_entropy, by_repeats, 0.0) if x is not None)) if by_entropy is not None or by_repeats is not None else 1.0


def narrow(docs: DataFrame, key: str, source: str, text: str, seed: int) -> DataFrame:
    """Rows (key, s, words, h, block, part): what mixing needs of each document, kept, so that texts are read once."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null")).alias("s"), words_of(F.col(text)).alias("words"), draw(F.lit(seed), F.col(key)).alias("h"))
    return cut(rows.withColumns(_places(F.col("h"))))


def _places(h: Column) -> dict[str, Column]:
    return {"block": F.shiftright(h, 50).cast("long"), "part": F.shiftright(h, 40).cast("long") % BLOCKS}


def plan(rows: DataFrame, budget: float, target_entropy: float | None, max_repeats: float | None, seed: int) -> DataFrame:
    """Rows (s, tokens, weight, quota, epochs, at_block, at_part, last_h, last_key), one for each source.

    A source is used ``epochs`` times in full and once up to the named place of that epoch's block permutation,
    which fills ``quota`` but for less than a document. Windows run over the BLOCKS blocks of a source, the BLOCKS
    parts of its last block and the documents of its last part, never over a source.
    """
    blocks = cut(rows.groupBy("s", "block").agg(F.sum("words").alias("words")))
    sources = cut(blocks.groupBy("s").agg(F.sum("words").alias("tokens")))
    total = int(sources.agg(F.sum("tokens")).first()[0] or 0)
    budget = int(total * budget)
    e = exponent(sources, total, budget, target_entropy, max_repeats) if total else 1.0
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(max(total, 1))), F.lit(e))).otherwise(0.0)
    scale = float(sources.agg(F.sum(power.cast("decimal(30,20)"))).first()[0] or 1)
    sources = sources.withColumn("weight", power / F.lit(scale or 1.0)).withColumn("quota", F.floor(F.col("weight") * F.lit(float(budget))))
    # a source without a word is used once
    sources = sources.withColumn("epochs", F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.greatest("tokens", F.lit(1)))).otherwise(1))
    sources = cut(sources.withColumn("left", F.when(F.col("tokens") > 0, F.col("quota") - F.col("epochs") * F.col("tokens")).otherwise(-1)))
    n = sources.count()
    near = F.broadcast if n <= BROADCAST_SOURCES else lambda x: x

    def border(found: DataFrame, level: str, of: str, to: str) -> DataFrame:
        """found: (s, epochs, left, ``of``, words). The first place whose words go beyond what is left, and what is left there."""
        turned = found.withColumn(to, turn_of(F.col(of), F.col("s"), F.col("epochs"), seed, level))
        so_far = F.sum("words").over(Window.partitionBy("s").orderBy(to).rowsBetween(Window.unboundedPreceding, 0))
        over = turned.withColumn("end", so_far).where(F.col("end") > F.col("left"))
        first = over.groupBy("s").agg(F.min(F.struct(to, of, (F.col("left") - F.col("end") + F.col("words")).alias("left"))).alias("x"))
        return first.select("s", f"x.{to}", F.col(f"x.{of}").alias(of), F.col("x.left").alias("left"))

    ends = sources.select("s", "epochs", "left")
    first = cut(border(blocks.join(near(ends), "s"), "block", "block", "at_block"))
    inside = rows.join(near(first.join(near(ends.drop("left")), "s")), ["s", "block"]).groupBy("s", "epochs", "left", "part").agg(F.sum("words").alias("words"))
    second = cut(border(inside, "part", "part", "at_part"))
    last = rows.join(near(first.select("s", "block", "at_block").join(near(second), "s")), ["s", "block", "part"])
    units = last.groupBy("s", "left", "h", "key").agg(F.sum("words").alias("words"))
    so_far = F.sum("words").over(Window.partitionBy("s").orderBy("h", "key").rowsBetween(Window.unboundedPreceding, 0))
    ended = units.withColumn("end", so_far).where(F.col("end") <= F.col("left")).groupBy("s").agg(F.max(F.struct("h", "key")).alias("x"))
    out = sources.drop("left").join(near(first.select("s", "at_block")), "s", "left").join(near(second.select("s", "at_part")), "s", "left")
    return out.join(near(ended.select("s", F.col("x.h").alias("last_h"), F.col("x.key").alias("last_key"))), "s", "left")


def copies_of(h: Column, key: Column, seed: int) -> Column:
    """How often a row joined with its source's plan is used."""
    p = _places(h)
    turn = turn_of(p["block"], F.col("s"), F.col("epochs"), seed, "block")
    part = turn_of(p["part"], F.col("s"), F.col("epochs"), seed, "part")
    within = (h < F.col("last_h")) | ((h == F.col("last_h")) & (key.isNull() | (key <= F.col("last_key"))))
    taken = (turn < F.col("at_block")) | ((turn == F.col("at_block")) & ((part < F.col("at_part")) | ((part == F.col("at_part")) & within)))
    return (F.col("epochs") + F.when(taken, 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", budget: float = 1.5, target_entropy: float | None = 0.95, max_repeats: float | None = 4.0, seed: int = 1) -> DataFrame:
    """One row (key, source, words, epoch, block, turn) for each use of a document.

    Source shares of the words are raised to an exponent (see ``exponent``) and scaled to weights; ``budget`` times the words
    that there are is dealt out by them. Every epoch of a source takes its blocks in another
    permutation (``turn``); the last epoch stops where the source's quota is full, less than a document short of it.

    A null source is a source of its own; a null or blank text has no word and is used whenever its place is; a
    source without a word is used once. Rows that repeat a key are used together, or not at all in the last epoch. A
    null key hashes like empty text. Empty tables give no rows. Other columns are not read.
    """
    rows = narrow(docs, key, source, text, seed)
    used = _used(rows, plan(rows, budget, target_entropy, max_repeats, seed), F.col("h"), F.col("key"), seed)
    out = used.withColumn("turn", turn_of(F.col("block"), F.col("s"), F.col("epoch"), seed, "block"))
    name = F.when(F.col("s") != "null", F.expr("substring(s, 2)"))
    return out.select(F.col("key").alias(key), name.alias(source), "words", "epoch", F.col("block").cast("int").alias("block"), F.col("turn").cast("int").alias("turn"))


def realise(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", budget: float = 1.5, target_entropy: float | None = 0.95, max_repeats: float | None = 4.0, seed: int = 1) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix`` uses it, with the columns of ``docs`` and no others."""
    rows = narrow(docs, key, source, text, seed)
    held = plan(rows, budget, target_entropy, max_repeats, seed)
    renamed = {c: fresh(docs, f"mix_{c}") for c in ("s", "h")}
    keyed = docs.withColumns({renamed["s"]: F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null")), renamed["h"]: draw(F.lit(seed), F.col(key))})
    inner = keyed.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(renamed["s"]).alias("s"), F.col(renamed["h"]).alias("h"), F.col(key).alias("key"))
    return _used(inner, held, F.col("h"), F.col("key"), seed).select("row.*")


def _used(rows: DataFrame, held: DataFrame, h: Column, key: Column, seed: int) -> DataFrame:
    held = cut(held.select("s", "epochs", "at_block", "at_part", "last_h", "last_key"))
    held = F.broadcast(held) if held.count() <= BROADCAST_SOURCES else held
    counted = rows.join(held, "s").withColumn("copies", copies_of(h, key, seed)).where("copies > 0")
    return counted.drop("epochs", "at_block", "at_part", "last_h", "last_key").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")


_MD5 = "('0x' || substr(md5({}), 1, 15))::BIGINT"
#: The same in DuckDB's SQL, over the view ``documents``; braces hold nothing that differs between data.
SQL = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'null' ELSE '=' || source END AS s,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS words,
         {_MD5.format("'1|' || coalesce(doc_id::VARCHAR, '')")} AS h
  FROM documents),
sources AS (SELECT s, sum(words)::DOUBLE AS tokens FROM docs GROUP BY s),
facts AS (SELECT sum(tokens) AS total, count(*) FILTER (tokens > 0) AS n, min(tokens) FILTER (tokens > 0) AS least,
                 list(tokens ORDER BY s) FILTER (tokens > 0) AS ts FROM sources),
halved AS (
  SELECT 0 AS step, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high, 0.0::DOUBLE AS rlow, 1.0::DOUBLE AS rhigh
  UNION ALL
  SELECT step + 1, CASE WHEN flat THEN mid ELSE low END, CASE WHEN flat THEN high ELSE mid END,
         CASE WHEN many THEN rmid ELSE rlow END, CASE WHEN many THEN rhigh ELSE rmid END
  FROM (SELECT step, low, high, rlow, rhigh, (low + high) / 2 AS mid, (rlow + rhigh) / 2 AS rmid,
               ln(list_sum(list_transform(ts, lambda t: (t / total) ** ((low + high) / 2))))
               - (low + high) / 2 * list_sum(list_transform(ts, lambda t: (t / total) ** ((low + high) / 2) * ln(t / total)))
                 / list_sum(list_transform(ts, lambda t: (t / total) ** ((low + high) / 2))) >= 0.95 * ln(n) AS flat,
               floor(total * 1.5) / total * (least / total) ** ((rlow + rhigh) / 2 - 1) / list_sum(list_transform(ts, lambda t: (t / total) ** ((rlow + rhigh) / 2))) > 4.0 AS many
        FROM halved, facts WHERE step < {HALVINGS})),
ends AS (
  SELECT total, ts, CASE WHEN n <= 1 THEN 1.0 ELSE least_of END AS e FROM (
    SELECT total, n, ts, least(1.0, greatest(
      CASE WHEN -list_sum(list_transform(ts, lambda t: t / total * ln(t / total))) >= 0.95 * ln(n) THEN 1.0 ELSE low END,
      CASE WHEN floor(total * 1.5) / least / n > 4.0 THEN rlow + 0.5 ** {HALVINGS} ELSE 0.0 END)) AS least_of
    FROM facts, halved WHERE step = {HALVINGS})),
quotas AS (
  SELECT s, tokens, CASE WHEN tokens > 0 THEN floor((tokens / total) ** e / list_sum(list_transform(ts, lambda t: (t / total) ** e)) * floor(total * 1.5))::BIGINT END AS quota
  FROM sources, ends),
epochs AS (SELECT s, CASE WHEN tokens > 0 THEN quota // tokens::BIGINT ELSE 1 END AS epochs,
                  CASE WHEN tokens > 0 THEN quota % tokens::BIGINT ELSE -1 END AS room FROM quotas),
turns AS (
  SELECT s, epochs, room, {_MD5.format("'1|block|' || s || '|' || epochs")} AS a, {_MD5.format("'1|part|' || s || '|' || epochs")} AS b FROM epochs),
placed AS (
  SELECT doc_id, source, d.s, words, h, epochs, room, h >> 50 AS block,
         ((a % {BLOCKS // 2} * 2 + 1) * (h >> 50) + (a >> 20) % {BLOCKS}) % {BLOCKS} AS t1,
         ((b % {BLOCKS // 2} * 2 + 1) * ((h >> 40) % {BLOCKS}) + (b >> 20) % {BLOCKS}) % {BLOCKS} AS t2
  FROM docs d JOIN turns USING (s)),
summed AS (SELECT *, sum(words) OVER (PARTITION BY s ORDER BY t1, t2, h, doc_id RANGE UNBOUNDED PRECEDING) AS so_far FROM placed),
first_over AS (SELECT s, min((t1, t2, h, doc_id)) FILTER (so_far > room) AS x FROM summed GROUP BY s),
used AS (
  SELECT doc_id, source, p.s, words, block, h,
         unnest(range(epochs + CASE WHEN x IS NOT NULL AND room >= 0 AND (t1, t2, h, doc_id) < x THEN 1 ELSE 0 END)) AS epoch
  FROM summed p JOIN first_over USING (s)),
turned AS (SELECT *, {_MD5.format("'1|block|' || s || '|' || epoch")} AS a FROM used)
SELECT doc_id, source, words, epoch::INTEGER AS epoch, block::INTEGER AS block,
       (((a % {BLOCKS // 2} * 2 + 1) * block + (a >> 20) % {BLOCKS}) % {BLOCKS})::INTEGER AS turn
FROM turned
"""
