"""Interaction of quality filters: what each of them removes in every order, walked by adjacent swaps over mask cells."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm._common import bounded_batches, columns_of, cut, utf8
from chronofold.llm.simhash import SLICE, SPACE

LETTERS = "ABCDE"
UPPER = bytes(range(65, 91))
SIGNS = b"#$%&*|"
#: Bytes that continue a code point of UTF-8.
INNER = bytes(range(0x80, 0xC0))
#: Fewest words, least share of distinct words and largest share of capitals, both in hundredths.
WORDS, DISTINCT, CAPITALS = 200, 50, 3


def failures(text: bytes) -> int:
    """The filters A to D that a UTF-8 text fails, as bits from the lowest: it is read in slices that end between words."""
    count, distinct, at = 0, set(), 0
    while at < len(text):
        end = min(at + SLICE, len(text))
        while end < len(text) and text[end] not in SPACE:
            end += 1
        words = (text if end - at == len(text) else text[at:end]).split()  # bytes.split() splits at SPACE only
        count += len(words)
        distinct.update(words)
        at = end
    points = len(text) if text.isascii() else len(text.translate(None, INNER))
    capitals = len(text) - len(text.translate(None, UPPER))
    signs = any(s in text for s in SIGNS)
    return (count < WORDS) | (100 * len(distinct) < DISTINCT * count) << 1 | (100 * capitals > CAPITALS * points) << 2 | signs << 3


def walk(n: int) -> Iterator[tuple[tuple[int, ...], int | None]]:
    """All orders of 0 to n - 1, each with the place of the swap that led to it: the places there and next change, no other.

    Every order but the first is the one before with two neighbours swapped (Steinhaus, Johnson and Trotter): the largest
    number that can still move in its direction moves, and all larger ones turn around.
    """
    order, left = list(range(n)), [True] * n
    yield tuple(order), None
    while True:
        best, at = -1, -1
        for k, x in enumerate(order):
            to = k - 1 if left[x] else k + 1
            if 0 <= to < n and order[to] < x and x > best:
                best, at = x, k
        if best < 0:
            return
        to = at - 1 if left[best] else at + 1
        order[at], order[to] = order[to], order[at]
        for x in range(best + 1, n):
            left[x] = not left[x]
        yield tuple(order), min(at, to)


MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def audit_cells(cells: dict[int, tuple[int, int, int]], filters: int = len(LETTERS)) -> list[tuple[str, int, int, int, int, int, int, int, int]]:
    """Rows (order, step, the measures, shapley) for all orders of the filters over cells mask: (documents, good, toxic).

    A step depends on its filter and on the set of those before it, so a swap of neighbours changes two steps only; the
    rest of an order's steps are those of the order before it. ``shapley`` adds up each filter's removals on the way.
    """

    def step(before: int, f: int) -> tuple[int, ...]:
        bit = 1 << f
        kept = removed = redundant = unique = good = toxic = 0
        for mask, (n, g, t) in cells.items():
            if not mask & (before | bit):
                kept += n
            if mask & bit:
                if mask & before:
                    redundant += n
                else:
                    removed, good, toxic = removed + n, good + g, toxic + t
                if mask == bit:
                    unique += n
        return kept, removed, redundant, unique, good, toxic

    rows, shapley, steps = [], [0] * filters, [(0,) * len(MEASURES)] * filters
    for order, swapped in walk(filters):
        for place in range(filters) if swapped is None else (swapped, swapped + 1):
            steps[place] = step(sum(1 << f for f in order[:place]), order[place])
        for place, f in enumerate(order):
            shapley[f] += steps[place][1]
        rows.append((order, tuple(steps)))
    named = []
    for order, found in rows:
        word = "".join(LETTERS[f] for f in order)
        named += [(word, place + 1, *found[place], shapley[f]) for place, f in enumerate(order)]
    return named


def cells(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (part, mask, n, good, toxic): the documents by part and by the filters that they fail.

    Texts are read once, where they are: a task returns an id, a part, the bits of A to D and the text's SHA-256. Rows that
    agree in all of these are counted first, so copies of a text shrink before anything else. Filter E passes the rows with
    the smallest id of their digest: that id is a minimum with map-side combine, and it meets the rows by digest and id, so
    a text that many documents share is no hot key.
    """
    bounded_batches(documents.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in columns_of(batches):
            masks, digests = [], []
            for value in batch.column(2):
                text = value.as_py() or b""
                masks.append(failures(text))
                digests.append(hashlib.sha256(text).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], ["id", "part", "mask", "digest"])

    narrow = documents.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("lang", F.lit("")).alias("part"), utf8("text").alias("text"))
    scanned = narrow.mapInArrow(read, "id long, part string, mask int, digest binary")
    counted = cut(scanned.groupBy("id", "part", "mask", "digest").agg(F.count("*").alias("n")))
    named = counted.where("id IS NOT NULL")
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.expr("int(quality <=> 1)")).alias("good"), F.max(F.expr("int(toxic <=> 1)")).alias("toxic"))
    first = named.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marked = named.join(known, "id", "left").join(first, ["digest", "id"], "left")
    full = marked.select("part", F.col("mask").bitwiseOR(F.when(F.col("first"), 0).otherwise(1 << LETTERS.index("E"))).alias("mask"), "n", "good", "toxic")
    nameless = counted.where("id IS NULL").select("part", "mask", "n", F.lit(None).cast("int").alias("good"), F.lit(None).cast("int").alias("toxic"))
    count_of = lambda c: F.coalesce(F.sum(F.when(F.col(c) == 1, F.col("n"))), F.lit(0)).alias(c)
    return full.unionByName(nameless).groupBy("part", "mask").agg(F.sum("n").alias("n"), count_of("good"), count_of("toxic"))


RESULT = "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in (*MEASURES, "shapley"))


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """What each of five filters removes at its step in each of their 120 orders, for every value of ``lang``.

    A document fails A with fewer than 200 words, B if under half of its words are distinct, C if over 3 % of its code
    points are A to Z, D if it holds one of ``#$%&*|``, and E if its text equals that of a smaller id anywhere in the table.
    Per part, order and step: kept, removed, redundant (fails but was removed earlier), unique_fails (fails this filter
    only), good_lost and toxic_lost (removed with such a label), shapley (removed, summed over all orders at any step).

    A null text is an empty one, a null or empty ``lang`` is the part ''. A row without an id has no label, passes E and is
    nothing's original; rows that repeat an id and a text do not fail E by each other. Of several label rows of an id any 1
    counts. Other columns are not read. An empty table gives no rows, missing labels give no losses.
    A part reaches one task as 32 cells at most, whatever its documents.
    """

    def parts(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = audit_cells({int(r.mask): (int(r.n), int(r.good), int(r.toxic)) for r in rows.itertuples()})
        out = pd.DataFrame(found, columns=["filter_order", "step", *MEASURES, "shapley"])
        out.insert(0, "part", key[0])
        return out

    return cells(documents, labels).groupBy("part").applyInPandas(parts, RESULT)


#: The query over the views ``documents`` and ``labels``.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, max((quality IS NOT DISTINCT FROM 1)::INTEGER) AS good, max((toxic IS NOT DISTINCT FROM 1)::INTEGER) AS toxic FROM labels GROUP BY doc_id),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
f AS (
  SELECT w.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
         (len(words) < 200)::INTEGER + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INTEGER
         + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::INTEGER
         + 8 * regexp_matches(text, '[#$%&*|]')::INTEGER + 16 * coalesce(w.doc_id > first, false)::INTEGER AS mask
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
x AS (SELECT unnest([0, 1, 2, 3, 4]) AS i),
orders AS (
  SELECT [a.i, b.i, c.i, e.i, g.i] AS o FROM x a, x b, x c, x e, x g
  WHERE len(list_distinct([a.i, b.i, c.i, e.i, g.i])) = 5),
steps AS (
  SELECT list_aggregate(list_transform(o, lambda i: substr('ABCDE', i + 1, 1)), 'string_agg', '') AS filter_order, s.i + 1 AS step, 1 << o[s.i + 1] AS bit,
         coalesce(list_sum(list_transform(o[1:s.i], lambda i: 1 << i)), 0)::INTEGER AS before
  FROM orders, x s),
found AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM found
"""
