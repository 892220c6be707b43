"""WARC fixity: Merkle trees over ordered offset ranges, and audits that descend to what differs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.llm._common import bounded_batches, cut, running

#: Bytes of an archive and of a tree's smallest range, and children of a node.
ARCHIVE, RANGE, FANOUT = 1 << 30, 1 << 16, 16


def depth(archive: int = ARCHIVE, smallest: int = RANGE, fanout: int = FANOUT) -> int:
    """The levels above the ranges that bring an archive together in one root."""
    levels, reach = 0, smallest
    while reach < archive:
        levels, reach = levels + 1, reach * fanout
    return levels


def record(key: Column, url: Column, payload: Column) -> Column:
    """The bytes of a WARC resource record. Null parts count as empty."""
    body = F.coalesce(payload.cast("binary"), F.lit(b""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(key.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), body, F.lit(b"\r\n\r\n"))


def split_records(content: bytes) -> Iterator[tuple[int, int]]:
    """(offset, length) of every record of an uncompressed WARC file; ValueError where a record is not one or is cut off."""
    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        if not content.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no record at {at}")
        fields = [x.partition(b":") for x in content[at:end].split(b"\r\n")[1:]]
        size = next((int(v) for k, _, v in fields if k.strip().lower() == b"content-length"), None)
        if size is None or end + 8 + size > len(content):
            raise ValueError(f"the record at {at} is cut off")
        yield at, end + 8 + size - at
        at = end + 8 + size


def read_archives(files: DataFrame) -> DataFrame:
    """Leaves (archive, offset, length, digest) of WARC files given as rows (path, content), as ``binaryFile`` reads them.

    From the first place on at which a file is damaged beyond its framing, the rest is one leaf.
    """
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                content, found, at = content or b"", [], 0
                try:
                    for at, size in split_records(content):
                        found.append((at, size))
                        at += size
                except ValueError:
                    at = sum(found[-1]) if found else 0
                    found.append((at, len(content) - at))
                rows = [(path, o, n, hashlib.sha256(content[o : o + n]).hexdigest()) for o, n in found]
                yield pa.RecordBatch.from_pylist([dict(zip(("archive", "offset", "length", "digest"), r, strict=True)) for r in rows], pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("digest", pa.string())]))

    bounded_batches(files.sparkSession)
    return files.select("path", "content").mapInArrow(run, "archive string, offset long, length long, digest string")


def layout(rows: DataFrame, order: list[Column], length: str = "length", archive: int = ARCHIVE) -> DataFrame:
    """``rows`` with columns archive and offset: records end to end in the given order, a new archive every ``archive`` bytes."""
    placed = running(rows, order, length, "offset")
    return placed.withColumn("archive", F.floor(F.col("offset") / archive)).withColumn("offset", F.col("offset") % archive)


class Tree:
    """Levels (archive, node, hash) over leaves (archive, offset, length, digest); level 0 is of ``RANGE`` bytes a node.

    A node's hash is over its children in order, each with its place. A node has ``FANOUT`` children, or the records
    that begin in its range: their headers alone bound how many these are. Leaves and levels are kept, so an
    audit reads each once.
    """

    def __init__(self, leaves: DataFrame):
        self.leaves = cut(leaves.select("archive", F.floor(F.col("offset") / RANGE).alias("node"), "offset", "length", "digest"))
        own = F.concat_ws(":", F.col("offset").cast("string"), F.col("length").cast("string"), "digest")
        self.levels = [cut(self._over(self.leaves.select("archive", "node", F.col("offset").alias("at"), own.alias("own"))))]
        for _ in range(depth()):
            below = self.levels[-1]
            self.levels.append(cut(self._over(below.select("archive", F.floor(F.col("node") / FANOUT).alias("node"), F.col("node").alias("at"), F.concat_ws(":", F.col("node").cast("string"), "hash").alias("own")))))

    @staticmethod
    def _over(children: DataFrame) -> DataFrame:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "own"))), lambda x: x["own"]), ",")
        return children.groupBy("archive", "node").agg(F.sha2(joined, 256).alias("hash"))


def audit(original: DataFrame, replica: DataFrame) -> DataFrame:
    """One row (archive, offset, length, state) for each record in which a replica differs from the original.

    Both are leaves (archive, offset, length, digest). Roots are compared first; then, level by level, only the
    children of nodes that differ, down to the records of the ranges that do. ``state`` is ``changed``, ``missing``
    or ``extra``; ``length`` is the original's, or the extra record's. Equal replicas end at the roots with no rows.
    Rows with a null archive or offset name no place and are left out; a null digest differs from any other.
    Two records at one place are one group there, compared as a whole by their least digests.
    """
    a, b = (Tree(x.where("archive IS NOT NULL AND offset IS NOT NULL")) for x in (original, replica))
    differ = None
    for ours, theirs in zip(reversed(a.levels), reversed(b.levels), strict=True):
        sides = [x.withColumn("up", F.floor(F.col("node") / FANOUT)) for x in (ours, theirs)]
        if differ is not None:
            up = differ.select("archive", F.col("node").alias("up"))
            sides = [x.join(up, ["archive", "up"], "left_semi") for x in sides]
        left, right = (x.select("archive", "node", F.col("hash").alias(n)) for x, n in zip(sides, "ab", strict=True))
        # kept, as both sides of the next level read it
        differ = cut(left.join(right, ["archive", "node"], "full_outer").where("NOT (a <=> b)").select("archive", "node"))
    left, right = (x.leaves.join(differ, ["archive", "node"], "left_semi").groupBy("archive", "offset").agg(F.min("length").alias(f"{n}l"), F.min("digest").alias(n), F.lit(True).alias(f"{n}h")) for x, n in ((a, "a"), (b, "b")))
    both = left.join(right, ["archive", "offset"], "full_outer").where("ah IS NULL OR bh IS NULL OR NOT (a <=> b) OR NOT (al <=> bl)")
    state = F.when(F.col("bh").isNull(), "missing").when(F.col("ah").isNull(), "extra").otherwise("changed")
    return both.select("archive", "offset", F.coalesce("al", "bl").alias("length"), state.alias("state"))


def damaged(html: Column, key: Column) -> Column:
    """The payload that the drilled replica holds: by the key, a first character or the last one is lost."""
    return F.when(key % 97 == 5, F.concat(F.lit("#"), F.expr("substring(html, 2)"))).when(key % 389 == 7, F.expr("substring(html, 1, length(html) - 1)")).otherwise(html)


def drill(pages: DataFrame) -> DataFrame:
    """A fixity drill over ``pages`` (page_id, url, html): rows (page_id, archive, offset, length, state) that the audit finds.

    The pages are laid out as WARC archives in the order of page_id. The replica holds the same places, but for
    records lost (page_id 3 by 211), altered (5 by 97) and cut short (7 by 389). Both replicas' bytes are hashed where
    they are read, so only lengths and digests are sorted and shuffled. Null parts of a page count as empty, a null
    page_id is first and never damaged; pages that repeat are records of their own.
    """
    key = F.col("page_id")
    ours = record(key, F.col("url"), F.col("html"))
    theirs = record(key, F.col("url"), damaged(F.col("html"), key))
    rows = pages.select("page_id", "url", "html").select("page_id", F.octet_length(ours).cast("long").alias("length"), F.sha2(ours, 256).alias("digest"), F.octet_length(theirs).cast("long").alias("their_length"), F.sha2(theirs, 256).alias("their_digest"))
    placed = cut(layout(rows, [F.col("page_id").asc_nulls_first(), F.col("digest")]))
    replica = placed.where("NOT coalesce(page_id % 211 = 3, false)").select("archive", "offset", F.col("their_length").alias("length"), F.col("their_digest").alias("digest"))
    found = audit(placed.select("archive", "offset", "length", "digest"), replica)
    return placed.select("page_id", "archive", "offset").join(found, ["archive", "offset"]).select("page_id", "archive", "offset", "length", "state")


#: The drill's result by comparing all records, in DuckDB's SQL over the view ``pages``.
SQL = f"""
WITH sized AS (
  SELECT page_id, html, url, octet_length(encode(coalesce(html, ''))) AS n,
         octet_length(encode('WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '')
           || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ')) AS head
  FROM pages),
placed AS (
  SELECT page_id, html, (head + length(n::VARCHAR) + 4 + n + 4)::BIGINT AS length FROM sized),
summed AS (
  SELECT *, (sum(length) OVER (ORDER BY page_id ROWS UNBOUNDED PRECEDING) - length)::BIGINT AS start FROM placed)
SELECT page_id, start // {ARCHIVE} AS archive, start % {ARCHIVE} AS "offset", length,
       CASE WHEN page_id % 211 = 3 THEN 'missing' ELSE 'changed' END AS state
FROM summed
WHERE page_id % 211 = 3 OR (page_id % 97 = 5 AND left(html, 1) <> '#')
   OR (page_id % 97 <> 5 AND page_id % 389 = 7 AND html <> '')
"""
