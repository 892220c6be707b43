import hashlib

import duckdb
import pandas as pd
import pytest
from chronofold.llm import warc

LEAF = "archive long, offset long, length long, digest string"


def leaves(n=3000, size=700):
    return [(k * size // (1 << 20), k * size % (1 << 20), size, hashlib.sha256(str(k).encode()).hexdigest()) for k in range(n)]


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(warc, "RANGE", 4096)
    monkeypatch.setattr(warc, "ARCHIVE", 1 << 20)
    monkeypatch.setattr(warc, "depth", lambda: 2)


def test_audit_locates_every_difference(spark, small):
    rows = leaves()
    other = [r for k, r in enumerate(rows) if k != 100]
    other[500] = (*other[500][:3], "bad")
    other[2900] = (*other[2900][:2], 1, other[2900][3])
    other.append((7, 5, 10, "new"))
    other[10] = (*other[10][:3], None)
    got = sorted(map(tuple, warc.audit(spark.createDataFrame(rows, LEAF), spark.createDataFrame(other, LEAF)).collect()))
    ours, theirs = {r[:2]: r[2:] for r in rows}, {r[:2]: r[2:] for r in other}
    want = sorted((*k, (ours.get(k) or theirs[k])[0], "missing" if k not in theirs else "extra" if k not in ours else "changed") for k in ours.keys() | theirs.keys() if ours.get(k) != theirs.get(k))
    assert got == want and len(want) == 5


def test_equal_empty_and_null(spark, small):
    rows = leaves(50)
    df = spark.createDataFrame(rows, LEAF)
    assert warc.audit(df, df).count() == 0
    none = spark.createDataFrame([], LEAF)
    assert warc.audit(none, none).count() == 0
    assert warc.audit(df, none).count() == 50
    assert warc.audit(df, spark.createDataFrame([*rows, (None, 1, 1, "x"), (1, None, 1, "x")], LEAF)).count() == 0


def test_drill_matches_sql(spark):
    rows = [(k, f"https://x/{k}", f"<p>{'é' * (k % 50)}{k}</p>") for k in range(900)]
    rows += [(1000, None, "<p>"), (1003, "u", None), (1004, None, None), (1072, "v", None), (1169, "w", ""), (396, "late", "#x")]
    pages = pd.DataFrame(rows, columns=["page_id", "url", "html"])  # noqa: F841
    df = spark.createDataFrame([(*r, 1, "x") for r in rows if r[0] != 396 or r[1] != "late"], "page_id long, url string, html string, archive int, length string")
    pages = pages[~((pages.page_id == 396) & (pages.url == "late"))]
    got = warc.drill(df)
    assert sorted(map(tuple, got.collect())) == sorted(duckdb.sql(f"SELECT page_id, archive, \"offset\", length, state FROM ({warc.SQL})").fetchall())
    assert warc.drill(df.limit(0)).count() == 0


def test_repeated_and_null_pages(spark):
    rows = [(None, "u", "<p>"), (5, "u", "<p>a"), (5, "u", "<p>a"), (102, None, None), (3, "u", "x" * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r["page_id"], r["state"]) for r in warc.drill(df).collect())
    assert got == [(3, "missing"), (5, "changed"), (5, "changed")]  # a null page has nothing to alter


def test_reads_its_own_records(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "https://a", "<p>é</p>"), (2, None, None)], "k long, u string, h string")
    parts = [bytes(r[0]) for r in df.select(warc.record(F.col("k"), F.col("u"), F.col("h"))).collect()]
    content = b"".join(parts)
    assert [content[o : o + n] for o, n in warc.split_records(content)] == parts
    files = spark.createDataFrame([("a.warc", bytearray(content)), ("b.warc", bytearray(content[:-9])), ("c.warc", None)], "path string, content binary")
    found = sorted(map(tuple, warc.read_archives(files).collect()))
    assert [r[:3] for r in found] == [("a.warc", 0, len(parts[0])), ("a.warc", len(parts[0]), len(parts[1])), ("b.warc", 0, len(parts[0])), ("b.warc", len(parts[0]), len(parts[1]) - 9)]
    with pytest.raises(ValueError):
        list(warc.split_records(b"nonsense"))
