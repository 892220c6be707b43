"""The table-sized queries against their SQL, over texts that are null, empty, blank, long, repeated or full of marks."""

import difflib
import random

import duckdb
import pytest
from chronofold.core import wording
from chronofold.plans import corpora, queries

NAMES = [name for name, f in queries.QUERIES.items() if f.__module__ == corpora.__name__]
TEXTS = [None, "", "   ", "<b>&amp; & ]] §", "En linje er her. Tre.\n\nto  tre er Fire.\nfire\nfem", "ord " * 200, "A. b. C " * 90 + "&lt;", "x" * 500, "se § 1 skal lyde: noe\n2 to"]
KINDS = ("purchase", "signup", "error", "view")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpora"))
    rng = random.Random(2)
    save = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    save("documents", [(k, x, "no", f"s{k % 2}", len(x or "")) for k, x in enumerate(TEXTS * 4)], "doc_id long, text string, lang string, source string, n_chars long")
    save("conversations", [(c, n, "user", rng.choice(["a b", "noe helt annet her", "", "x y z " * 9])) for c in range(14) for n in range(5)], "conv_id long, turn long, role string, text string")
    save("lineitem", [(k // 6, rng.randrange(9), rng.randrange(9), k % 6 + 1) for k in range(60)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int")
    events = [(k, k % 7 if k % 9 else None, rng.choice(KINDS), f"2024-01-{rng.randrange(1, 9):02d} 00:00:00") for k in range(200)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, ts string").selectExpr("event_id", "user_id", "event_type", "cast(ts AS timestamp_ntz) AS ts").write.parquet(f"{path}/events.parquet")
    return path


@pytest.mark.parametrize("name", NAMES)
def test_query_against_its_sql(spark, folder, name):
    got = queries.QUERIES[name](spark, folder)
    with duckdb.connect() as db:
        for table in ("documents", "conversations", "lineitem", "events"):
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
        found = db.execute(queries.SQL[name])
        names = [c[0] for c in found.description]
        want = [dict(zip(names, row, strict=True)) for row in found.fetchall()]
    assert sorted(got.columns) == sorted(names)
    rows = lambda rs: sorted(str([r[c] for c in sorted(names)]) for r in rs)
    assert rows(got.collect()) == rows(want)


def test_ratio_of_a_contained_text():
    rng = random.Random(3)
    for _ in range(300):
        a = "".join(rng.choice("ab c") for _ in range(rng.randrange(1, 12)))
        b = "".join(rng.choice("ab c") for _ in range(rng.randrange(5))) + a + "".join(rng.choice("ab c") for _ in range(rng.randrange(5)))
        assert wording.ratio(a, b) == difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() and wording.ratio(b, a) == difflib.SequenceMatcher(None, b, a, autojunk=False).ratio()
