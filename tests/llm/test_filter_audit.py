import re
from itertools import permutations

import duckdb
import pyarrow as pa
from chronofold.llm import filter_audit

DOCS = "doc_id long, text string, lang string, mask int, n string, part long"


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    capitals = len(re.findall("[A-Z]", text))
    return {f for f, hit in zip("ABCD", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * capitals > 3 * len(text), bool(re.search(r"[#$%&*|]", text))), strict=True) if hit}


def brute(docs, labels):
    rows = [(i, t or "", p or "") for i, t, p in docs]
    bad = [fails(t) | ({"E"} if i is not None and any(j is not None and j < i and u == t for j, u, _ in rows) else set()) for i, t, _ in rows]
    good, toxic = ({i for i, q, x in labels if (q, x)[k] == 1 and i is not None} for k in range(2))
    out = []
    for part in {p for _, _, p in rows}:
        mine = [(i, b) for (i, _, p), b in zip(rows, bad, strict=True) if p == part]
        shapley, found = dict.fromkeys("ABCDE", 0), []
        for order in permutations("ABCDE"):
            left = list(mine)
            for s, f in enumerate(order):
                gone = [(i, b) for i, b in left if f in b]
                left = [x for x in left if f not in x[1]]
                earlier = sum(f in b for _, b in mine) - len(gone)
                shapley[f] += len(gone)
                found.append([part, "".join(order), s + 1, len(left), len(gone), earlier, sum(b == {f} for _, b in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), f])
        out += [(*r[:-1], shapley[r[-1]]) for r in found]
    return sorted(out)


def run(spark, docs, labels):
    found = filter_audit.audit(spark.createDataFrame([(*d, 1, "x", 2) for d in docs], DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert [f.dataType.simpleString() for f in found.schema] == ["string", "string", "int"] + ["bigint"] * 7
    return sorted(map(tuple, found.collect()))


def sql(docs, labels):
    con = duckdb.connect()
    for name, rows, columns in (("documents", docs, [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string())]), ("labels", labels, [("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())])):
        con.register(name, pa.table({c: pa.array([r[k] for r in rows], kind) for k, (c, kind) in enumerate(columns)}))
    return sorted(con.sql(filter_audit.SQL).fetchall())


LONG = " ".join(f"w{k}" for k in range(200))


def test_matches_brute_force_and_sql(spark):
    texts = [LONG, LONG, LONG + " w1", " ".join("ab"[k % 2] for k in range(200)), LONG.upper(), LONG + " $", "short", "short", "A", "", None, "é" * 97 + "ABC", "é" * 96 + "ABCD", " \t\x0b\n", "a\x85b c"]
    docs = [(k, t, ("en", "fr", None, "")[k % 4]) for k, t in enumerate(texts)]
    docs += [(None, LONG, "en"), (None, LONG, "en"), (3, LONG, "fr"), (3, LONG, "fr"), (-1, "short", None), (7, "other", "en"), (20, "é ", "de"), (21, "É ", "de")]
    labels = [(k, k % 2, k % 3) for k in range(12)] + [(None, 1, 1), (5, 0, 1), (6, None, None), (3, 1, None)]
    want = brute(docs, labels)
    assert run(spark, docs, labels) == want
    assert sql(docs, labels) == want
    assert run(spark, docs, []) == brute(docs, [])
    assert run(spark, [], labels) == []


def test_walk_swaps_neighbours_only():
    orders = list(filter_audit.walk(5))
    assert {o for o, _ in orders} == set(permutations(range(5)))
    assert len(orders) == 120
    for (before, _), (after, at) in zip(orders, orders[1:], strict=False):
        swapped = list(before)
        swapped[at], swapped[at + 1] = swapped[at + 1], swapped[at]
        assert tuple(swapped) == after


def test_shapley_shares_add_up_to_what_all_remove():
    rows = filter_audit.audit_cells({0: (5, 1, 0), 1: (3, 0, 0), 3: (4, 2, 1), 31: (2, 0, 0), 16: (1, 1, 1)})
    share = {o[s - 1]: sh for o, s, *_, sh in rows}
    assert sum(share.values()) == 120 * 10
    assert len(rows) == 600


def test_slices_read_a_long_text_whole(monkeypatch):
    text = (LONG + "\n") * 40 + "é" * 50 + " end of it"
    whole = filter_audit.failures(text.encode())
    monkeypatch.setattr(filter_audit, "SLICE", 7)
    assert filter_audit.failures(text.encode()) == whole == sum(1 << "ABCD".index(f) for f in fails(text))
