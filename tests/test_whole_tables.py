"""Queries over whole tables: nothing is left out by length, by number or by key."""

import difflib
import math
import random

import pytest
from chronofold.core import likeness, wording
from chronofold.operators import align
from chronofold.plans import queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    long = " ".join(f"ord{k * k}" for k in range(150))
    texts = [("s1", long), ("s2", long + " til"), ("s1", long + " nok et"), ("s1", "kort"), ("s2", "kort"), ("s2", "noe helt annet enn de andre her")]
    rows = [(2 * k, t, "no", s, len(t)) for k, (s, t) in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    turns = [(1, 0, "user", "a b " + "x" * 2500), (1, 1, "assistant", "a c " + "x" * 2500), (2, 0, "user", "a"), (2, 1, "assistant", "b")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return path, rows


def documents(spark, path):
    return spark.read.parquet(f"{path}/documents.parquet").selectExpr("doc_id AS id", "lang", "source", "text")


def test_similar_pairs_of_any_length(spark, folder):
    path, rows = folder
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and wording.similarity(a[1], b[1]) >= 0.9}
    docs = documents(spark, path)
    assert {(r["a_id"], r["b_id"]) for r in align.pairs(docs, docs, 0.9, ["lang"]).where("a_id < b_id").collect()} == want >= {(0, 2), (0, 4), (6, 8)}


def test_best_matches_between_versions(spark, folder):
    docs = documents(spark, folder[0])
    found = align.mutual_best(docs.where("source = 's1'"), docs.where("source = 's2'"), 0.9, ["lang"])
    assert {(r["a_id"], r["b_id"]) for r in found.collect()} == {(0, 2), (6, 8)} and align.renumbered(found).count() == 2


def test_redline_of_long_turns(spark, folder):
    assert sorted(r["conv_id"] for r in queries.redline(spark, folder[0]).collect()) == [1, 2]


def test_many_short_passages(spark, monkeypatch):
    monkeypatch.setattr(align, "SHORT", 2)
    passages = [(1, "one"), (2, "two words"), (3, "nowhere"), (4, "e t"), (5, "one two three four five six seven"), (6, None)]
    texts = [(1, "one two three four five six seven eight"), (2, "two words"), (3, None), (4, "")]
    got = align.verbatim(spark.createDataFrame(texts, "k int, text string"), spark.createDataFrame(passages, "item int, text string"), "k", "item")
    assert sorted(map(tuple, got.collect())) == sorted((i, k) for i, p in passages for k, t in texts if t and p and p in t)


def test_classes_and_links_are_brute_force(spark, monkeypatch):
    """Tiles of three texts in squares of many cells: every pair still meets once, copies stay one class."""
    monkeypatch.setattr(align, "TILE", 3)
    monkeypatch.setattr(align, "TILES", 1)
    rng = random.Random(7)
    words = ["alfa", "beta", "gamma", "delta", "epsilon", "zeta"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([3, 20, 60]))) for _ in range(25)]
    texts += [t.upper() for t in texts[:6]] + [t + " ny" for t in texts] + [t.replace("alfa", "alfe", 1) for t in texts[::2]] + ["", None, " - "]
    rows = [(k * 7 % 101, t, f"b{k % 2}" if k % 5 else None) for k, t in enumerate(texts)] + [(None, texts[0], "b1"), (None, "only here", "b1"), (3, texts[3], "b0"), (3, texts[4], "b0")]
    df = spark.createDataFrame(rows, "id int, text string, block string")
    for block in ([], ["block"]):
        members, links = align.classes(df, 0.9, block)
        groups = {}
        for key, text, b in rows:
            groups.setdefault((b if block else 0, wording.canonical(text or "")), []).append(key)
        rep = {g: min(k for k in ids if k is not None) for g, ids in groups.items() if any(k is not None for k in ids)}
        want = {(x, y): s for x in rep for y in rep if x[0] == y[0] and x[1] != y[1] and rep[x] < rep[y] and (s := wording.ratio(x[1], y[1])) >= 0.9}
        found = {((r[0] if block else 0), r["a_id"], r["b_id"]): r["score"] for r in links.collect()}
        assert found == pytest.approx({(x[0], rep[x], rep[y]): s for (x, y), s in want.items()})
        degree = {g: sum(g in pair for pair in want) for g in rep}
        held = sorted(map(repr, [((r[0] if block else 0), r["id"], r["class_id"], r["links"]) for r in members.collect()]))
        assert held == sorted(map(repr, [(g[0], key, rep[g], degree[g]) for g, ids in groups.items() if g in rep for key in ids]))
        assert len(want) > (5 if block else 20)


def test_ratios_are_the_library_s():
    """The blocks found by hashes are those of the standard library, also where one text repeats itself."""
    rng = random.Random(11)
    for trial in range(200):
        letters = "abcdefgh ij"[: rng.choice([2, 4, 11])]
        a = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 400)))
        b = a
        for _ in range(rng.randrange(0, 40)):
            at = rng.randrange(len(b) + 1)
            b = b[:at] + rng.choice(letters) + b[at + rng.randrange(3) :]
        b = b if trial % 3 else "".join(rng.choice(letters) for _ in range(rng.randrange(1, 400)))
        want = difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()
        assert likeness.ratio(a, b) == want
        assert likeness.ratio(a, b, want) == want
        assert likeness.ratio(a, b, min(1.0, want + 0.02)) <= want
        # the common subsequence bounds every ratio, and its early end loses none
        assert 2 * likeness.common(likeness.Masks(a), b, math.ceil(want * (len(a) + len(b)) / 2 - 1e-6)) >= want * (len(a) + len(b)) - 1e-6


def test_common_subsequence_in_a_band(monkeypatch):
    rng = random.Random(12)
    for trial in range(300):
        monkeypatch.setattr(likeness, "ROWS", rng.choice([1, 3, 16, 128]))
        a, b = ("".join(rng.choice("abcd"[: 2 + trial % 3]) for _ in range(rng.randrange(60))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for c in a:
            before = 0
            for j, d in enumerate(b):
                row[j + 1], before = (before + 1 if c == d else max(row[j + 1], row[j])), row[j + 1]
        for least in {0, row[-1], row[-1] + 1, max(0, row[-1] - 4)}:
            assert likeness.common(likeness.Masks(a), b, least) == (row[-1] if row[-1] >= least else -1)
