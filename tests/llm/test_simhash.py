import random
import re

import numpy as np
import pytest
import xxhash
from chronofold.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `node` int, shard string"


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    if not words:
        return 0
    cut = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in cut]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    """(doc_id, fingerprint, component) of each row by all pairs."""
    prints = [(k, plain_print(t)) for k, t in rows]
    parent = {k: k for k, _ in prints if k is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, p) in enumerate(prints):
        for b, q in prints[:i]:
            if a is not None and b is not None and (p ^ q).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return sorted(((k, f"{p:016x}", None if k is None else root(k)) for k, p in prints), key=str)


def run(spark, rows):
    df = spark.createDataFrame([(k, t, "en", "s", 1, 3, "x") for k, t in rows], SCHEMA)
    return sorted(map(tuple, simhash.near_duplicates(df).collect()), key=str)


def made_rows(seed=3, n=150):
    rng = random.Random(seed)
    vocabulary = ["Alpha", "bêta", "GAMMA", "δέλτα", "e", "zeta x", "Éta", "theta"]
    rows = []
    for k in range(n):
        kind = rng.random()
        if rows and kind < 0.5:
            words = (rng.choice(rows)[1] or "").split(" ")
            if kind < 0.3 and words:
                words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        else:
            text = rng.choice([" ", "\n", "\t"]).join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 3, 40, 200])))
        rows.append((k, text))
    return rows


def test_matches_brute_force(spark):
    rows = made_rows()
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "a b c"), (4, "a b c"), (4, "x y z w"), (5, "x y z w"), (5, "x y z w"), (9, "x" * 5000), (8, "a  b\nc")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_spark_hash_is_the_same(spark):
    text = "été two three"
    assert spark.range(1).selectExpr(f"xxhash64('{text}')").first()[0] == np.uint64(xxhash.xxh64_intdigest(text.encode(), 42)).astype(np.int64)


def test_long_text_in_slices(monkeypatch):
    text = (" ".join(random.Random(1).choice(["ab", "Cd", "e"]) for _ in range(3000))).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "SLICE", 64)
    assert simhash.fingerprint(text) == whole == plain_print(text.decode())


@pytest.mark.parametrize("depth", [0, 3, 6])
def test_links_join_all_close_pairs(spark, monkeypatch, depth):
    rng = np.random.default_rng(depth)
    seeds = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    flips = np.array([np.uint64(0)] + [np.uint64(1 << int(b)) for b in rng.integers(0, 63, 40)])
    prints = np.unique(np.concatenate([seeds ^ flips[rng.integers(0, 41, 60)] ^ flips[rng.integers(0, 41, 60)] for _ in range(12)]))
    monkeypatch.setattr(simhash, "SHARD", max(1, len(prints) >> depth))
    nodes = spark.createDataFrame([(int(p), k) for k, p in enumerate(prints.view(np.int64))], "fingerprint long, node long")
    found = simhash.Forest(len(prints))
    got = simhash.links(nodes, 2).collect()
    found.join(np.array([r[0] for r in got], int), np.array([r[1] for r in got], int))
    want = simhash.Forest(len(prints))
    i, j = np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 2)
    want.join(i, j)
    assert (found.label == want.label).all()
    assert 1 < len(set(want.label)) < len(prints)
