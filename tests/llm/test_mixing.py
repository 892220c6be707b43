import math
import random

import duckdb
import pandas as pd
import pytest
from chronofold.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, epoch string, s int, words string"


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "en", s, 1, "x", 3, "y") for k, t, s in rows], SCHEMA)


def made_rows(n=600):
    rng = random.Random(5)
    rows = []
    for k in range(n):
        source = "hot" if rng.random() < 0.5 else f"s{int(rng.random() ** 2 * 6)}"
        rows.append((k, " ".join(rng.choice(["a", "bb", "Ü c"]) for _ in range(rng.randrange(0, 60))), source))
    return rows


def natural_exponent(tokens, target):
    """By plain bisection over the exact shares."""
    total = sum(tokens)

    def flat(e):
        powers = [(t / total) ** e for t in tokens]
        return -sum(x / sum(powers) * math.log(x / sum(powers)) for x in powers) >= target * math.log(len(tokens))

    low, high = 0.0, 1.0
    for _ in range(60):
        low, high = ((low + high) / 2, high) if flat((low + high) / 2) else (low, (low + high) / 2)
    return low


def test_bisect_is_plain_bisection():
    assert mixing.bisect(lambda xs: [x < 0.3137 for x in xs]) == pytest.approx(0.3137, abs=1e-11)


def test_weights_meet_the_entropy_and_quotas_are_filled(spark):
    rows = made_rows()
    got = mixing.mix(frame(spark, rows), budget=1.5, max_repeats=None).toPandas()
    counts = {k: len(t.split()) for k, t, _ in rows}
    tokens = {}
    for k, _, s in rows:
        tokens[s] = tokens.get(s, 0) + counts[k]
    e = natural_exponent(list(tokens.values()), 0.95)
    assert 0 < e < 1
    total = sum(tokens.values())
    powers = {s: (t / total) ** e for s, t in tokens.items()}
    used = got.groupby("source")["words"].sum()
    for s, p in powers.items():
        quota = p / sum(powers.values()) * int(1.5 * total)
        assert quota - 120 < used[s] <= quota
    # full epochs hold every document once, and the last one nothing twice
    assert not got.duplicated(["doc_id", "epoch"]).any()
    uses = got.groupby("doc_id").size()
    for k, _, s in rows:
        assert uses.get(k, 0) in (int(used[s] // tokens[s]), int(used[s] // tokens[s]) + 1)


def test_repeat_limit(spark):
    rows = [(k, "a b c d", "big") for k in range(95)] + [(100 + k, "a b c d", "small") for k in range(5)]
    got = mixing.mix(frame(spark, rows), budget=1.5, target_entropy=1.0, max_repeats=3.0).toPandas()
    used = got.groupby("source").size()
    assert used["small"] in (14, 15) and used["big"] == pytest.approx(135, abs=1)  # a quota of 60 words, but for the last bit
    with pytest.raises(ValueError):
        mixing.mix(frame(spark, rows), budget=5.0, max_repeats=3.0)


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_sql(spark, seed):
    rows = made_rows(300 + seed)
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "source"])  # noqa: F841
    want = sorted(duckdb.sql(mixing.SQL).fetchall())
    assert sorted(map(tuple, mixing.mix(frame(spark, rows)).select("doc_id", "source", "words", "epoch", "block", "turn").collect())) == want


def test_realise_keeps_columns_and_counts(spark):
    rows = made_rows(200)
    df = frame(spark, rows)
    real = mixing.realise(df)
    assert real.schema == df.schema
    assert sorted(r[0] for r in real.collect()) == sorted(r[0] for r in mixing.mix(df).collect())


def test_odd_rows(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    rows = [(1, None, None), (2, "", "a"), (None, "x y", "a"), (3, "x " * 4000, "a"), (4, "a b", "b"), (4, "a b", "b"), (5, " \n", "empty"), (6, None, "empty")]
    got = mixing.mix(frame(spark, rows), max_repeats=None).toPandas()
    assert set(got[got.source == "empty"].doc_id) == {5, 6}
    assert (got[got.source == "empty"].epoch == 0).all()
    assert sorted(got[got.doc_id == 4].epoch) == sorted([*range(got[got.doc_id == 4].epoch.max() + 1)] * 2)
    assert mixing.realise(frame(spark, rows), max_repeats=None).count() == len(got)
