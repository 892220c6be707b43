import random
import zlib

import numpy as np
from chronofold.llm import quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, held_out int, t string, k int"


def made(n=400, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        good = rng.random() < 0.7
        words = ["".join(rng.choice("abcdeéou") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(5, 120))]
        if not good:
            words = [w + rng.choice(["***", "&&&", "%%%"]) for w in words]
        rows.append((k, " ".join(words)))
        labels.append((k, int(good), 0))
    return rows, labels


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(k, t, "en", "s", 1, "x", 7, "y", 9) for k, t in rows], DOCS)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_columns(spark, monkeypatch):
    monkeypatch.setattr(quality, "STEPS", 150)
    rows, labels = made()
    docs, marks = frames(spark, rows + [(None, "abc"), (9000, None), (9001, ""), (5, rows[5][1])], labels)
    got = quality.classify(docs, marks).toPandas()
    assert list(got.columns) == ["doc_id", "held_out", "score", "predicted"] and len(got) == 404
    held = [k for k, _ in rows if zlib.crc32(str(k).encode()) % 3 == 1]
    assert set(got[got.held_out].doc_id) - {9000, 9001} == set(held)
    truth = {k: q for k, q, _ in labels}
    sure = got[got.held_out & got.doc_id.isin(held)]
    assert np.mean([truth[int(k)] == p for k, p in zip(sure.doc_id, sure.predicted, strict=True)]) > 0.95
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    assert got[got.doc_id == 5].score.nunique() == 1
    assert got[got.doc_id == 9000].score.iloc[0] == got[got.doc_id == 9001].score.iloc[0]


def test_nothing_to_learn(spark):
    rows, _ = made(20)
    docs, marks = frames(spark, rows, [(0, 1, 0), (2, None, 0), (None, 0, 0), (3, 0, 0), (3, 1, 0), (4, 5, 0)])
    assert set(quality.classify(docs, marks).toPandas().score) <= {2 / 3, 1 / 2}
    assert quality.classify(*frames(spark, [], [])).count() == 0


def test_flat_scores_match_single_texts():
    rng = np.random.default_rng(0)
    net = quality.Network(rng.normal(0, 1, (quality.WIDTH, 256, quality.FILTERS)).astype(np.float32), rng.normal(0, 1, quality.FILTERS).astype(np.float32), rng.normal(0, 1, (2 * quality.FILTERS, quality.HIDDEN)), np.zeros(quality.HIDDEN), rng.normal(0, 1, quality.HIDDEN), 0.1)
    texts = [b"", b"a", b"x" * 63, b"hello world " * 40, bytes(rng.integers(0, 256, 5000, dtype=np.uint8)), b"y" * 200_000]
    raw, at = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    whole = quality.score(net, net.pairs(), raw, at)
    for text, p in zip(texts, whole, strict=True):
        # every position's filter value by its definition, in overlapping chunks over the whole text
        data = np.concatenate([np.zeros(quality.WIDTH - 1, np.uint8), np.frombuffer(text, np.uint8)])
        total = -(-(len(text) + quality.WIDTH - 1) // quality.SEGMENT) * quality.SEGMENT
        data = np.concatenate([data, np.zeros(total + quality.WIDTH - 1 - len(data), np.uint8)])
        value = sum(net.tables[k][data[k : k + total]] for k in range(quality.WIDTH)) + net.bias
        starts = range(0, max(total - quality.SEGMENT, 1), quality.SEGMENT)
        chunks = np.maximum([value[s : s + 2 * quality.SEGMENT].max(axis=0) for s in starts], 0)
        x = np.concatenate([chunks.mean(axis=0), chunks.max(axis=0)])[None, :]
        assert abs(quality.head(net, x)[1][0] - p) < 1e-4


def test_gradient_matches_differences():
    rng = np.random.default_rng(3)
    net = quality.Network(rng.normal(0, 0.5, (quality.WIDTH, 256, quality.FILTERS)), rng.normal(0, 0.1, quality.FILTERS), rng.normal(0, 0.5, (2 * quality.FILTERS, quality.HIDDEN)), np.zeros(quality.HIDDEN), rng.normal(0, 0.5, quality.HIDDEN), 0.0)
    texts, labels = [b"abc defg " * 30, b"zz*** qq" * 20, b"k"], np.array([1, 0, 1])

    def loss():
        raw, at = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        p = quality.score(net, net.pairs(), raw, at.astype(np.int64))
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    got = quality.gradient(net, texts, labels, decay=0.0)
    for name, at in (("hidden", (3, 2)), ("out", (4,)), ("hidden_bias", (1,))):
        weights = getattr(net, name)
        weights[at] += 1e-4
        up = loss()
        weights[at] -= 2e-4
        down = loss()
        weights[at] += 1e-4
        assert abs((up - down) / 2e-4 - got[name][at]) < 1e-3
