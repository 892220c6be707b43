"""A quality classifier: a byte-level convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.llm._common import bounded_batches, flat_bytes, fresh, utf8

#: Bytes that a filter sees, filters, and bytes of a segment; a chunk is two neighbouring segments, so chunks overlap by one.
WIDTH, FILTERS, SEGMENT = 6, 16, 64
HIDDEN = 16
#: The bounds of what is learned from: labelled rows for each class, and bytes of a text; a longer one teaches by as many
#: bytes in WINDOWS even pieces from its start to its end.
MAX_ROWS, MAX_TEXT, WINDOWS = 1500, 32 << 10, 8
STEPS, BATCH, RATE = 600, 32, 0.02
#: Segments whose filter values are held at a time.
BLOCK = 1024


@dataclass
class Network:
    """Weights: a filter's value is the sum over its places of a table's row for the byte there, plus a bias."""

    tables: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray
    hidden: np.ndarray  # 2 * FILTERS x HIDDEN
    hidden_bias: np.ndarray
    out: np.ndarray
    shift: float  # the last bias
    constant: float | None = None  # the score of every text where there was nothing to learn

    def pairs(self) -> np.ndarray:
        """The tables of two neighbouring places, as one row for each pair of bytes."""
        return np.stack([(self.tables[k][:, None, :] + self.tables[k + 1][None, :, :]).reshape(65536, -1) for k in range(0, WIDTH, 2)])


def layout(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, first segment of each text and the end): texts in whole segments, each with WIDTH - 1 zeros after it at least.

    The bytes begin with WIDTH - 1 zeros, so a filter that ends at any place never sees another text.
    """
    sizes = np.diff(at)
    segments = -(-(sizes + WIDTH - 1) // SEGMENT)
    first = np.concatenate([[0], np.cumsum(segments)])
    out = np.zeros(WIDTH - 1 + first[-1] * SEGMENT, np.uint8)
    for k in np.flatnonzero(sizes):
        to = WIDTH - 1 + first[k] * SEGMENT
        out[to : to + sizes[k]] = raw[at[k] : at[k + 1]]
    return out, first


def segment_values(data: np.ndarray, pairs: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Each segment's largest value of each filter."""
    total = (len(data) - WIDTH + 1) // SEGMENT
    out = np.empty((total, FILTERS), np.float32)
    value, other = np.empty((BLOCK * SEGMENT, FILTERS), np.float32), np.empty((BLOCK * SEGMENT, FILTERS), np.float32)
    for at in range(0, total, BLOCK):
        n = (min(BLOCK, total - at)) * SEGMENT
        some = data[at * SEGMENT : at * SEGMENT + n + WIDTH]
        both = some[:-1].astype(np.intp) << 8 | some[1:]
        np.take(pairs[0], both[:n], axis=0, out=value[:n], mode="clip")
        for k in range(1, len(pairs)):
            np.take(pairs[k], both[2 * k : 2 * k + n], axis=0, out=other[:n], mode="clip")
            np.add(value[:n], other[:n], out=value[:n])
        out[at : at + n // SEGMENT] = value[:n].reshape(-1, SEGMENT, FILTERS).max(axis=1)
    return out + bias


def chunk_values(segments: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, first chunk of each text and the end): the larger of two neighbouring segments' values, negatives as 0."""
    last = np.zeros(len(segments), bool)
    last[first[1:] - 1] = True
    single = np.diff(first) == 1
    keep = ~last
    keep[first[:-1][single]] = True
    after = np.where(last, np.arange(len(segments)), np.arange(len(segments)) + 1)
    chunks = np.maximum(segments, segments[after])[keep]
    return np.maximum(chunks, 0), np.concatenate([[0], np.cumsum(np.maximum(np.diff(first) - 1, 1))])


def pooled(chunks: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each text's mean and largest chunk values."""
    mean = np.add.reduceat(chunks, first[:-1], axis=0, dtype=np.float64) / np.diff(first)[:, None]
    return np.concatenate([mean, np.maximum.reduceat(chunks, first[:-1], axis=0)], axis=1)


def head(net: Network, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.tanh(x @ net.hidden + net.hidden_bias)
    return h, 1 / (1 + np.exp(-np.clip(h @ net.out + net.shift, -30, 30)))


def score(net: Network, pairs: np.ndarray, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The probability of label 1 for each text of a flat buffer."""
    if net.constant is not None or len(at) == 1:
        return np.full(len(at) - 1, net.constant if net.constant is not None else 0.0)
    data, first = layout(raw, at)
    return head(net, pooled(*chunk_values(segment_values(data, pairs, net.bias), first)))[1]


def train(texts: list[bytes], labels: np.ndarray, share: float | None = None, seed: int = 1) -> Network:
    """A network for texts with labels 0 and 1, from batches that hold both alike; ``share`` is the share of label 1.

    The last bias then moves the score from equal shares to ``share``. With one class only there is nothing to tell
    apart, and every text gets the smoothed share of label 1.
    """
    rng = np.random.default_rng(seed)
    net = Network(
        rng.normal(0, 0.1, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32),
        rng.normal(0, 0.3, (2 * FILTERS, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), 0.0,
    )
    classes = [np.flatnonzero(labels == c) for c in (0, 1)]
    if not all(map(len, classes)):
        net.constant = (len(classes[1]) + 1) / (len(labels) + 2)
        return net
    weights = {"tables": net.tables, "bias": net.bias, "hidden": net.hidden, "hidden_bias": net.hidden_bias, "out": net.out}
    weights["shift"] = np.zeros(1)
    slope, square = ({k: np.zeros(v.shape) for k, v in weights.items()} for _ in range(2))
    for step in range(1, STEPS + 1):
        drawn = np.concatenate([rng.choice(c, BATCH // 2) for c in classes])
        net.shift = float(weights["shift"][0])
        for k, g in gradient(net, [texts[i] for i in drawn], labels[drawn]).items():
            slope[k] += 0.1 * (g - slope[k])
            square[k] += 0.01 * (g * g - square[k])
            rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
            weights[k] -= (rate * (slope[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(weights[k].dtype)
    share = share if share is not None else len(classes[1]) / len(labels)
    net.shift = float(weights["shift"][0]) + float(np.log(share / (1 - share)))
    return net


def gradient(net: Network, texts: list[bytes], labels: np.ndarray, decay: float = 1e-4) -> dict[str, np.ndarray]:
    """The slopes of the mean log loss of a batch; through the pooling they reach the winning places only."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    data, first = layout(raw, np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    total = first[-1]
    place, segments = np.empty((total, FILTERS), np.int64), np.empty((total, FILTERS), np.float32)
    pairs = net.pairs()
    both = data[:-1].astype(np.intp) << 8 | data[1:]
    for at in range(0, total, BLOCK):
        n = min(BLOCK, total - at) * SEGMENT
        value = sum(pairs[k][both[at * SEGMENT + 2 * k : at * SEGMENT + 2 * k + n]] for k in range(len(pairs))).reshape(-1, SEGMENT, FILTERS)
        won = value.argmax(axis=1)
        place[at : at + len(won)] = won + (at + np.arange(len(won)))[:, None] * SEGMENT
        segments[at : at + len(won)] = np.take_along_axis(value, won[:, None, :], axis=1)[:, 0] + net.bias
    chunks, start = chunk_values(segments, first)
    x = pooled(chunks, start)
    h, p = head(net, x)
    d = (p - labels) / len(texts)
    dh = d[:, None] * net.out * (1 - h * h)
    dx = dh @ net.hidden.T
    owner = np.repeat(np.arange(len(texts)), np.diff(start))
    top = chunks == x[owner][:, FILTERS:].astype(np.float32)
    ties = np.add.reduceat(top, start[:-1], axis=0, dtype=np.int64)[owner]
    dc = dx[owner][:, :FILTERS] / np.diff(start)[owner][:, None] + np.where(top, dx[owner][:, FILTERS:] / np.maximum(ties, 1), 0)
    dc = np.where(chunks > 0, dc, 0)
    # a chunk's first segment, and its second where that one won
    lead = first[:-1][owner] + np.arange(len(owner)) - start[:-1][owner]
    second = np.minimum(lead + 1, first[1:][owner] - 1)
    from_ = np.where(segments[second] > segments[lead], second[:, None], lead[:, None])
    column = np.broadcast_to(np.arange(FILTERS), from_.shape)
    ds = np.bincount((from_ * FILTERS + column).ravel(), dc.ravel(), total * FILTERS).reshape(total, FILTERS)
    column = np.broadcast_to(np.arange(FILTERS), place.shape)
    tables = np.stack([np.bincount((data[place + k].astype(np.int64) * FILTERS + column).ravel(), ds.ravel(), 256 * FILTERS).reshape(256, FILTERS) for k in range(WIDTH)])
    return {"tables": tables + decay * net.tables, "bias": ds.sum(axis=0), "hidden": x.T @ dh + decay * net.hidden, "hidden_bias": dh.sum(axis=0), "out": h.T @ d + decay * net.out, "shift": np.array([d.sum()])}


def held_out(key: Column) -> Column:
    """Whether a row's label is kept from learning: CRC-32 of the key's text leaves 1 by 3. False for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = MAX_ROWS, max_text: int = MAX_TEXT) -> Network:
    """A network learned from at most ``max_rows`` labelled documents of each class that are not held out.

    The rows are those with the smallest hash of the key, whatever their length. A text of over ``max_text`` bytes
    teaches by so many of them, in pieces spread evenly over all of it. So at most ``2 * max_rows * max_text`` bytes
    reach the driver. Labels other than 0 and 1, null keys and keys with
    both labels teach nothing; of several texts with one key the smallest does.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col(key)))
    known = known.groupBy(F.col(key).alias("k")).agg(F.min(label).alias("y"), F.max(label).alias("z")).where("y = z").select("k", F.col("y").cast("int").alias("y"))
    counts = dict(known.groupBy("y").count().collect())
    drawn: dict = {}
    for y in counts:
        drawn |= dict(known.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(max_rows).collect())
    width, whole = max_text // WINDOWS, utf8(F.coalesce(F.col(text), F.lit("")))
    places = [F.floor((F.octet_length("w") - width) * k / max(1, WINDOWS - 1)).cast("int") + 1 for k in range(WINDOWS)]
    pieces = F.concat(*(F.substring(F.col("w"), at, F.lit(width)) for at in places))
    texts = docs.select(F.col(key).alias("k"), whole.alias("w")).where(F.col("k").isin(list(drawn))).select("k", F.when(F.octet_length("w") <= max_text, F.col("w")).otherwise(pieces).alias("t"))
    rows = sorted((k, bytes(t)) for k, t in texts.groupBy("k").agg(F.min("t").alias("t")).collect()) if drawn else []
    return train([t for _, t in rows], np.array([drawn[k] for k, _ in rows], np.int64), (counts.get(1, 0) + 1) / (sum(counts.values()) + 2))


def scored(docs: DataFrame, net: Network, text: str = "text", to: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text as column ``to``; a null text counts as empty. Not one row is dropped."""
    pairs, spark = net.pairs(), docs.sparkSession
    bounded_batches(spark)
    weights = spark.sparkContext.broadcast((net, pairs))  # of fixed size

    @F.pandas_udf("double")
    def of(texts):
        held = list(texts)
        raw, at = np.frombuffer(b"".join(held), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in held], dtype=np.int64)])
        import pandas as pd

        return pd.Series(score(*weights.value, raw, at.astype(np.int64)))

    return docs.withColumn(to, of(utf8(F.coalesce(F.col(text), F.lit("")))))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (key, held_out, score, predicted) for each document, by a network learned from ``labels``.

    Scores follow from the text alone, so equal texts score alike; a null text counts as empty. A null key is scored
    and never held out. Repeated rows are scored each. Without labels every score is the smoothed share of label 1.
    An empty table gives no rows. Other columns are not read.
    """
    net = fit(docs, labels, key, text)
    pairs, kind = net.pairs(), docs.schema[key].dataType.simpleString()
    bounded_batches(docs.sparkSession)
    weights = docs.sparkSession.sparkContext.broadcast((net, pairs))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score(*weights.value, *flat_bytes(batch.column(2))))], ["key", "held_out", "score"])

    rows = docs.select(F.col(key).alias("key"), held_out(F.col(key)).alias("held_out"), utf8(text).alias("t"))
    out = rows.mapInArrow(run, f"key {kind}, held_out boolean, score double")
    return out.select(F.col("key").alias(key), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
