"""Quality classifier: supervised subword embeddings.

A document's features are its words, their character n-grams with the word ends, and the form of each word (its letter
case, what it ends with, whether it repeats the word before it), all hashed into tables of fixed size. Each bucket has a
learned vector; a document is the mean of the vectors of its features, and a softmax over that mean gives the label.
Vectors and output are trained by stochastic gradient descent in numpy.

Training reads at most ``SAMPLE`` labelled rows of each label (those with the least hash of their id). Their features are
counted in Spark tasks; the driver gets sparse counts of these rows only, whatever the corpus. For scoring, a bucket's
vector times the output weights is one number, so a document's score is the mean of its features' numbers.

Defined results: a null or empty text has no features and gets the score of the labels' frequency; ids with contradictory
or null labels aren't learned from; without rows of both labels the score is the frequency of label 1 (0.5 without any);
rows that repeat are scored alike; long texts are read whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import tokens as T

#: Labelled rows of each label that training reads at most.
SAMPLE = 2000
SIZES = (3, 4, 5)
BITS, WORD_BITS, FORM_BITS = 16, 14, 8
BUCKETS = (1 << BITS) + (1 << WORD_BITS) + (1 << FORM_BITS)

_SLICE = 2 << 20
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[128:] = True
_KINDS = np.full(256, 3, np.uint8)  # what a word ends with
_KINDS[_LETTER] = 0
_KINDS[48:58] = 1
_KINDS[[33, 44, 46, 58, 59, 63]] = 2


@dataclass
class Model:
    numbers: np.ndarray  # one for each bucket
    bias: float


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the features of a batch, and the byte at which each begins, one kind of feature after the other."""
    starts, ends, first = T.words(data, offsets)
    # n-grams: the byte before and after a word counts as a space
    inside = ~T.SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    for n in SIZES:
        # inside a word
        if len(data) >= n:
            h = np.zeros(len(data) - n + 1, np.uint32)
            ok = np.ones(len(h), bool)
            for k in range(n):
                h *= np.uint32(0x01000193)
                h += data[k:len(h) + k]
                ok &= inside[k:len(h) + k]
                if k:
                    ok &= ~edge[k:len(h) + k]
            at = np.flatnonzero(ok)
            yield _bucket(h[at], n, BITS), at
        # at its beginning and its end
        long = ends - starts >= n - 1
        for side, base in ((0, starts[long]), (1, ends[long] - n + 1)):
            h = np.full(len(base), 7 + side, np.uint32)
            for k in range(n - 1):
                h *= np.uint32(0x01000193)
                h += data[base + k]
            yield _bucket(h, 16 + n + side, BITS), base
    words = T.hashes(data, starts, ends)
    yield (words >> np.uint64(64 - WORD_BITS)).astype(np.int64) + (1 << BITS), starts
    same = np.zeros(len(words), bool)
    same[1:] = words[1:] == words[:-1]
    begins = first[:-1][np.diff(first) > 0]
    same[begins] = False
    upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    ups, lets = upper[ends] - upper[starts], letters[ends] - letters[starts]
    case = np.where(lets == 0, 3, np.where(ups == 0, 0, np.where(ups == 1, 1, 2)))
    tail = _KINDS[data[ends - 1]] if len(ends) else np.zeros(0, np.uint8)
    tail2 = _KINDS[data[np.maximum(ends - 2, starts)]] if len(ends) else tail
    form = (same.astype(np.int64) * 4 + case) * 16 + tail * 4 + tail2
    yield form + (1 << BITS) + (1 << WORD_BITS), starts


def _bucket(h: np.ndarray, salt: int, bits: int) -> np.ndarray:
    h = (h + np.uint32(salt)) * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    return (h * np.uint32(0x85EBCA77) >> np.uint32(32 - bits)).astype(np.int64)


def counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of one text and their share of its features."""
    total = np.zeros(BUCKETS, np.int64)
    for buckets, _ in features(data, offsets):
        total += np.bincount(buckets, minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at.astype(np.int32), (total[at] / max(1, total.sum())).astype(np.float32)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], prior: float, dim: int = 8, steps: int = 30_000, rate: float = 0.3, seed: int = 1) -> Model:
    """Stochastic gradient descent with steps that shrink where a weight has moved much (Adagrad)."""
    n1 = sum(y for _, _, y in rows)
    n0 = len(rows) - n1
    if not n0 or not n1:
        p = min(max(prior, 0.0), 1.0) if rows else 0.5
        return Model(np.zeros(BUCKETS), float(np.log((p + 1e-6) / (1 - p + 1e-6))))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim))
    out, bias = rng.uniform(-0.5, 0.5, (dim, 2)), np.zeros(2)
    seen_v, seen_o, seen_b = np.full(BUCKETS, 1e-8), np.full(dim, 1e-8), 1e-8
    epochs = -(-steps // len(rows))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for k in rng.permutation(len(rows)):
            at, share, y = rows[k]
            mean = share @ vectors[at]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1  # the gradient of the loss
            g = out @ p
            grad = share[:, None] * g
            seen_v[at] += (grad**2).mean(axis=1)
            go = np.outer(mean, p)
            seen_o += (go**2).mean(axis=1)
            seen_b += (p**2).mean()
            vectors[at] -= step * grad / np.sqrt(seen_v[at])[:, None]
            out -= step * go / np.sqrt(seen_o)[:, None]
            bias -= step * p / np.sqrt(seen_b)
    # the sample holds the labels as evenly as it can; the bias brings back how frequent they are
    shift = np.log(prior / (1 - prior)) - np.log(n1 / n0)
    w = out[:, 1] - out[:, 0]
    return Model(vectors @ w, float(bias[1] - bias[0] + shift))


def score_batch(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    total, size = np.zeros(n), np.zeros(n)
    for buckets, at in features(data, offsets):
        # features of n-grams are in two runs of ascending places, so each kind is summed by row on its own
        cuts = np.searchsorted(at, offsets)
        sums = np.concatenate([[0.0], np.cumsum(model.numbers[buckets])])
        total += sums[cuts[1:]] - sums[cuts[:-1]]
        size += np.diff(cuts)
    z = model.bias + total / np.maximum(size, 1)
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def held_out(id_col: Column) -> Column:
    """Rows that training never sees: a fifth, by the id's checksum."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def labelled(labels: DataFrame, label: str, id_col: str = "doc_id") -> DataFrame:
    """(id, y) for ids with one label, without the held-out ones."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col(id_col)))
    grouped = rows.groupBy(F.col(id_col).alias("_id")).agg(F.min(label).alias("y"), F.max(label).alias("_most"))
    return grouped.where("y = _most").select("_id", F.col("y").cast("int").alias("y"))


def bounded(known: DataFrame, sample: int) -> DataFrame:
    """At most ``sample`` rows of each label, those with the least hash of their id."""
    return known.where("y = 0").orderBy(F.xxhash64("_id"), "_id").limit(sample).unionAll(known.where("y = 1").orderBy(F.xxhash64("_id"), "_id").limit(sample))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    known = labelled(labels, label, id_col)
    share = known.agg(F.avg("y")).first()[0]
    chosen = F.broadcast(bounded(known, sample))  # at most twice the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                at, part = counts(*T.flat(batch.column("text").slice(k, 1)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(k, 1), batch.column("y").slice(k, 1), pa.array([at.tobytes()], pa.binary()), pa.array([part.tobytes()], pa.binary())], ["id", "y", "at", "part"],
                )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, F.expr("id = _id")).select("id", "y", "text")
    got = rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, y int, at binary, part binary").toArrow().to_pylist()
    got.sort(key=lambda r: (r["id"], r["at"]))
    data = [(np.frombuffer(r["at"], np.int32), np.frombuffer(r["part"], np.float32), r["y"]) for r in got]
    return train(data, share if share is not None else 0.5)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one number for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in T.slices(whole, "text", _SLICE):
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(score_batch(shared.value, *T.flat(batch.column("text"))))], ["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, score double")


def report(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    return score(docs, fit(docs, labels)).select(
        F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
