"""Toxicity: a support vector machine over a subsequence string kernel, with Nyström landmarks.

The kernel counts common subsequences of three letters in two units of text, each weighted by ``DECAY`` for every letter
that it skips, up to a span of ``SPAN`` bytes. So "idxiot", "id-iot" and "i d i o t" stay close to "idiot": a unit is a
word, or a run of single letters with the spaces between them, and signs count as gaps. Letters are compared without
case and accents' case; digits and signs that stand for letters are read as these.

Training works on sentences. Those of clean documents are clean. A toxic document's label says only that some sentence
is toxic: the sentence and unit that tell most (by the share of toxic documents among those that hold one of its
fragments at first, by the machine's own margin later) are its witnesses, with units that tell about as much. Landmarks are witnesses far from each other and
clean units near to them; the Nyström map takes units to their kernel values with the landmarks, whitened; a linear
machine is trained there by Newton steps on the squared hinge loss, on witnesses, on copies of them with gaps and inserted letters, and on
clean units, the hardest of which join in each round.

A trained machine is a sum over landmarks, and the kernel a sum over subsequences, so both fold into one table with a
weight for each subsequence. A unit's margin is then a sum of table entries over its norm, and a document's the largest
of its units.

Training reads at most ``SAMPLE`` labelled documents of each label (those with the least hash of their id), and of these
as many as ``SAMPLE_BYTES`` hold. Of their units it takes all that tell of toxicity as witnesses; landmarks are chosen among
the ``CANDIDATES`` most frequent ones; clean units that it trains on are the ``COMMON`` most frequent, ``OTHERS`` by hash and
all that come near the margin in a round; ``ALTERED`` common ones join with gaps and inserted letters. Scoring has no limits.

Defined results: a null or empty text has no unit and gets the least score; ids with contradictory or null labels aren't
learned from; without documents of both labels every score is the frequency of label 1 (0.5 without any); rows that
repeat are scored alike; long texts are read whole; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import tokens as T
from .quality import bounded, held_out, labelled

#: Labelled documents of each label that training reads at most.
SAMPLE = 1000
#: Bytes of text that training reads at most: they are on the driver.
SAMPLE_BYTES = 64 << 20
LANDMARKS = 160
#: Bounds of training: frequent units among which landmarks are chosen; clean units that are frequent, others, and altered.
CANDIDATES, COMMON, OTHERS, ALTERED = 600, 2000, 4000, 300
DECAY, SPAN = 0.5, 9
_WINDOW, _STRIDE = 28, 8  # bytes of a long unit that are judged together
_SLICE = 1 << 20
_ROUNDS = 3

_KINDS = 59  # letters a to z, then bytes beyond ASCII by their low bits, which upper and lower case share
_CLASS = np.zeros(256, np.int64)
for _k in range(26):
    _CLASS[65 + _k] = _CLASS[97 + _k] = 1 + _k
_CLASS[128:] = 27 + (np.arange(128, 256) & 31)
for _sign, _letter in ((b"0", b"o"), (b"1", b"i"), (b"3", b"e"), (b"4", b"a"), (b"5", b"s"), (b"7", b"t"), (b"@", b"a"), (b"$", b"s")):
    _CLASS[_sign[0]] = _CLASS[_letter[0]]
#: First bytes of letters: those of other characters beyond ASCII are mostly signs.
_ALONE = _CLASS > 0
_ALONE[128:] = False
_ALONE[0xC3:0xE0] = _ALONE[0xE3:0xED] = True
_GAPS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of the units of a batch, and the first unit of each row."""
    starts, ends, first = T.words(data, offsets)
    n = len(starts)
    # one letter, of however many bytes
    letters = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    single = (letters[ends] - letters[starts] == 1) & _ALONE[data[starts]] if n else np.zeros(0, bool)
    joins = np.zeros(n, bool)  # to the word before it
    if n:
        joins[1:] = single[1:] & single[:-1]
        joins[first[:-1][np.diff(first) > 0]] = False
    head = np.flatnonzero(~joins)
    last = np.append(head[1:], n)[: len(head)] - 1
    a, b = starts[head], ends[last] if n else ends
    # long units are judged in windows
    more = np.maximum(0, -(-(b - a - _WINDOW) // _STRIDE))
    size = 1 + more
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    a2 = np.repeat(a, size) + at * _STRIDE
    b2 = np.minimum(np.repeat(b, size), a2 + _WINDOW)
    row_first = np.searchsorted(a2, offsets)
    return a2, b2, row_first


def _flat(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letter classes of units with room between them, and where each begins."""
    size = ends - starts + SPAN
    first = np.cumsum(size) - size
    out = np.zeros(int(size.sum()) + SPAN, np.int64)
    length = ends - starts
    to = np.arange(int(length.sum())) + np.repeat(first - (np.cumsum(length) - length), length)
    frm = np.arange(int(length.sum())) + np.repeat(starts - (np.cumsum(length) - length), length)
    out[to] = _CLASS[data[frm]]
    return out, first


def _sums(flat: np.ndarray, first: np.ndarray, table: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """For each unit the table's weights over its subsequences, and its squared norm."""
    n = len(flat) - SPAN
    raw, norm = np.zeros(n, np.float32), np.zeros(n, np.float32)
    real = (flat > 0).astype(np.float32)
    lead = flat[:n] * (_KINDS * _KINDS)
    middle = flat * _KINDS
    for a, b in _GAPS:
        weight = DECAY ** (b - 2)
        if table is not None:
            raw += np.float32(weight) * table[lead + middle[a:a + n] + flat[b:b + n]]
        norm += np.float32(weight**2) * (real[:n] * real[a:a + n] * real[b:b + n])
    return np.add.reduceat(raw, first).astype(float), np.add.reduceat(norm, first).astype(float)


def _pack(names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum([len(n) for n in names])
    return _flat(np.frombuffer(b"".join(names), np.uint8), ends - [len(n) for n in names], ends)


def _feature_table(names: list[bytes], weights: np.ndarray) -> np.ndarray:
    """The weighted sum of the units' normalised feature vectors, as a table over subsequences."""
    flat, first = _pack(names)
    n = len(flat) - SPAN
    owner = np.repeat(np.arange(len(names)), np.diff(np.append(first, n)))
    norm = np.sqrt(np.maximum(_sums(flat, first, None)[1], 1e-12))
    scale = weights[owner] / norm[owner]
    table = np.zeros(_KINDS**3, np.float64)
    for a, b in _GAPS:
        at = np.flatnonzero((flat[:n] > 0) & (flat[a:a + n] > 0) & (flat[b:b + n] > 0))
        key = flat[at] * (_KINDS * _KINDS) + flat[at + a] * _KINDS + flat[at + b]
        np.add.at(table, key, DECAY ** (b - 2) * scale[at])
    return table.astype(np.float32)


def kernel(names: list[bytes], landmarks: list[bytes]) -> np.ndarray:
    """Normalised kernel values of units with landmarks."""
    flat, first = _pack(names)
    out = np.zeros((len(names), len(landmarks)))
    norm = None
    for k, z in enumerate(landmarks):
        raw, squared = _sums(flat, first, _feature_table([z], np.ones(1)))
        norm = np.sqrt(np.maximum(squared, 1e-12)) if norm is None else norm
        out[:, k] = raw / norm
    return out


@dataclass
class Model:
    table: np.ndarray | None
    bias: float
    middle: float  # the margin that stands for a probability of one half
    slope: float
    prior: float

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The largest margin of the units of each row."""
        least = self.bias
        out = np.full(len(offsets) - 1, least)
        a, b, rows = units(data, offsets)
        if not len(a):
            return out
        folded = _CLASS[data].astype(np.uint8)
        _, some, back = np.unique(T.hashes(folded, a, b), return_index=True, return_inverse=True)
        raw, squared = _sums(*_flat(data, a[some], b[some]), self.table)
        margin = (raw / np.sqrt(np.maximum(squared, 1e-12)) + self.bias)[back]
        full = np.flatnonzero(np.diff(rows))
        out[full] = np.maximum(least, np.maximum.reduceat(margin, rows[:-1][full]))
        return out

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.table is None:
            return np.full(len(offsets) - 1, self.prior)
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.margins(data, offsets) - self.middle), -500, 500)))


def sentences(text: str) -> list[list[bytes]]:
    """Units of each sentence, in lower case."""
    out = []
    for part in re.split(r"(?<=[.!?])\s+|\n", text):
        data = np.frombuffer(part.lower().encode(), np.uint8)
        a, b, _ = units(data, np.array([0, len(data)]))
        raw = data.tobytes()
        if len(a):
            out.append([raw[x:y] for x, y in zip(a, b, strict=True)])
    return out


def _fragments(unit: bytes) -> set[bytes]:
    core = unit.strip(b".,;:!?\"'()*#&%$|")
    return {core[k:k + n] for n in (4, 5, 6) for k in range(len(core) - n + 1)} | {b"^" + core}


def _altered(unit: bytes, rng: np.random.Generator) -> list[bytes]:
    """The unit with gaps, and with an inserted letter and sign."""
    core = unit.strip(b".,;:!?\"'()")
    if len(core) < 4:
        return []
    k, x = int(rng.integers(1, len(core))), bytes([int(rng.integers(97, 123))])
    return [b" ".join(core[i:i + 1] for i in range(len(core)))[:_WINDOW], core[:k] + x + core[k:], core[:k] + b"-" + core[k:]]


def _spread(names: list[bytes], count: Counter, k: int) -> list[bytes]:
    """Frequent units, each the farthest from those before it."""
    names = sorted(names, key=lambda n: (-count[n], n))[:CANDIDATES]
    if len(names) <= k:
        return names
    chosen = [0]
    near = kernel(names, [names[0]])[:, 0]
    weight = np.log1p([count[n] for n in names])
    while len(chosen) < k:
        i = int(np.argmax((1 - near) * weight))
        if near[i] > 0.999:
            break
        chosen.append(i)
        near = np.maximum(near, kernel(names, [names[i]])[:, 0])
    return [names[i] for i in chosen]


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-5) -> np.ndarray:
    """A linear machine by Newton steps on the weighted squared hinge loss; the last column of x is one."""
    def loss(w):
        return penalty * (w @ w) + (weight * np.maximum(0, 1 - y * (x @ w)) ** 2).sum()

    w = np.zeros(x.shape[1])
    for _ in range(60):
        bad = y * (x @ w) < 1
        z = x[bad] * weight[bad][:, None]
        new = np.linalg.solve(z.T @ x[bad] + penalty * np.eye(x.shape[1]), z.T @ y[bad])
        step, now = 1.0, loss(w)
        while step > 1e-4 and loss(w + step * (new - w)) > now:
            step /= 2
        if np.abs(step * (new - w)).max() < 1e-6:
            break
        w = w + step * (new - w)
    return w


def train(docs: list[tuple[str, int]], prior: float, landmarks: int = LANDMARKS, seed: int = 1) -> Model:
    if len({y for _, y in docs}) < 2:
        return Model(None, 0.0, 0.0, 1.0, prior if docs else 0.5)
    rng = np.random.default_rng(seed)
    pool: dict[bytes, bytes] = {}  # each unit once
    parsed = [([[pool.setdefault(u, u) for u in s] for s in sentences(t or "")], y) for t, y in docs]
    del pool
    bags = [({u for s in ss for u in s if len(u) >= 3}, y) for ss, y in parsed]
    n = Counter(y for _, y in bags)
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for bag, y in sorted(bags, key=lambda b: -b[1]):
        found = set().union(*map(_fragments, bag)) if bag else set()
        # fragments that no toxic document holds tell nothing
        seen[y].update(found if y else found & seen[1].keys())
    # how much more often a fragment is in toxic documents, where chance doesn't explain it among so many fragments
    odds, least, part = {}, np.log(1 + len(seen[1])), n[1] / (n[0] + n[1])
    for f, c in seen[1].items():
        d = seen[0][f]
        if c / n[1] > d / n[0] and c * np.log(c / (c + d) / part) + (d * np.log(d / (c + d) / (1 - part)) if d else 0) > least:
            odds[f] = np.log((c + 0.1) / n[1] / ((d + 0.5) / n[0]))
    del seen
    clean = Counter(u for bag, y in bags if not y for u in bag)
    toxic = Counter(u for bag, y in bags if y for u in bag)
    toxic_units = sorted(toxic)
    worth = {u: max((odds.get(f, -9.0) for f in _fragments(u)), default=-9.0) for u in toxic_units}
    common = [u for u, _ in sorted(clean.items(), key=lambda x: (-x[1], x[0]))[:COMMON]]
    rare = sorted(clean, key=lambda u: hash_of(u))[:OTHERS]
    negatives = sorted(set(common + rare))
    model, found = None, Counter()
    for attempt in range(_ROUNDS):
        # witnesses of each toxic document: the best units of its sentences
        near_best = 0.5 if attempt else 1.5
        before, found = found, Counter()
        for ss, y in parsed:
            if y:
                told = {u: worth.get(u, -9.0) for s in ss for u in s if clean[u] * 10 < toxic[u] or u not in clean}
                best = max(told.values(), default=-9.0)
                found.update(u for u, w in told.items() if w > 0 and w >= best - near_best)
        found |= before
        if not found:
            return Model(None, 0.0, 0.0, 1.0, prior)
        negatives = [u for u in negatives if u not in found]
        marks = _spread(sorted(found), found, landmarks * 5 // 8)
        # clean units that come nearest: to the witnesses at first, to the margin later
        near = kernel(negatives, marks).max(axis=1) if model is None else _margin(model, negatives)
        hard = [negatives[i] for i in np.argsort(-near, kind="stable")[: landmarks]]
        marks += _spread(hard, Counter(hard), landmarks - len(marks))
        values, vectors = np.linalg.eigh(kernel(marks, marks))
        keep = values > 1e-6 * values.max()
        white = vectors[:, keep] / np.sqrt(values[keep])
        bad = sorted(found)
        altered = [(v, found[u]) for u in bad for v in _altered(u, rng)]
        other = [v for u in hard + common[:ALTERED] for v in _altered(u, rng)]
        names = bad + [v for v, _ in altered] + negatives + other
        y = np.array([1] * (len(bad) + len(altered)) + [-1] * (len(negatives) + len(other)))
        weight = np.array([float(found[u]) for u in bad] + [c / 3 for _, c in altered] + [1.0] * (len(negatives) + len(other)))
        for side in (1, -1):
            weight[y == side] /= weight[y == side].sum()
        x = np.column_stack([kernel(names, marks) @ white, np.ones(len(names))])
        close = set(hard)
        weight *= np.array([20.0 if u in close else 1.0 for u in names])
        weight[y < 0] /= weight[y < 0].sum()
        w = _machine(x, y, weight)
        alpha = white @ w[:-1]
        model = Model(_feature_table(marks, alpha), float(w[-1]), 0.0, 1.0, prior)
        every = sorted(clean)
        margin = dict(zip(every, _margin(model, every), strict=True))
        negatives = sorted(set(negatives) | {u for u in every if margin[u] > -0.5})
        worth = dict(zip(toxic_units, _margin(model, toxic_units) + 1.0, strict=True))
    top = np.array([max((margin_of for margin_of in _margin(model, [u for s in ss for u in s])), default=model.bias) if ss else model.bias for ss, _ in parsed])
    labels = np.array([y for _, y in parsed])
    order = np.argsort(top, kind="stable")
    t, l = top[order], labels[order]
    # the cut with the fewest errors at the labels' own frequency, in the middle of the widest such gap
    weigh = np.where(l == 1, prior / n[1], (1 - prior) / n[0])
    wrong = np.concatenate([[0.0], np.cumsum(np.where(l == 1, weigh, 0))]) + np.concatenate([np.cumsum(np.where(l == 0, weigh, 0)[::-1])[::-1], [0.0]])
    edges = np.concatenate([[t[0] - 1], t, [t[-1] + 1]])
    gap = np.diff(edges)
    best = max(range(len(wrong)), key=lambda i: (-round(wrong[i], 9), gap[i]))
    model.middle = float((edges[best] + edges[best + 1]) / 2)
    spread = np.median(t[l == 1]) - np.median(t[l == 0])
    model.slope = float(8 / max(spread, 1e-3))
    return model


def hash_of(unit: bytes) -> int:
    """A fixed order of units that has nothing to do with their text."""
    return int(T.hashes(np.frombuffer(unit, np.uint8), np.array([0]), np.array([len(unit)]))[0]) if unit else 0


def _margin(model: Model, names: list[bytes], block: int = 20_000) -> np.ndarray:
    out = []
    for k in range(0, len(names), block):
        raw, squared = _sums(*_pack(names[k:k + block]), model.table)
        out.append(raw / np.sqrt(np.maximum(squared, 1e-12)) + model.bias)
    return np.concatenate(out) if out else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    known = labelled(labels, label, id_col)
    share = known.agg(F.avg("y")).first()[0]
    chosen = F.broadcast(bounded(known, sample))  # at most twice the sample
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, F.expr("id = _id")).select("id", "text", "y")
    # rows of one id are all read or none
    before = Window.orderBy("_hash", "id").rangeBetween(Window.unboundedPreceding, 0)
    small = found.groupBy("id").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes")).withColumn("_hash", F.xxhash64("id"))
    fits = small.withColumn("_sum", F.sum("bytes").over(before)).where(F.col("_sum") <= SAMPLE_BYTES).select(F.col("id").alias("_fits"))
    rows = found.join(F.broadcast(fits), F.expr("id = _fits"), "left_semi").collect()
    return train([(r.text, r.y) for r in sorted(rows, key=lambda r: (r.id, r.text or ""))], share if share is not None else 0.5)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one weight for each subsequence

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in T.slices(whole, "text", _SLICE):
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(shared.value.scores(*T.flat(batch.column("text"))))], ["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, score double")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents below the threshold, as they are. Each is judged where it lies; nothing is shuffled. A model that has learned nothing rejects nothing."""
    if model.table is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in T.slices(whole, text_col, _SLICE):
                yield batch.filter(pa.array(shared.value.scores(*T.flat(batch.column(text_col))) < threshold))

    return docs.mapInArrow(run, docs.schema)


def report(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    return score(docs, fit(docs, labels)).select(
        F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
