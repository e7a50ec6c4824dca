"""Quality rules: fixed counts of a text, and a classifier of hashed word and character n-grams.

A logistic regression over means of hashed n-gram weights is trained on a bounded, hash-ordered sample of
labelled rows, calibrated on rows held out of it, and scores every text in Arrow batches against
a fixed threshold.  All counts and hashes are made with numpy over the bytes of many texts at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import on_arrow, text_runs, texts_of

# Labelled rows that the classifier is fitted on, a fifth of them for its calibration.
SAMPLE_ROWS = 1500
# Weights per kind of n-gram, as a power of two.
WEIGHT_BITS = 18
THRESHOLD = 0.5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

_KINDS = 3  # words, pairs of words, four characters
_STEPS, _RATE, _SCALE, _DECAY = 120, 0.3, 20.0, 1e-5
_PIECE_BYTES = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64."""
    if name not in _powers or len(_powers[name]) < n:
        grown = np.full(max(n, _PIECE_BYTES), base, np.uint64)
        grown[0] = 1
        _powers[name] = np.multiply.accumulate(grown)
    return _powers[name][:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[bounds])


class Texts:
    """Texts as one array of bytes, with their words, lines and hashes."""

    def __init__(self, texts: list[bytes]):
        self.data = data = np.frombuffer(b"".join(texts), np.uint8)
        self.bounds = bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        self.n, size = len(texts), len(data)
        word = ~_SPACE[data]
        begins = np.zeros(size + 1, bool)
        begins[bounds] = True
        before = np.empty(size, bool)
        before[:1], before[1:] = True, ~word[:-1]
        after = np.empty(size, bool)
        after[-1:], after[:-1] = True, ~word[1:]
        self.starts = np.flatnonzero(word & (before | begins[:-1]))
        self.ends = np.flatnonzero(word & (after | begins[1:])) + 1
        self.doc = np.searchsorted(bounds, self.starts, "right") - 1
        self.sums = np.zeros(size + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, size), out=self.sums[1:])
        self.word_hash = self.hash_of(self.starts, self.ends)
        self.word_bytes = word

    def hash_of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of the bytes of each range that does not depend on where the range lies."""
        down = _power("down", _INVERSE, len(self.data) + 1)
        return _mixed((self.sums[ends] - self.sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and text of each run of ``n`` words, of all that lie in one text, and the run's first word."""
        if len(self.starts) < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        last = len(self.starts) - n + 1
        h = self.word_hash[:last].copy()
        for i in range(1, n):
            h = h * _BASE + self.word_hash[i : last + i]
        first = np.flatnonzero(self.doc[:last] == self.doc[n - 1 :])
        return _mixed(h[first]), first

    def counts(self) -> dict[str, np.ndarray]:
        data, bounds, n = self.data, self.bounds, self.n
        return {
            "n_words": np.bincount(self.doc, minlength=n),
            "word_chars": _per_text(self.word_bytes & ((data & 0xC0) != 0x80), bounds),
            "n_symbols": _per_text(_SYMBOL[data], bounds),
            "n_dup_lines": self._duplicate_lines(),
            "n_repeat_words": self._repeated_words(5),
        }

    def _duplicate_lines(self) -> np.ndarray:
        size = len(self.data)
        breaks = np.flatnonzero(self.data == 10)
        starts = np.union1d(self.bounds[:-1], breaks + 1)
        starts = starts[starts < size]
        doc = np.searchsorted(self.bounds, starts, "right") - 1
        ends = np.minimum(np.append(breaks, size)[np.searchsorted(breaks, starts)], self.bounds[doc + 1])
        wordy = np.searchsorted(self.starts, ends) > np.searchsorted(self.starts, starts)
        starts, ends, doc = starts[wordy], ends[wordy], doc[wordy]
        key = self.hash_of(starts, ends) + doc.astype(np.uint64) * _MIX
        order = np.argsort(key)
        again = key[order][1:] == key[order][:-1]
        return np.bincount(doc[order][1:][again], minlength=self.n)

    def _repeated_words(self, n: int) -> np.ndarray:
        key, first = self.grams(n)
        key = key + self.doc[first].astype(np.uint64) * _MIX
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        change = np.zeros(len(self.starts) + n + 1, np.int64)
        change[first[twice]] += 1
        change[first[twice] + n] -= 1
        covered = np.cumsum(change)[: len(self.starts)] > 0
        return np.bincount(self.doc[covered], minlength=self.n)

    def features(self, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each kind of n-gram: its weights' places and its texts."""
        shift = np.uint64(64 - bits)
        yield (self.word_hash >> shift).astype(np.int64), self.doc
        pair, first = self.grams(2)
        yield (pair >> shift).astype(np.int64), self.doc[first]
        data = self.data.astype(np.uint32)
        four = data[:-3] | data[1:-2] << np.uint32(8) | data[2:-1] << np.uint32(16) | data[3:] << np.uint32(24)
        at = np.arange(len(four))
        doc = np.repeat(np.arange(self.n), np.diff(self.bounds))[: len(four)]
        inside = at + 4 <= self.bounds[doc + 1]
        place = (four * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
        yield place[inside].astype(np.int64), doc[inside]


@dataclass(frozen=True)
class Model:
    """Weights by kind and place; logit = slope * (bias + sum of the kinds' mean weights) + offset."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float
    bits: int

    def probability(self, texts: Texts) -> np.ndarray:
        raw = np.full(texts.n, self.bias)
        for kind, (place, doc) in enumerate(texts.features(self.bits)):
            total = np.bincount(doc, weights=self.weights[kind][place], minlength=texts.n)
            raw += _SCALE * total / np.maximum(1, np.bincount(doc, minlength=texts.n))
        return _sigmoid(self.slope * raw + self.offset)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _calibrate(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit of held-out labels on raw scores, by Newton steps.

    Targets are drawn in a little, and a weak prior holds the slope, so that separable rows stay finite.
    """
    up, down = y.sum(), (1 - y).sum()
    if not up or not down:
        return 1.0, 0.0
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a = np.array([1.0, 0.0])
    x = np.stack([raw, np.ones_like(raw)])
    for _ in range(30):
        p = _sigmoid(a @ x)
        gradient = x @ (p - t) + 0.1 * (a - [1.0, 0.0])
        hessian = (x * (p * (1 - p))) @ x.T + 0.1 * np.eye(2)
        a = a - np.linalg.solve(hessian, gradient)
    return float(a[0]), float(a[1])


def _rows_of_features(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, values = [], []
            for text in texts_of(batch.column("text")):
                texts, place, value = Texts([text]), [], []
                for kind, (found, _) in enumerate(texts.features(bits)):
                    at, n = np.unique(found, return_counts=True)
                    place.append((at + (kind << bits)).astype("<u4"))
                    value.append((_SCALE * n / max(1, n.sum())).astype("<f4"))
                places.append(np.concatenate(place).tobytes())
                values.append(np.concatenate(value).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array(places, pa.binary()), pa.array(values, pa.binary())],
                names=["doc_id", "label", "places", "parts"],
            )

    return run


def train(
    docs: DataFrame, labels: DataFrame, label_column: str = "quality", sample_rows: int = SAMPLE_ROWS, bits: int = WEIGHT_BITS
) -> Model:
    """Fit on at most ``sample_rows`` labelled rows, those whose doc_id has the smallest hash.

    Rows without label or document are left out.  Without rows of both classes every text gets the
    only class's label (1 if there are no rows).
    """
    order = F.xxhash64("doc_id", F.lit(7))
    chosen = (
        labels.where(F.col(label_column).isNotNull() & F.col("doc_id").isNotNull())
        .select("doc_id", (F.col(label_column) > 0).cast("int").alias("label"))
        .orderBy(order, "doc_id", "label")
        .limit(sample_rows)
    )
    met = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    # One row for each labelled doc_id, however many documents have it, so that the sample bounds what reaches the driver.
    least = F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")
    texts = met.groupBy("doc_id", "label").agg(least)
    schema = "doc_id long, label int, places binary, parts binary"
    rows = on_arrow(texts.select("doc_id", "label", "text"), _rows_of_features(bits), schema).toArrow().to_pylist()
    rows.sort(key=lambda r: (r["doc_id"], r["label"], r["places"]))
    weights = np.zeros(_KINDS << bits, np.float32)
    y = np.array([r["label"] for r in rows], np.float64)
    if len(set(y.tolist())) < 2:
        return Model(weights.reshape(_KINDS, -1), 0.0, 0.0, 30.0 if not len(y) or y[0] else -30.0, bits)
    place = np.concatenate([np.frombuffer(r["places"], "<u4") for r in rows]).astype(np.int64)
    value = np.concatenate([np.frombuffer(r["parts"], "<f4") for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r["parts"]) // 4 for r in rows])
    held_out = np.arange(len(rows)) % 5 == 0
    fit = ~held_out
    if len(set(y[fit].tolist())) < 2:
        fit = np.ones(len(rows), bool)
    at = fit[row]
    used, compact = np.unique(place[at], return_inverse=True)
    own_row, own_value = row[at], value[at].astype(np.float64)
    w, bias = np.zeros(len(used)), float(np.log(y[fit].mean() / (1 - y[fit].mean())))
    mean_g, mean_s, mean_b, square_b = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for step in range(1, _STEPS + 1):
        raw = bias + np.bincount(own_row, weights=own_value * w[compact], minlength=len(rows))
        error = np.where(fit, _sigmoid(raw) - y, 0) / fit.sum()
        g = np.bincount(compact, weights=own_value * error[own_row], minlength=len(used)) + _DECAY * w
        mean_g, mean_s = 0.9 * mean_g + 0.1 * g, 0.99 * mean_s + 0.01 * g * g
        gb = error.sum()
        mean_b, square_b = 0.9 * mean_b + 0.1 * gb, 0.99 * square_b + 0.01 * gb * gb
        rate = _RATE * np.sqrt(1 - 0.99**step) / (1 - 0.9**step) / np.sqrt(step)
        w -= rate * mean_g / (np.sqrt(mean_s) + 1e-8)
        bias -= rate * mean_b / (np.sqrt(square_b) + 1e-8)
    weights[used] = w
    raw = bias + np.bincount(row, weights=value * weights[place], minlength=len(rows))
    slope, offset = _calibrate(raw[held_out], y[held_out])
    return Model(weights.reshape(_KINDS, -1), bias, slope, offset, bits)


_SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, probability double"
)


def _verdicts(model: Model, texts: list[bytes], threshold: float) -> dict[str, np.ndarray]:
    """Counts, verdict and probability of texts."""
    analysed = Texts(texts)
    counts = analysed.counts()
    p = model.probability(analysed)
    words = counts["n_words"]
    failed = (words < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * words)
    counts = {k: c.astype(np.int64) for k, c in counts.items()}
    return {**counts, "base_failed": failed, "kept": ~failed & (p >= threshold), "probability": p}


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Counts, verdict and calibrated probability of every row of ``docs``.

    Null texts count as empty, and those fail the base rules.  Repeated rows and null identifiers are
    rows of their own; an empty table gives no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            for start, stop, texts in text_runs(batch, "text", _PIECE_BYTES):
                verdicts = _verdicts(fitted, texts, threshold)
                doc_ids = batch.column("doc_id").slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([doc_ids, *map(pa.array, verdicts.values())], names=["doc_id", *verdicts])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return on_arrow(source, run, _SCHEMA)


def quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``score`` with a model trained on ``labels`` (doc_id, quality)."""
    return score(docs, train(docs, labels, **options))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` with a kept verdict of their own, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, texts in text_runs(batch, "text", _PIECE_BYTES):
                kept = _verdicts(shared.value, texts, THRESHOLD)["kept"]
                yield batch.slice(start, stop - start).filter(pa.array(kept, pa.bool_()))

    return on_arrow(docs, run, docs.schema)
