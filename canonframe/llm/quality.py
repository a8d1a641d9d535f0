"""Operator 4, quality classifier: a factorisation machine.

Inputs of a text are hashed words (tf, length-normalised), structure statistics as bins of their training quantiles, and
metadata (its length, binned likewise).  The score is

    sigmoid(b + w.x + 1/2 * sum_f ((sum_i v_if x_i)**2 - sum_i v_if**2 x_i**2)),

which weighs every pair of inputs through low-rank vectors in linear time.  Labels, language, source and doc_id are never
inputs.  The model (a few hundred kilobytes whatever the data) is fitted on the driver from at most ``SAMPLE`` labelled
rows of each class and broadcast; scoring reads every whole text once.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import learning_rows, plain_words, slices, texts

SAMPLE = 3_000               # labelled rows of each class the model is fitted on, at most
BUCKETS = 1 << 11            # hashed words
RANK = 8
BINS = 8
EPOCHS = 12
HELD_OUT = "crc32(cast(doc_id as string)) % 3 = 1"

_CLASSES = np.zeros((256, 7))
for _b in range(256):
    _c = chr(_b)
    _CLASSES[_b, 0 if _b >= 128 else 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 4 if _b in (32, 10, 9, 13)
             else 5 if _c in ".,;:'\"-()" else 6] = 1

STATISTICS = ("other bytes", "lower", "upper", "digits", "white space", "sentence marks", "symbols", "exclamations", "bars",
              "words", "word length", "distinct words", "commonest word", "immediate repeats", "lines", "distinct lines",
              "line length", "distinct triples", "length")


def statistics(text: str | None) -> np.ndarray:
    """Structure statistics of a whole text and, last, its length; zeros for an empty one."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(len(STATISTICS))
    if not raw:
        return out
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    out[:7] = counts @ _CLASSES / len(raw)
    out[7], out[8] = counts[ord("!")] / len(raw), counts[ord("|")] / len(raw)
    words = raw.lower().split()
    n = len(words)
    if n:
        tally = Counter(words)
        out[9] = np.log1p(n)
        out[10] = sum(map(len, words)) / n
        out[11] = len(tally) / n
        out[12] = max(tally.values()) / n
        out[13] = sum(map(bytes.__eq__, words, words[1:])) / n
        out[17] = len(set(zip(words, words[1:], words[2:]))) / max(1, n - 2)
    lines = raw.split(b"\n")
    out[14], out[15], out[16] = np.log1p(len(lines)), len(set(lines)) / len(lines), np.log1p(len(raw) / len(lines))
    out[18] = np.log1p(len(raw))
    return out


def word_counts(text: str | None, memo: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, weight) of the hashed words: damped counts of unit length."""
    tally: Counter[int] = Counter()
    for word, n in Counter(plain_words(text)).items():
        at = memo.get(word)
        if at is None:
            if len(memo) > 300_000:
                memo.clear()
            at = memo[word] = zlib.crc32(word) % BUCKETS
        tally[at] += n
    at = np.fromiter(tally.keys(), np.int64, len(tally))
    weight = np.log1p(np.fromiter(tally.values(), np.float64, len(tally)))
    return at, weight / max(1e-9, np.sqrt((weight ** 2).sum()))


@dataclass
class FactorisationMachine:
    edges: np.ndarray            # (statistics, BINS - 1) bounds of the bins
    bias: float
    linear: np.ndarray
    factors: np.ndarray          # (inputs, RANK)

    def inputs(self, stats: np.ndarray) -> np.ndarray:
        """Input numbers of the bins of one text's statistics; each has weight one."""
        return BUCKETS + np.arange(len(stats)) * BINS + (stats[:, None] > self.edges).sum(axis=1)

    def score(self, at: np.ndarray, x: np.ndarray) -> float:
        """Linear time: the pairs come from sums and sums of squares."""
        v = self.factors[at] * x[:, None]
        z = self.bias + self.linear[at] @ x + 0.5 * (v.sum(axis=0) ** 2 - (v ** 2).sum(axis=0)).sum()
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def score_text(self, text: str | None, memo: dict[bytes, int]) -> float:
        at, x = word_counts(text, memo)
        bins = self.inputs(statistics(text))
        return self.score(np.concatenate([at, bins]), np.concatenate([x, np.ones(len(bins))]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, where: str = f"not ({HELD_OUT})") -> FactorisationMachine:
    """Fit on a bounded sample of labelled rows.  Without rows of both classes every score is one half."""
    def run(batches: Iterator[pa.RecordBatch]):
        memo: dict[bytes, int] = {}
        for b in slices(batches):
            stats, at, x = [], [], []
            for t in b.column("text").to_pylist():
                a, w = word_counts(t, memo)
                stats.append(statistics(t))
                at.append(a.astype(np.int16))
                x.append(w.astype(np.float32))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(stats, pa.list_(pa.float64())),
                                              pa.array(at, pa.list_(pa.int16())), pa.array(x, pa.list_(pa.float32()))],
                                             ["doc_id", "y", "stats", "at", "x"])
    rows = (learning_rows(docs, labels, label, sample, where)
            .mapInArrow(run, "doc_id bigint, y int, stats array<double>, at array<short>, x array<float>")
            .limit(4 * sample).toPandas().sort_values("doc_id", kind="stable"))       # repeated documents stay within the bound
    width = len(STATISTICS)
    y = rows["y"].to_numpy(np.float64)
    if not len(y) or y.min() == y.max():
        return FactorisationMachine(np.zeros((width, BINS - 1)), 0.0, np.zeros(BUCKETS + width * BINS), np.zeros((BUCKETS + width * BINS, RANK)))
    stats = np.stack(rows["stats"].to_numpy())
    edges = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T
    model = FactorisationMachine(edges, 0.0, np.zeros(BUCKETS + width * BINS), np.zeros((BUCKETS + width * BINS, RANK)))
    dense = np.zeros((len(y), BUCKETS + width * BINS), np.float32)
    for i, (at, x) in enumerate(zip(rows["at"], rows["x"])):
        dense[i, at] = x
        dense[i, model.inputs(stats[i])] = 1
    del rows
    rng = np.random.default_rng(3)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    bias, linear = 0.0, np.zeros(dense.shape[1], np.float32)
    factors = rng.normal(0, 0.01, (dense.shape[1], RANK)).astype(np.float32)
    seen = [1e-6, np.full_like(linear, 1e-6), np.full_like(factors, 1e-6)]            # AdaGrad
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            x = dense[part]
            sums = x @ factors
            z = bias + x @ linear + 0.5 * ((sums ** 2).sum(axis=1) - ((x ** 2) @ (factors ** 2)).sum(axis=1))
            error = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) * weight[part]).astype(np.float32)
            error /= len(part)
            grads = [error.sum(), x.T @ error + 1e-5 * linear,
                     x.T @ (error[:, None] * sums) - ((x ** 2).T @ error)[:, None] * factors + 1e-4 * factors]
            steps = []
            for g, s in zip(grads, range(3)):
                seen[s] = seen[s] + g ** 2
                steps.append(0.1 * g / np.sqrt(seen[s]))
            bias, linear, factors = bias - float(steps[0]), linear - steps[1], factors - 0.3 * steps[2]
    return FactorisationMachine(edges, float(bias), linear.astype(np.float64), factors.astype(np.float64))


def score(docs: DataFrame, model: FactorisationMachine) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row; null text scores as empty text; a null doc_id is not held out."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]):
        memo: dict[bytes, int] = {}
        for b in slices(batches):
            scores = [shared.value.score_text(t, memo) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])
    return (texts(docs).mapInArrow(run, "doc_id bigint, score double")
            .select("doc_id", F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out"), "score",
                    (F.col("score") >= 0.5).cast("int").alias("predicted")))


def keep_good(docs: DataFrame, model: FactorisationMachine, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]):
        memo: dict[bytes, int] = {}
        for b in slices(batches):
            yield b.filter(pa.array([shared.value.score_text(t, memo) >= least for t in b.column("text").to_pylist()], pa.bool_()))
    return docs.mapInArrow(run, docs.schema)
