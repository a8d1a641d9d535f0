"""Operator 8, toxicity by a classifier chain.

The chain predicts its categories one after the other; each link is a linear (logistic) model over words and the
probabilities of all earlier links.  In training those probabilities are out of fold: a row's are predicted by models that
have not seen it.  The tables label only the last category (``toxic``); the earlier ones are labelled weakly, as the toxic
rows that hold a word of the category's list.

Inputs are words and beginnings of words (abuse is inflected), chosen on the training sample by the chi-square and the lift
of their presence against ``toxic``.  Each counts once per text however long it is, so an unknown word or a long clean text moves
no score.

A chain that could not learn (labels of one class or none, or no trait that tells them apart) gives one half for everything
and rejects nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import learning_rows, plain_words, slices, texts

SAMPLE = 5_000               # labelled rows of each class, at most
WORDS = 400                  # words and beginnings the links look at, at most
PREFIXES = (4, 5, 6, 7)      # lengths of the beginnings, in bytes
SIGNIFICANT = 20.0           # least chi-square
LIFT = 20.0                  # least ratio of its shares among toxic and other rows
FOLDS = 5
# Weak categories in chain order, by plain words of abuse.
CATEGORIES = {
    "insult": ("idiot", "moron", "loser", "clown", "scum", "fool", "dumb", "stupid"),
    "contempt": ("pathetic", "disgusting", "worthless", "trash", "garbage", "filthy", "vile"),
}


def traits(text: str | None) -> set[bytes]:
    """The words of a text and, marked by ``~``, their beginnings."""
    words = set(plain_words(text))
    out = set(words)
    for n in PREFIXES:
        out.update([w[:n] + b"~" for w in words if len(w) > n])
    return out


def _logistic(x: np.ndarray, y: np.ndarray, times: np.ndarray, ridge: float = 0.1, steps: int = 500) -> np.ndarray:
    """Weights and, last, bias of an L2-regularised logistic model: accelerated gradient descent, classes balanced."""
    n, ones = times.sum(), (times * y).sum()
    if not ones or ones == n:
        w = np.zeros(x.shape[1] + 1)
        w[-1] = 0.0 if not n else (6.0 if ones else -6.0)
        return w
    x1 = np.hstack([x, np.ones((len(y), 1), x.dtype)])
    weight = times * np.where(y == 1, 0.5 * n / ones, 0.5 * n / (n - ones))
    penalty = np.full(x1.shape[1], ridge)
    penalty[-1] = 0
    v = np.ones(x1.shape[1])
    for _ in range(20):                                     # largest curvature by power iteration
        v = x1.T @ (weight * (x1 @ v))
        v /= np.linalg.norm(v)
    rate = 1 / (0.25 * float(v @ (x1.T @ (weight * (x1 @ v)))) * 1.1 + ridge)
    w = ahead = np.zeros(x1.shape[1])
    for t in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ ahead, -30, 30)))
        new = ahead - rate * (x1.T @ (weight * (p - y)) + penalty * ahead)
        ahead, w = new + t / (t + 3) * (new - w), new
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Chain:
    names: list[str]
    words: list[bytes]
    links: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self):
        self.at = {w: i for i, w in enumerate(self.words)}

    @property
    def trained(self) -> bool:
        """Whether it tells any texts apart; one that does not rejects none."""
        return bool(self.words)

    def probabilities(self, text: str | None) -> list[float]:
        """One per category, in chain order."""
        held = [self.at[w] for w in traits(text) if w in self.at]
        earlier: list[float] = []
        for link in self.links:
            z = link[held].sum() + link[-1] + sum(w * p for w, p in zip(link[len(self.words):-1], earlier))
            earlier.append(float(_sigmoid(z)))
        return earlier


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, where: str = "true") -> Chain:
    """Fit the chain on a bounded sample.  Without rows of both classes, or a trait that parts them, it is untrained."""
    names = [*CATEGORIES, "toxic"]
    rows = learning_rows(docs, labels, "toxic", sample, where)

    def count(batches: Iterator[pa.RecordBatch]):
        tallies = Counter(), Counter()
        for b in slices(batches):
            for t, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist()):
                tallies[y].update(traits(t))
        for y in (0, 1):
            yield pa.RecordBatch.from_arrays([pa.array(list(tallies[y]), pa.binary()), pa.array([y] * len(tallies[y]), pa.int32()),
                                              pa.array(list(tallies[y].values()), pa.int64())], ["word", "y", "n"])
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    untrained = Chain(names, [], [np.zeros(1 + n) for n in range(len(names))])
    if len(sizes) < 2:
        return untrained
    a, b = F.col("a") / sizes[1], F.col("b") / sizes[0]
    share = (F.col("a") + F.col("b")) / sum(sizes.values())
    total = sum(sizes.values())
    tested = (rows.mapInArrow(count, "word binary, y int, n bigint").groupBy("word")
              .agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("b"))
              .where("a + b >= 5").withColumn("chi", (a - b) ** 2 / (share * (1 - share) + 1e-9) * (sizes[0] * sizes[1] / total))
              .where((F.col("chi") >= SIGNIFICANT) & (a >= LIFT * b)).orderBy(F.desc("chi"), "word").limit(WORDS).collect())
    if not tested:
        return untrained
    chain = Chain(names, [bytes(r["word"]) for r in tested])
    listed = {name: {w.encode() for w in words} for name, words in CATEGORIES.items()}

    def present(batches: Iterator[pa.RecordBatch]):
        for b in slices(batches):
            held, marks = [], []
            for t in b.column("text").to_pylist():
                found = traits(t)
                held.append(sorted(chain.at[w] for w in found if w in chain.at))
                marks.append([not found.isdisjoint(listed[n]) for n in CATEGORIES])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(held, pa.list_(pa.int32())),
                                              pa.array(marks, pa.list_(pa.bool_()))], ["doc_id", "y", "held", "marks"])
    got = (rows.mapInArrow(present, "doc_id bigint, y int, held array<int>, marks array<boolean>")
           .limit(4 * sample).toPandas().sort_values("doc_id", kind="stable"))
    fold = np.random.default_rng(5).permutation(len(got)) % FOLDS
    alike = Counter((f, y, tuple(h), tuple(m)) for f, y, h, m in zip(fold.tolist(), got["y"], got["held"], got["marks"]))   # equal rows once
    fold, y = np.array([k[0] for k in alike]), np.array([k[1] for k in alike])
    times = np.array(list(alike.values()), float)
    x = np.zeros((len(y), len(chain.words) + len(names) - 1))
    for i, k in enumerate(alike):
        x[i, list(k[2])] = 1
    targets = [(y == 1) & np.array([k[3][n] for k in alike], bool) for n in range(len(CATEGORIES))] + [y == 1]
    for n, target in enumerate(targets):
        width = len(chain.words) + n
        if n + 1 < len(names):                              # out-of-fold probabilities feed the later links
            for f in range(FOLDS):
                inside = fold != f
                w = _logistic(x[inside, :width], target[inside].astype(float), times[inside])
                x[~inside, width] = _sigmoid(x[~inside, :width] @ w[:-1] + w[-1])
        chain.links.append(_logistic(x[:, :width], target.astype(float), times))
    return chain


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """(doc_id, one probability column per category, predicted) per row; null text counts as empty; untrained chains predict 0."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    columns = [f"p_{n}" for n in chain.names]

    def run(batches: Iterator[pa.RecordBatch]):
        for b in slices(batches):
            found = np.array([shared.value.probabilities(t) for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(found[:, n]) for n in range(len(columns))),
                                              pa.array((shared.value.trained & (found[:, -1] >= 0.5)).astype(np.int32))], ["doc_id", *columns, "predicted"])
    return texts(docs).mapInArrow(run, "doc_id bigint, " + ", ".join(f"{c} double" for c in columns) + ", predicted int")


def keep_civil(docs: DataFrame, chain: Chain, most: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose toxicity is below ``most``; all rows if the chain is untrained."""
    if not chain.trained:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in slices(batches):
            yield b.filter(pa.array([shared.value.probabilities(t)[-1] < most for t in b.column("text").to_pylist()], pa.bool_()))
    return docs.mapInArrow(run, docs.schema)
