"""Quality scores by Bradley-Terry pairwise ranking.

Every text labelled good is preferred to every one labelled bad. Weights of a text's features are learned by logistic loss
on the differences of all these pairs' features, so a score says how likely a text wins over another. The pairs are never
formed: the loss's slope follows from counts and sums of features by class and strength, which tasks add up over all labelled
rows, once for each Newton step; within one of GRID steps of strength, a row counts with their mean. The threshold is the
strength that as many of all learned rows reach as are good; it is found by counting parts of the range, smaller and smaller.

Defined cases: null and empty texts have the features of an empty text and get a score like any other; rows with null
labels aren't learned from, nor are ids with labels that contradict each other; if only one label occurs all weights are 0
and scores 0.5; a score of just 0.5 predicts 1; repeated rows are scored each, and of a learned id's rows with different
texts all are learned from; a very long text is read whole, in parts of bounded size; empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship, temporaries
from .shingles import distinct, slabs, windows

STEPS, RIDGE, TOLERANCE = 25, 1e-3, 2e-4
GRID, COARSE, REACH = 1024, 32, 8.0  # steps of strength over 2 * REACH deviations; coarser ones, for the bend only
NEAR = 10_000  # so many strengths around the threshold are sorted

Step = Callable[[np.ndarray, np.ndarray], np.ndarray]  # a result of features and labels of some rows
Each = Callable[[Step, Callable[[np.ndarray, np.ndarray], np.ndarray]], np.ndarray | None]  # a step's results of all rows, merged

FEATURES = ("log_words", "word_bytes", "upper", "digit", "mark", "space", "line", "high", "end", "distinct_words", "distinct_runs", "marked_words", "short", "spread")

_KIND = np.full(256, 6, dtype=np.uint8)  # high bytes
_KIND[:128] = 3  # marks
for _low, _high, _kind in ((65, 91, 0), (97, 123, 1), (48, 58, 2), (32, 33, 4), (9, 14, 5)):
    _KIND[_low:_high] = _kind
_KIND[[44, 46]] = 7  # comma and full stop


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    texts = texts.cast(pa.large_string()).fill_null("").cast(pa.large_binary())
    out = np.zeros((len(texts), len(FEATURES)))
    for first, end, words, counts in slabs(texts):
        many = end - first
        part = texts.slice(first, many)
        offsets = np.frombuffer(part.buffers()[1], dtype=np.int64)[part.offset : part.offset + many + 1]
        data = np.frombuffer(part.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if part.buffers()[2] else np.zeros(0, dtype=np.uint8)
        sizes = np.diff(offsets)
        kinds = np.zeros((many, 8))
        for text, (low, high) in enumerate(zip(offsets[:-1] - offsets[0], offsets[1:] - offsets[0], strict=True)):
            kinds[text] = np.bincount(_KIND[data[low:high]], minlength=8)
        owner = np.repeat(np.arange(many), counts)
        _, own_words = distinct(words, owner, many)
        runs, run_owner, _ = windows(words, counts, 3)
        all_runs = np.bincount(run_owner, minlength=many)
        _, own_runs = distinct(runs, run_owner, many)
        size, number = np.maximum(1, sizes), np.maximum(1, counts)
        letters = np.maximum(1, kinds[:, 0] + kinds[:, 1])
        rows = out[first:end]
        rows[:, 0] = np.log1p(counts)
        rows[:, 1] = np.minimum(20, sizes / number)
        rows[:, 2] = np.sqrt(kinds[:, 0] / letters)
        rows[:, 3] = np.sqrt(kinds[:, 2] / size)
        rows[:, 4] = np.sqrt(kinds[:, 3] / size)
        rows[:, 5] = kinds[:, 4] / size
        rows[:, 6] = np.sqrt(kinds[:, 5] / size)
        rows[:, 7] = kinds[:, 6] / size
        rows[:, 8] = np.sqrt(kinds[:, 7] / size)
        rows[:, 9] = np.log(np.maximum(1, own_words)) - 0.75 * np.log(number)
        rows[:, 10] = own_runs / np.maximum(1, all_runs)
        rows[:, 11] = np.minimum(3, kinds[:, 3] / number)
        rows[:, 12] = 1.0 / number
        rows[:, 13] = np.abs(kinds[:, 0] / letters - 0.05)
    return out


@dataclass
class Ranking:
    """Bradley-Terry weights of standardised features, with the score at the threshold quantile and its scale."""

    centre: np.ndarray
    width: np.ndarray
    weights: np.ndarray
    threshold: float = 0.0
    scale: float = 1.0

    def strength(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((rows - self.centre) / self.width, -8, 8) @ self.weights

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.strength(rows) - self.threshold) / self.scale, -30, 30)))


def _moments(rows: np.ndarray, good: np.ndarray) -> np.ndarray:
    return np.concatenate([[good.sum(), (~good).sum()], rows.sum(axis=0), (rows.T @ rows).reshape(-1)])


def _tally(model: Ranking, spread: float, rows: np.ndarray, good: np.ndarray) -> np.ndarray:
    """By class and step of strength, how many rows and the sums of their features; by class and coarse step, of their products."""
    scaled = np.clip((rows - model.centre) / model.width, -8, 8)
    step = np.clip(np.floor((scaled @ model.weights / (spread * REACH) + 1) * (GRID / 2)), 0, GRID - 1).astype(np.int64)
    cell = step + GRID * good
    sums = [np.bincount(cell, minlength=2 * GRID), *(np.bincount(cell, weights=column, minlength=2 * GRID) for column in scaled.T)]
    products = np.zeros((2 * COARSE, scaled.shape[1], scaled.shape[1]))
    cell = step // (GRID // COARSE) + COARSE * good
    order = np.argsort(cell, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1) if len(order) else []:
        products[cell[part[0]]] += scaled[part].T @ scaled[part]
    return np.concatenate([np.array(sums, dtype=np.float64).reshape(-1), products.reshape(-1)])


def _newton(weights: np.ndarray, tally: np.ndarray) -> np.ndarray:
    """The Newton step of the mean logistic loss of all pairs, with a ridge."""
    many = len(weights)
    sums = tally[: 2 * GRID * (1 + many)].reshape(1 + many, 2, GRID)
    products = tally[2 * GRID * (1 + many) :].reshape(2, COARSE, many, many)
    counts, sums = sums[0], sums[1:].transpose(1, 2, 0)
    bad, good = (np.flatnonzero(own) for own in counts)
    strength = [sums[kind, own] @ weights / counts[kind, own] for kind, own in ((0, bad), (1, good))]
    lost = 1 / (1 + np.exp(np.clip(strength[1][:, None] - strength[0][None], -30, 30)))
    pairs = counts[0].sum() * counts[1].sum()
    slope = (lost @ counts[0, bad] @ sums[1, good] - counts[1, good] @ lost @ sums[0, bad]) / pairs - RIDGE * weights
    curved = lost * (1 - lost)
    bend = -(sums[1, good].T @ curved @ sums[0, bad])
    bend = bend + bend.T
    for kind, own, curve in ((1, good, curved @ counts[0, bad]), (0, bad, counts[1, good] @ curved)):
        group = own // (GRID // COARSE)
        mean = np.bincount(group, weights=curve * counts[kind, own], minlength=COARSE) / np.maximum(1, np.bincount(group, weights=counts[kind, own], minlength=COARSE))
        bend += np.tensordot(mean, products[kind], 1)
    values, axes = np.linalg.eigh(bend / pairs)
    return axes @ ((axes.T @ slope) / (np.maximum(0, values) + RIDGE))


def _extent(model: Ranking, rows: np.ndarray, good: np.ndarray) -> np.ndarray:
    strength = model.strength(rows)
    return np.array([-strength.min(), strength.max()]) if len(rows) else np.full(2, -np.inf)


def _histogram(model: Ranking, low: float, high: float, rows: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Sums of strengths and of their squares; how many lie below low, in each of GRID equal parts up to high, and above."""
    strength = model.strength(rows)
    part = np.clip(np.floor((strength - low) / (high - low) * GRID), -1, GRID).astype(np.int64)
    part[strength == high] = GRID - 1
    return np.concatenate([[strength.sum(), strength @ strength], np.bincount(part + 1, minlength=GRID + 2)])


def _between(model: Ranking, low: float, high: float, rows: np.ndarray, good: np.ndarray) -> np.ndarray:
    """How many strengths lie below low, then each one up to high and how often it occurs."""
    strength = model.strength(rows)
    values, counts = np.unique(strength[(strength >= low) & (strength <= high)], return_counts=True)
    return np.concatenate([[(strength < low).sum()], np.stack([values, counts], axis=1).reshape(-1)])


def _ranked(model: Ranking, each: Each, many: int, rank: int) -> tuple[float, float]:
    """(the strength of a rank among all rows, the lowest being 0; all strengths' deviation)."""
    low, high = (each(partial(_extent, model), np.maximum) * [-1, 1]).tolist()
    deviation, held = None, many
    while (held > NEAR or deviation is None) and high - low > 1e-12 * max(1.0, abs(low), abs(high)):
        tally = each(partial(_histogram, model, low, high), np.add)
        if deviation is None:
            deviation = float(np.sqrt(max(0.0, tally[1] / many - (tally[0] / many) ** 2)))
        ends = np.cumsum(tally[2:])  # how many up to each part's end
        part = int(np.searchsorted(ends, rank, side="right")) - 1
        width = (high - low) / GRID  # rounding must not lose the rank, so a little more of the range is kept
        low, high, held = max(low, low + (part - 1e-6) * width), min(high, low + (part + 1 + 1e-6) * width), ends[part + 1] - ends[part]
    if held > NEAR:
        return low, deviation or 0.0
    found = each(partial(_between, model, low, high), lambda a, b: np.concatenate([[a[0] + b[0]], a[1:], b[1:]]))
    pairs = found[1:].reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    at = np.searchsorted(found[0] + np.cumsum(pairs[:, 1]), rank, side="right")
    return float(pairs[min(at, len(pairs) - 1), 0]), deviation or 0.0


def _rank(each: Each, features: int) -> Ranking:
    """Learn from all rows that `each` goes over: Newton steps, then the threshold. Results are rounded, as sums depend on the order of rows."""
    sums = each(_moments, np.add)
    if sums is None or not sums[0] or not sums[1]:
        return Ranking(np.zeros(features), np.ones(features), np.zeros(features))
    many = sums[0] + sums[1]
    centre = sums[2 : 2 + features] / many
    moved = sums[2 + features :].reshape(features, features) / many - np.outer(centre, centre)
    made = Ranking(np.round(centre, 9), np.round(np.maximum(1e-6, np.sqrt(np.maximum(0, np.diag(moved)))), 9), np.zeros(features))
    for _ in range(STEPS):
        bare = made.weights / made.width
        step = _newton(made.weights, each(partial(_tally, made, float(np.sqrt(max(1e-12, bare @ moved @ bare)))), np.add))
        made.weights = made.weights + step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < TOLERANCE * max(1.0, np.abs(made.weights).max()):
            break
    made.weights = np.round(made.weights, 9)
    threshold, deviation = _ranked(made, each, int(many), int(sums[1]))
    made.threshold, made.scale = float(np.floor(threshold * 1e9) / 1e9), float(max(1e-6, round(deviation, 9)))
    return made


def fit(rows: np.ndarray, good: np.ndarray) -> Ranking:
    """Learn from features and labels in memory."""
    good = np.asarray(good, dtype=bool)
    return _rank(lambda step, merge: step(rows, good) if len(rows) else None, rows.shape[1] if rows.ndim == 2 else len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Ranking:
    """A ranking from all labelled rows for which `learn`, a condition on the id, holds; features are stored once, without texts."""
    ship(docs.sparkSession)
    known = labels.where(learn & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id"))
    known = known.agg(F.min(F.col(label_col) == 1).alias("good"), F.max(F.col(label_col) == 1).alias("most")).where("good = most").select("doc_id", "good")
    texts = docs.where(learn).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL")

    def read(batches):
        for batch in batches:
            rows = features(batch.column(1))
            edges = np.arange(len(rows) + 1, dtype=np.int32) * (8 * len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(edges), pa.py_buffer(rows)])], names=["doc_id", "x"])

    def each(step: Step, merge: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray | None:
        def run(batches):
            found = None
            for batch in batches:
                if batch.num_rows:
                    rows = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.float64).reshape(-1, len(FEATURES))
                    own = step(rows, batch.column(1).to_numpy(zero_copy_only=False).astype(bool))
                    found = own if found is None else merge(found, own)
            if found is not None:
                yield pa.RecordBatch.from_arrays([pa.array([found.astype(np.float64).tobytes()], pa.binary())], names=["found"])

        parts = [np.frombuffer(row["found"]) for row in frame.mapInArrow(run, "found binary").collect()]
        return reduce(merge, parts) if parts else None

    with temporaries():
        frame = materialize(texts.mapInArrow(read, "doc_id long, x binary").join(known, "doc_id").distinct().select("x", "good"), "features")
        return _rank(each, len(FEATURES))


def score(docs: DataFrame, model: Ranking, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) for each row."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            scores = model.score(features(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")
