"""Quality scores learned from preference pairs (Bradley-Terry), thresholded at a score quantile.

A pair holds a document that its label prefers and one that it rejects; P(first beats second) is
logistic in the difference of their scores, and a score is linear in features of the whole text: its layout (words, lines,
kinds of characters, repeats) and its language, as how often hashed runs of three bytes occur. The weights minimise the mean
logistic loss over all pairs of labelled training documents, with a small ridge. The raw
score is then mapped to 0..1 so that the raw threshold, the quantile at the share of rejected training
documents, gets ``cut``: raw scores above it give more, those below it less.

Labels, language, source and identifier are never inputs of a score. Null and empty texts get the score
of the all-zero feature row. Rows of labels whose document is missing, or with a null label, are not
used; if fewer than one good and one bad document are labelled, every text scores 1 (nothing is
rejected). Repeated rows score alike; extra columns are kept; an empty table gives an empty table.

All pairs. A document's share in the gradient is the sum, over all documents of the other label, of the probability of
the wrong order, which depends on scores only; so it follows from how many of those have each score. That count is kept on
a grid of 1 / GRID, each score shared between the two points next to it. The curvature of pairs of steps of the coarser
grid is the one of all their pairs. So each step of Newton's method takes two passes over the features of all labelled
documents, whose rows stay in Spark; counts and sums go to the driver, whose size does not follow the number of rows.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, release, row_numbers, scratch, with_range_block

FEATURES = (
    "log_words", "mean_word", "upper_share", "digit_share", "bang_share", "pipe_share", "symbol_share", "punct_share",
    "same_as_last", "distinct_share", "line_repeat", "log_line", "long_words", "short_words", "stop_share", "upper_words",
)

#: Points of the grid of scores in 1; those in a step of the coarse grid, and that grid's steps on either side of 0.
GRID, STEP, STEPS = 64, 16, 64
#: Buckets of runs of three bytes.
GRAMS = 256
FEATURES += tuple(f"gram{i}" for i in range(GRAMS))

_CLASS = np.zeros(256, np.uint8)
for _chars, _k in ((range(65, 91), 1), (range(97, 123), 2), (range(48, 58), 3), (b"!?", 4), (b"|", 5), (b"#$%&*+=<>@^_~\\{}[]`/", 6), (b".,;:'\"()-", 7), (range(128, 256), 8)):
    for _c in _chars:
        _CLASS[_c] = _k


def grams(raw: np.ndarray) -> np.ndarray:
    """Square roots of the shares of hashed runs of three bytes (A-Z as a-z), less those of even shares."""
    if len(raw) < 3:
        return np.zeros(GRAMS)
    low = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw).astype(np.uint32)
    mixed = (low[:-2] + (low[1:-1] << np.uint32(8)) + (low[2:] << np.uint32(16))) * np.uint32(2_654_435_761)
    counts = np.bincount(mixed >> np.uint32(32 - GRAMS.bit_length() + 1), minlength=GRAMS)
    return np.sqrt(counts / (len(raw) - 2)) - GRAMS**-0.5


def features(text: str) -> list[float]:
    """Fixed-length description of the whole text, from its bytes, words and lines."""
    data = text.encode()
    if not data:
        return [0.0] * len(FEATURES)
    n, raw = len(data), np.frombuffer(data, np.uint8)
    kinds = np.bincount(_CLASS[raw], minlength=9)
    words = data.split()
    w = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    again = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in data.split(b"\n") if x.strip()]
    letters = max(1, int(kinds[1] + kinds[2] + kinds[8]))
    return [
        math.log1p(len(words)), float(sizes.mean()), kinds[1] / letters, kinds[3] / n, kinds[4] / w, kinds[5] / w, kinds[6] / w, kinds[7] / w,
        again / w, len(set(words)) / w ** 0.8, 1 - len(set(lines)) / max(1, len(lines)), math.log1p(n / max(1, len(lines))),
        float((sizes > 20).mean()), float((sizes < 3).mean()), float((sizes == 3).mean()), sum(map(bytes.isupper, words)) / w,
        *grams(raw).tolist(),
    ]


@dataclass(frozen=True)
class Ranker:
    """A fitted model: score = sigmoid(slope * (weights . z(features) - threshold) + logit(cut))."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    threshold: float
    slope: float
    cut: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.ones(len(x))
        z = standard(x, np.array(self.mean), np.array(self.scale))
        raw = self.slope * (z @ np.array(self.weights) - self.threshold) + math.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-np.clip(raw, -500, 500)))


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Features as the model sees them, from single precision, in which tables hold them."""
    return np.clip((x.astype(np.float32).astype(float) - mean) / scale, -8, 8)


def _raw(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, w: np.ndarray) -> np.ndarray:
    return standard(x, mean, scale) @ w


def _moments(x: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Numbers of good and bad rows (the first two of the first row), sums and sums of squares."""
    x, out = x.astype(np.float32).astype(float), np.zeros((3, x.shape[1]))
    out[0, :2] = (label == 1).sum(), (label == 0).sum()
    out[1], out[2] = x.sum(0), (x * x).sum(0)
    return out


def _newton(x: np.ndarray, label: np.ndarray, mean: np.ndarray, scale: np.ndarray, w: np.ndarray, points: list[np.ndarray], pull: list[np.ndarray], curve: np.ndarray) -> np.ndarray:
    """The gradient, the rows' own part of the curvature, and the sums of rows by label and step of the coarse grid."""
    z = standard(x, mean, scale)
    score = z @ w * GRID
    c = np.where(label == 1, -np.interp(score, points[1], pull[1]), np.interp(score, points[0], pull[0]))
    step = _step(np.floor(score)) + 2 * STEPS * label
    sums = np.zeros((4 * STEPS, len(z)))
    sums[step, np.arange(len(z))] = 1
    return np.concatenate([(c @ z)[None], (z * curve.ravel()[step][:, None]).T @ z, sums @ z])


def _step(point: np.ndarray) -> np.ndarray:
    return (np.clip(point // STEP, -STEPS, STEPS - 1) + STEPS).astype(int)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _pulls(found: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """By label: the grid's points around its scores, and the sum there of the probability of the wrong order with each
    document of the other label; by label and step the same of the curvature; the curvature of two steps.

    ``found`` has a row (point, label, number, sum of what scores exceed the point by) for each point and label.
    """
    points, weight, number = [], [], np.zeros((2, 2 * STEPS))
    for y in (0, 1):
        point, _, n, above = found[found[:, 1] == y].T
        np.add.at(number[y], _step(point), n)
        at, place = np.unique(np.r_[point, point + 1], return_inverse=True)
        points.append(at)
        weight.append(np.bincount(place, np.r_[n - above, above]))
    pull = []
    for y in (0, 1):
        side = 1 if y == 0 else -1  # wrong: the bad one's score is above the good one's
        pull.append(np.concatenate([_sigmoid(side * (points[y][i : i + 512, None] - points[1 - y]) / GRID) @ weight[1 - y] for i in range(0, len(points[y]), 512)]))
    apart = _sigmoid(np.subtract.outer(np.arange(2 * STEPS), np.arange(2 * STEPS)) * (STEP / GRID))
    between = apart * (1 - apart)
    return points, pull, np.stack([between @ number[1], between @ number[0]]), between


class _Held:
    """Labelled rows in memory."""

    def __init__(self, x: np.ndarray, label: np.ndarray):
        self.x, self.label = x, np.asarray(label).astype(int)

    def total(self, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        return sum(of(self.x[i : i + 2_048], self.label[i : i + 2_048]) for i in range(0, max(1, len(self.x)), 2_048))

    def binned(self, raw: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        score = raw(self.x) * GRID
        point = np.floor(score)
        at, place = np.unique(np.c_[point, self.label], axis=0, return_inverse=True)
        place = place.ravel()
        return np.c_[at, np.bincount(place), np.bincount(place, score - point)]

    def ordered(self, raw: Callable[[np.ndarray], np.ndarray], places: list[int]) -> list[float]:
        return np.sort(raw(self.x))[places].tolist()


class _Table:
    """Labelled rows (doc_id, features, quality) in Spark."""

    def __init__(self, table: DataFrame):
        self.table = table

    def total(self, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """Each task's sums, added in the tasks' order so that reruns agree."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = None
            for batch in batches:
                if len(batch):
                    part = of(_matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False))
                    out = part if out is None else out + part
            if out is not None:
                slots, task = pa.array(range(len(out)), pa.int32()), pa.array([TaskContext.get().partitionId()] * len(out), pa.int32())
                yield pa.RecordBatch.from_arrays([slots, task, pa.array(list(out), pa.list_(pa.float64()))], names=["slot", "task", "part"])

        parts = self.table.select("features", "quality").mapInArrow(run, "slot int, task int, part array<double>")
        every = parts.groupBy("slot").agg(F.sort_array(F.collect_list(F.struct("task", "part"))).alias("parts"))
        added = F.aggregate(F.slice("parts", F.lit(2), F.size("parts")), F.get("parts", F.lit(0))["part"], lambda s, x: F.zip_with(s, x["part"], lambda a, b: a + b))
        rows = every.select("slot", added.alias("sums")).collect()
        return np.array([r["sums"] for r in sorted(rows, key=lambda r: r["slot"])]) if rows else of(np.empty((0, len(FEATURES))), np.empty(0, int))

    def binned(self, raw: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        score = self.table.select((_scored(raw) * GRID).alias("score"), "quality").select(F.floor("score").alias("point"), "quality", "score")
        found = score.groupBy("point", "quality").agg(F.count("*").alias("n"), F.sum(F.col("score") - F.col("point")).alias("above"))
        return np.array([tuple(r) for r in found.orderBy("point", "quality").collect()], float)

    def ordered(self, raw: Callable[[np.ndarray], np.ndarray], places: list[int]) -> list[float]:
        ranged = with_range_block(self.table.select("doc_id", _scored(raw).alias("raw")), "raw", "doc_id")
        found = {r["position"]: r["raw"] for r in row_numbers(ranged, "raw", "doc_id").where(F.col("position").isin(*places)).collect()}
        return [found[p] for p in places]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(FEATURES))


def _scored(raw: Callable[[np.ndarray], np.ndarray]) -> Column:
    @F.pandas_udf("double")
    def judge(rows: pd.Series) -> pd.Series:
        return pd.Series(raw(np.stack(rows.to_list())) if len(rows) else np.empty(0))

    return judge("features")


def _solve(rows: _Held | _Table, cut: float, ridge: float, most: int = 50) -> Ranker:
    """Newton's method on the mean logistic loss of all pairs; weights are rounded, so the order of sums leaves no trace."""
    digits = np.vectorize(lambda v: float(f"{v:.9g}"))
    moments = rows.total(_moments)
    good, bad = int(moments[0, 0]), int(moments[0, 1])
    if not good or not bad:
        return Ranker((), (), (), 0.0, 1.0, cut)
    mean = digits(moments[1] / (good + bad))
    spread = moments[2] / (good + bad) - (moments[1] / (good + bad)) ** 2
    scale = digits(np.sqrt(np.where(spread > 1e-10 * mean**2 + 1e-18, spread, 1.0)))
    w, pairs = np.zeros(len(mean)), good * bad
    for _ in range(most):
        points, pull, curve, between = _pulls(rows.binned(functools.partial(_raw, mean=mean, scale=scale, w=w)))
        sums = rows.total(functools.partial(_newton, mean=mean, scale=scale, w=w, points=points, pull=pull, curve=curve))
        gradient, own, by_step = sums[0] / pairs + ridge * w, sums[1 : 1 + len(w)], sums[1 + len(w) :]
        cross = by_step[2 * STEPS :].T @ between @ by_step[: 2 * STEPS]
        move = np.linalg.solve((own - cross - cross.T) / pairs + ridge * np.eye(len(w)), gradient)
        w = w - move
        if np.abs(move).max() < 1e-5:
            break
    w = np.round(w, 6)
    # the quantile at the share of rejected documents: between the k-th and the next
    below, above = rows.ordered(functools.partial(_raw, mean=mean, scale=scale, w=w), [bad - 1, min(bad, good + bad - 1)])
    return Ranker(tuple(mean.tolist()), tuple(scale.tolist()), tuple(w.tolist()), (below + above) / 2, 1.0, cut)


def fit(x: np.ndarray, label: np.ndarray, cut: float = 0.3, ridge: float = 3e-3) -> Ranker:
    """The model of rows of features that are in memory; see ``train`` for tables."""
    return _solve(_Held(x, label), cut, ridge)


def fold(doc_id: int | None, folds: int = 5) -> int:
    return zlib.crc32(str(doc_id).encode()) % folds


def with_features(docs: DataFrame) -> DataFrame:
    """``docs`` with ``features array<float>``."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("array<float>")
    def describe(texts: pd.Series) -> pd.Series:
        return pd.Series([np.array(features(t or ""), np.float32) for t in texts])

    return docs.withColumn("features", describe("text"))


def train(docs: DataFrame, labels: DataFrame, held_out_fold: int | None = 0, cut: float = 0.3, ridge: float = 3e-3) -> Ranker:
    """Fits on all labelled documents, without those whose crc32(doc_id) mod 5 is ``held_out_fold``.

    Texts are described where they lie, and features meet the labels by a join that is the same at every size.
    """
    fold_of = F.crc32(F.col("doc_id").cast("string")) % 5
    learned = F.col("doc_id").isNotNull() if held_out_fold is None else F.col("doc_id").isNotNull() & (fold_of != held_out_fold)
    known = labels.where("quality in (0, 1)").where(learned).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    described = with_features(docs.select("doc_id", "text").where(learned)).select("doc_id", "features")
    found = described.join(known.hint("merge"), "doc_id").groupBy("doc_id").agg(F.min("features").alias("features"), F.min("quality").alias("quality"))
    with scratch(docs.sparkSession) as keep:
        table = keep(found, "labelled")
        release(docs.sparkSession)
        return _solve(_Table(table), cut, ridge)


def scorer(model: Ranker):
    """A function of the text column; no shuffle, one pass over the texts."""

    @F.pandas_udf("double")
    def judge(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([features(t or "") for t in texts], float).reshape(len(texts), len(FEATURES))))

    return judge


def accepted(docs: DataFrame, labels: DataFrame, cut: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score ``cut`` or more, with their own columns."""
    model = train(docs, labels, cut=cut)
    return docs.where(scorer(model)("text") >= cut)


def predictions(docs: DataFrame, labels: DataFrame, cut: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    model = train(docs, labels, cut=cut)
    return docs.select("doc_id", scorer(model)("text").alias("score")).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))).alias("held_out"),
        "score",
        (F.col("score") >= cut).cast("int").alias("predicted"),
    )


