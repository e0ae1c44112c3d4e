"""Quality scores: random Fourier features of document statistics, ridge, isotonic calibration.

Statistics of each whole text are standardised and sent through random Fourier
features, which approximate a Gaussian kernel.  Normal equations are summed over
partitions (their size is the number of features, whatever the corpus) and give
ridge scores.  They are summed by fold of the labelled rows, so that each row also
has a score of a ridge that did not see it; the labels' isotonic regression on
these, on a fine grid whose counts are summed over partitions too, calibrates.

Defined results: null text counts as empty and is scored like any text; without
labels every score is 0.5; with labels of one kind only, every score is their
mean; null labels are not learned from; labels that repeat a doc_id are averaged;
a null doc_id has no label; a very long text is scored whole; neighbouring cells of
equal label share are pooled, so that equal statistics have equal scores and ties
keep their order; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import NOT_SPACE, blocks, span_hashes, words
from .language_id import held_out
from .scratch import Scratch
from .sums import summed

#: Number of Fourier features, kernel width in units of sqrt(statistics), ridge, and calibration cells.
FEATURES, WIDTH, RIDGE, CELLS = 384, 1.0, 1e-3, 400
#: Folds of the labelled rows for calibration.
FOLDS = 4

_UPPER, _DIGIT, _MARK, _PLAIN, _WIDE = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91] = _DIGIT[48:58] = _WIDE[128:] = True
_PLAIN[[ord(c) for c in ".,;:'\"-?"]] = True
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True
_MARK &= ~_PLAIN
STATISTICS = ("bytes", "words", "word_bytes", "word_spread", "upper", "digit", "plain_marks", "odd_marks", "wide", "distinct", "lines", "line_words", "repeated_lines", "marked_words", "upper_words", "top_word")


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of statistics per document of a block."""
    n = len(offs) - 1
    out = np.zeros((n, len(STATISTICS)))
    starts, ends, per_doc = words(data, offs, NOT_SPACE)
    size, count = np.diff(offs), np.maximum(per_doc, 1)
    doc = np.repeat(np.arange(n), per_doc)
    length = (ends - starts).astype(float)

    def per_byte(kind: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(kind[data])])
        return (upto[offs[1:]] - upto[offs[:-1]]) / np.maximum(size, 1)

    mean = np.bincount(doc, weights=length, minlength=n) / count
    square = np.bincount(doc, weights=length**2, minlength=n) / count
    out[:, 0], out[:, 1], out[:, 2], out[:, 3] = np.log1p(size), np.log1p(per_doc), mean, np.sqrt(np.maximum(square - mean**2, 0))
    for k, kind in ((4, _UPPER), (5, _DIGIT), (6, _PLAIN), (7, _MARK), (8, _WIDE)):
        out[:, k] = per_byte(kind)
    h = span_hashes(data, starts, ends)
    is_line = np.ones(256, bool)
    is_line[10] = False
    l_starts, l_ends, l_per = words(data, offs, is_line)
    lh = span_hashes(data, l_starts, l_ends)
    out[:, 10] = np.log1p(l_per)
    out[:, 11] = np.log1p(per_doc / np.maximum(l_per, 1))
    for values, per, k in ((h, per_doc, 9), (lh, l_per, 12)):
        edge = np.concatenate([[0], np.cumsum(per)]).tolist()
        for i in range(n):
            if edge[i + 1] > edge[i]:
                kinds, times = np.unique(values[edge[i] : edge[i + 1]], return_counts=True)
                share = len(kinds) / (edge[i + 1] - edge[i])
                out[i, k] = share if k == 9 else 1 - share
                if k == 9:
                    out[i, 15] = times.max() / (edge[i + 1] - edge[i])
    marked = _MARK[data[ends - 1]] if len(ends) else np.zeros(0, bool)
    out[:, 13] = np.bincount(doc, weights=marked, minlength=n) / count
    second = np.minimum(starts + 1, len(data) - 1) if len(data) else starts
    loud = (_UPPER[data[starts]] & _UPPER[data[second]] & (ends - starts > 1)) if len(starts) else np.zeros(0, bool)
    out[:, 14] = np.bincount(doc, weights=loud, minlength=n) / count
    return out


def statistics_table(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each whole text, as array<double>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in blocks(batch.column(1)):
                x = statistics(data, offs)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), flat], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    turn: np.ndarray
    shift: np.ndarray
    ridge: np.ndarray
    grid: tuple[np.ndarray, np.ndarray]
    constant: float | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.ones((len(z), 1)), np.cos(z @ self.turn + self.shift) * np.sqrt(2 / self.turn.shape[1])])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.ridge

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return np.clip(np.interp(self.raw(x), *self.grid), 0.0, 1.0)


def isotonic(at: np.ndarray, weight: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: non-decreasing means of total/weight over the ascending points ``at``."""
    blocks_: list[list[float]] = []  # weight, total, weighted place
    for a, w, t in zip(at.tolist(), weight.tolist(), total.tolist(), strict=True):
        blocks_.append([w, t, a * w])
        while len(blocks_) > 1 and blocks_[-2][1] * blocks_[-1][0] >= blocks_[-1][1] * blocks_[-2][0]:
            last = blocks_.pop()
            blocks_[-1] = [x + y for x, y in zip(blocks_[-1], last, strict=True)]
    return np.array([b[2] / b[0] for b in blocks_]), np.array([b[1] / b[0] for b in blocks_])


def fit(labelled: DataFrame, features: int = FEATURES, width: float = WIDTH, ridge: float = RIDGE) -> Model:
    """Learn from rows (x array<double>, y double, fold int), all of them, in passes over a small table."""
    d = len(STATISTICS)
    rng = np.random.Generator(np.random.PCG64(4))
    turn, shift = rng.standard_normal((d, features)) / (width * np.sqrt(d)), rng.uniform(0, 2 * np.pi, features)

    def total(fn, size: int) -> np.ndarray:
        """Sums of fn(x, y, fold) over the rows of each fold, one row per fold."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: dict[int, np.ndarray] = {}
            for batch in batches:
                x, y, fold = _matrix(batch.column(0)), *(batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
                for f in np.unique(fold).tolist():
                    out[f] = out.get(f, 0) + fn(x[fold == f], y[fold == f], f)
            yield pa.RecordBatch.from_arrays([pa.array([str(f) for f in out], pa.string()), pa.array([v.tobytes() for v in out.values()], pa.binary())], ["key", "vector"])

        got = summed(labelled.select("x", "y", "fold").mapInArrow(run, "key string, vector binary"))
        return np.stack([got.get(str(f), np.zeros(size)) for f in range(FOLDS)])

    sums = total(lambda x, y, f: np.concatenate([[len(y), y.sum()], x.sum(0), (x**2).sum(0)]), 2 + 2 * d).sum(0)
    n, positive = sums[0], sums[1]
    if n == 0 or positive in (0, n):
        zero = np.zeros(d)
        return Model(zero, zero + 1, turn, shift, np.zeros(features + 1), (zero, zero), 0.5 if n == 0 else positive / n)
    mean = sums[2 : 2 + d] / n
    scale = np.sqrt(np.maximum(sums[2 + d :] / n - mean**2, 0))
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), turn, shift, np.zeros(features + 1), (mean, mean))

    def normal(x: np.ndarray, y: np.ndarray, fold: int) -> np.ndarray:
        z = model.features(x)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y, [len(y)]])

    k = features + 1
    by_fold = total(normal, k * k + k + 1)

    def solved(sums: np.ndarray) -> np.ndarray:
        rows = max(sums[-1], 1.0)
        a = sums[: k * k].reshape(k, k) / rows + ridge * np.diag([0.0] + [1.0] * features)
        return np.linalg.solve(a + 1e-9 * np.eye(k), sums[k * k : -1] / rows)

    model.ridge = solved(by_fold.sum(0))
    unseen = [solved(by_fold.sum(0) - own) for own in by_fold]
    # scores of labelled rows lie about 0 and 1; the outer cells take the rest
    edge = np.linspace(-0.5, 1.5, CELLS + 1)

    def cells(x: np.ndarray, y: np.ndarray, fold: int) -> np.ndarray:
        c = np.clip(np.searchsorted(edge, model.features(x) @ unseen[fold]) - 1, 0, CELLS - 1)
        return np.concatenate([np.bincount(c, minlength=CELLS), np.bincount(c, weights=y, minlength=CELLS)]).astype(float)

    sums = total(cells, 2 * CELLS).sum(0)
    weight, got = sums[:CELLS], sums[CELLS:]
    there = weight > 0
    model.grid = isotonic(((edge[1:] + edge[:-1]) / 2)[there], weight[there], got[there])
    return model


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted; learned from labels of documents that are not held out."""
    scratch = scratch or Scratch(docs.sparkSession, "quality")
    stats = scratch.write(statistics_table(docs), "statistics")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("q")).where("q IS NOT NULL AND doc_id IS NOT NULL")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.avg("q").alias("y"))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold")
    model = fit(scratch.write(stats.join(known, "doc_id").select("x", "y", fold), "labelled"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(_matrix(batch.column(1))))], ["doc_id", "score"])

    scored = stats.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
