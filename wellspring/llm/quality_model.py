"""A quality score: random Fourier features of document statistics, ridge regression, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspring.llm.words import GAP_CHARS, char_count, whole_rows, words
from wellspring.operators.keyed import attach_by_key
from wellspring.session import settle

FEATURES = 192
WIDTH = 3.0  # of the Gaussian kernel, in standard deviations of a statistic
RIDGE = 1e-3
FOLDS = 5
CELLS = 512  # of the raw score, for calibration
SUMS = 16  # tasks that add up the partitions' sums
SMOOTH = 1.0
CUT = 0.3
STATISTICS = ["log_words", "word_length", "letters", "capitals", "symbols", "digits", "marks", "bangs", "variety", "loose", "line_words", "same_lines"]


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and statistics of each whole text; null text counts as empty. Built-in functions only."""
    rows = whole_rows(docs, id_col, text_col).select("_id", "_text", words(F.col("_text")).alias("_words"), F.split("_text", "\n").alias("_lines"))
    n, chars = F.greatest(F.size("_words"), F.lit(1)), F.greatest(F.length(F.translate("_text", GAP_CHARS, "")), F.lit(1))

    def without(pattern: str) -> Column:
        return F.length("_text") - F.length(F.regexp_replace("_text", pattern, ""))

    values = [
        F.log1p(F.size("_words")), F.least(chars / n, F.lit(40)), without("\\p{L}+") / chars, without("\\p{Lu}+") / chars,
        char_count(F.col("_text"), "#*$%&|<>") / chars, char_count(F.col("_text"), "0123456789") / chars, char_count(F.col("_text"), ".,;:?") / n,
        char_count(F.col("_text"), "!") / n, F.log1p(F.size(F.array_distinct("_words"))) - F.log1p(F.size("_words")),
        char_count(F.col("_text"), "|") / n, F.log1p(n / F.size("_lines")), 1 - F.size(F.array_distinct("_lines")) / F.size("_lines"),
    ]
    return rows.select("_id", *[v.cast("double").alias(name) for name, v in zip(STATISTICS, values)])


@dataclass
class QualityModel:
    """Everything that scores a row of statistics; small, and the same for every row."""

    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps: np.ndarray  # calibrated score of each cell of the raw score
    low: float
    high: float

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2 / len(self.phases)) * np.cos(z @ self.waves + self.phases), np.ones((len(x), 1))])

    def cells(self, raw: np.ndarray) -> np.ndarray:
        return np.clip((raw - self.low) / (self.high - self.low) * CELLS, 0, CELLS - 1).astype(int)

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.steps[self.cells(self.features(x) @ self.weights)]


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in STATISTICS]) if batch.num_rows else np.zeros((0, len(STATISTICS)))


def _add_up(parts: DataFrame) -> dict[int, np.ndarray]:
    """Sum binary arrays of doubles per fold: first in ``SUMS`` groups of partitions, then those few on the driver."""
    def add(key, table):
        total = 0
        for value in table.column("sums"):
            total = total + np.frombuffer(value.as_buffer(), "f8")
        return pa.table({"fold": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    grouped = parts.groupBy("fold", F.pmod("part", F.lit(SUMS)).alias("group")).applyInArrow(add, "fold int, sums binary")
    out: dict[int, np.ndarray] = {}
    for row in sorted(grouped.collect(), key=lambda r: (r["fold"], bytes(r["sums"]))):
        out[row["fold"]] = out.get(row["fold"], 0) + np.frombuffer(row["sums"], "f8")
    return out


def _isotonic(total: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Pool adjacent violators over the cells; each cell is drawn a little to the overall share."""
    share = (positive.sum() + 0.5) / (total.sum() + 1)
    blocks: list[list[float]] = []  # weight, positives, cells
    for n, p in zip(total, positive):
        blocks.append([n, p, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n2, p2, c2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n2, blocks[-1][1] + p2, blocks[-1][2] + c2]
    steps = np.concatenate([np.full(int(c), (p + SMOOTH * share) / (n + SMOOTH)) for n, p, c in blocks])
    return np.maximum.accumulate(np.clip(steps, 0, 1))


def fit_quality(training: DataFrame, label_col: str = "_label", fold_col: str = "_fold", seed: int = 7) -> QualityModel:
    """Fit on rows of statistics with a 0/1 label and a fold (0 to ``FOLDS`` - 1).

    Every partition sums its normal equations per fold; a tree of sums adds them up. The ridge weights of all folds but one
    score that fold, and those scores, counted in ``CELLS`` cells, give the isotonic calibration; the final weights use all
    folds. Without rows or with one class the score is the share of that class.
    """
    training = settle(training)
    moments = training.agg(*[f(c).alias(f"{k}_{c}") for c in STATISTICS for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = np.array([moments[f"m_{c}"] or 0.0 for c in STATISTICS])
    scale = np.array([max(moments[f"s_{c}"] or 0.0, 1e-6) for c in STATISTICS])
    draw = np.random.default_rng(seed)
    model = QualityModel(mean, scale, draw.normal(0, 1 / WIDTH, (len(STATISTICS), FEATURES)), draw.uniform(0, 2 * np.pi, FEATURES),
                         np.zeros(FEATURES + 1), np.full(CELLS, 0.5), -0.5, 1.5)
    size = FEATURES + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            z, y, fold = model.features(_matrix(batch)), batch.column(label_col).to_numpy(), batch.column(fold_col).to_numpy()
            for k in np.unique(fold):
                own, label = z[fold == k], y[fold == k]
                held[k] = held.get(k, 0) + np.concatenate([(own.T @ own).ravel(), own.T @ label])
        yield pa.record_batch([pa.array(list(held), pa.int32()), pa.array([TaskContext.get().partitionId()] * len(held), pa.int64()),
                               pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["fold", "part", "sums"])

    equations = _add_up(training.mapInArrow(sums, "fold int, part bigint, sums binary"))
    if not equations:
        return model
    whole = sum(equations.values())

    def solve(v: np.ndarray) -> np.ndarray:
        left = v[:size * size].reshape(size, size)
        return np.linalg.solve(left + np.eye(size) * (RIDGE * max(left[-1, -1], 1.0)), v[size * size:])

    without = {k: solve(whole - v) for k, v in equations.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, CELLS))
        for batch in batches:
            z, y, fold = model.features(_matrix(batch)), batch.column(label_col).to_numpy(), batch.column(fold_col).to_numpy()
            for k in np.unique(fold):
                cell = model.cells(z[fold == k] @ without[int(k)])
                np.add.at(held[0], cell, 1.0)
                np.add.at(held[1], cell, y[fold == k].astype(float))
        yield pa.record_batch([pa.array([0], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int64()),
                               pa.array([held.tobytes()], pa.binary())], names=["fold", "part", "sums"])

    total, positive = _add_up(training.mapInArrow(count, "fold int, part bigint, sums binary"))[0].reshape(2, CELLS)
    model.weights, model.steps = solve(whole), _isotonic(total, positive)
    return model


def score_quality(stats: DataFrame, model: QualityModel) -> DataFrame:
    """(_id, score) of rows of statistics."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("_id"), pa.array(model.score(_matrix(batch)))], names=["_id", "score"])

    return stats.select("_id", *STATISTICS).mapInArrow(score, f"_id {stats.schema['_id'].dataType.simpleString()}, score double")


def classify_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per row of ``docs``: id, held_out, score (0 to 1, higher for label 1) and predicted (score at least ``CUT``).

    Learns from labelled documents whose crc32(id as text) is not a multiple of ``FOLDS``; the label is no input of a
    score. All labelled rows of that kind are used. Null text counts as empty and gets a score like any other. A label that is null
    or belongs to no document is passed over; ids with several labels count with each. Without labels each
    score is 0.5. Repeated rows get equal scores; further columns are ignored.
    """
    fold = F.pmod(F.crc32(F.col("_id").cast("string")), F.lit(FOLDS)).cast("int")
    stats = settle(statistics(docs, id_col, text_col).withColumn("_fold", fold))
    known = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_label"))
    model = fit_quality(attach_by_key(stats.where("_fold <> 0"), settle(known), ["_id"], how="inner", salt_by=["_id"]))
    scored = score_quality(stats, model)
    held = F.coalesce(F.pmod(F.crc32(F.col("_id").cast("string")), F.lit(FOLDS)) == 0, F.lit(False))
    return scored.select(F.col("_id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
