"""Quality scores by positive-unlabelled learning with the non-negative risk.

Every whole text becomes a row of bounded features: shares of byte classes and of hashed pairs of byte classes, and
a few shapes of words and lines, among them how often a word repeats the one before it. Trusted positives are the training rows labelled good; all documents together are
the unlabelled text. The loss is the squared one, for which the non-negative risk

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

depends on the data only through second moments of the features. So one pass over all documents gives exact moments
(a small matrix per task, summed), and the risk is then minimised on the driver, on numbers whose size does not depend
on the corpus. The class prior is the smallest ratio of unlabelled to positive mass above a threshold, from
histograms of a first scorer over all rows; with it, the ratio of both densities turns the final margin into a chance.

Nulls and ties: a null text counts as empty; empty texts have a score like any other. Rows without an id are held out;
repeated rows get the same score, and count as often as they occur. Without positives every score is one half.
An empty table gives no rows. Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import batches_of, is_training, materialize

PAIRS = 48
SHAPES = 11
BINS = 256
#: Share of the positives that a threshold must keep to count for the prior.
LEAST_MASS = 0.5
#: Shrinkage: a fixed part, and one that fades as positives are added.
RIDGE = 1e-4
RIDGE_ROWS = 2.0
BYTES_AT_ONCE = 2 << 20
ROWS_AT_ONCE = 512


def _byte_classes() -> tuple[np.ndarray, int]:
    """A class for each byte: letters by case, digits, bytes beyond ASCII by role, each other sign by itself."""
    found, signs = np.zeros(256, np.int64), {}
    for byte in range(256):
        sign = chr(byte)
        if byte >= 0xC0:
            found[byte] = 3
        elif byte >= 0x80:
            found[byte] = 4
        elif sign.islower():
            found[byte] = 0
        elif sign.isupper():
            found[byte] = 1
        elif sign.isdigit():
            found[byte] = 2
        elif byte < 32 and sign not in "\n\t":
            found[byte] = 5
        else:
            found[byte] = signs.setdefault(sign, 6 + len(signs))
    return found, 6 + len(signs)


_CLASS, CLASSES = _byte_classes()
_ODD = np.random.default_rng(7).integers(1 << 62, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
WIDTH = CLASSES + PAIRS + SHAPES + 1


def _repetition(data: np.ndarray, blank: np.ndarray, at: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags of words: equal to the word before, and first of its kind in its text."""
    if not len(at):
        return np.zeros(0, bool), np.zeros(0, bool)
    place = np.arange(len(data), dtype=np.int64)
    place -= np.repeat(at, np.diff(np.r_[at, len(data)])) if at[0] == 0 else np.r_[np.zeros(at[0], np.int64), np.repeat(at, np.diff(np.r_[at, len(data)]))]
    mixed = (data.astype(np.uint64) + np.uint64(1)) * _ODD[place & 63]
    mixed[blank] = 0
    word = np.add.reduceat(mixed, at) + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    repeated = np.r_[False, (word[1:] == word[:-1]) & (row[1:] == row[:-1])]
    fresh = np.zeros(len(at), bool)
    fresh[np.unique(word, return_index=True)[1]] = True
    return repeated, fresh


def features(texts: pa.Array) -> np.ndarray:
    """A row of `WIDTH` numbers, the last always 1, for every text."""
    texts = pa.concat_arrays([pc.fill_null(texts, "")]).cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets, n = offsets - offsets[0], len(texts)
    sizes = np.diff(offsets)
    classes, rows = _CLASS[data], np.repeat(np.arange(n), sizes)
    total = np.maximum(sizes, 1).astype(float)[:, None]

    single = np.bincount(rows * CLASSES + classes, minlength=n * CLASSES).reshape(n, CLASSES) / total
    pair = (classes[:-1] * 7919 + classes[1:] * 104729) % 1_000_003 % PAIRS
    inside = rows[1:] == rows[:-1]
    paired = np.bincount((rows[1:] * PAIRS + pair)[inside], minlength=n * PAIRS).reshape(n, PAIRS) / total

    blank = (data == 32) | (data == 10) | (data == 9)
    starts = ~blank
    starts[1:] &= blank[:-1] | ~inside
    lines = data == 10
    upper_start = starts & (classes == 1)
    after_word = np.zeros(len(data), bool)
    after_word[:-1] = blank[1:] & inside & (classes[:-1] >= 6) & ~blank[:-1]
    per_row = lambda flags: np.bincount(rows[flags], minlength=n)
    at = np.flatnonzero(starts)
    repeated, fresh = _repetition(data, blank, at, rows[at])
    words = np.maximum(per_row(starts), 1)
    letters = np.maximum(per_row(classes <= 1), 1)
    shapes = np.stack(
        [
            np.log1p(sizes) / 12, np.log1p(words) / 10, np.minimum((sizes - per_row(blank)) / words, 40) / 40, np.log1p(per_row(lines)) / 8,
            np.bincount(rows[at[repeated]], minlength=n) / words, np.bincount(rows[at[fresh]], minlength=n) / words,
            np.minimum(1.0, 4 * np.bincount(rows[at[repeated]], minlength=n) / words), per_row(upper_start) / words, per_row(after_word) / words, per_row(classes == 1) / letters, np.minimum(words / (per_row(lines) + 1), 200) / 200,
        ],
        axis=1,
    )
    return np.hstack([np.sqrt(single), np.sqrt(paired), shapes, np.ones((n, 1))]).astype(np.float32)


def featured(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, features) of every row."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slice_ in batches_of(batch, "text", BYTES_AT_ONCE):
                for low in range(0, slice_.num_rows, ROWS_AT_ONCE):
                    part = slice_.slice(low, ROWS_AT_ONCE)
                    flat = pa.FixedSizeListArray.from_arrays(pa.array(features(part.column("text")).ravel()), WIDTH)
                    yield pa.record_batch([part.column("id"), flat.cast(pa.list_(pa.float32()))], ["id", "features"])

    return rows.mapInArrow(compute, f"id {rows.schema['id'].dataType.simpleString()}, features array<float>")


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH).astype(float)


def moments(rows: DataFrame) -> np.ndarray:
    """The sum of outer products of the features; its last cell is the number of rows."""
    upper = np.triu_indices(WIDTH)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((WIDTH, WIDTH)), 0
        for batch in batches:
            x = matrix(batch.column("features"))
            total, seen = total + x.T @ x, seen + len(x)
        if seen:
            cells = [pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), pa.array(total[upper])]
            yield pa.record_batch(cells, ["i", "j", "value"])

    cells = rows.select("features").mapInArrow(partial, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))
    total = np.zeros((WIDTH, WIDTH))
    # WIDTH squared cells at most.
    for r in cells.collect():
        total[r["i"], r["j"]] = total[r["j"], r["i"]] = r["value"]
    return total


def histogram(rows: DataFrame, weights: np.ndarray) -> np.ndarray:
    """Counts of the scores in `BINS` equal bins."""

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BINS, np.int64)
        for batch in batches:
            scores = probability(matrix(batch.column("features")) @ weights)
            counts += np.bincount(np.minimum((scores * BINS).astype(int), BINS - 1), minlength=BINS)
        at = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(counts[at])], ["bin", "n"])

    found = np.zeros(BINS)
    for r in rows.select("features").mapInArrow(binned, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        found[r["bin"]] = r["n"]
    return found


def probability(margin: np.ndarray) -> np.ndarray:
    """The squared loss fits a margin of 2 p - 1; beyond -1 and 1 it is bent so that order stays."""
    return 0.5 + 0.5 * margin / (1.0 + np.abs(margin) ** 8) ** 0.125


def risk_parts(weights: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """prior * R_p(+) and R_u(-) - prior * R_p(-) under the loss (1 - margin)^2 / 4, from mean moments."""

    def loss(mean: np.ndarray, sign: float) -> float:
        return (1.0 - 2.0 * sign * weights @ mean[-1] + weights @ mean @ weights) / 4.0

    return prior * loss(positive, 1.0), loss(unlabelled, -1.0) - prior * loss(positive, -1.0)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, *, rounds: int = 400) -> np.ndarray:
    """Weights with the smallest non-negative risk, from sums of outer products.

    Starts at the minimum of the unbiased risk, which has a closed form. While the negative part is below zero,
    steps raise it, as the non-negative estimator's do; else they lower the whole risk. The best point seen stays.
    """
    p, u = positive / positive[-1, -1], unlabelled / unlabelled[-1, -1]
    ridge = RIDGE + RIDGE_ROWS / positive[-1, -1]
    scale = u + ridge * np.eye(WIDTH)
    # Gradient of the unbiased risk: (u w + mean_u) / 2 - prior * mean_p.
    weights = np.linalg.solve(scale, 2.0 * prior * p[-1] - u[-1])
    best, best_risk = weights, np.inf
    for _ in range(rounds):
        plus, minus = risk_parts(weights, p, u, prior)
        risk = plus + max(0.0, minus) + ridge * weights @ weights
        if not risk < 1e6:
            break
        if risk < best_risk - 1e-12:
            best, best_risk = weights, risk
        minus_slope = (u @ weights + u[-1] - prior * (p @ weights + p[-1])) / 2.0
        plus_slope = prior * (p @ weights - p[-1]) / 2.0
        slope = -minus_slope if minus < 0 else plus_slope + minus_slope + 2.0 * ridge * weights
        weights = weights - 0.1 * np.linalg.solve(scale, slope)
    return best


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The smallest share of unlabelled over positive mass above a threshold, from histograms of one score."""
    above = lambda counts: np.cumsum(counts[::-1])[::-1] / max(1.0, counts.sum())
    p, u = above(positive), above(unlabelled)
    enough = p >= LEAST_MASS
    return float(np.clip((u[enough] / p[enough]).min() if enough.any() else 0.5, 0.01, 0.99))


def calibration(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> np.ndarray:
    """The chance to be good in each bin of the score: prior times the ratio of densities, pooled until it rises."""
    levels: list[list[float]] = []
    for p, u in zip(prior * positive / max(1.0, positive.sum()), unlabelled / max(1.0, unlabelled.sum())):
        levels.append([p, u + 1e-9, 1])
        while len(levels) > 1 and levels[-2][0] * levels[-1][1] >= levels[-1][0] * levels[-2][1]:
            last = levels.pop()
            levels[-1] = [a + b for a, b in zip(levels[-1], last)]
    return np.clip(np.concatenate([np.full(int(n), p / u) for p, u, n in levels]), 0.0, 1.0)


def calibrated(scores: np.ndarray, chances: np.ndarray) -> np.ndarray:
    """Chances between the bins' middles, with a little of the score itself, so that its order stays."""
    return 0.98 * np.interp(scores, (np.arange(BINS) + 0.5) / BINS, chances) + 0.02 * scores


def score_rows(rows: DataFrame, weights: np.ndarray | None, chances: np.ndarray | None) -> DataFrame:
    """(id, score) of every row of features."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("features"))
            found = np.full(len(x), 0.5) if weights is None else calibrated(probability(x @ weights), chances)
            yield pa.record_batch([batch.column("id"), pa.array(np.clip(found, 0.0, 1.0))], ["id", "score"])

    return rows.mapInArrow(score, f"id {rows.schema['id'].dataType.simpleString()}, score double")


def quality_scores(docs: DataFrame, trusted: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every document; `trusted` has the keys of the trusted positives, once or more."""
    rows = materialize(featured(docs, key=key, text=text), "quality-features")
    known = trusted.select(F.col(key).alias("id")).where(is_training("id")).distinct()
    positive, unlabelled = rows.join(known, "id", "left_semi"), rows
    p, u = moments(positive), moments(unlabelled)
    if not p[-1, -1]:
        return score_rows(rows, None, None).withColumnRenamed("id", key)
    first = fit(p, u, 0.5)
    prior = class_prior(histogram(positive, first), histogram(unlabelled, first))
    weights = fit(p, u, prior)
    chances = calibration(histogram(positive, weights), histogram(unlabelled, weights), prior)
    return score_rows(rows, weights, chances).withColumnRenamed("id", key)
