from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from ledgerflow.llm import quality
from ledgerflow.llm.common import held_out, table
from ledgerflow.llm.queries import op3_quality

SF = "/root/testdata/sf0.01"


def test_features_are_of_one_text_only():
    texts = ["", "One two two.", "\n\nA", None, "\u00e9\u00e9 &&& ***", "same same same"]
    together = quality.features(pa.array(texts))
    alone = np.vstack([quality.features(pa.array([t], pa.string())) for t in texts])
    assert together.shape == (len(texts), quality.WIDTH)
    assert np.allclose(together, alone)
    assert np.allclose(quality.features(pa.array(["x y", *texts]).slice(1)), together)


def test_risk_equals_the_definition():
    draw = np.random.default_rng(3)
    p, u = (np.hstack([draw.normal(size=(n, quality.WIDTH - 1)), np.ones((n, 1))]) for n in (50, 80))
    w = draw.normal(size=quality.WIDTH) / 10
    loss = lambda x, sign: np.mean((1 - sign * (x @ w)) ** 2) / 4
    plus, minus = quality.risk_parts(w, p.T @ p / 50, u.T @ u / 80, 0.4)
    assert np.isclose(plus, 0.4 * loss(p, 1)) and np.isclose(minus, loss(u, -1) - 0.4 * loss(p, -1))


def test_fit_beats_its_start_on_the_non_negative_risk():
    draw = np.random.default_rng(4)
    hidden = np.zeros(quality.WIDTH - 1)
    hidden[0] = 2.0
    p = np.hstack([draw.normal(size=(30, quality.WIDTH - 1)) + hidden, np.ones((30, 1))])
    u = np.hstack([draw.normal(size=(100, quality.WIDTH - 1)) + hidden * draw.integers(0, 2, (100, 1)), np.ones((100, 1))])
    mp, mu = p.T @ p, u.T @ u
    risk = lambda w: (lambda a, b: a + max(0.0, b))(*quality.risk_parts(w, mp / 30, mu / 100, 0.5))
    start = np.linalg.solve(mu / 100 + (quality.RIDGE + quality.RIDGE_ROWS / 30) * np.eye(quality.WIDTH), mp[-1] / 30 - mu[-1] / 100)
    assert risk(quality.fit(mp, mu, 0.5)) <= risk(start) + 1e-9


def test_prior_and_calibration():
    positive, unlabelled = np.zeros(quality.BINS), np.zeros(quality.BINS)
    positive[200:240] = 10
    unlabelled[200:240], unlabelled[10:50] = 14, 6
    assert np.isclose(quality.class_prior(positive, unlabelled), 0.7)
    chances = quality.calibration(positive, unlabelled, 0.7)
    assert chances[220] > 0.99 and chances[20] < 0.01 and (np.diff(chances) >= -1e-12).all()


@pytest.fixture(scope="module")
def scored(spark):
    return op3_quality(spark, SF).collect()


def test_held_out_quality(spark, scored):
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    out = [(r["score"], labels[r["doc_id"]]) for r in scored if r["held_out"] and r["doc_id"] in labels]
    good, bad = np.array([s for s, q in out if q]), np.array([s for s, q in out if not q])
    assert (good[:, None] > bad[None]).mean() > 0.95
    assert np.mean([(s >= 0.3) == q for s, q in out]) > 0.9
    assert all(0.0 <= r["score"] <= 1.0 and r["predicted"] == (r["score"] >= 0.3) for r in scored)


def test_labels_of_held_out_rows_do_not_matter(spark, scored):
    trusted = table(spark, SF, "labels").where("quality = 1").where(~held_out("doc_id"))
    again = quality.quality_scores(table(spark, SF, "documents"), trusted)
    assert np.allclose(*(np.array([x for _, x in sorted((r["doc_id"], r["score"]) for r in rows)]) for rows in (again.collect(), scored)))


def test_odd_rows(spark):
    texts = [None, "", " ", "word " * 400_000, "Fine text. " * 20, "&&& *** " * 20]
    rows = [(i, t, "s", "f") for i, t in enumerate(texts)] + [(4, texts[4], "s", "f"), (None, "no id", "s", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, features string")
    trusted = spark.createDataFrame([(4,), (4,), (None,)], "doc_id long")
    got = quality.quality_scores(docs, trusted).collect()
    assert len(got) == len(rows) and all(0.0 <= r["score"] <= 1.0 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 4}) == 1
    assert {r["score"] for r in quality.quality_scores(docs, trusted.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(docs.limit(0), trusted).count() == 0


def slow_prior(positive, unlabelled):
    """Threshold after threshold: the smallest ratio of the shares above it, while enough positives are above."""
    ratios = []
    for low in range(quality.BINS):
        p, u = sum(positive[low:]) / sum(positive), sum(unlabelled[low:]) / sum(unlabelled)
        if p >= quality.LEAST_MASS:
            ratios.append(u / p)
    return min(0.99, max(0.01, min(ratios)))


def slow_calibration(positive, unlabelled, prior):
    """The rising fit by its max-min formula over all runs of bins."""
    p, u = np.r_[0, np.cumsum(prior * positive / positive.sum())], np.r_[0, np.cumsum(unlabelled / unlabelled.sum() + 1e-9)]
    found = []
    for at in range(quality.BINS):
        lows, highs = np.arange(at + 1)[:, None], np.arange(at + 1, quality.BINS + 1)[None]
        found.append(((p[highs] - p[lows]) / (u[highs] - u[lows])).min(axis=1).max())
    return np.clip(found, 0.0, 1.0)


@pytest.mark.parametrize("seed", range(4))
def test_prior_and_calibration_equal_the_definition(seed):
    draw = np.random.default_rng(seed)
    place = np.linspace(0, 1, quality.BINS)
    positive = draw.poisson(30 * place**2).astype(float)
    unlabelled = draw.poisson(40 * (0.6 * place**2 + 0.4 * (1 - place) ** 2)).astype(float)
    prior = quality.class_prior(positive, unlabelled)
    assert np.isclose(prior, slow_prior(positive, unlabelled))
    assert np.allclose(quality.calibration(positive, unlabelled, prior), slow_calibration(positive, unlabelled, prior), atol=1e-6)


def test_fit_is_near_the_least_risk_over_rows():
    draw = np.random.default_rng(6)
    wide = lambda x: np.hstack([x, np.zeros((len(x), quality.WIDTH - x.shape[1] - 1)), np.ones((len(x), 1))])
    p, u = wide(draw.normal(size=(40, 3)) + [1.5, 0, 0]), wide(np.vstack([draw.normal(size=(60, 3)) + [1.5, 0, 0], draw.normal(size=(60, 3)) - [1.5, 0, 0]]))
    prior, ridge = 0.5, quality.RIDGE + quality.RIDGE_ROWS / len(p)

    def risk(w):
        mean = lambda rows, sign: sum((1.0 - sign * float(w @ x)) ** 2 / 4.0 for x in rows) / len(rows)
        return prior * mean(p, 1) + max(0.0, mean(u, -1) - prior * mean(p, -1)) + ridge * float(w @ w)

    found = quality.fit(p.T @ p, u.T @ u, prior)
    least = risk(found)
    # No small or large step along a coordinate, nor any of many random points, does clearly better.
    used = [0, 1, 2, quality.WIDTH - 1]
    for at in used:
        for step in (-0.3, -0.05, 0.05, 0.3):
            moved = found.copy()
            moved[at] += step
            assert risk(moved) >= least - 1e-3
    for _ in range(200):
        point = np.zeros(quality.WIDTH)
        point[used] = draw.normal(size=4)
        assert risk(point) >= least - 1e-3
