from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerflow.llm import langid
from ledgerflow.llm.common import held_out, is_training, table
from ledgerflow.llm.queries import op4_langid

SF = "/root/testdata/sf0.001"


def test_families():
    assert langid.family_of("en") == langid.family_of("de-AT") == "germanic"
    assert langid.family_of("pt_BR") == "romance"
    assert langid.family_of("xx") == "xx"


def slow_features(text):
    data = f" {text} ".encode()
    lowered = [b | 0x20 if b < 0x80 and chr(b).isalpha() else b if b >= 0x80 else 32 for b in data]
    for i in range(1, len(data)):
        if data[i - 1] == 0xC3 and 0x80 <= data[i] <= 0x9E:
            lowered[i] += 0x20
    counts = np.zeros(langid.DIMENSIONS)
    for a, b, c in zip(lowered, lowered[1:], lowered[2:]):
        if (a == 32 and b == 32) or (b == 32 and c == 32):
            continue
        counts[((a << 16 | b << 8 | c) * 2654435761 % (1 << 32)) >> (32 - 11)] += 1
    weights = np.sqrt(counts)
    return weights / max(np.linalg.norm(weights), 1e-9)


def test_features_equal_the_definition():
    texts = ["a", "", "Hello, World", "\u00c9t\u00c9 \u4f60", "x  y 12 z", "ab" * 500]
    got = langid.trigram_features(pa.array(texts))
    assert np.allclose(got, [slow_features(t) for t in texts], atol=1e-5)
    sliced = langid.trigram_features(pa.array(["zzz", *texts]).slice(1))
    assert np.allclose(got, sliced)


@pytest.fixture(scope="module")
def predicted(spark):
    return op4_langid(spark, SF).collect()


def test_held_out_accuracy(spark, predicted):
    known = {r["doc_id"]: r["lang"] for r in table(spark, SF, "documents").collect()}
    out = [r for r in predicted if r["held_out"]]
    assert len(predicted) == len(known) and out
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in predicted)
    assert np.mean([known[r["doc_id"]] == r["lang_pred"] for r in out]) > 0.9
    assert all(0.0 <= r["score"] <= 1.0 for r in predicted)


def test_labels_of_held_out_rows_do_not_matter(spark, predicted):
    docs = table(spark, SF, "documents").withColumn("lang", F.when(held_out("doc_id"), "zz").otherwise(F.col("lang")))
    model = langid.fit(docs, key="doc_id", text="text", language="lang", training=is_training("doc_id"))
    again = langid.predict(docs.select("doc_id", "text"), model).collect()
    assert {(r["doc_id"], r["lang_pred"], r["score"]) for r in again} == {(r["doc_id"], r["lang_pred"], r["score"]) for r in predicted}


def test_odd_rows(spark):
    texts = [None, "", "123 !?", "der Hund und die Katze " * 40, "le chien et le chat " * 40, "\u4f60", "x" * 3_000_000]
    rows = [(i, t, "k", "s", 1.5) for i, t in enumerate(texts)] + [(3, texts[3], "k", "s", 1.5), (None, texts[4], None, "s", 1.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string, hash string, score double")
    learn = spark.createDataFrame(
        [(i, ("der Hund und die Katze " if i % 2 else "le chien et le chat ") * 9, "de" if i % 2 else "fr") for i in range(40)] + [(99, None, "xx"), (98, "no label", None)],
        "doc_id long, text string, lang string",
    )
    model = langid.fit(learn, key="doc_id", text="text", language="lang", training=F.lit(True))
    assert model.languages == {"germanic": ["de"], "romance": ["fr"]}
    found = langid.predict(docs, model)
    assert found.columns == ["doc_id", "text", "hash", "lang_pred", "score"]
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in found.collect()]
    assert [g for g in got if g[0] in (0, 1, 2)] == [(i, "und", 0.0) for i in range(3)]
    assert sorted(g[1] for g in got if g[0] in (3, 4) or g[0] is None) == ["de", "de", "fr", "fr"]
    assert {g[1] for g in got if g[0] in (5, 6)} <= {"de", "fr"}


def test_nothing_to_learn_from_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "text", "en")], "doc_id long, text string, lang string")
    model = langid.fit(docs, key="doc_id", text="text", language="lang", training=F.lit(False))
    assert [tuple(r) for r in langid.predict(docs.select("doc_id", "text"), model).collect()] == [(1, "text", "und", 0.0)]
    assert langid.predict(docs.limit(0), model).count() == 0


def test_one_language(spark):
    docs = spark.createDataFrame([(1, "text", "en")], "doc_id long, text string, lang string")
    model = langid.fit(docs, key="doc_id", text="text", language="lang", training=F.lit(True))
    assert [r["lang_pred"] for r in langid.predict(docs, model).collect()] == ["en"]


def slow_prediction(model, row):
    """The family with the largest margin; in it the language that wins most pairs, and of equal ones the one with the larger sum of bent margins."""
    margin = lambda weights: float(np.dot(weights[:-1], row) + weights[-1])
    names = list(model.languages)
    family = names[0] if len(names) == 1 else max(names, key=lambda name: margin(model.families[name]))
    members = model.languages[family]
    won, bent = dict.fromkeys(members, 0), dict.fromkeys(members, 0.0)
    for (a, b), weights in model.pairs.items():
        if a in won:
            side = np.tanh(margin(weights))
            won[a if side >= 0 else b] += 1
            bent[a] += side
            bent[b] -= side
    return max(members, key=lambda language: (won[language], bent[language]))


def test_votes_equal_the_definition():
    draw = np.random.default_rng(8)
    codes = ["en", "de", "nl", "fr", "es", "it", "pt", "ru", "xx"]
    centres = draw.normal(size=(len(codes), 30))
    labels = [codes[i % len(codes)] for i in range(270)]
    rows = np.array([centres[codes.index(x)] for x in labels]) + draw.normal(size=(270, 30)) * 1.5
    rows = (rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.float32)
    model = langid.fit_model(rows, labels)
    assert sorted(x for members in model.languages.values() for x in members) == sorted(codes)
    others = draw.normal(size=(200, 30)).astype(np.float32)
    found, sure = model.predict(np.vstack([rows, others]))
    assert list(found) == [slow_prediction(model, row) for row in np.vstack([rows, others])]
    assert ((sure >= 0) & (sure <= 1)).all()


def test_machine_is_near_the_smallest_loss():
    draw = np.random.default_rng(9)
    rows = draw.normal(size=(80, 12))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    signs = np.where(rows[:, 0] + 0.3 * draw.normal(size=80) > 0.1, 1.0, -1.0)
    cost = 20.0
    with_bias = [np.r_[row, 1.0] for row in rows]
    share = {sign: cost * 0.5 / (signs == sign).sum() for sign in (1.0, -1.0)}

    def loss(weights):
        return 0.5 * weights @ weights + sum(share[s] * max(0.0, 1.0 - s * (weights @ x)) ** 2 for x, s in zip(with_bias, signs))

    best = np.zeros(13)
    for _ in range(3000):
        slope = best.copy()
        for x, s in zip(with_bias, signs):
            slope -= 2.0 * share[s] * s * max(0.0, 1.0 - s * (best @ x)) * x
        best -= slope / 81.0
    # What the accelerated method promises after its rounds, with the curvature bound 1 + 4 * cost.
    found = langid.linear_svm(rows.astype(np.float32), signs, cost=cost, rounds=100).astype(float)
    assert loss(best) - 1e-6 <= loss(found) <= loss(best) + 2 * 81.0 * (best @ best) / 101**2 + 1e-3
