from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerflow.llm import neardup
from ledgerflow.llm.common import materialize, table
from tests.llm.test_decontam import slow_matches
from tests.llm.test_neardup import slow_components, slow_fingerprint
from tests.llm.test_pii import slow_base

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before and after every stage, over the given documents and a few odd ones."""
    docs = table(spark, SF, "documents")
    passage = table(spark, SF, "benchmark").first()["text"]
    first = docs.first()
    odd = [
        (900_001, None, None, "s", 0), (900_002, "", "en", "s", 0), (900_003, "123 456", "en", "s", 7), (900_004, "some " + passage + " more", None, "s", 9),
        (900_005, first["text"], None, "s", 9), (900_006, "mail me at some.one@example.com please, she said to him", None, "s", 9), (None, "no id but a text of its own with words", "en", "s", 9),
        (900_006, "mail me at some.one@example.com please, she said to him", None, "s", 9),
    ]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    # Columns of other tables may come along; they stay as they are.
    docs = docs.withColumns({"score": F.lit(-1.0), "id": F.lit("other"), "row.at": F.lit(7), "fp": F.lit("f"), "spans": F.array(F.lit(1))})
    clashing = ["_predicted", "_certainty", "predicted", "Certainty", "_gone", "_hash", "gone_id", "GONE_HASH", "_id", "_text"]
    docs = docs.withColumns({name: F.lit("mine") for name in clashing})
    docs = materialize(docs, "test-documents")
    states = [docs]
    for _, stage in corpus_pipeline.STAGES:
        states.append(materialize(stage(spark, states[-1], SF), "test-stage"))
    return [state.collect() for state in states], [state.columns for state in states]


def test_stages_are_the_dealt_ones(stages):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    _, columns = stages
    assert all(c == columns[0] for c in columns[:-1])
    assert {tuple(r)[-10:] for rows in stages[0][:-1] for r in rows} == {("mine",) * 10}
    assert {(r["score"], r["id"], r["row.at"], r["fp"], tuple(r["spans"])) for rows in stages[0][:-1] for r in rows} == {(-1.0, "other", 7, "f", (1,))}


def test_language_drops_only_what_has_no_letters(stages):
    (before, after, *_), _ = stages
    lettered = [r for r in before if re.search(r"[^\W\d_]", r["text"] or "")]
    assert sorted(str(r["doc_id"]) for r in after) == sorted(str(r["doc_id"]) for r in lettered)
    assert all(r["lang"] is not None for r in after)


def test_one_of_each_group_of_near_duplicates(stages):
    (_, before, after, *_), _ = stages
    roots = slow_components([slow_fingerprint(r["text"]) for r in before])
    lowest = {}
    for r, root in zip(before, roots):
        name = (r["doc_id"] is None, r["doc_id"] or 0)
        lowest[root] = min(lowest.get(root, name), name)
    assert sorted(lowest.values()) == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in after)


def test_benchmark_passages_go(stages, spark):
    (_, _, before, after, *_), _ = stages
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    clean = [str(r["doc_id"]) for r in before if not slow_matches(r["text"], items)]
    assert sorted(str(r["doc_id"]) for r in after) == sorted(clean)
    assert "900004" not in clean


def test_personal_data_is_replaced(stages):
    (_, _, _, before, after, _), _ = stages
    texts = {r["doc_id"]: r["text"] for r in before}
    assert len(after) == len(before)
    for r in after:
        assert not slow_base(r["text"]) and r["n_chars"] == len(r["text"])
        if not slow_base(texts[r["doc_id"]]):
            assert r["text"] == texts[r["doc_id"]]
    assert "[EMAIL]" in {r["doc_id"]: r["text"] for r in after}[900_006]


def test_all_pieces_are_packed(stages):
    (*_, before, after), _ = stages
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before}
    filled = Counter()
    for r in after:
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= 2048


def test_run_gives_the_same(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() > 0 and neardup.WORDS == 3


def test_empty_table_and_long_runs(spark, tmp_path):
    docs, benchmark = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    rows = [(1, "x" + " " * 1_200_000 + "y", None, "s", 9), (2, "\n" * 1_200_000, "en", "s", 9), (3, "A clean text of some words.", "en", "s", 9)]
    spark.createDataFrame(rows, docs.schema).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    # The second has no letter.
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {1, 3}
