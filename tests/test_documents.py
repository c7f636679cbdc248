from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerflow import schemas
from ledgerflow.functions import text as tx
from ledgerflow.operators import chunking, evaluation, ocr
from ledgerflow.plans import documents as queries
from ledgerflow.plans import inputs
from ledgerflow.sources import documents as source
from tests.conftest import collect

T0 = dt.datetime(2024, 1, 1)
SF = "/root/testdata/sf0.001"


def docs(spark, *texts, flag=False):
    rows = [("t", f"d{i}", "title", "policy", "internal", "active", T0, T0, text, f"u{i}", flag) for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, schemas.DOCUMENTS)


def chunks(spark, text, flag=False):
    rows = chunking.chunk_documents(docs(spark, text, flag=flag)).orderBy("chunk_index").collect()
    assert [r["chunk_id"] for r in rows] == [f"d0::chunk::{i}" for i in range(len(rows))]
    return [(r["chunk_kind"], r["text"]) for r in rows]


@pytest.mark.parametrize("text", ["", " \n\t ", "  \x1c", "\r\n\r\n"])
def test_blank_documents_have_no_chunks(spark, text):
    assert chunks(spark, text) == []
    assert evaluation.blank_documents(docs(spark, text)).count() == 1


def test_limit_is_exclusive(spark):
    assert chunks(spark, "B" * 320) == [("narrative", "B" * 320)]
    # One sentence cannot be cut, however long it is.
    assert chunks(spark, "B" * 900) == [("narrative", "B" * 900)]


def test_windows_repeat_their_last_sentence_and_carry_its_tail(spark):
    s = [f"{c * 99}." for c in "abcd"]
    found = chunks(spark, " ".join(s))
    assert [t for _, t in found] == [" ".join(s[:3]), f"{s[2]}\n{s[2]} {s[3]}"]


def test_window_size_leaves_out_the_joining_blanks(spark):
    s = [f"{c * 79}." for c in "abcd"]  # 4 x 80 = 320, plus three blanks
    assert len(chunks(spark, " ".join(s))) == 1
    s[3] = "dd" + s[3]
    assert len(chunks(spark, " ".join(s))) == 2


def test_carry_crosses_paragraphs_is_cut_and_stops_at_tables(spark):
    text = "First. " + "x" * 200 + "\n\nName  Value\nRow  1\n\nAfter."
    assert chunks(spark, text, flag=True) == [
        ("narrative", "First. " + "x" * 200),
        ("table_fragment", "x" * 160 + "\nName  Value\nRow  1"),
        ("narrative", "After."),
    ]
    assert [k for k, _ in chunks(spark, text, flag=False)] == ["narrative"] * 3


@pytest.mark.parametrize(
    ("paragraph", "table"),
    [
        ("a  b", False), ("a  b\nc", True), ("a b\nc d", False), ("a\tb\nc\td", False), ("  a\n  b", False),
        ("a  b\x0bc", True), ("é  ü\r\nx", True), ("a  -\nb", False), ("a\n\x1c\nb  c", True),
    ],
)
def test_table_like(spark, paragraph, table):
    found = chunks(spark, paragraph, flag=True)
    assert [k for k, _ in found] == ["table_fragment" if table else "narrative"]


def test_many_windows_keep_their_order(spark):
    s = [f"Sentence number {i} of a very long paragraph that never seems to come to its end at all." for i in range(2000)]
    found = chunks(spark, " ".join(s))
    joined = "\n".join(t for _, t in found)
    at = [joined.index(f"number {i} of") for i in range(2000)]
    assert at == sorted(at) and len(found) > 600


def test_normalize(spark):
    df = spark.createDataFrame([("﻿ a \r\nb\t c  \n\n\n\n\nd　 ",)], "x string")
    assert df.select(tx.normalize(F.col("x"))).first()[0] == "﻿ a\nb  c\n\nd"


def test_chunking_needs_no_shuffle_and_computes_each_array_once(spark):
    plan = queries.chunks(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert plan.count("aggregate(") == 1


def test_chunk_statistics_and_overlap(spark):
    rows = chunking.chunk_documents(docs(spark, " ".join(f"{c * 99}." for c in "abcdefg"), "Short."))
    stats = evaluation.chunk_stats(rows).first()
    assert (stats["chunk_count"], stats["min_chars"], stats["mean_in_target_range"]) == (4, 6, True)
    assert evaluation.chunk_overlap(rows).first()["overlap_pair_rate"] == 1.0
    assert evaluation.chunk_stats(rows.where("false")).first()["chunk_count"] == 0


def test_table_detection_counts_documents_without_chunks(spark):
    rows = chunking.chunk_documents(docs(spark, "a  b\nc", "", "plain", flag=True))
    labels = spark.createDataFrame([("d0", True), ("d1", True), ("d2", False)], "document_id string, expected_table boolean")
    report = evaluation.table_detection(rows, labels).first()
    assert (report["true_positives"], report["false_negatives"], report["precision"], report["recall"]) == (1, 1, 1.0, 0.5)


def test_documents_since_and_validation(spark):
    base = docs(spark, "a", "b").withColumn("updated_at", F.col("updated_at") + F.make_dt_interval(F.substring("document_id", 2, 1).cast("int")))
    assert collect(source.documents_since(base, F.lit("2024-01-02").cast("timestamp")), "document_id") == [("d1",)]
    bad = base.withColumn("doc_type", F.lit("memo")).withColumn("title", F.lit(None).cast("string"))
    assert source.validate(bad).first()["validation_errors"] == ["missing_title", "invalid_doc_type"]


def block(block_id, kind, text=None, row=None, col=None, entity=None, child=None, value=None):
    rels = [(t, list(ids)) for t, ids in (("CHILD", child), ("VALUE", value)) if ids is not None]
    return (block_id, kind, text, row, col, entity, rels or None)


def ocr_rows(df):
    return {r["document_id"]: r.asDict(recursive=True) for r in df.collect()}


def relational(results):
    """{document: (tables, form fields)} by the joins over tables of blocks."""
    rows = ocr.blocks(results)
    found = {r["document_id"]: ([], []) for r in results.collect()}
    for r in sorted(ocr.tables(rows).collect(), key=lambda r: r["table_position"]):
        found[r["document_id"]][0].append(r["table"])
    for r in sorted(ocr.key_values(rows).collect(), key=lambda r: r["position"]):
        found[r["document_id"]][1].append({"key": r["key"], "value": r["value"]})
    return found


@pytest.mark.parametrize("repeated", [True, False])
def test_ocr_edge_cases(spark, repeated):
    graph = [
        block("p", "PAGE"),
        block("empty", "TABLE", child=[]),
        block("t", "TABLE", child=["c2", "c1", "nowhere"]),
        block("c1", "CELL", row=1, col=2, child=["w", "w"]),
        block("c2", "CELL", child=["k"]),
        block("k", "KEY_VALUE_SET", entity=["KEY"], child=["w"], value=["lost"]),
        block("w" if repeated else "v", "WORD", "old"),
        block("w", "WORD", "new"),
    ]
    results = spark.createDataFrame([("t", "full", graph), ("t", "none", []), ("t", "null", None)], schemas.OCR_RESULT)
    rows = ocr_rows(ocr.extracted_documents(results))
    assert relational(results) == {key: (row["tables"], row["key_value_pairs"]) for key, row in rows.items()}
    assert rows["full"]["tables"] == [[], [[""], ["new new"]]]
    assert rows["full"]["key_value_pairs"] == [{"key": "new", "value": ""}]
    assert rows["full"]["raw_text"] == "\n\n\n" + " " * 20 + "\n" + "new new".ljust(20) + "\n"
    assert (rows["full"]["page_count"], rows["full"]["contains_table_like_text"]) == (1, True)
    for name in ("none", "null"):
        assert (rows[name]["raw_text"], rows[name]["tables"], rows[name]["page_count"]) == ("", [], 0)


def test_ocr_observed_time_defaults_to_now(spark):
    results = spark.createDataFrame([("t", "d", [block("l", "LINE", "hello")])], schemas.OCR_RESULT)
    record = ocr.to_documents(ocr.extracted_documents(results), doc_type="workpaper", classification="internal", retention_state="active").first()
    assert record["text"] == "hello" and record["created_at"] == record["updated_at"]


def test_results_and_tables_of_blocks_agree(spark):
    results = inputs.ocr_results(spark, SF)
    rows = ocr_rows(ocr.extracted_documents(results))
    assert relational(results) == {key: (row["tables"], row["key_value_pairs"]) for key, row in rows.items()}
    assert len(rows) == results.count()


def test_large_results_stay_exact(spark):
    graph = [block("t", "TABLE", child=[f"c{i}" for i in range(3000)])]
    graph += [block(f"c{i}", "CELL", row=i, col=1, child=[f"w{i}"]) for i in range(3000)] + [block(f"w{i}", "WORD", f"x{i}") for i in range(3000)]
    results = spark.createDataFrame([("t", "large", graph)], schemas.OCR_RESULT)
    assert ocr_rows(ocr.extracted_documents(results))["large"]["tables"] == [[[f"x{i}"] for i in range(3000)]]


def test_results_need_no_shuffle_and_exploded_sides_are_never_broadcast(spark):
    results = inputs.ocr_results(spark, SF)
    in_row = ocr.extracted_documents(results)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in in_row
    joined = ocr.owners(ocr.blocks(results))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in joined and "Broadcast" not in joined


def test_owners_of_blocks_are_found_once(spark):
    """Texts are looked up by grouping the owners by document; a join of the owners with themselves would find them twice."""
    plan = ocr.key_values(ocr.blocks(inputs.ocr_results(spark, "/root/testdata/sf0.001")))._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortMergeJoin") == 1


def test_only_useful_blocks_are_shuffled_and_once_by_document(spark):
    graph = [
        block("t", "TABLE", child=["c", "w", "gone"], value=["c"]),
        block("c", "CELL", child=["w", "l"], value=["w"]),
        block("l", "LINE", "not a word", child=["w"]),
        block("k", "KEY_VALUE_SET", entity=["KEY"], child=["w"], value=["l", "gone"]),
        block("j", "KEY_VALUE_SET", entity=["KEY"], child=["w"], value=["gone", "l"]),
        block("w", "WORD", "word"),
    ]
    results = spark.createDataFrame([("t", "d", graph), (None, "n", graph)], schemas.OCR_RESULT)
    rows = ocr.blocks(results)
    assert {r["document_id"]: r["table"] for r in ocr.tables(rows).collect()} == {"d": [["word"]], "n": []}
    assert sorted((r["position"], r["key"], r["value"]) for r in ocr.key_values(rows).collect()) == [(3, "word", ""), (4, "word", "word")]
    for found, most in ((ocr.tables(rows), 5), (ocr.key_values(rows), 3)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= most
