from __future__ import annotations

import datetime as dt
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerflow.operators import evaluation, guardrails, metrics, retrieval, routing, slo
from ledgerflow.operators.blocks import best_positions
from ledgerflow.operators.percentiles import nearest_rank_percentiles
from ledgerflow.plans import inputs
from tests.conftest import collect

SF = "/root/testdata/sf0.001"

ROUTES = [
    ("How high is the sum of all unpaid invoices?", "sql"),
    ("Which control is in status red, and how many exceptions does it have?", "sql"),
    ("Are the balances of last year final?", "sql"),
    ("EXPLAIN our deferred   revenue approach", "rag"),
    ("What do the policies recommend?", "rag"),
    ("Give me the issue summary of the last review", "rag"),
    ("Is there guidance on leases, and why?", "rag"),
    ("Which total does the workpaper show?", "mixed_guardrail"),
    ("What amount is printed in the ocr output?", "mixed_guardrail"),
    ("Is this invoice covered by policy?", "mixed_guardrail"),
    ("Put the count into a table", "mixed_guardrail"),
    # A narrative word with an exact one but no document word stays with SQL.
    ("Explain the status of this engagement", "sql"),
    # Document words alone are no narrative words.
    ("Show me the document", "sql"),
    # Terms are whole words.
    ("Notebooks, accountability and summary judgements", "sql"),
    ("Whyever not? Essays", "sql"),
    ("", "sql"),
]


def questions(spark, rows):
    return spark.createDataFrame([(f"q{i}", text, route) for i, (text, route) in enumerate(rows)], "question_id string, question string, expected_route string")


def test_routes(spark):
    routed = routing.route_questions(questions(spark, ROUTES))
    assert evaluation.routing_misses(routed).collect() == []
    report = {r["expected_route"]: r for r in evaluation.routing_accuracy(routed).collect()}
    assert report["all"]["total"] == len(ROUTES) and report["all"]["accuracy"] == 1.0
    row = routed.where("question_id = 'q7'").first()
    assert row["skill"] == "precision_guardrail" and row["rules_fired"][-1] == "precision_guardrail_required"


def test_every_term_is_found_alone_and_only_as_a_word(spark):
    terms = sorted({*routing.SQL_TERMS, *routing.RAG_TERMS, *routing.PRECISION_DOC_TERMS})
    rows = [(f"({t.upper()})", "") for t in terms] + [(f"x{t}", "") for t in terms]
    found = routing.matched_terms(questions(spark, rows)).orderBy(F.substring("question_id", 2, 9).cast("int")).collect()
    hits = [{*r["sql_hits"], *r["rag_hits"], *r["precision_doc_hits"]} for r in found]
    assert all(t in h for t, h in zip(terms, hits))
    assert not any(hits[len(terms):])


def test_governing_rules(spark):
    rows = routing.guardrail_context(routing.route_questions(questions(spark, ROUTES))).collect()
    for r in rows:
        assert r["rule_ids"] == (["tool_routing"] if r["route"] == "sql" else ["tool_routing", "retrieval_grounding", "response_guardrail"])
        assert len(r["enforcement_points"]) == 3 * len(r["rule_ids"])


INDEX = "tenant_id string, chunk_id string, doc_type string, retention_state string, text string, document_id string, source_uri string"


def small_index(spark, seed=1, rows=60):
    rng = random.Random(seed)
    words = "the a of lease revenue note policy audit fee late plan".split()
    kinds = ["policy", "workpaper", "engagement_note", "issue_summary"]
    data = [
        (f"t{rng.choice([1, 1, 1, 2])}", f"c{i:03}", rng.choice(kinds), rng.choice(["active"] * 4 + ["archived"]),
         " ".join(rng.choices(words, k=rng.randint(0, 8))), f"d{rng.randint(0, 9)}", "u")
        for i in range(rows)
    ]
    asked = [(f"q{i}", f"t{rng.choice([1, 2, 3])}", " ".join(rng.choices(words, k=rng.randint(0, 5))), rng.choice([None, None, "policy"])) for i in range(12)]
    return data, asked, spark.createDataFrame(data, INDEX), spark.createDataFrame(
        asked, "question_id string, tenant_id string, question string, wanted_doc_type string"
    )


@pytest.mark.parametrize("sizes", [{}, {"index_block": 7, "question_block": 2}])
def test_lexical_search_equals_brute_force_for_any_block_size(spark, sizes):
    data, asked, index, frame = small_index(spark)
    want = []
    for qid, tenant, text, kind in asked:
        tokens = set(text.split())
        scored = []
        for t, chunk, doc_type, state, body, _, _ in data:
            if t == tenant and state == "active" and kind in (None, doc_type):
                share = len(tokens & set(body.split())) / len(tokens) if tokens else 0.0
                scored.append((-(share + (0.2 if retrieval.CUE_WORDS[doc_type] in tokens else 0.0)), chunk))
        want += [(qid, rank, chunk, -score) for rank, (score, chunk) in enumerate(sorted(scored)[:4], 1)]
    found = retrieval.lexical_topk(frame, index, **sizes)
    assert collect(found, "question_id", "rank", "chunk_id", "score") == sorted(want)


def test_best_row_per_document_survives_blocking(spark):
    data, asked, index, frame = small_index(spark, seed=5)
    whole = retrieval.policy_topk(frame, index, one_per="document_id")
    cut = retrieval.policy_topk(frame, index, one_per="document_id", index_block=5, question_block=3)
    assert collect(whole, "question_id", "rank", "chunk_id") == collect(cut, "question_id", "rank", "chunk_id")
    owner = {r[1]: r[5] for r in data}
    seen = [(r["question_id"], owner[r["chunk_id"]]) for r in whole.collect()]
    assert len(seen) == len(set(seen)) and seen


@pytest.mark.parametrize("sizes", [{}, {"index_block": 11, "question_block": 4}])
def test_vector_search_equals_brute_force(spark, sizes):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(80, 6)).astype(np.float32)
    vectors[10] = vectors[11]  # a tie
    vectors[12] = 0
    rows = [("t", f"c{i:03}", "policy", "active" if i % 9 else "archived", v.tolist()) for i, v in enumerate(vectors)]
    index = spark.createDataFrame(rows, "tenant_id string, chunk_id string, doc_type string, retention_state string, embedding array<float>")
    asked = index.select(F.concat(F.lit("q"), "chunk_id").alias("question_id"), "tenant_id", "embedding")
    found = {}
    for r in retrieval.vector_topk(asked, index, **sizes).orderBy("question_id", "rank").collect():
        found.setdefault(r["question_id"], []).append(r["chunk_id"])
    wide = vectors.astype(np.float64)
    norms = np.linalg.norm(wide, axis=1)
    unit = wide / np.where(norms > 0, norms, 1)[:, None]
    for i in range(80):
        score = np.round(unit @ unit[i], 9)
        order = sorted((j for j in range(80) if j % 9), key=lambda j: (-score[j], j))[:4]
        assert found[f"qc{i:03}"] == [f"c{j:03}" for j in order]


def test_hybrid_needs_all_terms_or_nearness(spark):
    rows = [("t", "c1", "policy", "active", "late fee policy", [1.0, 0.0]), ("t", "c2", "policy", "active", "late plan", [0.0, 1.0]),
            ("t", "c3", "policy", "active", "fee", [-1.0, 0.0]), ("t", "c4", "policy", "archived", "late fee", [1.0, 0.0])]
    index = spark.createDataFrame(rows, "tenant_id string, chunk_id string, doc_type string, retention_state string, text string, embedding array<float>")
    asked = spark.createDataFrame([("q", "t", "Late fee", [0.0, 1.0])], "question_id string, tenant_id string, question string, embedding array<float>")
    found = {r["chunk_id"]: r["score"] for r in retrieval.hybrid_topk(asked, index, k=1).collect()}
    # c1 holds both terms (each in 2 of 3 rows); its length is 3 against a mean of 2. c2 is nearest with score 1.
    rarity = math.log(1 + 1.5 / 2.5)
    bm25 = 2 * rarity * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 3 / 2))
    assert bm25 < 1 and found == {"c2": 1.0}
    both = {r["chunk_id"]: r["score"] for r in retrieval.hybrid_topk(asked, index, k=3).collect()}
    assert both == {"c1": pytest.approx(bm25 + 0.5, abs=1e-8), "c2": 1.0, "c3": 0.5}
    lexical = collect(retrieval.match_topk(asked, index), "chunk_id", "score")
    assert lexical == [("c1", pytest.approx(bm25, abs=1e-8))]


def test_match_all_equals_brute_force(spark):
    data, asked, index, frame = small_index(spark, seed=4)
    want = []
    for qid, tenant, text, kind in asked:
        rows = [(r[1], r[4].split(), r[2]) for r in data if r[0] == tenant and r[3] == "active"]
        terms = set(text.split())
        scored = []
        for chunk, words, doc_type in rows:
            if terms and terms <= set(words) and kind in (None, doc_type):
                mean, total = sum(len(w) for _, w, _ in rows) / len(rows), 0.0
                for t in terms:
                    n = sum(t in w for _, w, _ in rows)
                    tf = words.count(t)
                    total += math.log(1 + (len(rows) - n + 0.5) / (n + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean))
                scored.append((-round(total, 9), chunk))
        want += [(qid, rank, chunk, -score) for rank, (score, chunk) in enumerate(sorted(scored)[:4], 1)]
    found = collect(retrieval.match_topk(frame, index), "question_id", "rank", "chunk_id", "score")
    assert len(want) > 10 and [f[:3] for f in found] == [w[:3] for w in sorted(want)]
    assert [f[3] for f in found] == pytest.approx([w[3] for w in sorted(want)], abs=1e-8)


def test_hybrid_searches_rows_and_questions_without_a_vector(spark):
    rows = [("t", "c1", "policy", "active", "late fee", None), ("t", "c2", "policy", "active", "other", [0.0, 1.0]), ("t", "c3", "policy", "active", "fee late", [1.0, 0.0])]
    index = spark.createDataFrame(rows, "tenant_id string, chunk_id string, doc_type string, retention_state string, text string, embedding array<float>")
    asked = [("plain", "t", "late fee", None), ("both", "t", "late fee", [0.0, 1.0]), ("wordless", "t", "?!", [0.0, 1.0]), ("nothing", "t", "", None), ("missing", "t", "absent", None)]
    frame = spark.createDataFrame(asked, "question_id string, tenant_id string, question string, embedding array<float>")
    found = {}
    for r in retrieval.hybrid_topk(frame, index, k=3).collect():
        found.setdefault(r["question_id"], set()).add(r["chunk_id"])
    assert found == {"plain": {"c1", "c3"}, "both": {"c1", "c2", "c3"}, "wordless": {"c2", "c3"}}


def test_match_all_has_no_python_in_its_plan(spark):
    _, _, index, frame = small_index(spark, seed=4)
    plan = retrieval.match_topk(frame, index)._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Python" not in plan


def test_best_positions_keeps_ties_in_order():
    scores = np.array([0.5, 1.0, 0.5, -np.inf, 0.5, 1.0])
    assert best_positions(scores, 4).tolist() == [1, 5, 0, 2]
    assert best_positions(scores, 9).tolist() == [1, 5, 0, 2, 4]
    assert best_positions(scores, 2, np.array([0, 0, 0, 1, 2, 0])).tolist() == [1, 4]


@pytest.mark.parametrize(
    ("lengths", "budget", "kept"),
    [([3000] * 3, 6500, 2), ([3000] * 5, 8000, 2), ([5000, 5000], 8000, 1), ([9000, 10], 8000, 0), ([4000, 4000, 0, 1], 8000, 3)],
)
def test_budget_keeps_a_prefix(spark, lengths, budget, kept):
    hits = spark.createDataFrame([("q", i + 1, "x" * n, 1.0) for i, n in enumerate(lengths)], "question_id string, rank int, text string, score double")
    assert collect(guardrails.context_budget(hits, budget), "rank") == [(i + 1,) for i in range(kept)]


def test_answer_checks(spark):
    rows = [("sql", 0, 0, True), ("rag", 1, 0, True), ("rag", 0, 1, False), ("mixed_guardrail", 1, 1, True), ("mixed_guardrail", 1, 0, False), ("mixed_guardrail", 0, 1, False)]
    checked = guardrails.check_answers(spark.createDataFrame(rows, "route string, citation_count int, sql_row_count int, want boolean"))
    assert all(r["guardrail_passed"] == r["want"] for r in checked.collect())
    with pytest.raises(guardrails.GuardrailViolation):
        guardrails.enforce(checked)
    assert guardrails.enforce(checked.where("want")).count() == 3


def test_contracts(spark):
    schema = "skill string, answer string, sql string, records array<string>, citations array<string>, warnings array<string>, route string, guardrail_context string"
    rows = [
        ("exact_accounting_sql", "", "SELECT", ["r"], None, None, "sql", "g"),
        ("exact_accounting_sql", "a", None, ["r"], None, None, "sql", "g"),
        ("tenant_safe_policy_rag", "a", None, None, ["c"], None, "rag", "g"),
        ("tenant_safe_policy_rag", "a", None, None, [], None, "rag", "g"),
        ("precision_guardrail", "a", None, None, ["c"], ["w"], "mixed_guardrail", "g"),
        ("precision_guardrail", "a", None, None, ["c"], None, "mixed_guardrail", None),
    ]
    found = [r["missing_fields"] for r in guardrails.check_contracts(spark.createDataFrame(rows, schema)).collect()]
    assert found == [[], ["sql"], [], ["citations"], [], ["warnings", "guardrail_context"]]


def test_tenant_boundary(spark):
    rows = [("q1", "t1", "t1"), ("q2", "t1", "t2"), ("q3", None, None), ("q4", "t1", None)]
    allowed, violations = guardrails.split_by_tenant(spark.createDataFrame(rows, "question_id string, tenant_id string, authenticated_tenant_id string"))
    assert collect(allowed, "question_id") == [("q1",)]
    assert collect(violations, "question_id") == [("q2",), ("q3",), ("q4",)]


def test_retrieval_never_leaves_its_tenant(spark):
    _, _, index, frame = small_index(spark, seed=9)
    hits = retrieval.lexical_topk(frame, index, index_block=6)
    owners = index.select("chunk_id", F.col("tenant_id").alias("owner"), "retention_state")
    joined = hits.join(owners, "chunk_id")
    assert joined.where((F.col("owner") != F.col("tenant_id")) | (F.col("retention_state") != "active")).count() == 0
    cited = hits.select("question_id", "tenant_id")
    assert guardrails.cross_tenant_leaks(cited, frame).count() == 0


@pytest.mark.parametrize("values", [[5.0], [1.0, 2.0], list(range(31)), [7.0] * 500 + [1e9], [0.0] * 10 + list(range(10))])
def test_percentiles_are_exact(spark, values):
    values = [float(v) for v in values]
    rows = spark.createDataFrame([("g", v) for v in values] + [("h", 1.0), ("g", None)], "g string, v double")
    found = {r["g"]: r for r in nearest_rank_percentiles(rows, ["g"], "v", {"p50": 0.5, "p95": 0.95, "p100": 1.0}).collect()}
    ordered = sorted(values)
    for name, share in (("p50", 0.5), ("p95", 0.95), ("p100", 1.0)):
        assert found["g"][name] == ordered[int(round((len(values) - 1) * share))]
        assert found["h"][name] == 1.0
    assert nearest_rank_percentiles(rows.where("g = 'g'"), [], "v", {"p95": 0.95}).first()["p95"] == found["g"]["p95"]


def test_query_metrics_and_export(spark):
    log = spark.createDataFrame(
        [("q", "t", "mixed_guardrail", {"route": 3.5, "synthesize": 50.25, "other": 1.0}, 2, 1, True, 4.0, 3.0, 8000.0, 2400.0, 0.75)],
        "question_id string, tenant_id string, route string, timings map<string,double>, citation_count int, sql_row_count int, guardrail_passed boolean, "
        "chunks_returned double, chunks_kept double, chunk_budget_chars double, budget_used_chars double, top_hit_score double",
    )
    rows = metrics.query_metrics(log)
    row = rows.first()
    assert (row["QueryLatencyMs"], row["RouteLatencyMs"], row["SqlRetrievalLatencyMs"]) == (54.75, 3.5, None)
    assert row["ContextBudgetUsedPct"] == pytest.approx(0.3)
    line = metrics.export_json(rows, ["tenant_id", "route"], namespace="n", at=F.lit("2024-01-01").cast("timestamp")).first()["value"]
    payload = json.loads(line)
    assert list(payload) == sorted(payload) and "SqlRetrievalLatencyMs" not in payload
    declared = payload["_aws"]["CloudWatchMetrics"][0]
    assert {"Name": "RouteLatencyMs", "Unit": "Milliseconds"} in declared["Metrics"] and declared["Dimensions"] == [["tenant_id", "route"]]
    assert payload["_aws"]["Timestamp"] == 1704067200000


def test_token_spellings(spark):
    rows = [("t", '{"inputTokens": 5, "outputTokens": 1}'), ("t", '{"input_tokens": 7, "total_tokens": 9}'), ("t", "{}")]
    usage = metrics.token_usage(spark.createDataFrame(rows, "tenant_id string, usage_json string")).first()
    assert tuple(usage) == ("t", 3, 12, 1, 9)


def test_latency_alert_fires_once_per_stretch(spark):
    midnight = dt.datetime(2024, 1, 2)
    slow = [-3, -2, -1, 0, 1, 2, 10, 11, 12, 13, 20, 21, 22, 23, 24]
    rows = [(midnight + dt.timedelta(minutes=m, seconds=s), {"a": 5000.0}) for m in slow for s in (1, 30)]
    rows += [(midnight + dt.timedelta(minutes=m), {"a": 10.0}) for m in (3, 9, 14, 25)]
    alerts = slo.latency_alerts(spark.createDataFrame(rows, "asked_at timestamp, timings map<string,double>"))
    assert collect(alerts, "since") == [(midnight - dt.timedelta(minutes=3),), (midnight + dt.timedelta(minutes=20),)]


def test_reports_use_no_python(spark):
    requests = inputs.questions(spark, SF)
    citations = requests.select("question_id", "tenant_id")
    rows = slo.slo_report(inputs.stage_runs(spark, SF), inputs.query_log(spark, SF), routing.route_questions(requests), requests, citations)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan
    assert {r["metric"] for r in rows.select("metric").distinct().collect()} == set(slo.OBJECTIVES)


def test_isolation_counts_leaks_and_violations_that_reached_retrieval(spark):
    day = dt.datetime(2024, 1, 2, 5)
    requests = spark.createDataFrame(
        [("ok", day, "t1", "t1"), ("stopped", day, "t1", "t2"), ("reached", day, "t1", "t2")],
        "question_id string, asked_at timestamp, tenant_id string, authenticated_tenant_id string",
    )
    cited = spark.createDataFrame([("ok", "c1", "t1"), ("ok", "c2", "t9"), ("reached", "c3", "t1"), ("reached", "c4", "t2")], "question_id string, chunk_id string, tenant_id string")
    assert collect(slo.isolation_objectives(requests, cited), "metric", "value") == [("cross_tenant_leaks", 2.0), ("tenant_boundary_violations", 1.0)]
    alerts = collect(slo.boundary_alerts(requests, cited), "alert", "subject", "since")
    assert alerts == [("cross_tenant", "reached", day), ("cross_tenant", "stopped", day), ("cross_tenant_leak", "c2", day), ("cross_tenant_leak", "c3", day)]


def test_a_null_group_has_percentiles_too(spark):
    rows = spark.createDataFrame([(None, 1.0), (None, 3.0), ("g", 2.0)], "g string, v double")
    assert {tuple(r) for r in nearest_rank_percentiles(rows, ["g"], "v", {"p": 1.0}).collect()} == {(None, 3.0), ("g", 2.0)}
