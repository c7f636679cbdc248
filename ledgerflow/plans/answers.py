"""Registered queries: routing, retrieval, guardrails, answers, reports and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.operators import chunking, evaluation, guardrails, metrics, retrieval, routing, slo, snapshot, term_index
from ledgerflow.plans import inputs, medallion
from ledgerflow.plans.answering import answer_questions as answer
from ledgerflow.plans.common import materialize, portable, rounded
from ledgerflow.session import work_dir


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk table as a search index. A search reads it twice and cuts it again each time, since storing it takes as much room as the input."""
    return chunking.chunk_documents(inputs.documents(spark, sf_dir))


def _hits(rows: DataFrame) -> DataFrame:
    return portable(rows.select("question_id", "tenant_id", "chunk_id", F.bround("score", 4).alias("score"), "rank"))


def route_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = routing.route_questions(inputs.questions(spark, sf_dir))
    return portable(rows.select("question_id", "route", "skill", "reason", "rules_fired"))


def route_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = routing.matched_terms(inputs.questions(spark, sf_dir))
    return portable(rows.select("question_id", "sql_hits", "rag_hits", "precision_doc_hits"))


def guardrail_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = routing.guardrail_context(routing.route_questions(inputs.questions(spark, sf_dir)))
    return portable(rows.select("question_id", "route", "rule_ids", "enforcement_points"))


def eval_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = evaluation.routing_accuracy(routing.route_questions(inputs.questions(spark, sf_dir)))
    return portable(rounded(report, 6, "accuracy"))


def eval_routing_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    misses = evaluation.routing_misses(routing.route_questions(inputs.questions(spark, sf_dir)))
    return portable(misses.select("question_id", "question", "expected_route", "route", "skill"))


def tenant_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, violations = guardrails.split_by_tenant(inputs.questions(spark, sf_dir))
    return portable(violations.select("question_id", "tenant_id", "authenticated_tenant_id"))


def retrieve_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(retrieval.lexical_topk(inputs.retrieval_cases(spark, sf_dir), _index(spark, sf_dir)))


def retrieve_policy_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(retrieval.policy_topk(inputs.questions(spark, sf_dir), _index(spark, sf_dir)))


def retrieve_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieval.vector_topk(inputs.vector_queries(spark, sf_dir), inputs.vectors(spark, sf_dir))
    return portable(hits.select("question_id", "tenant_id", "chunk_id", F.round("score", 6).alias("similarity"), "rank"))


def _embedded(spark: SparkSession, sf_dir: str, prefix: str, key: str) -> DataFrame:
    return inputs.table(spark, sf_dir, "embeddings").select(F.concat(F.lit(prefix), F.col("vec_id").cast("string")).alias(key), "embedding")


def retrieve_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every active document is asked for, among all documents; those of an embedding's number have a vector."""
    documents = inputs.documents(spark, sf_dir).withColumn("chunk_id", F.col("document_id"))
    index = documents.join(_embedded(spark, sf_dir, "doc_", "document_id"), "document_id", "left")
    cases = inputs.retrieval_cases(spark, sf_dir).join(_embedded(spark, sf_dir, "case_", "question_id"), "question_id", "left")
    hits = retrieval.hybrid_topk(materialize(cases, "hybrid-questions"), index)
    return portable(hits.select("question_id", "tenant_id", "chunk_id", F.round("score", 6).alias("score"), "rank"))


def index_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holders of every word after three batches of upserts and deletions, each taken off and added to the stored counts alone."""
    base = work_dir(spark, "term-index")
    documents = inputs.documents(spark, sf_dir).withColumn("chunk_id", F.col("document_id"))
    k = F.substring_index("document_id", "_", -1).cast("long")
    # Every fifth document comes only later.
    term_index.create(documents.where(k % 5 != 3), base)
    changes = (
        documents.where(k % 5 == 3).withColumn("deleted", F.lit(False)),
        documents.where(k % 7 == 2).withColumn("text", F.col("title")).withColumn("deleted", k % 4 == 1),
        documents.where(k % 9 == 4).withColumn("retention_state", F.when(k % 2 == 0, "archived").otherwise("active")).withColumn("deleted", F.lit(False)),
    )
    for version, change in enumerate(changes, 1):
        term_index.apply(change, base, version, fold_every=2)
    counts, sizes = term_index.holders(spark, base), term_index.tenants(spark, base)
    return portable(counts.join(sizes, "tenant_id").select("tenant_id", "term", "holders", "row_count", "word_count"))


def _case_hits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Cases and their hits; some cases also get a foreign or an archived row, as a faulty search would return."""
    index = _index(spark, sf_dir)
    cases = inputs.retrieval_cases(spark, sf_dir)
    hits = materialize(retrieval.lexical_topk(cases, index), "hits")
    details = index.select("chunk_id", "document_id", "retention_state", F.col("tenant_id").alias("chunk_tenant_id"))
    found = hits.join(details, "chunk_id").drop("tenant_id").withColumnRenamed("chunk_tenant_id", "tenant_id")
    k = F.substring_index("question_id", "_", -1).cast("long")
    faulty = cases.where((k % 41 == 0) | (k % 43 == 0)).select(
        F.lit("faulty").alias("chunk_id"), "question_id", F.lit(0.0).alias("score"), F.lit(5).alias("rank"), F.lit("faulty").alias("document_id"),
        F.when(k % 43 == 0, "archived").otherwise("active").alias("retention_state"),
        F.when(k % 41 == 0, "tenant_of_no_one").otherwise(F.col("tenant_id")).alias("tenant_id"),
    )
    return cases, found.unionByName(faulty)


def eval_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portable(evaluation.retrieval_report(evaluation.retrieval_cases(*_case_hits(spark, sf_dir))))


def eval_retrieval_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluation.retrieval_cases(*_case_hits(spark, sf_dir))
    return portable(rows.withColumn("reciprocal_rank", F.bround("reciprocal_rank", 4)))


def cross_tenant_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations checked against the authenticated tenant: those of a mismatched request are leaks."""
    requests = inputs.questions(spark, sf_dir)
    index = _index(spark, sf_dir)
    hits = materialize(retrieval.policy_topk(requests, index), "hits")
    cited = hits.join(index.select("chunk_id", F.col("tenant_id").alias("owner")), "chunk_id").select(
        "question_id", "chunk_id", F.col("owner").alias("tenant_id")
    )
    asked = requests.select("question_id", F.col("authenticated_tenant_id").alias("tenant_id"))
    return portable(guardrails.cross_tenant_leaks(cited, asked))


def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked prefix of every case's hits that fits 900 characters."""
    index = _index(spark, sf_dir)
    hits = materialize(retrieval.lexical_topk(inputs.retrieval_cases(spark, sf_dir), index), "hits")
    kept = guardrails.context_budget(retrieval.with_content(hits, index), 900)
    return portable(kept.select("question_id", "chunk_id", "rank", "chars_used"))


def retrieval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, cases = _index(spark, sf_dir), inputs.retrieval_cases(spark, sf_dir)
    hits = retrieval.with_content(materialize(retrieval.lexical_topk(cases, index), "hits"), index)
    summary = guardrails.retrieval_summary(cases, hits, guardrails.context_budget(hits, 900), 900)
    return portable(rounded(summary, 6, "top_hit_score"))


def context_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The declared budget policy: the best chunk of each of the four best documents, within the budget."""
    index, asked = _index(spark, sf_dir), inputs.questions(spark, sf_dir)
    hits = materialize(retrieval.policy_topk(asked, index, one_per="document_id"), "hits")
    kept = guardrails.context_budget(retrieval.with_content(hits, index))
    return portable(kept.select("question_id", "document_id", "chunk_id", "rank", "chars_used"))


def guardrail_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = guardrails.check_answers(inputs.query_log(spark, sf_dir).drop("guardrail_passed"))
    return portable(rows.select("question_id", "route", "citation_ok", "exact_from_sql_ok", "guardrail_passed"))


def _answer_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer payloads of every skill, some of them incomplete."""
    log = inputs.query_log(spark, sf_dir)
    n = F.substring_index("question_id", "_", -1).cast("long")
    none = F.lit(None).cast("string")
    cited = F.array_repeat(F.lit("chunk"), F.col("citation_count").cast("int"))
    return log.select(
        "question_id",
        "route",
        F.when(F.col("route") == "sql", "exact_accounting_sql").when(F.col("route") == "rag", "tenant_safe_policy_rag")
        .otherwise("precision_guardrail").alias("skill"),
        F.when(n % 7 == 0, none).when(n % 11 == 0, "").otherwise("answer").alias("answer"),
        F.when(n % 5 == 0, none).otherwise("SELECT 1").alias("sql"),
        F.array_repeat(F.lit("row"), F.col("sql_row_count").cast("int")).alias("records"),
        F.when(n % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("warning"))).alias("warnings"),
        F.when(n % 13 == 0, F.lit(None).cast("array<string>")).otherwise(cited).alias("citations"),
        F.lit("rules").alias("guardrail_context"),
        (n % 2 == 0).alias("expected_pass"),
    )


def answer_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = guardrails.check_contracts(_answer_payloads(spark, sf_dir))
    return portable(rows.select("question_id", "skill", "missing_fields", "complies"))


def eval_guardrails(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = guardrails.check_contracts(_answer_payloads(spark, sf_dir)).withColumnRenamed("complies", "actual_pass")
    return portable(rounded(evaluation.compliance(checked, "skill"), 6, "compliance_rate"))


def _guardrail_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of every check, from whole tables; some expectations are wrong, so that the report has failures."""
    k = F.substring_index("question_id", "_", -1).cast("long")
    requests = inputs.questions(spark, sf_dir).withColumn("expected_pass", k % 97 != 0)
    log = inputs.query_log(spark, sf_dir).drop("guardrail_passed")
    answers = guardrails.check_answers(log).withColumns(
        {
            "expected_citation": (F.col("route") == "sql") | (F.col("citation_count") > 0),
            "expected_exact": (F.col("route") != "mixed_guardrail") | (k % 11 != 0),
        }
    )
    # Three contexts of equal length per answer: how many a budget of 8,000 characters should keep.
    length = 1500 + k % 5 * 1000
    chunks = log.select("question_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("rank"), F.repeat(F.lit("x"), length.cast("int")).alias("text"))
    kept = guardrails.context_budget(chunks).groupBy("question_id").agg(F.count("*").alias("kept"))
    contexts = kept.select("question_id", "kept", F.least(F.lit(3), F.floor(8000 / length)).alias("expected_kept"), F.lit(True).alias("expected_pass"))
    return evaluation.guardrail_cases(requests, answers, guardrails.check_contracts(_answer_payloads(spark, sf_dir)), contexts)


def eval_guardrail_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portable(rounded(evaluation.compliance(_guardrail_cases(spark, sf_dir), "check"), 6, "compliance_rate"))


def eval_guardrail_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portable(evaluation.guardrail_failures(_guardrail_cases(spark, sf_dir)))


def answer_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answer(inputs.questions(spark, sf_dir), medallion.gold_invoices(spark, sf_dir), _index(spark, sf_dir), max_chars=1500)
    rows = rounded(rows, 2, "total_overdue_amount")
    rows = rounded(rows, 6, "top_hit_score")
    return portable(
        rows.select(
            "question_id", "tenant_id", "status", "route", "skill", "total_overdue_amount", "overdue_invoice_count",
            "sql_row_count", "chunks_returned", "chunks_kept", "chunk_budget_chars", "budget_used_chars", "top_hit_score",
            "citations", "citation_count", "warnings", "citation_ok", "exact_from_sql_ok", "guardrail_passed",
        )
    )


def query_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.query_metrics(inputs.query_log(spark, sf_dir))
    return portable(rounded(rows, 6, *[n for n, t in rows.dtypes if t == "double"]))


def stage_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portable(rounded(metrics.stage_metrics(inputs.stage_runs(spark, sf_dir)), 6, "StageDurationMs"))


def metrics_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported JSON lines, read again: which metrics each line declares and holds."""
    rows = metrics.query_metrics(inputs.query_log(spark, sf_dir))
    at = F.lit("2024-06-01 00:00:00").cast("timestamp")
    lines = metrics.export_json(rows, ["tenant_id", "route"], namespace="ledgerflow", at=at)
    block = "struct<CloudWatchMetrics:array<struct<Namespace:string,Metrics:array<struct<Name:string,Unit:string>>>>,Timestamp:bigint>"
    parsed = lines.select(
        F.from_json("value", f"tenant_id string, route string, QueryLatencyMs double, TopHitScore double, _aws {block}").alias("p")
    ).select("p.*")
    declared = F.col("_aws.CloudWatchMetrics")[0]
    return portable(
        parsed.select(
            "tenant_id", "route", F.round("QueryLatencyMs", 6).alias("latency_ms"), "TopHitScore",
            declared["Namespace"].alias("namespace"),
            F.transform(declared["Metrics"], lambda m: F.concat(m["Name"], F.lit(":"), m["Unit"])).alias("declared"),
            (F.col("_aws.Timestamp") / 1000).cast("long").alias("at"),
        )
    )


def trace_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portable(rounded(metrics.trace_scores(inputs.query_log(spark, sf_dir)), 6, "score"))


def step_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portable(metrics.step_spans(inputs.query_log(spark, sf_dir)))


def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and p95 per route, and over all questions."""
    log = inputs.query_log(spark, sf_dir)
    every = metrics.latency_summary(log).withColumn("route", F.lit("all"))
    return portable(metrics.latency_summary(log, "route").unionByName(every))


def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portable(metrics.token_usage(inputs.model_usage(spark, sf_dir)))


def slo_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = inputs.questions(spark, sf_dir)
    report = slo.slo_report(
        inputs.stage_runs(spark, sf_dir), inputs.query_log(spark, sf_dir), routing.route_questions(requests), requests, inputs.citations(spark, sf_dir)
    )
    return portable(rounded(report, 6, "value"))


def slo_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All alerts; the latency alert here fires after two minutes above 1,500 ms."""
    runs, log = inputs.stage_runs(spark, sf_dir), inputs.query_log(spark, sf_dir)
    alerts = slo.lag_alerts(runs).unionByName(slo.latency_alerts(log, threshold_ms=1500.0, minutes=2))
    alerts = alerts.unionByName(slo.guardrail_alerts(log))
    requests = inputs.questions(spark, sf_dir)
    return portable(alerts.unionByName(slo.boundary_alerts(requests, inputs.citations(spark, sf_dir))))


def latency_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latency alert as declared: five minutes above 3,000 ms, over a log dense enough to fire."""
    return portable(slo.latency_alerts(inputs.dense_query_log(spark, sf_dir)))


def context_budget_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked prefix of every case's hits that fits the declared 8,000 characters."""
    index = _index(spark, sf_dir)
    hits = materialize(retrieval.lexical_topk(inputs.retrieval_cases(spark, sf_dir), index, k=40), "hits")
    kept = guardrails.context_budget(retrieval.with_content(hits, index))
    return portable(kept.select("question_id", "chunk_id", "rank", "chars_used"))


def pipeline_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage metrics of the bronze to silver step, from its own reconciliation."""
    counts = snapshot.reconcile(inputs.bronze_invoices(spark, sf_dir), medallion.validated(spark, sf_dir))
    runs = metrics.stage_run(counts, run_id="bronze_to_silver_1", stage="bronze_to_silver_invoice_validation", duration_ms=F.lit(0.0))
    return portable(metrics.stage_metrics(runs))


QUERIES = {
    f.__name__: f
    for f in (
        route_questions, route_terms, guardrail_context, eval_routing, eval_routing_misses, tenant_violations, retrieve_lexical,
        retrieve_policy_ranked, retrieve_vector, retrieve_hybrid, index_statistics, eval_retrieval, eval_retrieval_cases, cross_tenant_leaks,
        context_budget, retrieval_summary, context_policy, guardrail_checks, answer_contracts, eval_guardrails, answer_questions,
        query_metrics, stage_metrics, metrics_export, trace_scores, step_spans, latency_summary, token_usage, slo_report, slo_alerts,
        latency_alerts, context_budget_declared, eval_guardrail_checks, eval_guardrail_failures, pipeline_metrics,
    )
}
