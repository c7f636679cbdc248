"""A whole table of questions -> grounded, checked answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.operators import guardrails, retrieval, routing, serving
from ledgerflow.session import materialize


def answer_questions(
    questions: DataFrame, gold: DataFrame, index: DataFrame, *, k: int = retrieval.TOP_K, max_chars: int = guardrails.MAX_CONTEXT_CHARS
) -> DataFrame:
    """Tenant check, route, exact rows, retrieval, budget and checks for every question at once.

    A question from the wrong tenant stays in the result with nothing but its status: it is split
    off before any table or document is read for it.
    """
    allowed, violations = guardrails.split_by_tenant(questions)
    routed = routing.route_questions(allowed)
    exact = serving.overdue_total(gold)
    asks_documents = routed.where(F.col("route") != "sql")
    # The search is read by the budget, the summary and the citations: it is done once.
    hits = retrieval.with_content(materialize(retrieval.lexical_topk(asks_documents, index, k=k), "hits"), index)
    kept = guardrails.context_budget(hits, max_chars)
    summary = guardrails.retrieval_summary(asks_documents, hits, kept, max_chars)
    cited = kept.groupBy("question_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda c: c["chunk_id"]).alias("citations")
    )
    uses_sql = F.col("route") != "rag"
    found = uses_sql & F.col("total_overdue_amount").isNotNull()
    answered = (
        routed.join(exact, "tenant_id", "left")
        .join(summary, "question_id", "left")
        .join(cited, "question_id", "left")
        .withColumn("citations", F.coalesce("citations", F.array().cast("array<string>")))
        .withColumn("citation_count", F.size("citations"))
        .withColumn("sql_row_count", F.when(found, 1).otherwise(0))
        .withColumn("total_overdue_amount", F.when(uses_sql, F.col("total_overdue_amount")))
        .withColumn("overdue_invoice_count", F.when(uses_sql, F.col("overdue_invoice_count")))
        .withColumn("warnings", guardrails.messages(F.col("route"), F.col("citation_count")))
    )
    checked = guardrails.check_answers(answered).withColumn("status", F.lit("answered"))
    refused = violations.withColumn("status", F.lit("tenant_violation")).withColumn("guardrail_passed", F.lit(False))
    return checked.unionByName(refused, allowMissingColumns=True)
