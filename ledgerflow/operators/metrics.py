"""Metric rows for answered questions and data stages, and their JSON export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.functions.numeric import flag
from ledgerflow.operators.percentiles import nearest_rank_percentiles

# Metric name of each timed step; other steps have no metric of their own.
STEP_METRICS = {
    "validate_tenant": "ValidateTenantLatencyMs",
    "route": "RouteLatencyMs",
    "sql_retrieval": "SqlRetrievalLatencyMs",
    "rag_retrieval": "RagRetrievalLatencyMs",
    "synthesize": "SynthesisLatencyMs",
    "guardrails": "GuardrailLatencyMs",
}
LATENCY_UNIT, COUNT_UNIT = "Milliseconds", "Count"


def total_latency(timings: Column) -> Column:
    """Sum over all timed steps, named or not."""
    return F.aggregate(F.map_values(timings), F.lit(0.0), lambda total, ms: total + ms)


def query_metrics(log: DataFrame) -> DataFrame:
    """One metric row per question; a metric whose input is missing stays NULL."""
    budget = F.col("chunk_budget_chars")
    return log.select(
        "question_id",
        "tenant_id",
        "route",
        total_latency(F.col("timings")).alias("QueryLatencyMs"),
        F.col("citation_count").cast("double").alias("CitationCount"),
        F.col("sql_row_count").cast("double").alias("SqlRowCount"),
        flag(F.col("guardrail_passed")).alias("GuardrailPassed"),
        *[F.try_element_at("timings", F.lit(step)).alias(metric) for step, metric in STEP_METRICS.items()],
        F.col("chunks_returned").alias("RetrievedChunks"),
        F.col("chunks_kept").alias("RetrievedChunksKept"),
        F.col("top_hit_score").alias("TopHitScore"),
        F.when(budget != 0, F.coalesce("budget_used_chars", F.lit(0.0)) / budget).alias("ContextBudgetUsedPct"),
    )


def stage_run(counts: DataFrame, *, run_id: str, stage: str, duration_ms: Column) -> DataFrame:
    """A run of a data stage from the counts of its reconciliation."""
    return counts.select(
        F.lit(run_id).alias("run_id"), F.lit(stage).alias("stage"), F.col("candidates").alias("records_in"), F.col("curated").alias("records_out"),
        "quarantined", duration_ms.alias("duration_ms"),
    )


def stage_metrics(runs: DataFrame) -> DataFrame:
    """One metric row per run of a data stage."""
    return runs.select(
        "run_id",
        "stage",
        F.col("records_in").cast("double").alias("RecordsIn"),
        F.col("records_out").cast("double").alias("RecordsOut"),
        F.col("quarantined").cast("double").alias("Quarantined"),
        F.col("duration_ms").alias("StageDurationMs"),
    )


def export_json(metrics: DataFrame, dimensions: list[str], *, namespace: str, at: Column | None = None) -> DataFrame:
    """Embedded-metric JSON lines: declared metrics with units, then all fields in name order.

    NULL metrics are neither declared nor written.
    """
    names = [f.name for f in metrics.schema.fields if f.dataType.typeName() == "double"]
    declared = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(n).isNotNull(),
                    F.struct(F.lit(n).alias("Name"), F.lit(LATENCY_UNIT if n.endswith("Ms") else COUNT_UNIT).alias("Unit")),
                )
                for n in names
            ]
        )
    )
    when = F.current_timestamp() if at is None else at
    block = F.struct(
        F.array(
            F.struct(
                F.array(F.array(*[F.lit(d) for d in dimensions])).alias("Dimensions"),
                declared.alias("Metrics"),
                F.lit(namespace).alias("Namespace"),
            )
        ).alias("CloudWatchMetrics"),
        F.unix_millis(when).alias("Timestamp"),
    )
    fields = {**{n: F.col(n) for n in [*dimensions, *names]}, "_aws": block}
    return metrics.select(F.to_json(F.struct(*[fields[n].alias(n) for n in sorted(fields)])).alias("value"))


def trace_scores(log: DataFrame) -> DataFrame:
    """Scores of each answered question in long form (question_id, name, score); absent ones are left out."""
    cited, summarised = F.col("citation_count") > 0, F.col("chunk_budget_chars").isNotNull()
    retrieved = cited | summarised
    budget = F.col("chunk_budget_chars")
    scores = {
        "citation_coverage": flag(cited),
        "citation_count": F.col("citation_count").cast("double"),
        "guardrail_passed": flag(F.col("guardrail_passed")),
        "top_hit_score": F.when(retrieved, F.coalesce("top_hit_score", F.lit(0.0))),
        "budget_utilization": F.when(retrieved & (budget != 0), F.coalesce("budget_used_chars", F.lit(0.0)) / budget),
        "retrieved_chunk_count": F.when(retrieved, F.col("chunks_returned")),
        "kept_chunk_count": F.when(retrieved, F.col("chunks_kept")),
        "sql_row_count": F.when(F.col("sql_row_count") > 0, F.col("sql_row_count").cast("double")),
    }
    wide = log.select("question_id", *[c.alias(n) for n, c in scores.items()])
    return wide.unpivot("question_id", list(scores), "name", "score").where(F.col("score").isNotNull())


def step_spans(log: DataFrame) -> DataFrame:
    """One row per timed step of each question, to two decimals."""
    spans = log.select("question_id", F.explode("timings").alias("step", "ms"))
    return spans.select("question_id", "step", F.bround("ms", 2).alias("duration_ms"))


def latency_summary(log: DataFrame, *by: str) -> DataFrame:
    """Mean and nearest-rank p95 of the total latency, to four decimals."""
    timed = log.select(*by, total_latency(F.col("timings")).alias("latency_ms"))
    p95 = nearest_rank_percentiles(timed, by, "latency_ms", {"p95_latency_ms": 0.95})
    none = F.lit(None).cast("double")
    mean = timed.groupBy(*by).agg(F.count("*").alias("questions"), F.avg("latency_ms").alias("mean_latency_ms"))
    # Each side has one row per group; put them under each other and fold, which needs no join key.
    both = mean.withColumn("p95_latency_ms", none).unionByName(
        p95.withColumns({"questions": F.lit(None).cast("long"), "mean_latency_ms": none})
    )
    return both.groupBy(*by).agg(
        F.max("questions").alias("questions"),
        F.bround(F.max("mean_latency_ms"), 4).alias("mean_latency_ms"),
        F.bround(F.max("p95_latency_ms"), 4).alias("p95_latency_ms"),
    )


def token_usage(usage: DataFrame) -> DataFrame:
    """Tokens by tenant; usage records come in two spellings, a missing count is zero."""

    def count(camel: str, snake: str) -> Column:
        read = lambda name: F.get_json_object("usage_json", f"$.{name}").try_cast("long")
        return F.sum(F.coalesce(read(camel), read(snake), F.lit(0)))

    return usage.groupBy("tenant_id").agg(
        F.count("*").alias("answers"),
        count("inputTokens", "input_tokens").alias("input_tokens"),
        count("outputTokens", "output_tokens").alias("output_tokens"),
        count("totalTokens", "total_tokens").alias("total_tokens"),
    )
