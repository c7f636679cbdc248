"""Service-level report and alert evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.functions.numeric import ratio
from ledgerflow.operators.metrics import total_latency
from ledgerflow.operators.percentiles import nearest_rank_percentiles

# Objectives as (metric, comparison, target); lags in seconds, latencies in ms.
OBJECTIVES = {
    "bronze_lag_seconds": ("<", 300.0),
    "silver_freshness_seconds": ("<", 900.0),
    "gold_freshness_seconds": ("<", 1800.0),
    "success_rate": (">", 0.995),
    "quality_pass_rate": (">", 0.99),
    "quarantine_rate": ("<", 0.01),
    "query_p50_ms": ("<", 800.0),
    "query_p95_ms": ("<", 2000.0),
    "retrieval_p95_ms": ("<", 200.0),
    "sql_retrieval_p95_ms": ("<", 300.0),
    "synthesis_p95_ms": ("<", 1500.0),
    "guardrail_compliance_rate": (">", 0.995),
    "citation_coverage": (">", 0.95),
    "routing_accuracy": (">", 0.95),
    "cross_tenant_leaks": ("=", 0.0),
    "tenant_boundary_violations": ("=", 0.0),
    "endpoint_uptime": (">", 0.999),
    "pipeline_uptime": (">", 0.995),
}

# The reported percentiles of the total latency and of single steps.
LATENCY_METRICS = {
    ("latency_ms", "p50"): "query_p50_ms",
    ("latency_ms", "p95"): "query_p95_ms",
    ("rag_retrieval", "p95"): "retrieval_p95_ms",
    ("sql_retrieval", "p95"): "sql_retrieval_p95_ms",
    ("synthesize", "p95"): "synthesis_p95_ms",
}

# Alert thresholds.
BRONZE_LAG_WARNING_S, BRONZE_LAG_CRITICAL_S = 900, 1800
GOLD_FRESHNESS_S = 2700
GUARDRAIL_RATE = 0.99
QUERY_P95_MS, QUERY_P95_MINUTES = 3000.0, 5
QUARANTINE_RATE = 0.02


def _seconds(start: str, end: str) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 1e6


def _met(metric: Column, value: Column) -> Column:
    met = F.lit(None).cast("boolean")
    for name, (comparison, target) in OBJECTIVES.items():
        holds = value < target if comparison == "<" else value > target if comparison == ">" else value == target
        met = F.when(metric == name, holds).otherwise(met)
    return met


def _long(wide: DataFrame, key: str, names: list[str]) -> DataFrame:
    return wide.select(key, *[F.col(n).cast("double").alias(n) for n in names]).unpivot(key, names, "metric", "value")


def data_objectives(runs: DataFrame) -> DataFrame:
    """(day, metric, value): worst lags and rates of the data stages."""
    daily = runs.withColumn("day", F.to_date("emitted_at")).groupBy("day").agg(
        F.max(_seconds("emitted_at", "bronze_at")).alias("bronze_lag_seconds"),
        F.max(_seconds("bronze_at", "silver_at")).alias("silver_freshness_seconds"),
        F.max(_seconds("silver_at", "gold_at")).alias("gold_freshness_seconds"),
        ratio(F.count_if("succeeded"), F.count("*")).alias("success_rate"),
        ratio(F.sum("records_out"), F.sum("records_in")).alias("quality_pass_rate"),
        ratio(F.sum("quarantined"), F.sum("records_in")).alias("quarantine_rate"),
        ratio(F.count_if("completed"), F.count("*")).alias("pipeline_uptime"),
    )
    return _long(daily, "day", [c for c in daily.columns if c != "day"])


def answer_objectives(log: DataFrame) -> DataFrame:
    """(day, metric, value): latency percentiles and rates of the answered questions."""
    timed = log.withColumn("day", F.to_date("asked_at")).withColumn("latency_ms", total_latency(F.col("timings")))
    for step in ("rag_retrieval", "sql_retrieval", "synthesize"):
        timed = timed.withColumn(step, F.try_element_at("timings", F.lit(step)))
    needs_citation = F.col("route") != "sql"
    served = F.col("outcome") != "client_error"
    rates = timed.groupBy("day").agg(
        ratio(F.count_if("guardrail_passed"), F.count("*")).alias("guardrail_compliance_rate"),
        ratio(F.count_if(needs_citation & (F.col("citation_count") > 0)), F.count_if(needs_citation)).alias("citation_coverage"),
        ratio(F.count_if(F.col("outcome") == "ok"), F.count_if(served)).alias("endpoint_uptime"),
    )
    report = _long(rates, "day", ["guardrail_compliance_rate", "citation_coverage", "endpoint_uptime"])
    # All latencies in one long table, ranked in one go.
    steps = ["latency_ms", "rag_retrieval", "sql_retrieval", "synthesize"]
    long = timed.select("day", *steps).unpivot("day", steps, "step", "value")
    ranked = nearest_rank_percentiles(long, ["day", "step"], "value", {"p50": 0.5, "p95": 0.95})
    shares = ranked.unpivot(["day", "step"], ["p50", "p95"], "share", "value")
    metric = F.lit(None).cast("string")
    for (step, share), name in LATENCY_METRICS.items():
        metric = F.when((F.col("step") == step) & (F.col("share") == share), F.lit(name)).otherwise(metric)
    named = shares.withColumn("metric", metric).where(F.col("metric").isNotNull())
    return report.unionByName(named.select("day", "metric", "value"))


def isolation_objectives(requests: DataFrame, citations: DataFrame) -> DataFrame:
    """(day, metric, value): retrieved rows of a foreign tenant, and mismatched requests that reached retrieval.

    `citations` has the question and the tenant of every retrieved row.
    """
    found = citations.select("question_id", F.col("tenant_id").alias("owner"))
    joined = requests.select("question_id", "asked_at", "tenant_id", "authenticated_tenant_id").join(found, "question_id", "left")
    foreign = F.col("owner").isNotNull() & ~F.col("owner").eqNullSafe(F.col("authenticated_tenant_id"))
    mismatched = ~F.col("tenant_id").eqNullSafe(F.col("authenticated_tenant_id"))
    per_request = joined.groupBy(F.to_date("asked_at").alias("day"), "question_id").agg(
        F.count_if(foreign).alias("leaks"), F.bool_or(mismatched & F.col("owner").isNotNull()).alias("violates")
    )
    daily = per_request.groupBy("day").agg(
        F.sum("leaks").alias("cross_tenant_leaks"), F.count_if("violates").alias("tenant_boundary_violations")
    )
    return _long(daily, "day", ["cross_tenant_leaks", "tenant_boundary_violations"])


def routing_objectives(routed: DataFrame) -> DataFrame:
    """(day, metric, value): share of labelled questions that took the expected route."""
    daily = routed.groupBy(F.to_date("asked_at").alias("day")).agg(
        ratio(F.count_if(F.col("route") == F.col("expected_route")), F.count("*")).alias("routing_accuracy")
    )
    return _long(daily, "day", ["routing_accuracy"])


def slo_report(runs: DataFrame, log: DataFrame, routed: DataFrame, requests: DataFrame, citations: DataFrame) -> DataFrame:
    """(day, metric, value, met) of every daily objective."""
    values = data_objectives(runs).unionByName(answer_objectives(log)).unionByName(routing_objectives(routed))
    values = values.unionByName(isolation_objectives(requests, citations))
    return values.withColumn("met", _met(F.col("metric"), F.col("value")))


def lag_alerts(runs: DataFrame) -> DataFrame:
    lag, gold = _seconds("emitted_at", "bronze_at"), _seconds("silver_at", "gold_at")
    share = ratio(F.col("quarantined"), F.col("records_in"))
    alerts = F.array_compact(
        F.array(
            F.when(lag > BRONZE_LAG_CRITICAL_S, F.lit("bronze_lag_critical")).when(lag > BRONZE_LAG_WARNING_S, F.lit("bronze_lag_warning")),
            F.when(gold > GOLD_FRESHNESS_S, F.lit("gold_freshness")),
            F.when(share > QUARANTINE_RATE, F.lit("quarantine_rate")),
        )
    )
    return runs.select(F.explode(alerts).alias("alert"), F.col("run_id").alias("subject"), F.col("emitted_at").alias("since"))


def minute_p95(log: DataFrame) -> DataFrame:
    """(minute, p95) of the total latency."""
    timed = log.select(F.date_trunc("minute", "asked_at").alias("minute"), total_latency(F.col("timings")).alias("latency_ms"))
    return nearest_rank_percentiles(timed, ["minute"], "latency_ms", {"p95": 0.95})


def latency_alerts(log: DataFrame, *, threshold_ms: float = QUERY_P95_MS, minutes: int = QUERY_P95_MINUTES) -> DataFrame:
    """The first minute of each stretch of at least `minutes` minutes whose p95 exceeds the threshold.

    A slow minute votes for every start whose first `minutes` minutes include it, and against the
    start right after it; votes meet by minute, so no task orders the whole history.
    """
    slow = minute_p95(log).where(F.col("p95") > threshold_ms).select((F.unix_seconds("minute") / 60).cast("long").alias("m"))
    votes = slow.select("m", F.explode(F.sequence(F.col("m") - (minutes - 1), F.col("m") + 1)).alias("start"))
    starts = votes.groupBy("start").agg(
        F.count_if(F.col("start") <= F.col("m")).alias("slow_minutes"), F.count_if(F.col("start") > F.col("m")).alias("slow_before")
    )
    fired = starts.where((F.col("slow_minutes") == minutes) & (F.col("slow_before") == 0))
    return fired.select(
        F.lit("query_p95").alias("alert"),
        F.lit("all").alias("subject"),
        F.timestamp_seconds(F.col("start") * 60).alias("since"),
    )


def guardrail_alerts(log: DataFrame) -> DataFrame:
    """Days on which too few answers passed their checks."""
    daily = log.groupBy(F.to_date("asked_at").alias("day")).agg(ratio(F.count_if("guardrail_passed"), F.count("*")).alias("rate"))
    low = daily.where(F.col("rate") < GUARDRAIL_RATE)
    return low.select(F.lit("guardrail_compliance").alias("alert"), F.col("day").cast("string").alias("subject"), F.col("day").cast("timestamp").alias("since"))


def boundary_alerts(requests: DataFrame, citations: DataFrame | None = None) -> DataFrame:
    """Every request from the wrong tenant, and every retrieved row of a foreign tenant, when it was asked for."""
    mismatched = ~F.col("tenant_id").eqNullSafe(F.col("authenticated_tenant_id"))
    alerts = requests.where(mismatched).select(F.lit("cross_tenant").alias("alert"), F.col("question_id").alias("subject"), F.col("asked_at").alias("since"))
    if citations is None:
        return alerts
    found = citations.select("question_id", "chunk_id", F.col("tenant_id").alias("owner"))
    leaked = requests.join(found, "question_id").where(~F.col("owner").eqNullSafe(F.col("authenticated_tenant_id")))
    return alerts.unionByName(leaked.select(F.lit("cross_tenant_leak").alias("alert"), F.col("chunk_id").alias("subject"), F.col("asked_at").alias("since")))
