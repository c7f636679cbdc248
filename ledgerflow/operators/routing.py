"""Question tables -> route, skill, reason and governing rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.functions import text as tx

# The terms that mark exact-value, narrative and document questions.
SQL_TERMS = (
    "invoice", "invoices", "overdue", "amount", "total", "sum", "count", "control", "controls", "status", "exception",
    "exceptions", "balance", "balances",
)
RAG_TERMS = (
    "policy", "policies", "workpaper", "note", "notes", "explain", "why", "say", "guidance", "revenue recognition",
    "deferred revenue", "issue summary",
)
PRECISION_DOC_TERMS = ("table", "ocr", "document", "policy", "workpaper")

# The outcome of each route.
SKILLS = {"sql": "exact_accounting_sql", "rag": "tenant_safe_policy_rag", "mixed_guardrail": "precision_guardrail"}
REASONS = {
    "sql": "The question requests exact operational or financial data available in gold tables.",
    "rag": "The question asks for narrative or policy context better served by tenant-scoped retrieval.",
    "mixed_guardrail": (
        "The question mixes exact-value intent with document-oriented cues; SQL must own precise answers."
    ),
}
RULES_FIRED = {
    "sql": ("structured_terms_detected", "sql_skill_selected"),
    "rag": ("narrative_terms_detected", "rag_skill_selected"),
    "mixed_guardrail": (
        "exact_value_terms_detected", "document_context_terms_detected", "precision_guardrail_required",
    ),
}

# Rule id, routes, skills (none = all) and where the rule is enforced.
GUARDRAIL_RULES = (
    ("tool_routing", ("sql", "rag", "mixed_guardrail"), (), ("route_selection", "skill_binding", "structured_truth_priority")),
    (
        "retrieval_grounding", ("rag", "mixed_guardrail"), ("tenant_safe_policy_rag", "precision_guardrail"),
        ("tenant_filtering", "retention_filtering", "citation_requirement"),
    ),
    (
        "response_guardrail", ("rag", "mixed_guardrail"), ("tenant_safe_policy_rag", "precision_guardrail"),
        ("warning_injection", "exactness_protection", "insufficient_grounding_handling"),
    ),
)


def _strings(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _by_route(route: Column, values: dict) -> Column:
    pick = lambda v: _strings(v) if isinstance(v, tuple) else F.lit(v)
    return F.when(route == "mixed_guardrail", pick(values["mixed_guardrail"])).when(route == "rag", pick(values["rag"])).when(route == "sql", pick(values["sql"]))


def route_of(question: Column) -> Column:
    """Exact values with document cues are mixed; narrative alone is rag; everything else is sql."""
    exact = tx.has_phrase(question, SQL_TERMS)
    return (
        F.when(exact & tx.has_phrase(question, PRECISION_DOC_TERMS), "mixed_guardrail")
        .when(~exact & tx.has_phrase(question, RAG_TERMS), "rag")
        .otherwise("sql")
    )


def route_questions(questions: DataFrame, question: str = "question") -> DataFrame:
    routed = questions.withColumn("route", route_of(F.col(question)))
    route = F.col("route")
    return routed.withColumns(
        {
            "skill": _by_route(route, SKILLS),
            "reason": _by_route(route, REASONS),
            "rules_fired": _by_route(route, RULES_FIRED),
        }
    )


def matched_terms(questions: DataFrame, question: str = "question") -> DataFrame:
    """Which terms of each list a question contains."""
    text = F.col(question)
    return questions.withColumns(
        {
            "sql_hits": tx.matching_phrases(text, SQL_TERMS),
            "rag_hits": tx.matching_phrases(text, RAG_TERMS),
            "precision_doc_hits": tx.matching_phrases(text, PRECISION_DOC_TERMS),
        }
    )


def guardrail_context(routed: DataFrame) -> DataFrame:
    """The rules that govern each question, and every point where they are enforced."""
    rules = F.array(
        *[
            F.struct(
                F.lit(rule_id).alias("rule_id"), _strings(routes).alias("routes"), _strings(skills).alias("skills"),
                _strings(points).alias("points"),
            )
            for rule_id, routes, skills, points in GUARDRAIL_RULES
        ]
    )
    governing = F.filter(
        rules,
        lambda r: F.array_contains(r["routes"], F.col("route"))
        & ((F.size(r["skills"]) == 0) | F.array_contains(r["skills"], F.col("skill"))),
    )
    return routed.withColumns(
        {
            "rule_ids": F.transform(governing, lambda r: r["rule_id"]),
            "enforcement_points": F.flatten(F.transform(governing, lambda r: r["points"])),
        }
    )
