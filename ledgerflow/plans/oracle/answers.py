"""SQL of the routing, retrieval, guardrail and metric queries."""

from __future__ import annotations

from ledgerflow.plans.oracle import values
from ledgerflow.plans.oracle.base import CTES, DOC_TYPE, codes, has, sql, stamp


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _by_route(values: dict, joined: bool = False) -> str:
    pick = lambda r: _text(",".join(values[r]) if joined else values[r])
    return f"CASE route WHEN 'mixed_guardrail' THEN {pick('mixed_guardrail')} WHEN 'rag' THEN {pick('rag')} ELSE {pick('sql')} END"


def _tokens(x: str, pattern: str = "[a-z0-9]+") -> str:
    return f"list_distinct(regexp_extract_all(lower({x}), '{pattern}'))"


_RULES = {r[0]: r for r in values.GUARDRAIL_RULES}
_TOOL, _OTHERS = ("tool_routing",), ("tool_routing", "retrieval_grounding", "response_guardrail")
_points = lambda ids: ",".join(p for i in ids for p in _RULES[i][3])

CTES.update(
    {
        "questions": (
            (),
            """
        SELECT 'q_' || c_custkey AS question_id, 'tenant_' || c_nationkey % 20 AS tenant_id,
               'tenant_' || (c_nationkey % 20 + CASE WHEN c_custkey % 97 = 0 THEN 1 ELSE 0 END) AS authenticated_tenant_id,
               CASE c_custkey % 4 WHEN 0 THEN 'What is the outstanding balance for ' || c_name || '?'
                    WHEN 1 THEN 'What does the deferred revenue policy say about ' || c_name || '?'
                    WHEN 2 THEN 'What does the OCR workpaper say about ' || c_name || ' and what exact amount is overdue?'
                    ELSE 'Hello from ' || c_name || ', how are you?' END AS question,
               CASE WHEN c_custkey % 4 = 1 OR c_custkey % 50 = 0 THEN 'rag' WHEN c_custkey % 4 = 2 THEN 'mixed_guardrail' ELSE 'sql' END AS expected_route,
               TIMESTAMP '2024-01-01' + (c_custkey % 30) * INTERVAL 1 DAY AS asked_at
        FROM customer""",
        ),
        "routed": (
            ("questions",),
            f"""
        SELECT *, {_by_route(values.SKILLS)} AS skill FROM (
            SELECT *, CASE WHEN {has('question', values.SQL_TERMS)} AND {has('question', values.PRECISION_DOC_TERMS)} THEN 'mixed_guardrail'
                           WHEN NOT {has('question', values.SQL_TERMS)} AND {has('question', values.RAG_TERMS)} THEN 'rag' ELSE 'sql' END AS route
            FROM questions)""",
        ),
        "cases": (
            ("docs",),
            """
        SELECT 'case_' || k AS question_id, k, tenant_id, title AS question, document_id AS expected
        FROM docs WHERE retention_state = 'active'""",
        ),
        "indexed": (
            ("chunks",),
            f"SELECT *, {_tokens('text')} AS tokens FROM chunks WHERE retention_state = 'active'",
        ),
        "case_hits": (
            ("cases", "indexed"),
            f"""
        SELECT question_id, tenant_id, chunk_id, document_id, text, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank
        FROM (SELECT q.question_id, q.tenant_id, c.chunk_id, c.document_id, c.text,
                     CASE WHEN len(q.tokens) = 0 THEN 0.0 ELSE CAST(len(list_intersect(q.tokens, c.tokens)) AS DOUBLE) / len(q.tokens) END
                     + CASE {' '.join(f"WHEN c.doc_type = '{t}' AND list_contains(q.tokens, '{w}') THEN {values.CUE_BOOST}::DOUBLE" for t, w in values.CUE_WORDS.items())} ELSE 0.0 END AS score
              FROM (SELECT *, {_tokens('question')} AS tokens FROM cases) q JOIN indexed c ON c.tenant_id = q.tenant_id)
        QUALIFY rank <= 4""",
        ),
        "policy_scores": (
            ("questions", "indexed"),
            f"""
        SELECT q.question_id, q.tenant_id, q.authenticated_tenant_id, c.chunk_id, c.document_id, c.text,
               {values.POLICY_WEIGHT}::DOUBLE * (CAST(len(list_intersect(q.tokens, c.tokens)) AS DOUBLE) / len(q.tokens))
               + CASE {' '.join(f"WHEN c.doc_type = '{t}' AND hint_{t} THEN {values.POLICY_BOOSTS[t]}::DOUBLE" for t in values.HINTS)} ELSE 0.0 END AS score
        FROM (SELECT *, {_tokens('question')} AS tokens, {', '.join(f"{has('question', w)} AS hint_{t}" for t, w in values.HINTS.items())} FROM questions) q
        JOIN indexed c ON c.tenant_id = q.tenant_id""",
        ),
        "policy_hits": (
            ("policy_scores",),
            """
        SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM policy_scores QUALIFY rank <= 4""",
        ),
        "cited": (
            ("docs", "questions"),
            "SELECT 'q_' || k AS question_id, document_id AS chunk_id, tenant_id FROM docs WHERE 'q_' || k IN (SELECT question_id FROM questions)",
        ),
        "vector_index": (
            (),
            f"""
        SELECT 'tenant_' || label AS tenant_id, 'vec_' || vec_id AS chunk_id, vec_id AS k, {DOC_TYPE.format(k='vec_id')} AS doc_type,
               CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings""",
        ),
        "hybrid_index": (
            ("docs",),
            """
        SELECT d.tenant_id, d.document_id AS chunk_id, d.k, d.title, d.text, CAST(e.embedding AS DOUBLE[]) AS embedding,
               regexp_extract_all(lower(d.text), '[\\p{L}\\p{N}]+') AS words
        FROM docs d LEFT JOIN embeddings e ON e.vec_id = d.k WHERE d.retention_state = 'active'""",
        ),
        "log": (
            (),
            """
        SELECT *, ((((((1.0::DOUBLE + 2.0) + coalesce(sql_ms, 0)) + coalesce(rag_ms, 0)) + synth_ms) + 0.5) + 0.25) AS latency_ms FROM (
            SELECT 'e_' || event_id AS question_id, event_id AS k, 'tenant_' || user_id % 25 AS tenant_id, route, ts AS asked_at,
                   CASE WHEN route <> 'rag' THEN value * 2 END AS sql_ms, CASE WHEN route <> 'sql' THEN value END AS rag_ms, value * 5 AS synth_ms,
                   CASE WHEN route <> 'sql' THEN n % 5 ELSE 0 END AS citation_count, CASE WHEN route <> 'rag' THEN 1 ELSE 0 END AS sql_row_count,
                   event_type <> 'error' AS guardrail_passed,
                   CASE WHEN event_id % 97 = 0 THEN 'failed' WHEN event_id % 89 = 0 THEN 'client_error' ELSE 'ok' END AS outcome, CASE WHEN route <> 'sql' THEN 4.0::DOUBLE END AS chunks_returned,
                   CASE WHEN route <> 'sql' THEN CAST(n % 5 AS DOUBLE) END AS chunks_kept,
                   CASE WHEN route <> 'sql' THEN n / 100.0::DOUBLE END AS top_hit_score, CASE WHEN route <> 'sql' THEN n * 80.0::DOUBLE / 8000.0 END AS budget_share
            FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS n,
                         CASE WHEN event_type IN ('click', 'signup') THEN 'sql' WHEN event_type = 'purchase' THEN 'mixed_guardrail' ELSE 'rag' END AS route
                  FROM events))""",
        ),
        "runs": (
            (),
            """
        SELECT 'run_' || event_id AS run_id, event_type AS stage, ts AS emitted_at, floor(value * 5) AS bronze_lag,
               floor(value * 8) - floor(value * 5) AS silver_lag, floor(value * 16) - floor(value * 8) AS gold_lag,
               n + 100 AS records_in, n + 100 - n % 4 AS records_out, n % 4 AS quarantined, value * 10 AS duration_ms, event_id % 200 <> 0 AS succeeded, event_id % 400 <> 0 AS completed
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS n FROM events)""",
        ),
    }
)


def _p(column: str, share: float, by: str, source: str = "log") -> str:
    """Nearest-rank percentile per group."""
    return f"""SELECT {by} AS grp, {column} AS v FROM {source} WHERE {column} IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY {column}) = CAST(round_even((count(*) OVER (PARTITION BY {by}) - 1) * {share}::DOUBLE, 0) AS BIGINT) + 1"""


_K1, _B = values.BM25_K1, values.BM25_B
_HYBRID = {
    "terms": "SELECT 'case_' || k AS question_id, tenant_id, unnest(ts) AS term, len(ts) AS n_terms FROM (SELECT *, list_distinct(regexp_extract_all(lower(title), '[\\p{L}\\p{N}]+')) AS ts FROM hybrid_index)",
    "stats": "SELECT tenant_id, count(*) AS n, avg(len(words)) AS mean_length FROM hybrid_index GROUP BY ALL",
    "postings": "SELECT tenant_id, chunk_id, dl, term, count(*) AS tf FROM (SELECT tenant_id, chunk_id, len(words) AS dl, unnest(words) AS term FROM hybrid_index) GROUP BY ALL",
    "freq": "SELECT tenant_id, term, count(*) AS df FROM postings GROUP BY ALL",
    "lexical": f"""SELECT t.question_id, t.tenant_id, p.chunk_id,
            sum(ln(1 + (s.n - f.df + 0.5::DOUBLE) / (f.df + 0.5::DOUBLE)) * p.tf * {_K1 + 1}::DOUBLE / (p.tf + {_K1}::DOUBLE * (1 - {_B}::DOUBLE + {_B}::DOUBLE * p.dl / s.mean_length))) AS bm25
        FROM terms t JOIN postings p ON p.tenant_id = t.tenant_id AND p.term = t.term JOIN freq f ON f.tenant_id = t.tenant_id AND f.term = t.term
        JOIN stats s ON s.tenant_id = t.tenant_id GROUP BY t.question_id, t.tenant_id, p.chunk_id, t.n_terms HAVING count(*) = t.n_terms""",
    "near": """SELECT 'case_' || q.k AS question_id, q.tenant_id, c.chunk_id, (1 + round(list_cosine_similarity(q.embedding, c.embedding), 9)) / 2 AS nearness
        FROM hybrid_index q JOIN hybrid_index c ON c.tenant_id = q.tenant_id WHERE q.embedding IS NOT NULL AND c.embedding IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY q.k ORDER BY round(list_cosine_similarity(q.embedding, c.embedding), 9) DESC, c.chunk_id) <= 4""",
}
_BUDGET = "sum(length(text)) OVER (PARTITION BY question_id ORDER BY rank ROWS UNBOUNDED PRECEDING)"

_STEPS = {
    "ValidateTenantLatencyMs": "1.0::DOUBLE", "RouteLatencyMs": "2.0::DOUBLE", "SqlRetrievalLatencyMs": "sql_ms",
    "RagRetrievalLatencyMs": "rag_ms", "SynthesisLatencyMs": "synth_ms", "GuardrailLatencyMs": "0.5::DOUBLE",
}
_METRICS = {
    "QueryLatencyMs": "latency_ms", "CitationCount": "citation_count", "SqlRowCount": "sql_row_count", "GuardrailPassed": "guardrail_passed",
    **_STEPS, "RetrievedChunks": "chunks_returned", "RetrievedChunksKept": "chunks_kept", "TopHitScore": "top_hit_score",
    "ContextBudgetUsedPct": "budget_share",
}
_DENSE = {
    "dense": """SELECT TIMESTAMP '2024-06-01' + k * 2 * INTERVAL 1 SECOND AS asked_at,
        ((((((1.0::DOUBLE + 2.0) + coalesce(sql_ms, 0)) + coalesce(rag_ms, 0)) + synth_ms + CASE WHEN k % 1800 < 300 THEN 5000 ELSE 0 END) + 0.5) + 0.25) AS latency_ms FROM log"""
}
_SLOW_STRETCHES = f"""SELECT 'query_p95' AS alert, 'all' AS subject, {stamp('min(m)', 'since')} FROM (
    SELECT m, m - row_number() OVER (ORDER BY m) * INTERVAL 1 MINUTE AS island FROM (
        SELECT DISTINCT grp AS m FROM ({_p('latency_ms', 0.95, "date_trunc('minute', asked_at)", 'dense')}) WHERE v > 3000) WHERE {{closed}})
    GROUP BY island HAVING count(*) >= 5"""
_DECLARED = codes(
    *[(f"{n}:{values.LATENCY_UNIT if n.endswith('Ms') else values.COUNT_UNIT}", f"({e}) IS NOT NULL") for n, e in _METRICS.items()]
)

_PAYLOAD = """
    SELECT question_id, CASE route WHEN 'sql' THEN 'exact_accounting_sql' WHEN 'rag' THEN 'tenant_safe_policy_rag' ELSE 'precision_guardrail' END AS skill,
           k % 7 <> 0 AS answer, k % 5 <> 0 AS sql, sql_row_count > 0 AS records, k % 3 <> 0 AS warnings,
           k % 13 <> 0 AND citation_count > 0 AS citations, true AS route, true AS guardrail_context, k % 2 = 0 AS expected_pass FROM log"""
_MISSING = "CASE skill " + " ".join(
    f"WHEN '{s}' THEN {codes(*[(f, f'NOT {f}') for f in fields])}" for s, fields in values.CONTRACTS.items()
) + " END"

_CHECKS = f"""
    SELECT question_id AS case_id, 'tenant_boundary' AS "check", CAST(substr(question_id, 3) AS BIGINT) % 97 <> 0 AS expected_pass,
           tenant_id = authenticated_tenant_id AS actual_pass FROM questions
    UNION ALL SELECT question_id, 'citation_minimum', route = 'sql' OR citation_count > 0, citation_count >= CASE WHEN route = 'sql' THEN 0 ELSE 1 END FROM log
    UNION ALL SELECT question_id, 'exact_from_sql', route <> 'mixed_guardrail' OR k % 11 <> 0, route <> 'mixed_guardrail' OR sql_row_count > 0 FROM log
    UNION ALL SELECT question_id, 'contract', expected_pass, {_MISSING} = '' FROM payload
    UNION ALL SELECT question_id, 'context_budget', true, true FROM log"""

_ANSWER_HITS = f"""
    SELECT question_id, chunk_id, text, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM (
        SELECT q.question_id, c.chunk_id, c.text, CAST(len(list_intersect(q.tokens, c.tokens)) AS DOUBLE) / len(q.tokens)
               + CASE {' '.join(f"WHEN c.doc_type = '{t}' AND list_contains(q.tokens, '{w}') THEN {values.CUE_BOOST}::DOUBLE" for t, w in values.CUE_WORDS.items())} ELSE 0.0 END AS score
        FROM (SELECT *, {_tokens('question')} AS tokens FROM routed WHERE route <> 'sql' AND tenant_id = authenticated_tenant_id) q
        JOIN indexed c ON c.tenant_id = q.tenant_id)
    QUALIFY rank <= 4"""

_DAILY = """
    SELECT CAST(CAST(emitted_at AS DATE) AS VARCHAR) AS day, max(bronze_lag) AS bronze_lag_seconds, max(silver_lag) AS silver_freshness_seconds,
           max(gold_lag) AS gold_freshness_seconds, avg(succeeded::INTEGER) AS success_rate,
           sum(records_out) / sum(records_in) AS quality_pass_rate, sum(quarantined) / sum(records_in) AS quarantine_rate,
           avg(completed::INTEGER) AS pipeline_uptime
    FROM runs GROUP BY ALL"""
_LOG_DAY = "CAST(CAST(asked_at AS DATE) AS VARCHAR)"
_MET = "CASE metric " + " ".join(f"WHEN '{m}' THEN value {c} {t}" for m, (c, t) in values.OBJECTIVES.items()) + " END"
_DATA_METRICS = ("bronze_lag_seconds", "silver_freshness_seconds", "gold_freshness_seconds", "success_rate", "quality_pass_rate", "quarantine_rate", "pipeline_uptime")
_LATENCIES = (
    ("query_p50_ms", "latency_ms", 0.5), ("query_p95_ms", "latency_ms", 0.95), ("retrieval_p95_ms", "rag_ms", 0.95),
    ("sql_retrieval_p95_ms", "sql_ms", 0.95), ("synthesis_p95_ms", "synth_ms", 0.95),
)

ORACLE = {
    "route_questions": sql(
        f"""SELECT question_id, route, skill, {_by_route(values.REASONS)} AS reason, {_by_route(values.RULES_FIRED, True)} AS rules_fired FROM routed""",
        "routed",
    ),
    "route_terms": sql(
        "SELECT question_id, "
        + ", ".join(
            f"{codes(*[(t, has('question', [t])) for t in terms])} AS {name}"
            for name, terms in (
                ("sql_hits", values.SQL_TERMS), ("rag_hits", values.RAG_TERMS), ("precision_doc_hits", values.PRECISION_DOC_TERMS),
            )
        )
        + " FROM questions",
        "questions",
    ),
    "guardrail_context": sql(
        f"""SELECT question_id, route, CASE WHEN route = 'sql' THEN '{",".join(_TOOL)}' ELSE '{",".join(_OTHERS)}' END AS rule_ids,
        CASE WHEN route = 'sql' THEN '{_points(_TOOL)}' ELSE '{_points(_OTHERS)}' END AS enforcement_points FROM routed""",
        "routed",
    ),
    "eval_routing": sql(
        """SELECT coalesce(expected_route, 'all') AS expected_route, count(*) AS total, count(*) FILTER (route = expected_route) AS correct,
        round(count(*) FILTER (route = expected_route) / count(*), 6) AS accuracy FROM routed GROUP BY ROLLUP (expected_route)""",
        "routed",
    ),
    "eval_routing_misses": sql(
        "SELECT question_id, question, expected_route, route, skill FROM routed WHERE route <> expected_route", "routed"
    ),
    "tenant_violations": sql(
        "SELECT question_id, tenant_id, authenticated_tenant_id FROM questions WHERE tenant_id <> authenticated_tenant_id", "questions"
    ),
    "retrieve_lexical": sql(
        "SELECT question_id, tenant_id, chunk_id, round_even(score, 4) AS score, rank FROM case_hits", "case_hits"
    ),
    "retrieve_policy_ranked": sql(
        "SELECT question_id, tenant_id, chunk_id, round_even(score, 4) AS score, rank FROM policy_hits", "policy_hits"
    ),
    "retrieve_vector": sql(
        """SELECT question_id, tenant_id, chunk_id, round(s, 6) AS similarity, row_number() OVER (PARTITION BY question_id ORDER BY s DESC, chunk_id) AS rank
        FROM (SELECT 'vq_' || q.k AS question_id, q.tenant_id, c.chunk_id, round(list_cosine_similarity(q.embedding, c.embedding), 9) AS s
              FROM vector_index q JOIN vector_index c ON c.tenant_id = q.tenant_id AND (q.k % 3 <> 0 OR c.doc_type = q.doc_type) WHERE c.k % 10 <> 0)
        QUALIFY rank <= 4""",
        "vector_index",
    ),
    "retrieve_hybrid": sql(
        """SELECT question_id, tenant_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank
        FROM (SELECT coalesce(l.question_id, v.question_id) AS question_id, coalesce(l.tenant_id, v.tenant_id) AS tenant_id,
                     coalesce(l.chunk_id, v.chunk_id) AS chunk_id, round(coalesce(bm25, 0) + coalesce(nearness, 0), 9) AS score
              FROM lexical l FULL JOIN near v ON v.question_id = l.question_id AND v.chunk_id = l.chunk_id)
        QUALIFY rank <= 4""",
        "hybrid_index", extra=_HYBRID,
    ),
    "index_statistics": sql(
        """SELECT tenant_id, term, holders, row_count, word_count FROM (SELECT tenant_id, term, count(*) AS holders FROM (
            SELECT tenant_id, unnest(list_distinct(words)) AS term FROM kept) GROUP BY ALL)
        JOIN (SELECT tenant_id, count(*) AS row_count, CAST(sum(len(words)) AS BIGINT) AS word_count FROM kept GROUP BY ALL) USING (tenant_id)""",
        "docs",
        extra={
            # The newest of a document's changes: a state given anew (with its text as it was), a title for a text or a deletion, or the first state.
            "kept": """SELECT tenant_id, regexp_extract_all(lower(CASE WHEN k % 9 <> 4 AND k % 7 = 2 THEN title ELSE text END), '[\\p{L}\\p{N}]+') AS words FROM docs
                WHERE CASE WHEN k % 9 = 4 THEN k % 2 <> 0 WHEN k % 7 = 2 AND k % 4 = 1 THEN false ELSE retention_state = 'active' END""",
        },
    ),
    "eval_retrieval": sql(
        """SELECT count(*) AS cases, round_even(avg((r IS NOT NULL)::INTEGER), 2) AS hit_rate, round_even(avg(coalesce(1.0::DOUBLE / r, 0.0)), 2) AS mrr,
        round_even(avg((c.k % 41 <> 0)::INTEGER), 2) AS tenant_isolation_pass_rate, round_even(avg((c.k % 43 <> 0)::INTEGER), 2) AS retention_filter_pass_rate
        FROM (SELECT c.question_id, c.k, min(CASE WHEN h.document_id = c.expected THEN rank END) AS r FROM cases c
              LEFT JOIN case_hits h ON h.question_id = c.question_id GROUP BY ALL) c""",
        "case_hits",
    ),
    "eval_retrieval_cases": sql(
        """SELECT question_id, r IS NOT NULL AS hit, round_even(coalesce(1.0::DOUBLE / r, 0.0), 4) AS reciprocal_rank, c.k % 41 <> 0 AS tenant_isolated,
        c.k % 43 <> 0 AS retention_safe
        FROM (SELECT c.question_id, c.k, min(CASE WHEN h.document_id = c.expected THEN rank END) AS r FROM cases c
              LEFT JOIN case_hits h ON h.question_id = c.question_id GROUP BY ALL) c""",
        "case_hits",
    ),
    "cross_tenant_leaks": sql(
        """SELECT question_id, chunk_id, tenant_id, authenticated_tenant_id AS request_tenant_id FROM policy_hits
        WHERE tenant_id <> authenticated_tenant_id""",
        "policy_hits",
    ),
    "context_budget": sql(
        f"SELECT question_id, chunk_id, rank, CAST({_BUDGET} AS BIGINT) AS chars_used FROM case_hits QUALIFY {_BUDGET} <= 900", "case_hits"
    ),
    "retrieval_summary": sql(
        """SELECT c.question_id, CAST(count(h.chunk_id) AS DOUBLE) AS chunks_returned, CAST(count(*) FILTER (used <= 900) AS DOUBLE) AS chunks_kept,
        900.0::DOUBLE AS chunk_budget_chars, CAST(coalesce(max(used) FILTER (used <= 900), 0) AS DOUBLE) AS budget_used_chars,
        round(coalesce(max(score), 0.0), 6) AS top_hit_score
        FROM cases c LEFT JOIN used h ON h.question_id = c.question_id GROUP BY ALL""",
        "case_hits", extra={"used": f"SELECT *, {_BUDGET} AS used FROM case_hits"},
    ),
    "context_policy": sql(
        f"""SELECT question_id, document_id, chunk_id, rank, CAST({_BUDGET} AS BIGINT) AS chars_used FROM top
        QUALIFY {_BUDGET} <= 8000""",
        "policy_scores",
        extra={
            "best": "SELECT * FROM policy_scores QUALIFY row_number() OVER (PARTITION BY question_id, document_id ORDER BY score DESC, chunk_id) = 1",
            "top": "SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM best QUALIFY rank <= 4",
        },
    ),
    "guardrail_checks": sql(
        """SELECT question_id, route, citation_count >= CASE WHEN route = 'sql' THEN 0 ELSE 1 END AS citation_ok,
        route <> 'mixed_guardrail' OR sql_row_count > 0 AS exact_from_sql_ok,
        citation_count >= CASE WHEN route = 'sql' THEN 0 ELSE 1 END AND (route <> 'mixed_guardrail' OR sql_row_count > 0) AS guardrail_passed FROM log""",
        "log",
    ),
    "answer_contracts": sql(
        f"SELECT question_id, skill, {_MISSING} AS missing_fields, {_MISSING} = '' AS complies FROM payload", "log", extra={"payload": _PAYLOAD}
    ),
    "eval_guardrails": sql(
        f"""SELECT skill, count(*) AS total, count(*) FILTER (({_MISSING} = '') = expected_pass) AS correct,
        round(count(*) FILTER (({_MISSING} = '') = expected_pass) / count(*), 6) AS compliance_rate FROM payload GROUP BY ALL""",
        "log", extra={"payload": _PAYLOAD},
    ),
    "answer_questions": sql(
        f"""SELECT question_id, tenant_id, 'answered' AS status, route, skill, total_overdue_amount, overdue_invoice_count, sql_row_count,
        chunks_returned, chunks_kept, chunk_budget_chars, budget_used_chars, top_hit_score, citations, citation_count,
        concat_ws(',', CASE WHEN route = 'mixed_guardrail' THEN {_text(values.WARNING)} END,
                  CASE WHEN route <> 'sql' AND citation_count = 0 THEN {_text(values.NO_GROUNDING)} END) AS warnings,
        route = 'sql' OR citation_count >= 1 AS citation_ok, route <> 'mixed_guardrail' OR sql_row_count > 0 AS exact_from_sql_ok,
        (route = 'sql' OR citation_count >= 1) AND (route <> 'mixed_guardrail' OR sql_row_count > 0) AS guardrail_passed
        FROM (SELECT r.question_id, r.tenant_id, route, skill, CASE WHEN route <> 'rag' THEN amount END AS total_overdue_amount,
                     CASE WHEN route <> 'rag' THEN n END AS overdue_invoice_count,
                     CAST(CASE WHEN route <> 'rag' AND amount IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS sql_row_count,
                     CASE WHEN route <> 'sql' THEN coalesce(returned, 0) END AS chunks_returned, CASE WHEN route <> 'sql' THEN coalesce(kept, 0) END AS chunks_kept,
                     CASE WHEN route <> 'sql' THEN 1500.0::DOUBLE END AS chunk_budget_chars,
                     CASE WHEN route <> 'sql' THEN coalesce(used_chars, 0) END AS budget_used_chars,
                     CASE WHEN route <> 'sql' THEN round(coalesce(top, 0.0), 6) END AS top_hit_score,
                     coalesce(cited, '') AS citations, CAST(coalesce(kept, 0) AS BIGINT) AS citation_count
              FROM routed r LEFT JOIN exact e ON e.tenant_id = r.tenant_id LEFT JOIN found f ON f.question_id = r.question_id
              WHERE r.tenant_id = r.authenticated_tenant_id)
        UNION ALL
        SELECT question_id, tenant_id, 'tenant_violation', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, false
        FROM questions WHERE tenant_id <> authenticated_tenant_id""",
        "routed", "gold", "indexed",
        extra={
            "exact": "SELECT tenant_id, round(sum(invoice_amount), 2) AS amount, count(*) AS n FROM gold WHERE is_overdue GROUP BY ALL",
            "hits": _ANSWER_HITS,
            "budgeted": f"SELECT *, {_BUDGET} AS used FROM hits",
            "found": """SELECT question_id, CAST(count(*) AS DOUBLE) AS returned, CAST(count(*) FILTER (used <= 1500) AS DOUBLE) AS kept,
                CAST(max(used) FILTER (used <= 1500) AS DOUBLE) AS used_chars, max(score) AS top,
                string_agg(chunk_id, ',' ORDER BY rank) FILTER (used <= 1500) AS cited FROM budgeted GROUP BY ALL""",
        },
    ),
    "query_metrics": sql(
        "SELECT question_id, tenant_id, route, " + ", ".join(f"round(CAST({e} AS DOUBLE), 6) AS \"{n}\"" for n, e in _METRICS.items()) + " FROM log",
        "log",
    ),
    "stage_metrics": sql(
        """SELECT run_id, stage, CAST(records_in AS DOUBLE) AS "RecordsIn", CAST(records_out AS DOUBLE) AS "RecordsOut",
        CAST(quarantined AS DOUBLE) AS "Quarantined", round(duration_ms, 6) AS "StageDurationMs" FROM runs""",
        "runs",
    ),
    "metrics_export": sql(
        f"""SELECT tenant_id, route, round(latency_ms, 6) AS latency_ms, top_hit_score AS "TopHitScore", 'ledgerflow' AS namespace,
        {_DECLARED} AS declared, CAST(epoch(TIMESTAMP '2024-06-01 00:00:00') AS BIGINT) AS "at" FROM log""",
        "log",
    ),
    "trace_scores": sql(
        """SELECT question_id, name, round(score, 6) AS score FROM (
        SELECT question_id, 'citation_coverage' AS name, CAST(citation_count > 0 AS DOUBLE) AS score FROM log
        UNION ALL SELECT question_id, 'citation_count', citation_count FROM log
        UNION ALL SELECT question_id, 'guardrail_passed', CAST(guardrail_passed AS DOUBLE) FROM log
        UNION ALL SELECT question_id, 'top_hit_score', top_hit_score FROM log WHERE route <> 'sql'
        UNION ALL SELECT question_id, 'budget_utilization', budget_share FROM log WHERE route <> 'sql'
        UNION ALL SELECT question_id, 'retrieved_chunk_count', chunks_returned FROM log WHERE route <> 'sql'
        UNION ALL SELECT question_id, 'kept_chunk_count', chunks_kept FROM log WHERE route <> 'sql'
        UNION ALL SELECT question_id, 'sql_row_count', sql_row_count FROM log WHERE sql_row_count > 0)""",
        "log",
    ),
    "step_spans": sql(
        " UNION ALL ".join(
            f"SELECT question_id, '{step}' AS step, round_even(CAST({e} AS DOUBLE), 2) AS duration_ms FROM log WHERE ({e}) IS NOT NULL"
            for step, e in [*((s, _STEPS[m]) for s, m in values.STEP_METRICS.items()), ("cache_lookup", "0.25::DOUBLE")]
        ),
        "log",
    ),
    "latency_summary": sql(
        f"""SELECT g.route, questions, round_even(mean, 4) AS mean_latency_ms, round_even(p.v, 4) AS p95_latency_ms
        FROM (SELECT route, count(*) AS questions, avg(latency_ms) AS mean FROM named GROUP BY ALL) g
        JOIN (SELECT DISTINCT * FROM ({_p('latency_ms', 0.95, 'route', 'named')})) p ON p.grp = g.route""",
        "log", extra={"named": "SELECT route, latency_ms FROM log UNION ALL SELECT 'all', latency_ms FROM log"},
    ),
    "token_usage": """SELECT 'tenant_' || conv_id % 25 AS tenant_id, count(*) AS answers,
        CAST(sum(CASE WHEN role IN ('user', 'assistant') THEN length(text) ELSE 0 END) AS BIGINT) AS input_tokens,
        CAST(sum(CASE WHEN role IN ('user', 'assistant') THEN turn ELSE 0 END) AS BIGINT) AS output_tokens,
        CAST(sum(CASE WHEN role IN ('user', 'assistant') THEN length(text) + turn ELSE 0 END) AS BIGINT) AS total_tokens
        FROM conversations GROUP BY ALL""",
    "slo_report": sql(
        f"""SELECT day, metric, round(value, 6) AS value, {_MET} AS met FROM measured""",
        "log", "runs", "routed", "cited",
        extra={
            "daily": _DAILY,
            "isolation": f"""SELECT {_LOG_DAY} AS day, count(owner) FILTER (owner <> authenticated_tenant_id) AS cross_tenant_leaks,
                count(DISTINCT question_id) FILTER (tenant_id <> authenticated_tenant_id AND owner IS NOT NULL) AS tenant_boundary_violations
                FROM (SELECT q.*, h.tenant_id AS owner FROM questions q LEFT JOIN cited h USING (question_id)) GROUP BY ALL""",
            "measured": " UNION ALL ".join(
                [f"SELECT day, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM daily" for m in _DATA_METRICS]
                + [
                    f"""SELECT {_LOG_DAY}, 'guardrail_compliance_rate', avg(guardrail_passed::INTEGER) FROM log GROUP BY ALL""",
                    f"""SELECT {_LOG_DAY}, 'citation_coverage', count(*) FILTER (route <> 'sql' AND citation_count > 0) / count(*) FILTER (route <> 'sql')
                    FROM log GROUP BY ALL""",
                ]
                + [f"SELECT {_LOG_DAY}, 'endpoint_uptime', count(*) FILTER (outcome = 'ok') / count(*) FILTER (outcome <> 'client_error') FROM log GROUP BY ALL"]
                + [f"SELECT {_LOG_DAY}, 'routing_accuracy', avg((route = expected_route)::INTEGER) FROM routed GROUP BY ALL"]
                + [f"SELECT day, '{m}', CAST({m} AS DOUBLE) FROM isolation" for m in ("cross_tenant_leaks", "tenant_boundary_violations")]
                + [f"SELECT DISTINCT grp, '{m}', v FROM ({_p(c, s, _LOG_DAY)})" for m, c, s in _LATENCIES]
            ),
        },
    ),
    "slo_alerts": sql(
        f"""SELECT alert, subject, {stamp('since')} FROM (
        SELECT CASE WHEN bronze_lag > 1800 THEN 'bronze_lag_critical' ELSE 'bronze_lag_warning' END AS alert, run_id AS subject, emitted_at AS since
        FROM runs WHERE bronze_lag > 900
        UNION ALL SELECT 'gold_freshness', run_id, emitted_at FROM runs WHERE gold_lag > 2700
        UNION ALL SELECT 'quarantine_rate', run_id, emitted_at FROM runs WHERE quarantined / records_in > 0.02
        UNION ALL SELECT 'guardrail_compliance', d, CAST(d AS TIMESTAMP) FROM (
            SELECT {_LOG_DAY} AS d, avg(guardrail_passed::INTEGER) AS rate FROM log GROUP BY ALL) WHERE rate < 0.99
        UNION ALL SELECT 'cross_tenant', question_id, asked_at FROM questions WHERE tenant_id <> authenticated_tenant_id
        UNION ALL SELECT 'cross_tenant_leak', chunk_id, asked_at FROM cited h JOIN questions q USING (question_id)
            WHERE h.tenant_id <> q.authenticated_tenant_id
        UNION ALL SELECT 'query_p95', 'all', min(m) FROM (
            SELECT m, m - row_number() OVER (ORDER BY m) * INTERVAL 1 MINUTE AS island FROM (SELECT DISTINCT grp AS m FROM ({_p('latency_ms', 0.95, "date_trunc('minute', asked_at)")}) WHERE v > 1500))
            GROUP BY island HAVING count(*) >= 2)""",
        "log", "runs", "questions", "cited",
    ),
    "latency_alerts": sql(_SLOW_STRETCHES.format(closed="true"), "log", extra=_DENSE),
    # Minutes that end half an hour before the newest row, as the watermark closes them.
    "stream_latency_alerts": sql(
        _SLOW_STRETCHES.format(closed="m + INTERVAL 1 MINUTE <= (SELECT max(asked_at) - INTERVAL 30 MINUTE FROM dense)"), "log", extra=_DENSE
    ),
    "context_budget_declared": sql(
        f"SELECT question_id, chunk_id, rank, CAST({_BUDGET} AS BIGINT) AS chars_used FROM many_hits QUALIFY {_BUDGET} <= 8000",
        "case_hits", extra={"many_hits": CTES["case_hits"][1].replace("rank <= 4", "rank <= 40")},
    ),
    "eval_guardrail_checks": sql(
        """SELECT "check", count(*) AS total, count(*) FILTER (actual_pass = expected_pass) AS correct,
        round(count(*) FILTER (actual_pass = expected_pass) / count(*), 6) AS compliance_rate FROM checks GROUP BY ALL""",
        "log", "questions", extra={"payload": _PAYLOAD, "checks": _CHECKS},
    ),
    "eval_guardrail_failures": sql(
        "SELECT * FROM checks WHERE actual_pass <> expected_pass", "log", "questions", extra={"payload": _PAYLOAD, "checks": _CHECKS}
    ),
    "pipeline_metrics": sql(
        """SELECT 'bronze_to_silver_1' AS run_id, 'bronze_to_silver_invoice_validation' AS stage, CAST(count(*) AS DOUBLE) AS "RecordsIn",
        CAST(count(*) FILTER (quality_errors = '') AS DOUBLE) AS "RecordsOut", CAST(count(*) FILTER (quality_errors <> '') AS DOUBLE) AS "Quarantined",
        0.0::DOUBLE AS "StageDurationMs" FROM validated""",
        "validated",
    ),
}
