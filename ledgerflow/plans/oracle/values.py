"""What the checks hold the operators to, written out once more: a changed term, threshold or field turns a row red."""

from __future__ import annotations

# The terms, outcomes and rules of routing.
SQL_TERMS = ('invoice', 'invoices', 'overdue', 'amount', 'total', 'sum', 'count', 'control', 'controls', 'status', 'exception', 'exceptions', 'balance',
 'balances')
RAG_TERMS = ('policy', 'policies', 'workpaper', 'note', 'notes', 'explain', 'why', 'say', 'guidance', 'revenue recognition', 'deferred revenue',
 'issue summary')
PRECISION_DOC_TERMS = ('table', 'ocr', 'document', 'policy', 'workpaper')
SKILLS = {'sql': 'exact_accounting_sql', 'rag': 'tenant_safe_policy_rag', 'mixed_guardrail': 'precision_guardrail'}
REASONS = {'sql': 'The question requests exact operational or financial data available in gold tables.',
 'rag': 'The question asks for narrative or policy context better served by tenant-scoped retrieval.',
 'mixed_guardrail': 'The question mixes exact-value intent with document-oriented cues; SQL must own precise answers.'}
RULES_FIRED = {'sql': ('structured_terms_detected', 'sql_skill_selected'),
 'rag': ('narrative_terms_detected', 'rag_skill_selected'),
 'mixed_guardrail': ('exact_value_terms_detected', 'document_context_terms_detected', 'precision_guardrail_required')}
GUARDRAIL_RULES = (('tool_routing', ('sql', 'rag', 'mixed_guardrail'), (), ('route_selection', 'skill_binding', 'structured_truth_priority')),
 ('retrieval_grounding', ('rag', 'mixed_guardrail'), ('tenant_safe_policy_rag', 'precision_guardrail'),
  ('tenant_filtering', 'retention_filtering', 'citation_requirement')),
 ('response_guardrail', ('rag', 'mixed_guardrail'), ('tenant_safe_policy_rag', 'precision_guardrail'),
  ('warning_injection', 'exactness_protection', 'insufficient_grounding_handling')))

# The words, weights and boosts of ranking.
CUE_WORDS = {'policy': 'policy', 'workpaper': 'workpaper', 'engagement_note': 'note', 'issue_summary': 'issue'}
CUE_BOOST = 0.2
HINTS = {'policy': ('policy', 'policies'),
 'workpaper': ('workpaper', 'ocr', 'table'),
 'engagement_note': ('note', 'notes'),
 'issue_summary': ('issue', 'issue summary')}
POLICY_WEIGHT = 0.25
POLICY_BOOSTS = {'policy': 0.18, 'workpaper': 0.18, 'engagement_note': 0.12, 'issue_summary': 0.12}
BM25_K1 = 1.2
BM25_B = 0.75

# What an answer must contain and say.
CONTRACTS = {'exact_accounting_sql': ('answer', 'sql', 'records', 'route', 'guardrail_context'),
 'tenant_safe_policy_rag': ('answer', 'citations', 'route', 'guardrail_context'),
 'precision_guardrail': ('answer', 'warnings', 'citations', 'route', 'guardrail_context')}
WARNING = 'Guardrail applied: exact values are sourced from gold tables; document chunks are returned only as context.'
NO_GROUNDING = 'No grounded document evidence was found for the tenant-scoped query.'
MAX_CONTEXT_CHARS = 8000

# Metric names and units.
STEP_METRICS = {'validate_tenant': 'ValidateTenantLatencyMs',
 'route': 'RouteLatencyMs',
 'sql_retrieval': 'SqlRetrievalLatencyMs',
 'rag_retrieval': 'RagRetrievalLatencyMs',
 'synthesize': 'SynthesisLatencyMs',
 'guardrails': 'GuardrailLatencyMs'}
LATENCY_UNIT = 'Milliseconds'
COUNT_UNIT = 'Count'

# Service-level objectives.
OBJECTIVES = {'bronze_lag_seconds': ('<', 300.0),
 'silver_freshness_seconds': ('<', 900.0),
 'gold_freshness_seconds': ('<', 1800.0),
 'success_rate': ('>', 0.995),
 'quality_pass_rate': ('>', 0.99),
 'quarantine_rate': ('<', 0.01),
 'query_p50_ms': ('<', 800.0),
 'query_p95_ms': ('<', 2000.0),
 'retrieval_p95_ms': ('<', 200.0),
 'sql_retrieval_p95_ms': ('<', 300.0),
 'synthesis_p95_ms': ('<', 1500.0),
 'guardrail_compliance_rate': ('>', 0.995),
 'citation_coverage': ('>', 0.95),
 'routing_accuracy': ('>', 0.95),
 'cross_tenant_leaks': ('=', 0.0),
 'tenant_boundary_violations': ('=', 0.0),
 'endpoint_uptime': ('>', 0.999),
 'pipeline_uptime': ('>', 0.995)}
