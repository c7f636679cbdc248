"""SQL of the lakehouse queries."""

from __future__ import annotations

from ledgerflow.plans.oracle.base import INVOICE_ERRORS, SEGMENT, day, newest, parsed, sql, stamp

_EVENT = f"""event_id, entity_name, op, tenant_id, entity_id, {stamp('updated_at')}, {stamp('emitted_at')}, source_sequence,
    payload_json, source_system, batch_id, source_file, event_version"""
_CANDIDATE = f"""tenant_id, invoice_id, event_id, batch_id, {stamp('updated_at')}, {stamp('emitted_at')}, source_sequence,
    customer_id, engagement_id, invoice_number, raw_invoice_amount, invoice_amount, currency, status, raw_due_date,
    {day('due_date')}, raw_invoice_date, {day('invoice_date')}, is_deleted"""
SILVER = f"""tenant_id, invoice_id, customer_id, engagement_id, invoice_number, invoice_amount, currency, status,
    {day('due_date')}, {day('invoice_date')}, {stamp('updated_at')}, source_event_id, source_batch_id, is_deleted"""
REJECTED = f"""tenant_id, invoice_id, event_id, batch_id, payload_json, raw_invoice_amount, raw_due_date, raw_invoice_date,
    quality_errors, {stamp('updated_at')}, {stamp('emitted_at')}, source_sequence"""


def _checked(events: str) -> str:
    """Distinct events of a filtered part of bronze with their quality codes."""
    return f"SELECT *, {INVOICE_ERRORS} AS quality_errors FROM ({parsed('(' + newest(events, 'event_id', 'emitted_at', 'source_sequence') + ')')})"


_CREATED = _checked("(SELECT * FROM bronze WHERE op = 'create')")
_EARLY = _checked("(SELECT * FROM bronze WHERE op = 'create' AND source_sequence % 4 <> 0)")
_OLTP = {
    "customers": (
        """SELECT 'cust_' || c_custkey AS customer_id, 'tenant_' || c_nationkey AS tenant_id, c_name AS customer_name,
        CASE WHEN c_acctbal < 0 THEN 'inactive' ELSE 'active' END AS customer_status, '2001-01-01 00:00:00' AS updated_at FROM customer""",
    ),
    "engagements": (
        """SELECT 'eng_' || c_nationkey || '_' || c_mktsegment AS engagement_id, 'tenant_' || c_nationkey AS tenant_id, 'cust_' || min(c_custkey) AS customer_id,
        c_mktsegment || ' audit' AS engagement_name, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'closed' ELSE 'active' END AS engagement_status,
        '2001-01-01 00:00:00' AS updated_at FROM customer GROUP BY c_nationkey, c_mktsegment""",
    ),
    "invoices": (
        f"""SELECT invoice_id, tenant_id, customer_id, engagement_id, invoice_number, CAST(invoice_amount AS DOUBLE) AS invoice_amount,
        currency, status, {day('invoice_date')}, {day('due_date')}, strftime(CAST(invoice_date + INTERVAL 1 DAY AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS updated_at
        FROM invoices""",
        "invoices",
    ),
    "controls": (
        f"""SELECT 'ctrl_' || p_partkey AS control_id, 'tenant_' || p_partkey % 25 AS tenant_id, 'eng_' || p_partkey % 25 || '_' || {SEGMENT} AS engagement_id,
        p_name AS control_name, CASE WHEN p_size <= 16 THEN 'low' WHEN p_size <= 33 THEN 'medium' ELSE 'high' END AS severity,
        CASE WHEN p_size % 2 = 0 THEN 'closed' ELSE 'open' END AS status, CAST(p_size % 4 AS BIGINT) AS exception_count, '2001-01-01 00:00:00' AS updated_at FROM part""",
    ),
}

ORACLE = {
    "cdc_decode": sql(
        f"""SELECT topic, "partition", "offset", {_EVENT}, false AS corrupt FROM bronze
        UNION ALL SELECT topic, "partition", "offset", NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, true
        FROM bronze WHERE "offset" % 101 = 0
        UNION ALL SELECT topic, "partition", "offset", {_EVENT}, false FROM (SELECT * REPLACE ('payroll' AS entity_name) FROM bronze WHERE "offset" % 103 = 0)""",
        "bronze",
    ),
    "oltp_snapshot": sql(*_OLTP["invoices"]),
    **{f"oltp_{name}": sql(*parts) for name, parts in _OLTP.items() if name != "invoices"},
    "dedup_events": sql(f"SELECT {_EVENT} FROM deduped", "deduped"),
    "latest_state": sql(
        f"SELECT tenant_id, entity_id, event_id, op, {stamp('updated_at')}, {stamp('emitted_at')}, source_sequence FROM latest",
        "latest",
    ),
    "payload_extract": sql(f"SELECT {_CANDIDATE} FROM ({parsed('bronze')})", "bronze"),
    "silver_candidates": sql(f"SELECT {_CANDIDATE} FROM candidates", "candidates"),
    "quality_errors": sql("SELECT tenant_id, invoice_id, event_id, quality_errors FROM validated", "validated"),
    "quality_error_counts": sql(
        """SELECT tenant_id, error_code, count(*) AS rows FROM (
            SELECT tenant_id, unnest(string_split(quality_errors, ',')) AS error_code FROM validated WHERE quality_errors <> '')
        GROUP BY ALL""",
        "validated",
    ),
    "silver_curated": sql(f"SELECT {SILVER} FROM curated", "curated"),
    "silver_quarantine": sql(f"SELECT {REJECTED} FROM validated WHERE quality_errors <> ''", "validated"),
    "silver_reconciliation": sql(
        """SELECT (SELECT count(*) FROM bronze WHERE entity_name = 'invoice') AS raw_input, count(*) AS candidates,
        count(*) FILTER (quality_errors = '') AS curated, count(*) FILTER (quality_errors <> '') AS quarantined FROM validated""",
        "validated", "bronze",
    ),
    "silver_snapshot_generic": sql(
        f"""SELECT entity, tenant_id, entity_id, name, {stamp('updated_at')}, source_event_id, source_batch_id, is_deleted FROM (
        SELECT 'customer' AS entity, tenant_id, customer_id AS entity_id, customer_name AS name, updated_at, source_event_id, source_batch_id, is_deleted FROM customers
        UNION ALL SELECT 'engagement', tenant_id, engagement_id, engagement_name, updated_at, source_event_id, source_batch_id, is_deleted FROM engagements
        UNION ALL SELECT 'control', tenant_id, control_id, control_name, updated_at, source_event_id, source_batch_id, is_deleted FROM controls)""",
        "customers", "engagements", "controls",
    ),
    "quarantine_append": sql(
        f"""SELECT {REJECTED} FROM created WHERE quality_errors <> ''
        UNION ALL SELECT {REJECTED} FROM validated WHERE quality_errors <> ''
        AND event_id NOT IN (SELECT event_id FROM created WHERE quality_errors <> '')""",
        "validated", extra={"created": _CREATED},
    ),
    "silver_merge": sql(
        f"""SELECT {SILVER}, first_batch FROM (
        SELECT n.* REPLACE (n.tenant_id AS tenant_id), s.first_batch FROM changes n LEFT JOIN stored s USING (tenant_id, invoice_id)
        UNION ALL
        SELECT s.* FROM stored s WHERE NOT EXISTS (SELECT 1 FROM changes n WHERE n.tenant_id = s.tenant_id AND n.invoice_id = s.invoice_id))""",
        "curated",
        extra={
            "early": _EARLY,
            "stored": """SELECT tenant_id, invoice_id, customer_id, engagement_id, invoice_number, invoice_amount, currency, status, due_date, invoice_date,
                updated_at, event_id AS source_event_id, batch_id AS source_batch_id, is_deleted, batch_id AS first_batch FROM early WHERE quality_errors = ''""",
            "changes": "SELECT * FROM curated WHERE CAST(substr(invoice_id, 5) AS BIGINT) % 3 <> 1",
        },
    ),
    "insert_if_absent": sql(
        """SELECT tenant_id, customer_id, customer_name FROM customers
        UNION ALL SELECT 'tenant_' || c_nationkey, 'cust_' || c_custkey, 'seed ' || c_name FROM customer
        WHERE 'cust_' || c_custkey NOT IN (SELECT customer_id FROM customers)""",
        "customers",
    ),
    "gold_invoice_summary": sql(
        f"""SELECT tenant_id, invoice_id, invoice_number, engagement_id, engagement_name, customer_id, customer_name, invoice_amount,
        currency, status, {day('invoice_date')}, {day('due_date')}, days_past_due, is_overdue, aging_bucket, {stamp('updated_at')}, lineage_ref
        FROM gold""",
        "gold",
    ),
    "gold_partitions": sql(
        "SELECT tenant_id, strftime(invoice_date, '%Y-%m') AS invoice_month, count(*) AS invoices FROM gold GROUP BY ALL", "gold"
    ),
    "bronze_partitions": sql(
        "SELECT tenant_id, strftime(emitted_at, '%Y-%m') AS emitted_month, count(*) AS rows FROM bronze GROUP BY ALL", "bronze"
    ),
    "silver_partitions": sql(
        "SELECT tenant_id, strftime(invoice_date, '%Y-%m') AS invoice_month, count(*) AS rows FROM curated GROUP BY ALL", "curated"
    ),
    "quarantine_partitions": sql(
        "SELECT tenant_id, count(*) AS rows FROM validated WHERE quality_errors <> '' GROUP BY ALL", "validated"
    ),
    "v_invoice_summary": sql(
        """SELECT tenant_id, invoice_id, invoice_number, engagement_name, customer_name, invoice_amount, status, is_overdue,
        aging_bucket, lineage_ref FROM gold""",
        "gold",
    ),
    "v_control_exceptions": sql("SELECT * FROM control_summary", "control_summary"),
    "control_exceptions": sql("SELECT * FROM control_summary WHERE exception_count > 0", "control_summary"),
    "overdue_total": sql(
        """SELECT tenant_id, round(sum(invoice_amount), 2) AS total_overdue_amount, count(*) AS overdue_invoice_count
        FROM gold WHERE is_overdue GROUP BY ALL""",
        "gold",
    ),
    "overdue_total_month": sql(
        """SELECT tenant_id, strftime(due_date, '%Y-%m') AS due_month, round(sum(invoice_amount), 2) AS total_overdue_amount,
        count(*) AS overdue_invoice_count FROM gold WHERE is_overdue GROUP BY ALL""",
        "gold",
    ),
    "open_invoice_count": sql(
        "SELECT tenant_id, count(*) AS open_invoices FROM gold WHERE status = 'open' GROUP BY ALL", "gold"
    ),
    "aging_bucket_totals": sql(
        """SELECT tenant_id, aging_bucket, count(*) AS invoices, round(sum(invoice_amount), 2) AS total_amount
        FROM gold GROUP BY ALL""",
        "gold",
    ),
    "customer_balance": sql(
        """SELECT tenant_id, customer_id, round(sum(invoice_amount), 2) AS outstanding_balance, count(*) AS unpaid_invoices
        FROM gold WHERE status <> 'paid' GROUP BY ALL""",
        "gold",
    ),
    "engagement_status": sql(
        "SELECT tenant_id, engagement_id, engagement_name, engagement_status FROM engagements WHERE NOT is_deleted",
        "engagements",
    ),
}
ORACLE["silver_partition_merge"] = f"SELECT * EXCLUDE (first_batch) FROM ({ORACLE['silver_merge']})"
