"""SQL of the streaming queries: the deliveries applied one after another."""

from __future__ import annotations

from ledgerflow.plans.oracle.base import INVOICE_ERRORS, newest, parsed, sql, stamp
from ledgerflow.plans.oracle.lakehouse import ORACLE as LAKEHOUSE
from ledgerflow.plans.oracle.lakehouse import REJECTED, SILVER

# What each of three deliveries holds: distinct events, then the newest event of each invoice, then its quality codes.
_BATCHES = {
    "arrived": 'SELECT *, "offset" % 3 AS delivery FROM bronze',
    "distinct_events": newest("arrived", "delivery, event_id", "emitted_at", "source_sequence", '"offset"'),
    "batch_latest": newest("distinct_events", "delivery, tenant_id, entity_id", "updated_at", "source_sequence", "emitted_at", "event_id"),
    "batch_checked": f"SELECT *, event_id AS source_event_id, batch_id AS source_batch_id, {INVOICE_ERRORS} AS quality_errors FROM ({parsed('batch_latest', 'delivery')})",
}

# Deliveries in time, some events and copies one delivery late; a row is dropped if it is not newer than the watermark,
# two hours before the newest event of the deliveries before its own.
_LATE = """("offset" // 10) % 29 = 0 OR (("offset" // 10) % 25 = 0 AND hour(emitted_at) = 1)"""
_TIMED = {
    "arrived": f"SELECT *, least(2, (year(emitted_at) - 1992) // 2) + CASE WHEN {_LATE} THEN 1 ELSE 0 END AS delivery FROM bronze",
    "marks": "SELECT delivery, max(emitted_at) AS newest FROM arrived GROUP BY ALL",
    "in_time": """SELECT a.* FROM arrived a WHERE a.emitted_at > coalesce(
        (SELECT max(m.newest) - INTERVAL 2 HOUR FROM marks m WHERE m.delivery < a.delivery), TIMESTAMP '1970-01-01')""",
}

# Copies of an event are one session while each is emitted within two hours after the one before and finds it not closed yet.
_SESSIONS = {
    **{name: _TIMED[name] for name in ("arrived", "marks")},
    "marked": """SELECT a.*, coalesce((SELECT max(m.newest) - INTERVAL 2 HOUR FROM marks m WHERE m.delivery < a.delivery), TIMESTAMP '1970-01-01') AS mark
        FROM arrived a""",
    "neighbours": """SELECT *, lag(emitted_at) OVER w + INTERVAL 2 HOUR AS former_end, lag(delivery) OVER w AS former_delivery
        FROM marked WHERE emitted_at + INTERVAL 2 HOUR > mark WINDOW w AS (PARTITION BY event_id ORDER BY emitted_at, source_sequence, "offset")""",
    "sessions": """SELECT *, count(*) FILTER (former_end IS NULL OR emitted_at > former_end OR (former_delivery < delivery AND former_end <= mark))
        OVER (PARTITION BY event_id ORDER BY emitted_at, source_sequence, "offset") AS session FROM neighbours""",
    "last_copy": newest("sessions", "event_id, session", "emitted_at", "source_sequence", '"offset"'),
}

ORACLE = {
    "cdc_stream_ingest": LAKEHOUSE["cdc_decode"],
    # Full batches of the most messages, and what is left.
    "cdc_microbatch": sql(
        """SELECT b AS batch_id, least(5000, messages - 5000 * b) AS messages
        FROM (SELECT CAST(count(*) + count(*) FILTER ("offset" % 101 = 0) + count(*) FILTER ("offset" % 103 = 0) AS BIGINT) AS messages FROM bronze),
             range((messages + 4999) // 5000) AS r(b)""",
        "bronze",
    ),
    "stream_stage_metrics": sql(
        """SELECT "offset" % 3 AS batch_id, CAST(count(*) + sum(broken) + count(*) FILTER ("offset" % 103 = 0) AS DOUBLE) AS "RecordsIn",
        CAST(count(*) + count(*) FILTER ("offset" % 103 = 0) AS DOUBLE) AS "RecordsOut", CAST(sum(broken) AS DOUBLE) AS "Quarantined"
        FROM (SELECT "offset", CAST("offset" % 101 = 0 AS BIGINT) AS broken FROM bronze) GROUP BY ALL""",
        "bronze",
    ),
    "stream_dedup": sql(
        f"SELECT DISTINCT event_id, op, tenant_id, entity_id, {stamp('updated_at')}, payload_json FROM in_time", "bronze", extra=_TIMED
    ),
    "stream_last_copy": sql(
        f"""SELECT event_id, op, tenant_id, entity_id, {stamp('updated_at')}, payload_json, {stamp('emitted_at')}, source_sequence, "offset"
        FROM last_copy WHERE emitted_at + INTERVAL 2 HOUR <= (SELECT max(newest) - INTERVAL 2 HOUR FROM marks)""",
        "bronze", extra=_SESSIONS,
    ),
    "stream_latest_state": sql(
        f"""SELECT {SILVER} FROM batch_checked WHERE quality_errors = ''
        QUALIFY row_number() OVER (PARTITION BY tenant_id, invoice_id ORDER BY updated_at DESC, source_sequence DESC, emitted_at DESC, event_id DESC) = 1""",
        "bronze", extra=_BATCHES,
    ),
    "stream_quarantine": sql(
        f"""SELECT {REJECTED} FROM batch_checked WHERE quality_errors <> ''
        QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY delivery) = 1""",
        "bronze", extra=_BATCHES,
    ),
    "stream_arrival_windows": sql(
        """SELECT strftime(date_trunc('day', emitted_at), '%Y-%m-%d %H:%M:%S') AS window_start, entity_name, count(*) AS events
        FROM bronze GROUP BY ALL""",
        "bronze",
    ),
}
