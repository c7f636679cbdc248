"""Shared SQL building blocks: the derived inputs and the long pipelines, as named CTEs."""

from __future__ import annotations

# The same character classes as in functions/text.py.
SPACE = r"[\t\n\x0b\f\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORD = r"[\p{L}\p{N}_]"
LINE_END = r"\r\n|[\n\r\x0b\f\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def stamp(x: str, name: str | None = None) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S') AS {name or x}"


def day(x: str, name: str | None = None) -> str:
    return f"CAST({x} AS VARCHAR) AS {name or x}"


def blank(x: str) -> str:
    return f"({x} IS NULL OR trim({x}) = '')"


def phrase(terms) -> str:
    alternatives = "|".join(f"{SPACE}+".join(t.split()) for t in terms)
    return f"(^|[^\\p{{L}}\\p{{N}}_])({alternatives})([^\\p{{L}}\\p{{N}}_]|$)"


def has(text: str, terms) -> str:
    return f"regexp_matches(lower({text}), '{phrase(terms)}')"


def codes(*pairs: tuple[str, str]) -> str:
    """Comma-joined codes whose condition holds."""
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {cond} THEN '{code}' END" for code, cond in pairs) + ")"


def json_field(name: str, value: str) -> str:
    return f"'\"{name}\":\"' || {value} || '\"'"


# The payload fields of an invoice event, and the types of those that are not text.
PAYLOAD_FIELDS = ("customer_id", "engagement_id", "invoice_number", "invoice_amount", "currency", "status", "due_date", "invoice_date")
PAYLOAD_TYPES = {"invoice_amount": "DOUBLE", "due_date": "DATE", "invoice_date": "DATE"}


def parsed(source: str, *extra: str) -> str:
    """Events with their payload fields; a typed field also keeps its raw text."""
    columns = []
    for field in PAYLOAD_FIELDS:
        raw = f"json_extract_string(payload_json, '$.{field}')"
        typed = PAYLOAD_TYPES.get(field)
        columns += [f"{raw} AS raw_{field}", f"try_cast({raw} AS {typed}) AS {field}"] if typed else [f"{raw} AS {field}"]
    kept = ("event_id", "batch_id", "payload_json", "updated_at", "emitted_at", "source_sequence", *extra)
    return f"SELECT tenant_id, entity_id AS invoice_id, {', '.join([*kept, *columns])}, op = 'delete' AS is_deleted FROM {source}"


def newest(source: str, keys: str, *order: str) -> str:
    """The last row of each key."""
    ranked = ", ".join(f"{c} DESC" for c in order)
    return f"SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {ranked}) = 1"


# Days past due from which a bucket counts, and its name.
AGING = ((61, "61_plus"), (31, "31_60"), (1, "0_30"))


def aged(days: str) -> str:
    return "CASE " + " ".join(f"WHEN {days} >= {least} THEN '{name}'" for least, name in AGING) + " ELSE 'current' END"


DOC_TYPE = "CASE {k} % 4 WHEN 0 THEN 'policy' WHEN 1 THEN 'workpaper' WHEN 2 THEN 'engagement_note' ELSE 'issue_summary' END"

INVOICE_ERRORS = codes(
    ("missing_tenant_id", blank("tenant_id")),
    ("missing_invoice_id", blank("invoice_id")),
    *[
        pair
        for f in ("invoice_amount", "due_date", "invoice_date")
        for pair in (
            (f"missing_{f}", blank(f"raw_{f}")),
            (f"invalid_{f}", f"NOT {blank(f'raw_{f}')} AND {f} IS NULL"),
        )
    ],
)


def entity_events(entity: str, source: str, event_id: str, op: str, tenant: str, key: str, version: str, payload: str) -> str:
    return f"""
        SELECT {event_id} AS event_id, '{entity}' AS entity_name, {op} AS op, {tenant} AS tenant_id, {key} AS entity_id,
               CAST(DATE '2001-01-01' + {version} * INTERVAL 1 DAY AS TIMESTAMP) AS updated_at, {version} AS source_sequence,
               {payload} AS payload_json, 'batch_' || {version} AS batch_id
        FROM {source}"""


def snapshot_of(events: str, key: str, fields: tuple[str, ...], required: tuple[str, ...]) -> str:
    extracted = ", ".join(f"json_extract_string(payload_json, '$.{f}') AS {f}" for f in fields)
    complete = " AND ".join(f"NOT {blank(c)}" for c in ("tenant_id", key, *required))
    return f"""
        SELECT tenant_id, {key}, {', '.join(fields)}, updated_at, source_event_id, source_batch_id, is_deleted FROM (
            SELECT tenant_id, entity_id AS {key}, {extracted}, updated_at, event_id AS source_event_id,
                   batch_id AS source_batch_id, op = 'delete' AS is_deleted
            FROM {events}
            QUALIFY row_number() OVER (PARTITION BY tenant_id, entity_id ORDER BY updated_at DESC, source_sequence DESC) = 1
        ) WHERE {complete}"""


SEGMENT = "(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'])[p_partkey % 5 + 1]"

# name -> (names it needs, SQL)
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "invoices": (
        (),
        """
        SELECT 'inv_' || o_orderkey AS invoice_id, 'tenant_' || c_nationkey AS tenant_id, 'cust_' || c_custkey AS customer_id,
               'eng_' || c_nationkey || '_' || c_mktsegment AS engagement_id, 'INV-' || o_orderkey AS invoice_number,
               CAST(o_totalprice AS DECIMAL(18,2)) AS invoice_amount, 'USD' AS currency,
               CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'open' ELSE 'overdue' END AS status,
               CAST(o_orderdate AS DATE) AS invoice_date, CAST(o_orderdate + INTERVAL 30 DAY AS DATE) AS due_date, o_orderkey AS k
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    ),
    "bronze": (
        ("invoices",),
        f"""
        SELECT 'cdc.invoices' AS topic, k % 4 AS "partition", k * 10 + v + copy AS "offset", 'inv_' || k || '_v' || v AS event_id,
               'invoice' AS entity_name, CASE WHEN v = 1 THEN 'create' WHEN k % 19 = 0 THEN 'delete' ELSE 'update' END AS op,
               tenant_id, invoice_id AS entity_id, CAST(invoice_date + v * INTERVAL 1 DAY AS TIMESTAMP) AS updated_at,
               CAST(invoice_date + (v + CASE WHEN v = 1 AND k % 7 = 0 THEN 9 ELSE 0 END) * INTERVAL 1 DAY
                    + copy * INTERVAL 1 HOUR AS TIMESTAMP) AS emitted_at,
               k * 10 + v + copy AS source_sequence,
               '{{' || concat_ws(',', {json_field('customer_id', 'customer_id')}, {json_field('engagement_id', 'engagement_id')},
                   {json_field('invoice_number', 'invoice_number')},
                   {json_field('invoice_amount', "CASE WHEN (k + 4 * (v - 1)) % 11 = 0 THEN 'n/a' ELSE CAST(CAST(invoice_amount + 10 * (v - 1) AS DECIMAL(18,2)) AS VARCHAR) END")},
                   {json_field('currency', 'currency')}, {json_field('status', 'status')},
                   CASE WHEN (k + 5 * (v - 1)) % 13 <> 0 THEN {json_field('due_date', 'CAST(due_date AS VARCHAR)')} END,
                   {json_field('invoice_date', "CASE WHEN (k + 6 * (v - 1)) % 17 = 0 THEN ' ' ELSE CAST(invoice_date AS VARCHAR) END")}) || '}}' AS payload_json,
               'oltp' AS source_system, 'batch_' || v AS batch_id, 'invoices' AS source_file, '1' AS event_version, k
        FROM (
            SELECT *, unnest(CASE WHEN k % 5 = 0 THEN [0, 1] ELSE [0] END) AS copy
            FROM (SELECT *, unnest(CASE WHEN k % 3 = 0 THEN [1, 2] ELSE [1] END) AS v FROM invoices)
        )""",
    ),
    "deduped": (
        ("bronze",),
        """
        SELECT * FROM bronze WHERE entity_name = 'invoice'
        QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY emitted_at DESC, source_sequence DESC) = 1""",
    ),
    "latest": (
        ("deduped",),
        """
        SELECT * FROM deduped
        QUALIFY row_number() OVER (PARTITION BY tenant_id, entity_id ORDER BY updated_at DESC, source_sequence DESC, emitted_at DESC) = 1""",
    ),
    "candidates": (("latest",), parsed("latest")),
    "validated": (("candidates",), f"SELECT *, {INVOICE_ERRORS} AS quality_errors FROM candidates"),
    "curated": (
        ("validated",),
        """
        SELECT tenant_id, invoice_id, customer_id, engagement_id, invoice_number, invoice_amount, currency, status, due_date,
               invoice_date, updated_at, event_id AS source_event_id, batch_id AS source_batch_id, is_deleted
        FROM validated WHERE quality_errors = ''""",
    ),
    "customer_events": (
        (),
        entity_events(
            "customer", "(SELECT *, unnest(CASE WHEN c_custkey % 3 = 0 THEN [1, 2] ELSE [1] END) AS v FROM customer)",
            "'evc_' || c_custkey || '_v' || v", "CASE WHEN v = 1 THEN 'create' ELSE 'update' END", "'tenant_' || c_nationkey",
            "'cust_' || c_custkey", "v",
            "'{' || " + json_field("customer_name", "CASE WHEN c_custkey % 50 = 0 THEN ' ' WHEN v = 2 THEN c_name || ' (renamed)' ELSE c_name END")
            + " || ',' || " + json_field("customer_status", "CASE WHEN c_acctbal < 0 THEN 'inactive' ELSE 'active' END") + " || '}'",
        ),
    ),
    "engagement_events": (
        (),
        entity_events(
            "engagement", "(SELECT c_nationkey, c_mktsegment, min(c_custkey) AS first_customer FROM customer GROUP BY ALL)",
            "'eve_' || c_nationkey || '_' || c_mktsegment", "'create'", "'tenant_' || c_nationkey",
            "'eng_' || c_nationkey || '_' || c_mktsegment", "1",
            "'{' || " + json_field("customer_id", "'cust_' || first_customer") + " || ',' || "
            + json_field("engagement_name", "CASE WHEN c_nationkey = 0 AND c_mktsegment = 'FURNITURE' THEN ' ' ELSE c_mktsegment || ' audit' END")
            + " || ',' || " + json_field("engagement_status", "CASE WHEN c_mktsegment = 'MACHINERY' THEN 'closed' ELSE 'active' END") + " || '}'",
        ),
    ),
    "control_events": (
        (),
        entity_events(
            "control", "part", "'evx_' || p_partkey", "CASE WHEN p_partkey % 23 = 0 THEN 'delete' ELSE 'create' END",
            "'tenant_' || p_partkey % 25", "'ctrl_' || p_partkey", "1",
            "'{' || " + json_field("engagement_id", f"'eng_' || p_partkey % 25 || '_' || {SEGMENT}") + " || ',' || "
            + json_field("control_name", "p_name") + " || ',' || "
            + json_field("severity", "CASE WHEN p_size <= 16 THEN 'low' WHEN p_size <= 33 THEN 'medium' ELSE 'high' END") + " || ',' || "
            + json_field("status", "CASE WHEN p_size % 2 = 0 THEN 'closed' ELSE 'open' END") + " || ',' || "
            + json_field("exception_count", "p_size % 4") + " || '}'",
        ),
    ),
    "customers": (
        ("customer_events",),
        snapshot_of("customer_events", "customer_id", ("customer_name", "customer_status"), ("customer_name",)),
    ),
    "engagements": (
        ("engagement_events",),
        snapshot_of(
            "engagement_events", "engagement_id", ("customer_id", "engagement_name", "engagement_status"), ("engagement_name",)
        ),
    ),
    "controls": (
        ("control_events",),
        snapshot_of("control_events", "control_id", ("engagement_id", "control_name", "severity", "status", "exception_count"), ()),
    ),
    "gold": (
        ("curated", "customers", "engagements"),
        f"""
        SELECT * EXCLUDE (source_event_id, source_batch_id, is_deleted, customer_ref, engagement_ref),
               days_past_due > 0 OR status = 'overdue' AS is_overdue, {aged('days_past_due')} AS aging_bucket, {' || '.join(
                   f"'{'|' * bool(n)}{part}:' || {ref}" for n, (part, ref) in enumerate(
                       zip(("invoice", "customer", "engagement"), ("source_event_id", "customer_ref", "engagement_ref"))))} AS lineage_ref
        FROM (
            SELECT curated.*, customer_name, engagement_name, customers.source_event_id AS customer_ref,
                   engagements.source_event_id AS engagement_ref, DATE '2001-07-15' - due_date AS days_past_due
            FROM curated
            LEFT JOIN (SELECT tenant_id, customer_id, customer_name, source_event_id FROM customers) customers USING (tenant_id, customer_id)
            LEFT JOIN (SELECT tenant_id, engagement_id, engagement_name, source_event_id FROM engagements) engagements USING (tenant_id, engagement_id)
            WHERE NOT is_deleted)""",
    ),
    "control_summary": (
        ("controls", "engagements"),
        """
        SELECT c.tenant_id, c.control_id, c.control_name, e.engagement_name, c.severity, c.status,
               CAST(c.exception_count AS BIGINT) AS exception_count,
               'control:' || c.source_event_id || '|engagement:' || e.source_event_id AS lineage_ref
        FROM controls c LEFT JOIN engagements e ON c.tenant_id = e.tenant_id AND c.engagement_id = e.engagement_id
        WHERE NOT c.is_deleted""",
    ),
    "docs": (
        (),
        f"""
        SELECT 'tenant_' || substr(source, 4) AS tenant_id, 'doc_' || doc_id AS document_id, doc_id AS k,
               string_split(text, chr(10))[1] AS title, {DOC_TYPE.format(k='doc_id')} AS doc_type,
               CASE WHEN doc_id % 2 = 0 THEN 'confidential' ELSE 'internal' END AS classification,
               CASE WHEN doc_id % 10 = 0 THEN 'archived' WHEN doc_id % 10 = 5 THEN 'legal_hold' ELSE 'active' END AS retention_state,
               CAST(DATE '2024-01-01' + (doc_id % 365) * INTERVAL 1 DAY AS TIMESTAMP) AS updated_at,
               replace(text, chr(10), chr(10) || chr(10)) AS text, 'docs://' || source || '/' || doc_id AS source_uri,
               false AS flagged
        FROM documents""",
    ),
    "table_docs": (
        (),
        """
        SELECT 'tenant_' || l_suppkey % 25 AS tenant_id,
               'ship_' || l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey || '_' || CAST(round(l_extendedprice * 100) AS BIGINT) AS document_id,
               'workpaper' AS doc_type, 'active' AS retention_state,
               'Shipment of order ' || l_orderkey || '.' || chr(10) || chr(10) || 'Part    Quantity' || chr(10) || l_partkey || '    '
                   || CAST(l_quantity AS INTEGER) || chr(10) || chr(10) || 'Reviewed. Signed by supplier ' || l_suppkey || '.' AS text,
               l_returnflag <> 'R' AS flagged
        FROM lineitem""",
    ),
}


def chunk_ctes(prefix: str, source: str, keep: str) -> dict[str, tuple[tuple[str, ...], str]]:
    """The chunker over `source`, as a recursive CTE per sentence."""
    p = prefix
    gap = f"{WORD}{SPACE}{{2,}}{WORD}"
    lines = f"list_filter(list_transform(regexp_split_to_array(block, '{LINE_END}'), lambda l: {strip('l')}), lambda l: l <> '')"
    return {
        f"{p}normal": (
            (source,),
            f"""
        SELECT document_id, flagged, {strip("regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(9), ' '), ' +' || chr(10), chr(10), 'g'), chr(10) || '{3,}', chr(10) || chr(10), 'g')")} AS body
        FROM {source}""",
        ),
        f"{p}blocks": (
            (f"{p}normal",),
            f"""
        SELECT document_id, flagged, unnest(bs) AS block, generate_subscripts(bs, 1) AS pno FROM (
            SELECT document_id, flagged,
                   list_filter(list_transform(string_split(body, chr(10) || chr(10)), lambda b: {strip('b')}), lambda b: b <> '') AS bs
            FROM {p}normal)""",
        ),
        f"{p}paragraphs": (
            (f"{p}blocks",),
            f"""
        SELECT document_id, pno, block,
               CASE WHEN flagged AND len({lines}) >= 2 AND len(list_filter({lines}, lambda l: regexp_matches(l, '{gap}'))) > 0
                    THEN 'table_fragment' ELSE 'narrative' END AS kind
        FROM {p}blocks""",
        ),
        f"{p}sentences": (
            (f"{p}paragraphs",),
            f"""
        SELECT document_id, pno, unnest(ss) AS s, generate_subscripts(ss, 1) AS sno, len(ss) AS sentences FROM (
            SELECT document_id, pno, list_filter(list_transform(
                   string_split(regexp_replace(block, '([.!?]){SPACE}+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {strip('x')}), lambda x: x <> '') AS ss
            FROM {p}paragraphs WHERE kind = 'narrative' AND length(block) > 320)""",
        ),
        f"{p}packed": (
            (f"{p}sentences",),
            f"""
        SELECT document_id, pno, sno, sentences, s AS buffer, s AS last, length(s) AS chars, CAST(NULL AS VARCHAR) AS closed
        FROM {p}sentences WHERE sno = 1
        UNION ALL
        SELECT n.document_id, n.pno, n.sno, n.sentences,
               CASE WHEN r.chars + length(n.s) > 320 THEN r.last ELSE r.buffer END || ' ' || n.s, n.s,
               CASE WHEN r.chars + length(n.s) > 320 THEN length(r.last) ELSE r.chars END + length(n.s),
               CASE WHEN r.chars + length(n.s) > 320 THEN r.buffer END
        FROM {p}packed r JOIN {p}sentences n ON n.document_id = r.document_id AND n.pno = r.pno AND n.sno = r.sno + 1""",
        ),
        f"{p}fragments": (
            (f"{p}packed", f"{p}paragraphs"),
            f"""
        SELECT document_id, pno, sno AS ord, 'narrative' AS kind, closed AS text FROM {p}packed WHERE closed IS NOT NULL
        UNION ALL
        SELECT document_id, pno, sno + 1, 'narrative', buffer FROM {p}packed WHERE sno = sentences
        UNION ALL
        SELECT document_id, pno, 1, kind, block FROM {p}paragraphs WHERE NOT (kind = 'narrative' AND length(block) > 320)""",
        ),
        f"{p}chunks": (
            (f"{p}fragments", source),
            f"""
        SELECT f.document_id || '::chunk::' || chunk_index AS chunk_id, d.tenant_id, f.document_id, {keep}
               chunk_index, kind AS chunk_kind, CASE WHEN coalesce(carry, '') = '' THEN f.text ELSE carry || chr(10) || f.text END AS text
        FROM (
            SELECT *, row_number() OVER w - 1 AS chunk_index,
                   CASE WHEN lag(kind) OVER w = 'narrative' THEN left(string_split(lag(text) OVER w, '. ')[-1], 160) END AS carry
            FROM {p}fragments WINDOW w AS (PARTITION BY document_id ORDER BY pno, ord)
        ) f JOIN {source} d ON d.document_id = f.document_id""",
        ),
    }


CTES.update(chunk_ctes("", "docs", "title, doc_type, classification, retention_state, source_uri,"))
CTES.update(chunk_ctes("t_", "table_docs", "doc_type, retention_state,"))


def sql(body: str, *needs: str, extra: dict[str, str] | None = None) -> str:
    """The query with every CTE it needs in front, in dependency order."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in ordered:
            return
        for other in CTES[name][0]:
            add(other)
        ordered.append(name)

    for name in needs:
        add(name)
    # Only a recursive CTE cannot be marked as materialised.
    parts = [f"{n} AS {'' if 'packed' in n else 'MATERIALIZED '}({CTES[n][1]})" for n in ordered]
    parts += [f"{n} AS ({q})" for n, q in (extra or {}).items()]
    return f"WITH RECURSIVE {', '.join(parts)} {body}" if parts else body
