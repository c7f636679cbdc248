"""SQL of the document queries."""

from __future__ import annotations

from ledgerflow.plans.oracle.base import CTES, chunk_ctes, codes, sql, stamp


def _fingerprint(x: str, name: str | None = None) -> str:
    name = name or x
    return f"length({x}) AS {name}_chars, md5({x}) AS {name}_md5"


_RAW = """
    SELECT document_id, tenant_id, text, source_uri, updated_at, classification, CASE WHEN k % 43 <> 0 THEN title END AS title,
           CASE WHEN k % 37 = 0 THEN 'memo' ELSE doc_type END AS doc_type,
           CASE WHEN k % 41 = 0 THEN 'expired' ELSE retention_state END AS retention_state FROM docs"""
_VALIDATION = codes(
    *[
        (f"missing_{f}", f"{f} IS NULL")
        for f in (
            "tenant_id", "document_id", "title", "doc_type", "classification", "retention_state", "updated_at", "text", "source_uri",
        )
    ],
    ("invalid_doc_type", "doc_type NOT IN ('policy', 'workpaper', 'engagement_note', 'issue_summary')"),
    ("invalid_retention_state", "retention_state NOT IN ('active', 'archived', 'legal_hold')"),
)


def _block(pos: int, block_id: str, kind: str, text: str = "NULL", row="NULL", col="NULL", entity: str = "NULL", children=(), values=(), where: str = "true") -> str:
    rels = [("CHILD", children), ("VALUE", values)]
    listed = ", ".join(f"{{'type': '{t}', 'ids': {list(ids)!r}}}" for t, ids in rels if ids)
    return (
        f"SELECT 'tenant_' || o_custkey % 25 AS tenant_id, 'ocr_' || o_orderkey AS document_id, {pos} AS position, '{block_id}' AS block_id,"
        f" '{kind}' AS block_type, CAST({text} AS VARCHAR) AS text, CAST({row} AS BIGINT) AS row_index, CAST({col} AS BIGINT) AS column_index,"
        f" CAST({entity} AS VARCHAR) AS entity_types,"
        f" CAST({'[' + listed + ']' if listed else 'NULL'} AS STRUCT(type VARCHAR, ids VARCHAR[])[]) AS rels FROM orders WHERE {where}"
    )


_WORDS = "string_split(o_orderpriority, ' ')"
_SECOND = "o_orderkey % 4 = 0"
_BLOCKS = " UNION ALL ".join(
    [
        _block(0, "p1", "PAGE"),
        _block(1, "l1", "LINE", "'Order ' || o_orderkey"),
        _block(2, "l2", "LINE", "'Customer ' || o_custkey"),
        _block(3, "l3", "LINE"),
        _block(4, "t1", "TABLE", children=("c2", "c1", "gone", "c4", "c3", "w1", "c9")),
        _block(5, "c1", "CELL", row=1, col=1, children=("w1",)),
        _block(6, "c2", "CELL", row=1, col=2, children=("w2", "w3")),
        _block(7, "c3", "CELL", row=2, col=1, children=("w4",)),
        _block(8, "c4", "CELL", row=2, col=2, children=("w5", "w6")),
        _block(9, "c9", "CELL", row=2, col=1, children=("w7",)),
        _block(10, "w1", "WORD", "'Field'"),
        _block(11, "w2", "WORD", "'Recorded'"),
        _block(12, "w3", "WORD", "'value'"),
        _block(13, "w4", "WORD", "'Replaced'"),
        _block(14, "w5", "WORD", f"{_WORDS}[1]"),
        _block(15, "w6", "WORD", f"{_WORDS}[2]"),
        _block(16, "w7", "WORD", "'Priority'"),
        _block(17, "k1", "KEY_VALUE_SET", entity="'KEY'", children=("w8",), values=("v0", "v1")),
        _block(18, "v0", "KEY_VALUE_SET", entity="'VALUE'", children=("w1",)),
        _block(19, "v1", "KEY_VALUE_SET", entity="'VALUE'", children=("w9", "w2")),
        _block(20, "k2", "KEY_VALUE_SET", entity="'KEY'", values=("v1",)),
        _block(21, "k3", "KEY_VALUE_SET", entity="'KEY'", children=("w3",)),
        _block(22, "w8", "WORD", "'Status'"),
        _block(23, "w9", "WORD", "o_orderstatus"),
        _block(24, "t2", "TABLE", children=("d1",), where=_SECOND),
        _block(25, "d1", "CELL", row=1, col=1, children=("x1",), where=_SECOND),
        _block(26, "x1", "WORD", "CAST(o_totalprice AS DECIMAL(18,2))", where=_SECOND),
    ]
)

CTES.update(
    {
        "ocr_rows": ((), _BLOCKS),
        "edges": (
            ("ocr_rows",),
            """
        SELECT tenant_id, document_id, position, block_id AS parent_id, rel.type AS rel, unnest(rel.ids) AS child_id,
               generate_subscripts(rel.ids, 1) AS c
        FROM (SELECT *, unnest(rels) AS rel FROM ocr_rows)""",
        ),
        "below": (
            ("edges",),
            """
        SELECT e.document_id, e.position, string_agg(w.text, ' ' ORDER BY e.c) AS child_text
        FROM edges e JOIN ocr_rows w ON w.document_id = e.document_id AND w.block_id = e.child_id
        WHERE e.rel = 'CHILD' AND w.block_type = 'WORD' AND w.text IS NOT NULL GROUP BY ALL""",
        ),
        "slots": (
            ("edges", "below"),
            """
        SELECT e.document_id, e.position AS table_position, coalesce(cell.row_index, 0) AS row_index,
               coalesce(cell.column_index, 0) AS column_index, coalesce(b.child_text, '') AS cell_text
        FROM edges e JOIN ocr_rows t ON t.document_id = e.document_id AND t.position = e.position AND t.block_type = 'TABLE'
        JOIN ocr_rows cell ON cell.document_id = e.document_id AND cell.block_id = e.child_id AND cell.block_type = 'CELL'
        LEFT JOIN below b ON b.document_id = cell.document_id AND b.position = cell.position
        WHERE e.rel = 'CHILD'
        QUALIFY row_number() OVER (PARTITION BY e.document_id, e.position, cell.row_index, cell.column_index ORDER BY e.c DESC) = 1""",
        ),
        "table_rows": (
            ("slots",),
            """
        SELECT document_id, table_position, row_index, list(cell_text ORDER BY column_index) AS cells FROM slots GROUP BY ALL""",
        ),
        "fields": (
            ("edges", "below"),
            """
        SELECT k.tenant_id, k.document_id, k.position, own.child_text AS key, coalesce(v.child_text, '') AS value
        FROM ocr_rows k JOIN below own ON own.document_id = k.document_id AND own.position = k.position
        LEFT JOIN (
            SELECT e.document_id, e.position, coalesce(b.child_text, '') AS child_text
            FROM edges e LEFT JOIN ocr_rows t ON t.document_id = e.document_id AND t.block_id = e.child_id
            LEFT JOIN below b ON b.document_id = t.document_id AND b.position = t.position
            WHERE e.rel = 'VALUE'
            QUALIFY row_number() OVER (PARTITION BY e.document_id, e.position ORDER BY e.c DESC) = 1
        ) v ON v.document_id = k.document_id AND v.position = k.position
        WHERE k.block_type = 'KEY_VALUE_SET' AND k.entity_types = 'KEY' AND own.child_text <> ''""",
        ),
        "extracted": (
            ("table_rows", "fields", "ocr_rows"),
            """
        SELECT o.tenant_id, o.document_id, concat_ws(chr(10), l.lines, t.rendered) AS raw_text, coalesce(t.tables, 0) AS tables,
               coalesce(f.pairs, '') AS key_value_pairs, t.tables IS NOT NULL AS contains_table_like_text, o.page_count
        FROM (SELECT tenant_id, document_id, count(*) FILTER (block_type = 'PAGE') AS page_count FROM ocr_rows GROUP BY ALL) o
        LEFT JOIN (SELECT document_id, string_agg(text, chr(10) ORDER BY position) AS lines
                   FROM ocr_rows WHERE block_type = 'LINE' AND text IS NOT NULL GROUP BY ALL) l ON l.document_id = o.document_id
        LEFT JOIN (SELECT document_id, count(*) AS tables, string_agg(chr(10) || body || chr(10), chr(10) ORDER BY table_position) AS rendered FROM (
                       SELECT document_id, table_position, string_agg(array_to_string(list_transform(cells,
                              lambda c: CASE WHEN length(c) < 20 THEN rpad(c, 20, ' ') ELSE c END), '    '), chr(10) ORDER BY row_index) AS body
                       FROM table_rows GROUP BY ALL) GROUP BY ALL) t ON t.document_id = o.document_id
        LEFT JOIN (SELECT document_id, string_agg(key || '=' || value, ';' ORDER BY position) AS pairs FROM fields GROUP BY ALL) f
               ON f.document_id = o.document_id""",
        ),
        "ocr_docs": (
            ("extracted",),
            """SELECT tenant_id, document_id, raw_text AS text, contains_table_like_text AS flagged, 'workpaper' AS doc_type,
            'ocr://' || tenant_id || '/' || document_id AS source_uri FROM extracted""",
        ),
    }
)

CTES.update(chunk_ctes("o_", "ocr_docs", "doc_type, source_uri,"))

_CHANGE = """
    SELECT document_id || suffix AS chunk_id, tenant_id, document_id, doc_type, source_uri, '2 ' || title AS text
    FROM (SELECT *, unnest(['::chunk::0', '::title']) AS suffix FROM docs)"""

ORACLE = {
    "documents_since": sql(
        f"""SELECT tenant_id, document_id, {_fingerprint('title')}, doc_type, classification, retention_state, {stamp('updated_at')},
        source_uri, {_fingerprint('text')} FROM docs WHERE updated_at >= TIMESTAMP '2024-06-01 00:00:00'""",
        "docs",
    ),
    "source_health": " UNION ALL ".join(
        f"SELECT '{t}' AS source, count(*) AS row_count FROM {t}"
        for t in ("documents", "customer", "orders", "lineitem", "part", "events", "embeddings", "conversations")
    ),
    "document_validation": sql(
        f"""SELECT document_id, doc_type, retention_state, {_VALIDATION} AS validation_errors, {_VALIDATION} = '' AS valid FROM raw""",
        "docs", extra={"raw": _RAW},
    ),
    "normalize_text": sql(f"SELECT document_id, {_fingerprint('body', 'text')} FROM normal", "normal"),
    "paragraphs": sql(
        f"SELECT document_id, pno - 1 AS paragraph_index, kind, {_fingerprint('block', 'text')} FROM paragraphs", "paragraphs"
    ),
    "table_paragraphs": sql(
        "SELECT document_id, pno - 1 AS paragraph_index, kind, block AS text FROM t_paragraphs", "t_paragraphs"
    ),
    "sentence_windows": sql(
        f"""SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY pno, ord) - 1 AS fragment_index, kind,
        {_fingerprint('text')} FROM fragments""",
        "fragments",
    ),
    "chunk_documents": sql(
        f"""SELECT chunk_id, tenant_id, document_id, {_fingerprint('title')}, doc_type, classification, retention_state, source_uri,
        chunk_index, chunk_kind, {_fingerprint('text')} FROM chunks""",
        "chunks",
    ),
    "chunk_table_documents": sql(
        "SELECT chunk_id, tenant_id, document_id, chunk_index, chunk_kind, text FROM t_chunks", "t_chunks"
    ),
    "chunk_stats": sql(
        """SELECT tenant_id, count(*) AS chunk_count, min(length(text)) AS min_chars, max(length(text)) AS max_chars,
        round_even(avg(length(text)), 1) AS mean_chars, round_even(median(length(text)), 1) AS median_chars,
        round_even(avg(length(text)), 1) BETWEEN 200 AND 400 AS mean_in_target_range FROM chunks GROUP BY ALL""",
        "chunks",
    ),
    "chunk_kinds": sql(
        "SELECT tenant_id, chunk_kind, count(*) AS chunk_count FROM t_chunks GROUP BY ALL", "t_chunks"
    ),
    "chunk_overlap": sql(
        """SELECT tenant_id, count(*) FILTER (chunk_index > 0) AS pairs, count(*) FILTER (chunk_index > 0 AND tail <> '' AND contains(text, left(tail, 40))) AS overlapping_pairs,
        coalesce(round_even(count(*) FILTER (chunk_index > 0 AND tail <> '' AND contains(text, left(tail, 40))) / nullif(count(*) FILTER (chunk_index > 0), 0), 2), 0.0) AS overlap_pair_rate FROM (
            SELECT tenant_id, text, string_split(lag(text) OVER (PARTITION BY document_id ORDER BY chunk_index), '. ')[-1] AS tail,
                   chunk_index FROM chunks) GROUP BY ALL""",
        "chunks",
    ),
    "eval_table_detection": sql(
        """SELECT tp AS true_positives, fp AS false_positives, fn AS false_negatives,
        coalesce(round_even(tp / nullif(tp + fp, 0), 2), 0.0) AS precision, coalesce(round_even(tp / nullif(tp + fn, 0), 2), 0.0) AS recall
        FROM (SELECT count(*) FILTER (expected AND predicted) AS tp, count(*) FILTER (NOT expected AND predicted) AS fp,
                     count(*) FILTER (expected AND NOT predicted) AS fn FROM (
            SELECT l_returnflag <> 'A' AS expected, coalesce(predicted, false) AS predicted FROM lineitem LEFT JOIN (
                SELECT document_id, bool_or(chunk_kind = 'table_fragment') AS predicted FROM t_chunks GROUP BY ALL) p
            ON p.document_id = 'ship_' || l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey || '_' || CAST(round(l_extendedprice * 100) AS BIGINT)))""",
        "t_chunks",
    ),
    "chunk_upsert": sql(
        f"""SELECT chunk_id, tenant_id, document_id, doc_type, classification, retention_state, source_uri,
        CAST(length(text) AS DOUBLE) AS embedding, '2024-06-01 00:00:00' AS created_at, {_fingerprint('text', 'chunk_text')} FROM (
            SELECT c.chunk_id, c.tenant_id, c.document_id, c.doc_type, c.classification,
                   CASE WHEN n.chunk_id IS NULL THEN c.retention_state ELSE 'archived' END AS retention_state, c.source_uri,
                   CASE WHEN n.chunk_id IS NULL THEN c.text ELSE n.text END AS text
            FROM chunks c LEFT JOIN change n ON n.chunk_id = c.chunk_id
            UNION ALL
            SELECT chunk_id, tenant_id, document_id, doc_type, 'restricted', 'archived', source_uri, text FROM change
            WHERE chunk_id NOT IN (SELECT chunk_id FROM chunks))""",
        "chunks", extra={"change": _CHANGE},
    ),
    "ocr_blocks": sql(
        "SELECT tenant_id, document_id, CAST(position AS BIGINT) AS position, block_id, block_type, text, row_index, column_index, entity_types FROM ocr_rows",
        "ocr_rows",
    ),
    "ocr_lines": sql(
        """SELECT tenant_id, document_id, CAST(position AS BIGINT) AS position, text FROM ocr_rows
        WHERE block_type = 'LINE' AND text IS NOT NULL""",
        "ocr_rows",
    ),
    "ocr_tables": sql(
        """SELECT b.tenant_id, r.document_id, CAST(r.table_position AS BIGINT) AS table_position,
        string_agg(array_to_string(cells, '|'), ';' ORDER BY r.row_index) AS "table"
        FROM table_rows r JOIN ocr_rows b ON b.document_id = r.document_id AND b.position = r.table_position GROUP BY ALL""",
        "table_rows",
    ),
    "ocr_key_values": sql(
        "SELECT tenant_id, document_id, CAST(position AS BIGINT) AS position, key, value FROM fields", "fields"
    ),
    "ocr_documents": sql("SELECT * FROM extracted", "extracted"),
    "ocr_to_documents": sql(
        "SELECT chunk_id, tenant_id, document_id, doc_type, source_uri, chunk_kind, text FROM o_chunks", "o_chunks"
    ),
}
