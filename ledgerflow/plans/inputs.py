"""The given tables brought into the shapes the operators take.

Everything here is derived row by row from whole tables, so it grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow import schemas

# Fixed value: the reporting date of every query that depends on "today".
AS_OF = "2001-07-15"

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread_out(rows: DataFrame) -> DataFrame:
    """Rows over as many tasks as the session asks for in `spark.ledgerflow.input.partitions`, for heavy work on tables
    stored in too few files; otherwise as they are stored."""
    tasks = rows.sparkSession.conf.get("spark.ledgerflow.input.partitions", None)
    return rows.repartition(int(tasks)) if tasks else rows


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _when_multiple(column: Column, of: int, yes, no) -> Column:
    return F.when(column % of == 0, yes).otherwise(no)


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OLTP invoices: every order with its customer; the tenant is the customer's nation."""
    customer = table(spark, sf_dir, "customer")
    orders = table(spark, sf_dir, "orders")
    day = F.col("o_orderdate").cast("date")
    status = F.when(F.col("o_orderstatus") == "F", "paid").when(F.col("o_orderstatus") == "O", "open").otherwise("overdue")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        _text("inv_", F.col("o_orderkey")).alias("invoice_id"),
        _text("tenant_", F.col("c_nationkey")).alias("tenant_id"),
        _text("cust_", F.col("c_custkey")).alias("customer_id"),
        _text("eng_", F.col("c_nationkey"), "_", F.col("c_mktsegment")).alias("engagement_id"),
        _text("INV-", F.col("o_orderkey")).alias("invoice_number"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("invoice_amount"),
        F.lit("USD").alias("currency"),
        status.alias("status"),
        day.alias("invoice_date"),
        F.date_add(day, 30).alias("due_date"),
        F.date_add(day, 1).cast("timestamp").alias("updated_at"),
        F.col("o_orderkey").alias("k"),
    )


def _json_field(name: str, value: Column) -> Column:
    return _text(f'"{name}":"', value, '"')


def bronze_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice change events with updates, deletes, redeliveries, late events and bad payloads."""
    k = F.col("k")
    rows = invoices(spark, sf_dir)
    rows = rows.withColumn("v", F.explode(_when_multiple(k, 3, F.array(F.lit(1), F.lit(2)), F.array(F.lit(1)))))
    rows = rows.withColumn("copy", F.explode(_when_multiple(k, 5, F.array(F.lit(0), F.lit(1)), F.array(F.lit(0)))))
    v, copy = F.col("v"), F.col("copy")
    # Defects depend on the version too: an update may be valid where the creation is not, and the other way round.
    amount = _when_multiple(k + 4 * (v - 1), 11, F.lit("n/a"), (F.col("invoice_amount") + 10 * (v - 1)).cast("decimal(18,2)").cast("string"))
    fields = [_json_field(f, F.col(f)) for f in ("customer_id", "engagement_id", "invoice_number")]
    fields += [_json_field("invoice_amount", amount), _json_field("currency", F.col("currency")), _json_field("status", F.col("status"))]
    due = _when_multiple(k + 5 * (v - 1), 13, F.lit(None).cast("string"), _json_field("due_date", F.col("due_date")))
    fields += [due, _json_field("invoice_date", _when_multiple(k + 6 * (v - 1), 17, F.lit(" "), F.col("invoice_date").cast("string")))]
    changed = F.date_add("invoice_date", v).cast("timestamp")
    late = F.when((v == 1) & (k % 7 == 0), 9).otherwise(0)
    emitted = F.date_add("invoice_date", v + late).cast("timestamp") + F.make_dt_interval(hours=copy)
    return rows.select(
        F.lit("cdc.invoices").alias("topic"),
        (k % 4).cast("int").alias("partition"),
        (k * 10 + v + copy).alias("offset"),
        _text("inv_", k, "_v", v).alias("event_id"),
        F.lit("invoice").alias("entity_name"),
        F.when(v == 1, "create").when(k % 19 == 0, "delete").otherwise("update").alias("op"),
        "tenant_id",
        F.col("invoice_id").alias("entity_id"),
        changed.alias("updated_at"),
        emitted.alias("emitted_at"),
        (k * 10 + v + copy).alias("source_sequence"),
        _text("{", F.concat_ws(",", *fields), "}").alias("payload_json"),
        F.lit("oltp").alias("source_system"),
        _text("batch_", v).alias("batch_id"),
        F.lit("invoices").alias("source_file"),
        F.lit("1").alias("event_version"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The invoice events as wire messages; some partitions also carry broken values or entities that are not published."""
    events = bronze_invoices(spark, sf_dir)
    stamp = "yyyy-MM-dd'T'HH:mm:ss"

    def wire(entity: Column) -> Column:
        fields = [
            F.date_format(f, stamp).alias(f) if f in ("updated_at", "emitted_at")
            else entity.alias(f) if f == "entity_name" else F.col(f).cast("string").alias(f)
            for f in (*schemas.CDC_REQUIRED, *schemas.CDC_OPTIONAL)
        ]
        return F.to_json(F.struct(*fields))

    broken, foreign = F.col("offset") % 101 == 0, F.col("offset") % 103 == 0
    values = F.array_compact(
        F.array(wire(F.col("entity_name")), F.when(broken, F.lit("{bad")), F.when(foreign, wire(F.lit("payroll"))))
    )
    return events.select("topic", "partition", "offset", "emitted_at", F.explode(values).alias("value"))


def _entity_events(rows: DataFrame, entity: str, event_id: Column, op: Column, tenant: Column, key: Column, version: Column, payload: Column) -> DataFrame:
    return rows.select(
        event_id.alias("event_id"),
        F.lit(entity).alias("entity_name"),
        op.alias("op"),
        tenant.alias("tenant_id"),
        key.alias("entity_id"),
        F.date_add(F.lit("2001-01-01").cast("date"), version).cast("timestamp").alias("updated_at"),
        F.date_add(F.lit("2001-01-01").cast("date"), version).cast("timestamp").alias("emitted_at"),
        version.cast("long").alias("source_sequence"),
        payload.alias("payload_json"),
        _text("batch_", version).alias("batch_id"),
    )


def bronze_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer change events; some customers are renamed, some lack a name."""
    k, v = F.col("c_custkey"), F.col("v")
    rows = table(spark, sf_dir, "customer").withColumn(
        "v", F.explode(_when_multiple(k, 3, F.array(F.lit(1), F.lit(2)), F.array(F.lit(1))))
    )
    name = F.when(k % 50 == 0, " ").when(v == 2, _text(F.col("c_name"), " (renamed)")).otherwise(F.col("c_name"))
    status = F.when(F.col("c_acctbal") < 0, "inactive").otherwise("active")
    payload = _text("{", _json_field("customer_name", name), ",", _json_field("customer_status", status), "}")
    return _entity_events(
        rows, "customer", _text("evc_", k, "_v", v), F.when(v == 1, "create").otherwise("update"),
        _text("tenant_", F.col("c_nationkey")), _text("cust_", k), v, payload,
    )


def bronze_engagements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One engagement per nation and market segment that has customers; one of them lacks a name."""
    nation, segment = F.col("c_nationkey"), F.col("c_mktsegment")
    rows = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").alias("first_customer"))
    name = F.when((nation == 0) & (segment == "FURNITURE"), " ").otherwise(_text(segment, " audit"))
    status = F.when(segment == "MACHINERY", "closed").otherwise("active")
    payload = _text(
        "{", _json_field("customer_id", _text("cust_", F.col("first_customer"))), ",",
        _json_field("engagement_name", name), ",", _json_field("engagement_status", status), "}",
    )
    return _entity_events(
        rows, "engagement", _text("eve_", nation, "_", segment), F.lit("create"), _text("tenant_", nation),
        _text("eng_", nation, "_", segment), F.lit(1), payload,
    )


def bronze_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One control per part, tied to an engagement; some are deleted."""
    k, size = F.col("p_partkey"), F.col("p_size")
    segment = F.element_at(F.array(*[F.lit(s) for s in SEGMENTS]), (k % 5 + 1).cast("int"))
    severity = F.when(size <= 16, "low").when(size <= 33, "medium").otherwise("high")
    payload = _text(
        "{", _json_field("engagement_id", _text("eng_", k % 25, "_", segment)), ",",
        _json_field("control_name", F.col("p_name")), ",", _json_field("severity", severity), ",",
        _json_field("status", F.when(size % 2 == 0, "closed").otherwise("open")), ",",
        _json_field("exception_count", size % 4), "}",
    )
    return _entity_events(
        table(spark, sf_dir, "part"), "control", _text("evx_", k), _when_multiple(k, 23, F.lit("delete"), F.lit("create")),
        _text("tenant_", k % 25), _text("ctrl_", k), F.lit(1), payload,
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document records; a line of the given text is a paragraph, the first one is the title."""
    k = F.col("doc_id")
    kinds = F.array(*[F.lit(t) for t in schemas.DOC_TYPES])
    changed = F.date_add(F.lit("2024-01-01").cast("date"), (k % 365).cast("int")).cast("timestamp")
    return spread_out(table(spark, sf_dir, "documents")).select(
        _text("tenant_", F.expr("substring(source, 4)")).alias("tenant_id"),
        _text("doc_", k).alias("document_id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.element_at(kinds, (k % 4 + 1).cast("int")).alias("doc_type"),
        _when_multiple(k, 2, F.lit("confidential"), F.lit("internal")).alias("classification"),
        F.when(k % 10 == 0, "archived").when(k % 10 == 5, "legal_hold").otherwise("active").alias("retention_state"),
        changed.alias("created_at"),
        changed.alias("updated_at"),
        F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"),
        _text("docs://", F.col("source"), "/", k).alias("source_uri"),
        F.lit(False).alias("contains_table_like_text"),
    )


def raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document records as a source might deliver them: some without a title or outside the domains."""
    k = F.substring_index("document_id", "_", -1).cast("long")
    return (
        documents(spark, sf_dir)
        .withColumn("title", F.when(k % 43 == 0, F.lit(None)).otherwise(F.col("title")))
        .withColumn("doc_type", F.when(k % 37 == 0, "memo").otherwise(F.col("doc_type")))
        .withColumn("retention_state", F.when(k % 41 == 0, "expired").otherwise(F.col("retention_state")))
    )


def oltp_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The four relational source tables."""
    changed = F.lit("2001-01-01").cast("timestamp").alias("updated_at")
    nation, segment, k, size = F.col("c_nationkey"), F.col("c_mktsegment"), F.col("p_partkey"), F.col("p_size")
    customers = table(spark, sf_dir, "customer")
    engagements = customers.groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").alias("first_customer"))
    owner = F.element_at(F.array(*[F.lit(s) for s in SEGMENTS]), (k % 5 + 1).cast("int"))
    return {
        "customers": customers.select(
            _text("cust_", F.col("c_custkey")).alias("customer_id"), _text("tenant_", nation).alias("tenant_id"), F.col("c_name").alias("customer_name"),
            F.when(F.col("c_acctbal") < 0, "inactive").otherwise("active").alias("customer_status"), changed,
        ),
        "engagements": engagements.select(
            _text("eng_", nation, "_", segment).alias("engagement_id"), _text("tenant_", nation).alias("tenant_id"),
            _text("cust_", F.col("first_customer")).alias("customer_id"), _text(segment, " audit").alias("engagement_name"),
            F.when(segment == "MACHINERY", "closed").otherwise("active").alias("engagement_status"), changed,
        ),
        "invoices": invoices(spark, sf_dir).drop("k"),
        "controls": table(spark, sf_dir, "part").select(
            _text("ctrl_", k).alias("control_id"), _text("tenant_", k % 25).alias("tenant_id"),
            _text("eng_", k % 25, "_", owner).alias("engagement_id"), F.col("p_name").alias("control_name"),
            F.when(size <= 16, "low").when(size <= 33, "medium").otherwise("high").alias("severity"),
            F.when(size % 2 == 0, "closed").otherwise("open").alias("status"), (size % 4).cast("int").alias("exception_count"), changed,
        ),
    }


def line_document_id() -> Column:
    """An order line has no key of its own; these columns together tell lines apart."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return _text("ship_", *[p for c in (F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")) for p in (c, "_")], cents)


def table_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One short workpaper per order line: a sentence, a small table, a sentence."""
    body = _text(
        "Shipment of order ", F.col("l_orderkey"), ".\n\nPart    Quantity\n", F.col("l_partkey"), "    ",
        F.col("l_quantity").cast("int"), "\n\nReviewed. Signed by supplier ", F.col("l_suppkey"), ".",
    )
    changed = F.col("l_shipdate").cast("timestamp")
    return table(spark, sf_dir, "lineitem").select(
        _text("tenant_", F.col("l_suppkey") % 25).alias("tenant_id"),
        line_document_id().alias("document_id"),
        F.lit("Shipment").alias("title"),
        F.lit("workpaper").alias("doc_type"),
        F.lit("internal").alias("classification"),
        F.lit("active").alias("retention_state"),
        changed.alias("created_at"),
        changed.alias("updated_at"),
        body.alias("text"),
        F.concat(F.lit("ship://"), line_document_id()).alias("source_uri"),
        (F.col("l_returnflag") != "R").alias("contains_table_like_text"),
    )


def _block(kind: str, block_id: Column | str, text=None, row=None, column=None, entity: str | None = None, children=None, value=None) -> Column:
    relationships = []
    for rel, ids in (("CHILD", children), ("VALUE", value)):
        if ids:
            relationships.append(F.struct(F.lit(rel).alias("Type"), F.array(*[F.lit(i) for i in ids]).alias("Ids")))
    none = F.lit(None)
    return F.struct(
        (F.lit(block_id) if isinstance(block_id, str) else block_id).alias("Id"),
        F.lit(kind).alias("BlockType"),
        (none if text is None else F.lit(text) if isinstance(text, str) else text.cast("string")).cast("string").alias("Text"),
        F.lit(row).cast("int").alias("RowIndex"),
        F.lit(column).cast("int").alias("ColumnIndex"),
        (F.array(F.lit(entity)) if entity else none.cast("array<string>")).alias("EntityTypes"),
        (F.array(*relationships) if relationships else none.cast("array<struct<Type:string,Ids:array<string>>>")).alias("Relationships"),
    )


def ocr_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One OCR result per order: two lines, a table (two for some orders), two form fields."""
    k = F.col("o_orderkey")
    words = F.split("o_orderpriority", " ")
    blocks = [
        _block("PAGE", "p1"),
        _block("LINE", "l1", _text("Order ", k)),
        _block("LINE", "l2", _text("Customer ", F.col("o_custkey"))),
        _block("LINE", "l3"),
        # Cells are listed out of order; c9 lies on the slot of c3 and comes later; "gone" does not exist.
        _block("TABLE", "t1", children=["c2", "c1", "gone", "c4", "c3", "w1", "c9"]),
        _block("CELL", "c1", row=1, column=1, children=["w1"]),
        _block("CELL", "c2", row=1, column=2, children=["w2", "w3"]),
        _block("CELL", "c3", row=2, column=1, children=["w4"]),
        _block("CELL", "c4", row=2, column=2, children=["w5", "w6"]),
        _block("CELL", "c9", row=2, column=1, children=["w7"]),
        _block("WORD", "w1", "Field"),
        _block("WORD", "w2", "Recorded"),
        _block("WORD", "w3", "value"),
        _block("WORD", "w4", "Replaced"),
        _block("WORD", "w5", F.element_at(words, 1)),
        _block("WORD", "w6", F.get(words, F.lit(1))),
        _block("WORD", "w7", "Priority"),
        _block("KEY_VALUE_SET", "k1", entity="KEY", children=["w8"], value=["v0", "v1"]),
        _block("KEY_VALUE_SET", "v0", entity="VALUE", children=["w1"]),
        _block("KEY_VALUE_SET", "v1", entity="VALUE", children=["w9", "w2"]),
        _block("KEY_VALUE_SET", "k2", entity="KEY", value=["v1"]),
        _block("KEY_VALUE_SET", "k3", entity="KEY", children=["w3"]),
        _block("WORD", "w8", "Status"),
        _block("WORD", "w9", F.col("o_orderstatus")),
    ]
    second = [
        _block("TABLE", "t2", children=["d1"]),
        _block("CELL", "d1", row=1, column=1, children=["x1"]),
        _block("WORD", "x1", F.col("o_totalprice").cast("decimal(18,2)")),
    ]
    base = F.array(*blocks)
    return table(spark, sf_dir, "orders").select(
        _text("tenant_", F.col("o_custkey") % 25).alias("tenant_id"),
        _text("ocr_", k).alias("document_id"),
        F.when(k % 4 == 0, F.concat(base, F.array(*second))).otherwise(base).cast(schemas.OCR_RESULT["Blocks"].dataType).alias("Blocks"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index rows: every embedding, its label as the tenant."""
    k = F.col("vec_id")
    kinds = F.array(*[F.lit(t) for t in schemas.DOC_TYPES])
    return table(spark, sf_dir, "embeddings").select(
        _text("tenant_", F.col("label")).alias("tenant_id"),
        _text("vec_", k).alias("chunk_id"),
        F.element_at(kinds, (k % 4 + 1).cast("int")).alias("doc_type"),
        _when_multiple(k, 10, F.lit("archived"), F.lit("active")).alias("retention_state"),
        "embedding",
    )


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as a query; a third of them ask for one kind of document only."""
    rows = vectors(spark, sf_dir)
    k = F.substring_index("chunk_id", "_", -1).cast("long")
    return rows.select(
        F.regexp_replace("chunk_id", "vec_", "vq_").alias("question_id"),
        "tenant_id",
        _when_multiple(k, 3, F.col("doc_type"), F.lit(None)).alias("wanted_doc_type"),
        "embedding",
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per customer from four templates; some come from the wrong tenant."""
    k, name = F.col("c_custkey"), F.col("c_name")
    tenant = F.col("c_nationkey") % 20
    text = (
        F.when(k % 4 == 0, _text("What is the outstanding balance for ", name, "?"))
        .when(k % 4 == 1, _text("What does the deferred revenue policy say about ", name, "?"))
        .when(k % 4 == 2, _text("What does the OCR workpaper say about ", name, " and what exact amount is overdue?"))
        .otherwise(_text("Hello from ", name, ", how are you?"))
    )
    # Some labels are wrong, so that the report has misses.
    expected = F.when((k % 4 == 1) | (k % 50 == 0), "rag").when(k % 4 == 2, "mixed_guardrail").otherwise("sql")
    return table(spark, sf_dir, "customer").select(
        _text("q_", k).alias("question_id"),
        _text("tenant_", tenant).alias("tenant_id"),
        _text("tenant_", F.when(k % 97 == 0, tenant + 1).otherwise(tenant)).alias("authenticated_tenant_id"),
        text.alias("question"),
        expected.alias("expected_route"),
        F.date_add(F.lit("2024-01-01").cast("date"), (k % 30).cast("int")).cast("timestamp").alias("asked_at"),
    )


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows retrieved for the questions: the document of a customer's number, whichever tenant owns it."""
    found = documents(spark, sf_dir).select(F.col("document_id").alias("chunk_id"), "tenant_id", F.regexp_replace("document_id", "doc_", "q_").alias("question_id"))
    return found.join(questions(spark, sf_dir).select("question_id"), "question_id")


def retrieval_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known-item search: every active document is asked for by its title."""
    active = documents(spark, sf_dir).where(F.col("retention_state") == "active")
    return active.select(
        F.regexp_replace("document_id", "doc_", "case_").alias("question_id"),
        "tenant_id",
        F.col("title").alias("question"),
        F.array("document_id").alias("expected_document_ids"),
    )


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answered question per event: route, stage timings, retrieval summary and checks."""
    value, n = F.col("value"), F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    route = F.when(kind.isin("click", "signup"), "sql").when(kind == "purchase", "mixed_guardrail").otherwise("rag")
    uses_sql, uses_documents = F.col("route") != "rag", F.col("route") != "sql"
    none = F.lit(None).cast("double")
    timings = F.map_from_arrays(
        F.array(*[F.lit(s) for s in ("validate_tenant", "route", "sql_retrieval", "rag_retrieval", "synthesize", "guardrails", "cache_lookup")]),
        F.array(
            F.lit(1.0), F.lit(2.0), F.when(uses_sql, value * 2).otherwise(none), F.when(uses_documents, value).otherwise(none),
            value * 5, F.lit(0.5), F.lit(0.25),
        ),
    )
    kept = F.col("n") % 5
    return (
        table(spark, sf_dir, "events")
        .withColumn("route", route)
        .withColumn("n", n)
        .select(
            _text("e_", F.col("event_id")).alias("question_id"),
            _text("tenant_", F.col("user_id") % 25).alias("tenant_id"),
            "route",
            F.col("ts").cast("timestamp").alias("asked_at"),
            F.map_filter(timings, lambda _, ms: ms.isNotNull()).alias("timings"),
            F.when(uses_documents, kept).otherwise(0).alias("citation_count"),
            F.when(uses_sql, 1).otherwise(0).alias("sql_row_count"),
            (kind != "error").alias("guardrail_passed"),
            F.when(F.col("event_id") % 97 == 0, "failed").when(F.col("event_id") % 89 == 0, "client_error").otherwise("ok").alias("outcome"),
            F.when(uses_documents, F.lit(4.0)).alias("chunks_returned"),
            F.when(uses_documents, kept.cast("double")).alias("chunks_kept"),
            F.when(uses_documents, F.lit(8000.0)).alias("chunk_budget_chars"),
            F.when(uses_documents, F.col("n") * 80.0).alias("budget_used_chars"),
            F.when(uses_documents, F.col("n") / 100.0).alias("top_hit_score"),
        )
    )


def stage_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One data-stage run per event: times along the way, counts and outcome."""
    value, n = F.col("value"), F.get_json_object("props", "$.k").cast("int")
    emitted = F.col("ts").cast("timestamp")
    seconds = lambda factor: F.make_dt_interval(secs=F.floor(value * factor).cast("decimal(18,6)"))
    return table(spark, sf_dir, "events").select(
        _text("run_", F.col("event_id")).alias("run_id"),
        F.col("event_type").alias("stage"),
        emitted.alias("emitted_at"),
        (emitted + seconds(5)).alias("bronze_at"),
        (emitted + seconds(8)).alias("silver_at"),
        (emitted + seconds(16)).alias("gold_at"),
        (n + 100).alias("records_in"),
        (n + 100 - n % 4).alias("records_out"),
        (n % 4).alias("quarantined"),
        (value * 10).alias("duration_ms"),
        (F.col("event_id") % 200 != 0).alias("succeeded"),
        # Every second failed run still completes.
        (F.col("event_id") % 400 != 0).alias("completed"),
    )


def dense_query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same answers, two seconds apart; for ten minutes of every hour everything takes longer."""
    number = F.substring_index("question_id", "_", -1).cast("long")
    slow = number % 1800 < 300
    return query_log(spark, sf_dir).withColumns(
        {
            "asked_at": F.timestamp_seconds(F.lit(1717200000) + number * 2),
            "timings": F.transform_values("timings", lambda step, ms: F.when(slow & (step == "synthesize"), ms + 5000.0).otherwise(ms)),
        }
    )


def model_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token usage per conversation turn, in either of two spellings or missing."""
    size = F.length("text")
    camel = F.to_json(F.struct(size.alias("inputTokens"), F.col("turn").alias("outputTokens"), (size + F.col("turn")).alias("totalTokens")))
    snake = F.to_json(F.struct(size.alias("input_tokens"), F.col("turn").alias("output_tokens"), (size + F.col("turn")).alias("total_tokens")))
    usage = F.when(F.col("role") == "user", camel).when(F.col("role") == "assistant", snake).otherwise("{}")
    return table(spark, sf_dir, "conversations").select(
        _text("tenant_", F.col("conv_id") % 25).alias("tenant_id"), usage.alias("usage_json")
    )
