from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from ledgerflow import schemas
from ledgerflow.operators import gold, quality, serving, snapshot, upsert
from ledgerflow.plans import inputs, medallion
from ledgerflow.session import materialize, work_dir
from ledgerflow.sources import cdc, oltp
from tests.conftest import collect

SF = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1)


def event(event_id, entity, day, seq, *, op="update", emitted=None, amount="10.50", due="2024-02-01", **over):
    payload = {"customer_id": "c1", "engagement_id": "e1", "invoice_number": "n", "invoice_amount": amount, "currency": "USD",
               "status": "open", "due_date": due, "invoice_date": "2024-01-01"}
    row = dict(
        topic="cdc.invoices", partition=0, offset=seq, event_id=event_id, entity_name="invoice", op=op, tenant_id="t1",
        entity_id=entity, updated_at=T0 + dt.timedelta(days=day), emitted_at=T0 + dt.timedelta(days=day if emitted is None else emitted),
        source_sequence=seq, payload_json=json.dumps({k: v for k, v in payload.items() if v is not None}), source_system="s",
        batch_id="b", source_file=None, event_version=None,
    )
    return Row(**{**row, **over})


SCHEMA = "topic string, partition int, offset long, event_id string, entity_name string, op string, tenant_id string, entity_id string, updated_at timestamp, emitted_at timestamp, source_sequence long, payload_json string, source_system string, batch_id string, source_file string, event_version string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_last_emitted_copy_and_newest_state_win(spark):
    rows = [
        event("a1", "i1", 1, 1, amount="1"),
        event("a1", "i1", 1, 2, emitted=3, amount="2"),
        event("a0", "i1", 0, 3, emitted=9, amount="3"),  # late, but older
        event("b1", "i2", 1, 1),
        event("b2", "i2", 1, 2, amount="7"),
    ]
    for _ in range(3):
        random.shuffle(rows)
        found = snapshot.invoice_candidates(frame(spark, rows))
        assert collect(found, "invoice_id", "event_id", "invoice_amount") == [("i1", "a1", 2.0), ("i2", "b2", 7.0)]


def test_invalid_latest_event_does_not_promote_the_previous_one(spark):
    rows = [event("a1", "i1", 1, 1), event("a2", "i1", 2, 2, amount="n/a", due=" ")]
    validated = snapshot.validate_invoices(snapshot.invoice_candidates(frame(spark, rows)))
    assert snapshot.curated_invoices(validated).count() == 0
    assert validated.first()["quality_errors"] == ["invalid_invoice_amount", "missing_due_date"]


def test_deletes_are_validated_unless_switched_off(spark):
    candidates = snapshot.invoice_candidates(frame(spark, [event("a1", "i1", 1, 1, op="delete", amount=None)]))
    assert snapshot.curated_invoices(snapshot.validate_invoices(candidates)).count() == 0
    kept = snapshot.curated_invoices(snapshot.validate_invoices(candidates, validate_deletes=False)).collect()
    assert [r["is_deleted"] for r in kept] == [True]


def test_all_quality_rules(spark):
    rows = [event("a", "", 1, 1, amount=" ", due="soon", tenant_id=None)]
    errors = snapshot.validate_invoices(snapshot.invoice_candidates(frame(spark, rows))).first()["quality_errors"]
    assert errors == ["missing_tenant_id", "missing_invoice_id", "missing_invoice_amount", "invalid_due_date"]


def test_a_tab_is_content_for_the_blank_rule(spark):
    df = spark.createDataFrame([("\t",), ("  ",), (None,)], "x string")
    counts = quality.error_counts(quality.annotate(df, [quality.missing("x")]))
    assert collect(counts) == [("missing_x", 2)]


def test_broken_messages_keep_their_envelope(spark):
    good = json.dumps({"event_id": "e", "entity_name": "invoice", "op": "create", "updated_at": "2024-01-01T00:00:00", "source_sequence": "x"})
    messages = spark.createDataFrame([("t", 0, 1, "{bad"), ("t", 0, 2, good), ("t", 0, 3, None)], schemas.CDC_MESSAGE)
    rows = {r["offset"]: r for r in cdc.decode(messages).withColumn("corrupt", cdc.is_corrupt()).collect()}
    assert rows[1]["corrupt"] and rows[3]["corrupt"] and not rows[2]["corrupt"]
    assert rows[2]["source_sequence"] is None and rows[2]["updated_at"] == T0
    assert set(rows[1].asDict()) - {"corrupt"} == set(schemas.BRONZE_EVENTS.fieldNames())


def merge_frames(spark):
    target = spark.createDataFrame([("t", "a", 1, "x", 5), ("t", "b", 1, "x", 5)], "tenant string, id string, v int, keep string, seq int")
    source = spark.createDataFrame([("t", "b", 2, "y", 4), ("t", "c", 3, "z", 1)], target.schema)
    return target, source


def test_merge_updates_inserts_and_is_idempotent(spark):
    target, source = merge_frames(spark)
    once = upsert.merge(target, source, ["tenant", "id"])
    want = [("t", "a", 1, "x", 5), ("t", "b", 2, "y", 4), ("t", "c", 3, "z", 1)]
    assert collect(once) == want
    assert collect(upsert.merge(once, source, ["tenant", "id"])) == want


def test_merge_overwrites_only_named_columns_and_obeys_the_guard(spark):
    target, source = merge_frames(spark)
    partial = upsert.merge(target, source, ["tenant", "id"], update=["v"])
    assert ("t", "b", 2, "x", 5) in collect(partial)
    guarded = upsert.merge(target, source, ["tenant", "id"], guard=["seq"])
    assert ("t", "b", 1, "x", 5) in collect(guarded)


def test_merge_reads_and_shuffles_each_side_once(spark):
    target, source = (materialize(df, "merge") for df in merge_frames(spark))
    plan = upsert.merge(target, source, ["tenant", "id"])._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 2 and plan.count("Exchange") == 2 and plan.count("FullOuter") == 1


def test_rows_without_a_key_are_not_added_twice(spark):
    rows = spark.createDataFrame([("t", None, 1, "x", 5)], "tenant string, id string, v int, keep string, seq int")
    target, _ = merge_frames(spark)
    grown = upsert.insert_if_absent(target, rows, ["id"])
    assert grown.count() == 3 and upsert.append_new(grown, rows, ["id"]).count() == 0
    assert upsert.merge(grown, rows, ["tenant", "id"]).count() == 3


def test_append_new_adds_nothing_twice(spark):
    target, source = merge_frames(spark)
    grown = upsert.insert_if_absent(target, source, ["id"])
    assert grown.count() == 3
    assert upsert.append_new(grown, source, ["id"]).count() == 0


def test_published_versions_replace_each_other(spark):
    base = work_dir(spark, "versions")
    assert upsert.published(spark, base) is None
    for version, rows, whole in ((0, 2, True), (1, 5, True), (1, 5, True), (2, 3, False)):
        upsert.publish(spark.range(rows), base, version, whole=whole)
    assert upsert.published(spark, base)[0] == 2
    stored = upsert.read_published(spark, base)
    assert stored.columns == ["id"] and stored.count() == 8


def test_merge_statement_names_every_column():
    text = upsert.merge_statement("silver", "changes", ["k"], ["a"], ["k", "a", "b"])
    assert text == (
        "MERGE INTO silver AS t USING changes AS s ON t.k = s.k WHEN MATCHED THEN UPDATE SET t.a = s.a "
        "WHEN NOT MATCHED THEN INSERT (k, a, b) VALUES (s.k, s.a, s.b)"
    )


@pytest.mark.parametrize(
    ("due", "status", "bucket", "overdue"),
    [
        ("2001-07-15", "open", "current", False), ("2001-07-14", "open", "0_30", True), ("2001-06-15", "paid", "0_30", True),
        ("2001-06-14", "open", "31_60", True), ("2001-05-16", "open", "31_60", True), ("2001-05-15", "open", "61_plus", True),
        ("2001-08-01", "overdue", "current", True), (None, None, "current", False),
    ],
)
def test_aging(spark, due, status, bucket, overdue):
    silver = spark.createDataFrame(
        [("t", "i", "c", "e", "n", 1.0, "USD", status, None if due is None else dt.date.fromisoformat(due), None, T0, "ev", "b", False)],
        schemas.SILVER_INVOICES,
    )
    customers = spark.createDataFrame([("t", "c", "name", "evc")], "tenant_id string, customer_id string, customer_name string, source_event_id string")
    engagements = spark.createDataFrame([], "tenant_id string, engagement_id string, engagement_name string, source_event_id string")
    row = gold.invoice_summary(silver, customers, engagements, "2001-07-15").first()
    assert (row["aging_bucket"], row["is_overdue"], row["customer_name"], row["lineage_ref"]) == (bucket, overdue, "name", None)


def test_unknown_deletion_flag_leaves_gold(spark):
    rows = [event("a1", "i1", 1, 1, op=None), event("b1", "i2", 1, 1)]
    silver = snapshot.curated_invoices(snapshot.validate_invoices(snapshot.invoice_candidates(frame(spark, rows))))
    nothing = silver.where("false")
    customers = nothing.select("tenant_id", "customer_id", F.lit("n").alias("customer_name"), "source_event_id")
    engagements = nothing.select("tenant_id", "engagement_id", F.lit("n").alias("engagement_name"), "source_event_id")
    assert collect(gold.invoice_summary(silver, customers, engagements, "2024-01-01"), "invoice_id") == [("i2",)]


def test_contracts_and_views(spark):
    summary = medallion.gold_invoices(spark, SF)
    assert [(f.name, f.dataType) for f in summary.schema] == [(f.name, f.dataType) for f in schemas.GOLD_INVOICES]
    assert schemas.conform(medallion.silver(spark, SF), schemas.SILVER_INVOICES).columns == schemas.SILVER_INVOICES.fieldNames()
    serving.register_views(summary, medallion.control_summary(spark, SF))
    total = spark.sql(
        "SELECT tenant_id, sum(invoice_amount) AS amount, count(*) AS n FROM v_gold_invoice_summary WHERE tenant_id = ? AND is_overdue GROUP BY tenant_id",
        args=["tenant_3"],
    ).collect()
    bound = serving.overdue_total(summary, "tenant_3").collect()
    assert [(r["tenant_id"], round(r["amount"], 2), r["n"]) for r in total] == [
        (r["tenant_id"], round(r["total_overdue_amount"], 2), r["overdue_invoice_count"]) for r in bound
    ]
    assert spark.table("v_gold_control_exceptions").columns == list(serving.CONTROL_VIEW)


def test_tables_are_created_once(spark):
    spark.sql("DROP TABLE IF EXISTS quarantine_probe")
    for _ in range(2):
        schemas.ensure_table(spark, "quarantine_probe", schemas.QUARANTINED_INVOICES, partition_by=("tenant_id",))
    assert set(spark.table("quarantine_probe").columns) == set(schemas.QUARANTINED_INVOICES.fieldNames())
    spark.sql("DROP TABLE quarantine_probe")


def test_only_published_tables_can_be_read(spark):
    with pytest.raises(ValueError):
        oltp.read_snapshot(spark, "payroll", "/nowhere")


def test_partition_columns_prune_files(spark):
    path = work_dir(spark, "layout")
    gold.write_partitioned(medallion.gold_invoices(spark, SF), path)
    pruned = spark.read.parquet(path).where("tenant_id = 'tenant_3' AND invoice_month = '1998-03'")
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tenant_id" in plan and "tenant_id" in plan


def test_latest_state_limits_groups_before_the_shuffle_and_parses_once(spark):
    plan = medallion.silver(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 4
    assert plan.count("from_json") == 1
    assert "PythonUDF" not in plan and "EvalPython" not in plan


def test_scan_reads_only_needed_columns(spark):
    plan = inputs.invoices(spark, SF).select("tenant_id")._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan
