from __future__ import annotations

import zlib

import pytest

from ledgerflow.llm import sharding

SCHEMA = "doc_id long, text string, key string, shard int, size string"


def brute(rows, shards):
    """(doc_id, size, checksum) in order, dealt by the middle byte of each row."""
    sized = sorted(
        ((r[0], zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode()) + 1) for r in rows),
        key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]),
    )
    total, before, out, filled = sum(s for *_, s in sized), 0, [], [0] * shards
    for key, crc, size in sized:
        shard = min(shards - 1, (2 * before + size) * shards // (2 * total))
        out.append((key, size, crc, shard, filled[shard]))
        filled[shard] += 1
        before += size
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, type(v).__name__, v or type(v)()) if v is not None else (False,) for v in r))


@pytest.fixture(scope="module")
def rows():
    made = [(i, f"t\u00e9xt {i} " * (i % 37), "k", 1, "s") for i in range(500)]
    return made + [(None, "null id", "k", 1, "s"), (7, None, "k", 1, "s"), (9, "", "k", 1, "s"), (600, "long " * 50_000, "k", 1, "s")] + [(44, "copy", "k", 1, "s")] * 300


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_equals_brute_force(spark, rows, shards):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = [tuple(r) for r in sharding.byte_shards(docs, shards=shards).collect()]
    assert order(got) == order(brute(rows, shards))


def test_sizes_are_near_equal_and_slots_gapless(spark, rows):
    got = sharding.byte_shards(spark.createDataFrame([r for r in rows if r[0] != 600], SCHEMA)).collect()
    sizes = [sum(r["size"] for r in got if r["shard"] == k) for k in range(8)]
    largest = max(r["size"] for r in got)
    assert max(sizes) - min(sizes) <= 2 * largest
    for k in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))


def test_empty_table_and_native_plan(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sharding.byte_shards(docs.limit(0)).count() == 0
    plan = sharding.byte_shards(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_written_shards_hold_every_row_in_place(spark, rows, tmp_path):
    docs = spark.createDataFrame(rows, SCHEMA)
    sharding.write_shards(docs, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    got = [(r["row"]["doc_id"], r["row"]["text"], r["shard"], r["slot"]) for r in back.collect()]
    assert order((a, b) for a, b, _, _ in got) == order((r[0], r[1]) for r in rows)
    places = order((r[0], r[3], r[4]) for r in brute(rows, 8))
    assert order((a, s, slot) for a, _, s, slot in got) == places
