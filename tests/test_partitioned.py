from __future__ import annotations

import os
import random

from ledgerflow.operators import partitioned, upsert
from ledgerflow.session import work_dir
from tests.conftest import collect

SCHEMA = "tenant string, id long, amount double, month string"


def files(base):
    found = {}
    for folder, _, names in os.walk(base):
        for name in names:
            if name.endswith(".parquet"):
                path = os.path.join(folder, name)
                found[path] = os.stat(path).st_mtime_ns
    return found


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_merges_equal_the_whole_merge_and_leave_other_partitions(spark):
    draw, base, by, keys = random.Random(1), work_dir(spark, "parts"), ["tenant", "month"], ["tenant", "id"]
    rows = [(f"t{i % 3}", i, float(i), draw.choice(["01", "02", None, "2024-03"])) for i in range(60)]
    now = frame(spark, rows)
    partitioned.create(now, base, by)
    schema = now.schema
    for version in range(1, 4):
        # Some rows are new, some change, some move to another month, all of them of one tenant.
        tenant = f"t{version % 3}"
        source = frame(spark, [(tenant, i, -float(version), draw.choice(["01", "04"])) for i in range(version % 3, 80, 9)])
        before = files(base)
        partitioned.merge(source, base, keys, by, version)
        partitioned.merge(frame(spark, [("t0", 0, 1e9, "01")]), base, keys, by, version)
        now = frame(spark, [tuple(r) for r in upsert.merge(now, source, keys).collect()])
        assert sorted(map(str, partitioned.read(spark, base, schema, by).collect())) == sorted(map(str, now.collect()))
        after = files(base)
        assert all(after[path] == at for path, at in before.items())
        written = [p for p in after if p not in before and "_manifest" not in p]
        assert written and all(f"/tenant={tenant}/" in p for p in written)
    assert partitioned.manifest(spark, base)[0] == 3


def test_a_merge_that_fails_is_not_seen(spark, monkeypatch):
    base, by = work_dir(spark, "parts"), ["tenant", "month"]
    first = frame(spark, [("t", 1, 1.0, "01"), ("t", 2, 2.0, "02")])
    partitioned.create(first, base, by)
    store = partitioned._store

    def broken(*args):
        store(*args)
        raise OSError("no space")

    monkeypatch.setattr(partitioned, "_store", broken)
    change = frame(spark, [("t", 1, 5.0, "02")])
    try:
        partitioned.merge(change, base, ["tenant", "id"], by, 1)
        raise AssertionError
    except OSError:
        pass
    assert collect(partitioned.read(spark, base, first.schema, by), "id", "amount") == [(1, 1.0), (2, 2.0)]
    monkeypatch.setattr(partitioned, "_store", store)
    partitioned.merge(change, base, ["tenant", "id"], by, 1)
    # The row that moved is in one place alone; the month that it left is empty.
    assert collect(partitioned.read(spark, base, first.schema, by), "id", "amount", "month") == [(1, 5.0, "02"), (2, 2.0, "02")]
    assert partitioned.manifest(spark, work_dir(spark, "none")) is None
