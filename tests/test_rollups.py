"""Rollups under changed, late and repeated versions."""

import random
import tempfile
from datetime import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from spendloom.operators import rollups, spend, versions
from spendloom.sources.shared import listed

SCHEMA = "id long, customer long, amount decimal(18,2), sign_date timestamp_ntz, updated_at timestamp_ntz, seq int"
COLUMNS = ["customer", "amount", "sign_date", "updated_at", "seq"]


def some(seed, n):
    r = random.Random(seed)
    return [(r.randrange(12), r.randrange(1, 4), Decimal(r.choice(["0.00", "5.00", "7.50", "100.25"])), datetime(2024, r.randrange(1, 5), r.randrange(1, 4)), datetime(2024, 5, r.randrange(1, 9)), 100 * seed + k) for k in range(n)]


def rows_of(df):
    return sorted((r.customer, str(r.day), str(r.total_spend), r.contract_count) for r in df.collect())


def test_rollup_equals_a_fresh_one_after_each_batch(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/rollup"
    snapshot = lambda rows: versions.latest(spark.createDataFrame(rows, SCHEMA), ["id"], "updated_at", COLUMNS, ["seq"])
    every = some(0, 10)
    rollups.write_rollup(spend.daily_rollup(snapshot(every), ["customer"]), path)
    for seed in range(1, 5):
        batch = some(seed, 15) + every[:3]
        changes = rollups.snapshot_changes(snapshot(every), spark.createDataFrame(batch, SCHEMA), ["id"], "updated_at", COLUMNS, ["seq"])
        rollups.refresh_rollup(path, rollups.rollup_delta(changes, ["customer"]), ["customer"])
        every += batch
        fresh = spend.daily_rollup(snapshot(every), ["customer"])
        assert rows_of(spark.read.parquet(path)) == rows_of(fresh)
        assert not [n for n in listed(spark, path) if n.startswith("_new")]


def test_only_touched_months_are_written(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/rollup"
    at = lambda m: datetime(2024, m, 1)
    base = [(1, 1, Decimal("5.00"), at(1), at(5), 0), (2, 1, Decimal("6.00"), at(2), at(5), 0), (3, 1, Decimal("7.00"), at(3), at(5), 0)]
    stored = spark.createDataFrame(base, SCHEMA)
    rollups.write_rollup(spend.daily_rollup(stored, ["customer"]), path)
    before = {n: listed(spark, f"{path}/{n}") for n in listed(spark, path)}
    # the contract of February moves to April; a late version of January's changes nothing
    batch = spark.createDataFrame([(2, 1, Decimal("9.00"), at(4), at(6), 1), (1, 9, Decimal("1.00"), at(2), at(4), 1)], SCHEMA)
    changes = rollups.snapshot_changes(stored, batch, ["id"], "updated_at", COLUMNS, ["seq"])
    assert sorted((r.id, r.sign, str(r.amount)) for r in changes.collect()) == [(2, -1, "6.00"), (2, 1, "9.00")]
    assert rollups.refresh_rollup(path, rollups.rollup_delta(changes, ["customer"]), ["customer"]) == [202402, 202404]
    after = {n: listed(spark, f"{path}/{n}") for n in listed(spark, path)}
    assert "month=202402" not in after and all(after[f"month={m}"] == before[f"month={m}"] for m in (202401, 202403))
    assert rows_of(spark.read.parquet(path)) == [(1, "2024-01-01", "5.00", 1), (1, "2024-03-01", "7.00", 1), (1, "2024-04-01", "9.00", 1)]
    none = rollups.rollup_delta(changes.where(F.lit(False)), ["customer"])
    assert rollups.refresh_rollup(path, none, ["customer"]) == []
