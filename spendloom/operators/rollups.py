"""Stored daily rollups that stay right when contracts change: a new version takes its old row out and puts its new one in."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendloom.operators.spend import daily_rollup
from spendloom.operators.versions import latest
from spendloom.sources.shared import kept, listed, remove, renamed


def snapshot_changes(stored: DataFrame, batch: DataFrame, keys: Sequence[str], version: str, columns: Sequence[str], ties: Sequence[str] = ()) -> DataFrame:
    """What a batch of versions does to a snapshot: rows (keys, columns, sign), -1 for a row that goes, 1 for one that
    comes.

    ``stored`` has one row a key, ``batch`` any number of versions, late ones among them; both have ``keys`` and
    ``columns``, which include ``version`` and ``ties``. Of keys in the batch the highest version of both counts; keys
    whose row stays the same give nothing. Only keys of the batch are compared.
    """
    columns = list(dict.fromkeys([*columns, version, *ties]))
    newest = latest(batch, keys, version, columns, ties)
    old = stored.select(*(F.col(k).alias(f"__{k}") for k in keys), F.struct(*columns).alias("__old"))
    rank = lambda s: F.struct(*(s[c] for c in dict.fromkeys([version, *ties])))
    both = newest.select(*keys, F.struct(*columns).alias("__new")).join(old, [F.col(k) == F.col(f"__{k}") for k in keys], "left")
    wins = both.where(F.col("__old").isNull() | (rank(F.col("__new")) > rank(F.col("__old"))))
    same = F.col("__new").eqNullSafe(F.col("__old"))
    sides = F.array(F.struct(F.col("__old").alias("r"), F.lit(-1).alias("sign")), F.struct(F.col("__new").alias("r"), F.lit(1).alias("sign")))
    out = wins.where(~same).select(*keys, F.explode(F.filter(sides, lambda x: x["r"].isNotNull())).alias("x"))
    return out.select(*keys, "x.r.*", "x.sign")


def rollup_delta(changes: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, day, total_spend, contract_count, month) to be added to a stored daily rollup; sums and counts may be negative.

    ``changes`` as ``snapshot_changes`` gives them, with amount and sign_date.
    """
    sides = [daily_rollup(changes.where(F.col("sign") == s), by).withColumns({c: F.col(c) * s for c in ("total_spend", "contract_count")}) for s in (-1, 1)]
    return _summed(sides[0].unionByName(sides[1]), by)


def _summed(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    sums = parts.groupBy(*by, "day", "month").agg(F.sum("total_spend").cast("decimal(28,2)").alias("total_spend"), F.sum("contract_count").alias("contract_count"))
    return sums.where((F.col("contract_count") != 0) | (F.col("total_spend") != 0))


def with_delta(rollup: DataFrame, delta: DataFrame, by: Sequence[str]) -> DataFrame:
    """A rollup after a delta; days that no contract is left of are gone."""
    return _summed(rollup.unionByName(delta), by).where(F.col("contract_count") > 0)


def write_rollup(rollup: DataFrame, path: str) -> None:
    """A rollup as Parquet, a folder for each month."""
    rollup.write.partitionBy("month").parquet(path)


def refresh_rollup(path: str, delta: DataFrame, by: Sequence[str]) -> list[int]:
    """Applies a delta to a stored rollup: only the months that it touches are read and written again, which it returns.

    New months are written aside; then each takes the place of the old one by a rename. A month without rows goes.
    """
    spark = delta.sparkSession
    delta = kept(delta)
    months = sorted(r["month"] for r in delta.select("month").distinct().collect())  # as many as there are months
    if not months:
        return []
    old = spark.read.parquet(path).where(F.col("month").isin(months))
    aside = f"{path}/_new-{uuid.uuid4().hex}"
    write_rollup(with_delta(old.select(delta.columns), delta, by), aside)
    written = set(listed(spark, aside))
    for month in months:
        name = f"month={month}"
        remove(spark, f"{path}/{name}")
        if name in written:
            renamed(spark, f"{aside}/{name}", f"{path}/{name}")
    remove(spark, aside)
    return months
