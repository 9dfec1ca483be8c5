"""Spend analytics over a latest snapshot of contracts (customer, supplier, category, region, amount, sign_date).

Amounts are decimal(18,2): sums are exact and do not depend on their order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spendloom.operators.scope import digits


def _totals() -> list[Column]:
    return [F.sum("amount").alias("total_spend"), F.count(F.lit(1)).alias("contract_count")]


def total_by_customer(contracts: DataFrame) -> DataFrame:
    """(customer, total_spend, contract_count) of positive customers."""
    return contracts.where("customer > 0").groupBy("customer").agg(*_totals())


def by_category(contracts: DataFrame, length: int = 4) -> DataFrame:
    """(category, total_spend, contract_count) of codes with at least ``length`` digits, cut to them."""
    code = digits(F.col("category"), length)
    return contracts.where(F.length(code) == length).groupBy(code.alias("category")).agg(*_totals())


def by_region(contracts: DataFrame, names: DataFrame, unknown: str = "Unknown region") -> DataFrame:
    """(region, region_name, total_spend, contract_count) by the first two characters of the region code.

    ``names`` (code, name) gives each prefix the name of its smallest code. Spend is summed before names are joined.
    """
    prefix = F.substring("region", 1, 2)
    spend = contracts.where(F.length("region") >= 2).groupBy(prefix.alias("region")).agg(*_totals())
    named = names.where(F.length("code") >= 2).groupBy(F.substring("code", 1, 2).alias("__prefix")).agg(F.min_by("name", "code").alias("__name"))
    joined = spend.join(named, F.col("region") == F.col("__prefix"), "left")
    return joined.select("region", F.coalesce("__name", F.lit(unknown)).alias("region_name"), "total_spend", "contract_count")


def supplier_concentration(contracts: DataFrame, min_sample: int = 5) -> DataFrame:
    """(customer, hhi, supplier_count, top_share, band) of customers with at least ``min_sample`` contracts.

    A share is a supplier's spend of the customer's total to six places, hhi the sum of their squares. Suppliers with
    id 0 or no spend count in the total only. Both aggregates come from one grouping by (customer, supplier).
    """
    pairs = contracts.where("customer > 0").groupBy("customer", "supplier").agg(*_totals())
    own = Window.partitionBy("customer")
    pairs = pairs.withColumns({"total": F.sum("total_spend").over(own).cast("decimal(18,2)"), "n": F.sum("contract_count").over(own)})
    share = F.round(F.col("total_spend").cast("decimal(18,2)") / F.col("total"), 6).cast("decimal(12,6)")
    kept = pairs.where((F.col("n") >= max(1, min_sample)) & (F.col("supplier") > 0) & (F.col("total_spend") > 0) & (F.col("total") > 0))
    out = kept.withColumn("share", share).groupBy("customer").agg(
        F.round(F.sum(F.col("share") * F.col("share")), 6).cast("decimal(12,6)").alias("hhi"), F.count(F.lit(1)).alias("supplier_count"), F.max("share").alias("top_share")
    )
    return out.withColumn("band", F.when(F.col("hhi") < 0.15, "low").when(F.col("hhi") <= 0.25, "moderate").otherwise("high"))


def year_over_year(contracts: DataFrame, start_year: int | None = None) -> DataFrame:
    """(year, total_spend, contract_count, change_pct): change against the last year that has rows, to two places.

    change_pct is null for the first year and after a total that is not positive. Years before ``start_year`` serve
    for comparison only; give the contracts of one year more.
    """
    years = contracts.groupBy(F.year("sign_date").alias("year")).agg(*_totals())
    before = F.lag("total_spend").over(Window.orderBy("year")).cast("decimal(18,2)")  # one row a year
    change = F.when(before > 0, F.round((F.col("total_spend").cast("decimal(18,2)") - before) * 100 / before, 2))
    out = years.withColumn("change_pct", change)
    return out if start_year is None else out.where(F.col("year") >= start_year)


def customer_volume(contracts: DataFrame, years: tuple[int, int]) -> DataFrame:
    """(customer, contract_count, total_spend) in a range of years."""
    return contracts.where(F.year("sign_date").between(*years)).groupBy("customer").agg(*_totals())


def daily_rollup(contracts: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, day, month, total_spend, contract_count) of contracts with a positive amount; month serves as partition."""
    day = F.to_date("sign_date")
    rows = contracts.where("amount > 0").groupBy(*by, day.alias("day")).agg(*_totals())
    return rows.withColumn("month", F.date_format("day", "yyyyMM").cast("int"))


def merge_rollups(parts: Sequence[DataFrame], by: Sequence[str]) -> DataFrame:
    """Adds rollups of disjoint rows up."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*by).agg(F.sum("total_spend").alias("total_spend"), F.sum("contract_count").alias("contract_count"))


def analytics_bundle(contracts: DataFrame, names: DataFrame, min_sample: int = 5) -> DataFrame:
    """Five spend queries over one filtered snapshot, as rows (section, key, value, contract_count).

    The section 'total' has the sum of contract counts. Callers who compute the snapshot at length persist it.
    """
    base = contracts.select("customer", "supplier", "category", "region", "amount", "sign_date")
    rows = lambda df, section, key, value, n: df.select(F.lit(section).alias("section"), F.col(key).cast("string").alias("key"), F.col(value).cast("double").alias("value"), n.cast("long").alias("contract_count"))
    n = F.col("contract_count")
    by_customer = total_by_customer(base)
    out = rows(by_customer, "customer", "customer", "total_spend", n)
    out = out.unionByName(rows(by_category(base, 2), "category", "category", "total_spend", n))
    out = out.unionByName(rows(by_region(base, names), "region", "region", "total_spend", n))
    out = out.unionByName(rows(supplier_concentration(base, min_sample), "concentration", "customer", "hhi", F.col("supplier_count")))
    out = out.unionByName(rows(year_over_year(base), "year", "year", "total_spend", n))
    whole = by_customer.agg(F.lit("all").alias("k"), F.sum("total_spend").alias("v"), F.sum("contract_count").alias("contract_count"))
    return out.unionByName(rows(whole, "total", "k", "v", n))
