"""Filters, scope joins and referential checks."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def digits(code: Column, n: int | None = None) -> Column:
    """Digits of a code, or the first ``n`` of them."""
    only = F.regexp_replace(code, "[^0-9]", "")
    return only if n is None else F.substring(only, 1, n)


def member_of(column: str, values: Sequence[int]) -> Column:
    """Membership in the unique positive values; an empty list asks nothing."""
    own = sorted({int(v) for v in values if int(v) > 0})
    return F.col(column).isin(own) if own else F.lit(True)


def contract_filter(
    customers: Sequence[int] = (), start: date | str | None = None, end: date | str | None = None, categories: Sequence[str] = (), regions: Sequence[str] = (),
    customer: str = "customer", sign_date: str = "sign_date", category: str = "category", region: str = "region", amount: str = "amount",
) -> Column:
    """The filter bundle of spend queries, to be applied to a latest snapshot: positive amount, customers, inclusive
    dates, first four digits of categories, first two digits of regions. Empty parts ask nothing."""
    out = (F.col(amount) > 0) & member_of(customer, customers)
    if start is not None:
        out = out & (F.col(sign_date) >= F.lit(str(start)).cast("timestamp_ntz"))
    if end is not None:
        out = out & (F.col(sign_date) <= F.lit(str(end)).cast("timestamp_ntz"))
    short = lambda codes, n: sorted({d for c in codes if (d := "".join(x for x in c if x.isdigit())[:n])})
    if own := short(categories, 4):
        out = out & digits(F.col(category), 4).isin(own)
    if own := short(regions, 2):
        out = out & digits(F.col(region), 2).isin(own)
    return out


def entity_filter(customer: int | None = None, supplier: int | None = None, start: str | None = None, end: str | None = None, query: str | None = None,
                  names: Sequence[str] = (), customer_column: str = "customer", supplier_column: str | None = None, date_column: str = "sign_date") -> Column:
    """Customer, supplier (of entities that have one), inclusive days, and text contained in any name, without case."""
    out = F.lit(True)
    if customer:
        out = out & (F.col(customer_column) == customer)
    if supplier and supplier_column:
        out = out & (F.col(supplier_column) == supplier)
    if start:
        out = out & (F.col(date_column) >= F.lit(start).cast("timestamp_ntz"))
    if end:
        out = out & (F.col(date_column) < F.lit(end).cast("timestamp_ntz") + F.expr("interval 1 day"))
    if query and names:
        hit = F.lit(False)
        for n in names:
            hit = hit | F.contains(F.lower(n), F.lit(query.lower()))
        out = out & hit
    return out


def announcement_scope(rows: DataFrame, announcements: DataFrame, owners: Sequence[int], years: Sequence[int], link: str = "announcement_id", customer: str = "customer") -> DataFrame:
    """``rows`` with ``customer`` filled from the announcement where it is 0 or null, and ``reject_reason``.

    ``announcements`` is a latest snapshot (id, owner, year). Reasons: missing_link, out_of_scope (the announcement's
    owner or year is not asked for), non_target (the row's customer is not); null for rows in scope. No row is lost.
    """
    a = announcements.select(F.col("id").alias("__id"), F.col("owner").alias("__owner"), F.col("year").alias("__year"))
    joined = rows.join(a, F.col(link) == F.col("__id"), "left")
    filled = F.when(F.coalesce(F.col(customer), F.lit(0)) > 0, F.col(customer)).otherwise(F.col("__owner"))
    in_scope = member_of("__owner", owners) & F.col("__year").isin(list(years))
    joined = joined.withColumn(customer, filled)
    reason = F.when(F.col("__id").isNull(), "missing_link").when(~in_scope, "out_of_scope").when(~member_of(customer, owners), "non_target")
    return joined.withColumn("reject_reason", reason).drop("__id", "__owner", "__year")


def contract_scope(acts: DataFrame, contracts: DataFrame, link: str = "contract_id", amount: str = "act_sum") -> DataFrame:
    """Acts with their contract's customer, its supplier where theirs is 0 or null, and execution_pct.

    ``contracts`` is a latest snapshot (id, customer, supplier, amount). execution_pct is the act's share of the
    contract in per cent to two places, null without a positive contract sum; reject_reason missing_link marks acts
    without a contract.
    """
    c = contracts.select(F.col("id").alias("__id"), F.col("customer").alias("__customer"), F.col("supplier").alias("__supplier"), F.col("amount").alias("__amount"))
    joined = acts.drop("customer").join(c, F.col(link) == F.col("__id"), "left")
    supplier = F.when(F.coalesce(F.col("supplier"), F.lit(0)) > 0, F.col("supplier")).otherwise(F.col("__supplier"))
    share = F.round(F.col(amount).cast("decimal(18,2)") * 100 / F.col("__amount").cast("decimal(18,2)"), 2)
    return (
        joined.withColumn("supplier", supplier).withColumn("customer", F.col("__customer"))
        .withColumn("execution_pct", F.when(F.col("__amount") > 0, share))
        .withColumn("reject_reason", F.when(F.col("__id").isNull(), "missing_link"))
        .drop("__id", "__customer", "__supplier", "__amount")
    )


def execution_counters(scoped: DataFrame) -> DataFrame:
    """One row: acts with a percentage, acts whose contract has no sum, acts over 100 per cent, acts without contract."""
    return scoped.agg(
        F.count_if(F.col("execution_pct").isNotNull()).alias("computed"),
        F.count_if(F.col("execution_pct").isNull() & F.col("reject_reason").isNull()).alias("missing_sum"),
        F.count_if(F.col("execution_pct") > 100).alias("over_100"),
        F.count_if(F.col("reject_reason").isNotNull()).alias("missing_contract"),
    )


def with_lot_quantity(contracts: DataFrame, lots: DataFrame, link: str = "lot_id") -> DataFrame:
    """Contracts with ``quantity`` of their lot (latest lots: id, quantity), null without one."""
    return contracts.join(lots.select(F.col("id").alias("__id"), "quantity"), F.col(link) == F.col("__id"), "left").drop("__id")


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows of ``child`` whose positive key is no key of ``parent``."""
    return child.where(F.col(key) > 0).join(parent.select(F.col(parent_key).alias("__key")), F.col(key) == F.col("__key"), "left_anti")


def keyword_match(text: Column, tokens: Sequence[str], whole: str = "") -> Column:
    """Whether any of the tokens, or the whole query, is contained in the text, without case."""
    lower, out = F.lower(text), F.lit(False)
    for t in [*tokens, *([whole] if whole else [])]:
        out = out | F.contains(lower, F.lit(t.lower()))
    return out
