"""Statistics of a column, per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendloom.functions.order_stats import LIMIT, group_percentiles, interpolated, percentile_ranks, same_keys
from spendloom.sources.shared import kept

#: Two-sided normal quantiles by confidence (fixed values).
Z_SCORES = {"0.80": 1.281552, "0.90": 1.644854, "0.95": 1.959964, "0.98": 2.326348, "0.99": 2.575829}
PERCENTILES = (25.0, 50.0, 75.0, 90.0, 95.0, 99.0)


def median(value: Column) -> Column:
    return F.median(value)


def weighted_mean(value: Column, weight: Column, strict: bool = True) -> Column:
    """Sum of value x weight over the sum of weights. A negative weight or a zero sum is an error, or null if not
    ``strict``."""
    total = F.sum(weight)
    fine = (F.min(weight) >= 0) & (total != 0)
    bad = F.raise_error(F.lit("weights must not be negative and must have a sum")).cast("double") if strict else F.lit(None).cast("double")
    return F.when(fine, F.sum(value * weight) / F.nullif(total, F.lit(0))).otherwise(bad)


def percentile(value: Column, p: float) -> Column:
    """Exact percentile with linear interpolation, p from 0 to 100."""
    if not 0 <= p <= 100:
        raise ValueError("p must be from 0 to 100")
    return F.percentile(value, p / 100)


def percentiles(value: Column, ps: Sequence[float] = PERCENTILES) -> Column:
    """Array of exact percentiles, in one pass."""
    return F.percentile(value, [p / 100 for p in ps])


def iqr(value: Column) -> Column:
    q = F.percentile(value, [0.25, 0.75])
    return q[1] - q[0]


def confidence_interval(value: Column, confidence: str = "0.95") -> Column:
    """Struct low, high: mean and z standard errors on either side; the mean itself for one value or no spread."""
    z = Z_SCORES[confidence]
    half = F.when((F.count(value) > 1) & (F.stddev_samp(value) > 0), F.lit(z) * F.stddev_samp(value) / F.sqrt(F.count(value))).otherwise(F.lit(0.0))
    return F.struct((F.avg(value) - half).alias("low"), (F.avg(value) + half).alias("high"))


def quantile(value: Column, q: float, exact: bool = True, accuracy: int = 10_000) -> Column:
    """A quantile, exact or by a mergeable sketch of bounded size."""
    return F.percentile(value, q) if exact else F.approx_percentile(value, q, accuracy)


def with_mad(df: DataFrame, group: Sequence[str], value: str, limit: int = LIMIT) -> DataFrame:
    """(group, mad): the median of absolute deviations from the group's median, exact for groups of any size."""
    rows = kept(df.where(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("__v")))
    middle = group_percentiles(rows, group, "__v", [50], limit).select(*group, F.col("percentiles")[0].alias("__m"))
    deviations = same_keys(rows, middle, group).select(*group, F.abs(F.col("__v") - F.col("__m")).alias("__v"))
    return group_percentiles(deviations, group, "__v", [50], limit).select(*group, F.col("percentiles")[0].alias("mad"))


def describe(df: DataFrame, group: Sequence[str], value: str, confidence: str = "0.95", limit: int = LIMIT) -> DataFrame:
    """All statistics of ``value`` per group, in one grouping.

    A group's values become one sorted array, from which its percentiles and, sorted once more, the deviations' median
    are read. If a group has more than ``limit`` values, percentiles and deviations of all groups are found by counts
    instead (see ``order_statistics``), and only moments are grouped. The values are computed once, into the shared
    checkpoint folder.
    """
    v = F.col("__v")
    rows = kept(df.select(*group, F.col(value).cast("double").alias("__v")))
    moments = [F.count(v).alias("n"), F.avg(v).alias("mean"), confidence_interval(v, confidence).alias("__ci")]
    if rows.groupBy(*group).agg(F.count(v).alias("n")).where(F.col("n") > limit).isEmpty():
        one = rows.groupBy(*group).agg(*moments, F.sort_array(F.collect_list(v)).alias("__s"))
        one = one.withColumn("__at", F.array(*(F.try_element_at("__s", F.when(r > 0, r).cast("int")) for r in percentile_ranks(PERCENTILES)(F.col("n")))))
        one = one.withColumn("__p", F.array(*interpolated(F.col("__at"), F.col("n"), PERCENTILES)))
        one = one.withColumn("__d", F.sort_array(F.transform("__s", lambda x: F.abs(x - F.col("__p")[PERCENTILES.index(50.0)]))))
        middle = F.array(*(F.try_element_at("__d", F.when(r > 0, r).cast("int")) for r in percentile_ranks([50])(F.col("n"))))
        one = one.withColumn("__mad", middle).withColumn("mad", interpolated(F.col("__mad"), F.col("n"), [50])[0])
    else:
        found = group_percentiles(rows, group, "__v", PERCENTILES, limit).select(*group, F.col("percentiles").alias("__p"))
        one = same_keys(same_keys(rows.groupBy(*group).agg(*moments), found, group, "left"), with_mad(rows, group, "__v", limit), group, "left")
    named = [F.col("__p")[k].alias(f"p{p:g}") for k, p in enumerate(PERCENTILES)]
    quarters = F.col("__p")[PERCENTILES.index(75.0)] - F.col("__p")[PERCENTILES.index(25.0)]
    middle = F.col("__p")[PERCENTILES.index(50.0)]
    return one.select(*group, "n", "mean", middle.alias("median"), *named, quarters.alias("iqr"), F.col("__ci.low").alias("ci_low"), F.col("__ci.high").alias("ci_high"), "mad")
