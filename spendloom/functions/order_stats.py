"""Exact order statistics of groups of any size, and mergeable sketches of quantiles.

A group of up to ``limit`` rows becomes one sorted array. A larger one never meets in one task: its equal values are
counted together, its range is cut into slices whose counts tell in which slice a wanted rank lies, and only that slice
is cut again, until it has few enough values to be sorted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spendloom.sources.shared import kept

#: Groups up to so many rows are sorted as one array (8 bytes a value).
LIMIT = 200_000
#: Slices that the range of a larger group is cut into, in each round.
SLICES = 1024


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on ``keys``, null keys being equal too; the columns of ``left`` and the others of
    ``right``."""
    if not keys:
        return left.crossJoin(F.broadcast(right))  # one row, as there are no keys
    other = right.select(*(F.col(k).alias(f"__{k}") for k in keys), *(c for c in right.columns if c not in keys))
    return left.join(other, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], how).drop(*(f"__{k}" for k in keys))


def order_statistics(df: DataFrame, keys: Sequence[str], value: str, ranks: Callable[[Column], Sequence[Column]], limit: int = LIMIT, sized: bool = False) -> DataFrame:
    """(keys, n, at): of each group the number of its non-null values and the values at the wanted ranks.

    ``ranks`` gives the wanted ranks (from 1, as longs) as columns of n; a rank outside 1 to n gives null. Null keys
    form groups. ``sized`` promises that no group has more than ``limit`` rows, so that none is looked for. Groups
    without a value are left out.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__x"))
    if not sized:
        rows = kept(rows)
        large = kept(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit))
        if not large.isEmpty():
            big = _selected(same_keys(rows, large, keys), keys, ranks, limit)
            if not keys:
                return big
            other = large.select(*(F.col(k).alias(f"__{k}") for k in keys))
            rest = rows.join(other, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left_anti")
            return order_statistics(rest.withColumnRenamed("__x", value), keys, value, ranks, limit, True).unionByName(big)
    grouped = rows.groupBy(*keys).agg(F.sort_array(F.collect_list("__x")).alias("sorted")).where(F.size("sorted") > 0)
    n = F.size("sorted").cast("long")
    return grouped.select(*keys, n.alias("n"), F.array(*(F.try_element_at("sorted", F.when((r >= 1) & (r <= n), r).cast("int")) for r in ranks(n))).alias("at"))


def _selected(rows: DataFrame, keys: Sequence[str], ranks: Callable[[Column], Sequence[Column]], limit: int) -> DataFrame:
    """The same for large groups (rows: keys, n, __x), by rounds of counts.

    An interval is (keys, first, lo, hi): the values from lo to hi, of which ``first`` rows of the group lie below. A
    round cuts every interval of more than ``limit`` different values into SLICES and keeps those that a wanted rank
    lies in, so its range shrinks a thousandfold; a slice is counted by partial aggregates, and only counts meet.
    """
    counted = kept(rows.groupBy(*keys, "__x").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n")))
    wanted = lambda n: F.array(*ranks(n))
    open_ = counted.groupBy(*keys).agg(F.min("__x").alias("lo"), F.max("__x").alias("hi"), F.count(F.lit(1)).alias("d"), F.first("n").alias("n"))
    open_ = kept(open_.withColumn("first", F.lit(0).cast("long")))
    done = None
    while True:
        ready = open_.where((F.col("d") <= limit) | (F.col("lo") == F.col("hi")))
        done = ready if done is None else done.unionByName(ready)
        open_ = open_.where((F.col("d") > limit) & (F.col("lo") < F.col("hi")))
        if open_.isEmpty():
            break
        inside = same_keys(counted.drop("n"), open_.drop("d"), keys).where((F.col("__x") >= F.col("lo")) & (F.col("__x") <= F.col("hi")))
        # halves, so that the width of no range overflows
        part = F.least(F.lit(SLICES - 1), F.floor((F.col("__x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * SLICES))
        slices = inside.groupBy(*keys, "first", "n", part.alias("slice")).agg(F.sum("c").alias("rows"), F.count(F.lit(1)).alias("d"), F.min("__x").alias("lo"), F.max("__x").alias("hi"))
        # SLICES rows at most
        before = Window.partitionBy(*keys, "first", "n").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        slices = slices.withColumn("first", F.col("first") + F.coalesce(F.sum("rows").over(before), F.lit(0)))
        hit = F.exists(wanted(F.col("n")), lambda r: (r > F.col("first")) & (r <= F.col("first") + F.col("rows")))
        open_ = kept(slices.where(hit).select(*keys, "lo", "hi", "d", "n", "first"))
    # ``limit`` different values at most in an interval
    final = same_keys(counted.drop("n"), done.drop("d"), keys).where((F.col("__x") >= F.col("lo")) & (F.col("__x") <= F.col("hi")))
    upto = Window.partitionBy(*keys, "first", "n").orderBy("__x")
    final = final.withColumn("last", F.col("first") + F.sum("c").over(upto))
    n = F.col("n")
    found = [F.max(F.when((r > F.col("last") - F.col("c")) & (r <= F.col("last")), F.col("__x"))) for r in ranks(n)]
    return final.groupBy(*keys, "n").agg(F.array(*found).alias("at")).select(*keys, "n", "at")


def percentile_ranks(ps: Sequence[float]) -> Callable[[Column], list[Column]]:
    """For each p (0 to 100) the ranks of the two values between which its percentile lies."""
    return lambda n: [r.cast("long") for p in ps for r in (F.floor((n - 1) * p / 100) + 1, F.ceil((n - 1) * p / 100) + 1)]


def interpolated(at: Column, n: Column, ps: Sequence[float]) -> list[Column]:
    """The percentiles of ``ps``, from the values at their ``percentile_ranks``."""
    out = []
    for k, p in enumerate(ps):
        place = (n - 1) * p / 100
        low, high = at[2 * k], at[2 * k + 1]
        out.append(low + (high - low) * (place - F.floor(place)))
    return out


def group_percentiles(df: DataFrame, keys: Sequence[str], value: str, ps: Sequence[float], limit: int = LIMIT) -> DataFrame:
    """(keys, n, percentiles): exact percentiles of each group by linear interpolation, for groups of any size."""
    found = order_statistics(df, keys, value, percentile_ranks(ps), limit)
    return found.select(*keys, "n", F.array(*interpolated(F.col("at"), F.col("n"), ps)).alias("percentiles"))


#: Of a sketch with k = 2,000: with a confidence of 99 % the rank of what it gives for a quantile is off by less than
#: this share of the rows (the bound that the KLL sketch states is about 2.3 / k^0.9).
SKETCH_K, SKETCH_ERROR = 2_000, 0.003


def quantile_sketches(df: DataFrame, keys: Sequence[str], value: str, k: int = SKETCH_K) -> DataFrame:
    """(keys, sketch): a KLL sketch of the values of each group, of bounded size; store one for each day or month."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"))


def merged_quantiles(sketches: DataFrame, keys: Sequence[str], qs: Sequence[float], k: int = SKETCH_K) -> DataFrame:
    """(keys, n, quantiles): approximate quantiles of any union of stored sketches; no row is read again."""
    merged = sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("__m"))
    each = F.array(*(F.kll_sketch_get_quantile_double("__m", F.lit(float(q))) for q in qs))
    return merged.select(*keys, F.kll_sketch_get_n_double("__m").alias("n"), each.alias("quantiles"))
