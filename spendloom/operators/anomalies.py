"""Price, volume and fairness anomalies, and z-score outliers. ``detected_at`` is a parameter, so reruns agree."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spendloom.functions.order_stats import LIMIT, order_statistics
from spendloom.sources.shared import kept

# Name tokens that tell the size of an organisation.
SMALL_ORG_TOKENS = ("школ", "school", "лицей", "гимназ", "детск", "kindergarten", "ясли", "библиот", "museum", "амбулат", "clinic", "поликлиник")
LARGE_ORG_TOKENS = ("министер", "ministry", "акимат", "управлен", "департамент", "комитет", "national", "националь")
ORG_THRESHOLDS = {"small": 1_000_000.0, "medium": 2_000_000.0, "large": 5_000_000.0}
URBAN_PREFIXES = ("71", "75", "79")


def region_adjustment(region: Column, urban: Sequence[str] = URBAN_PREFIXES) -> Column:
    """0.10 for urban prefixes, -0.05 for other codes with two digits, else 0."""
    prefix = F.substring(F.regexp_replace(F.coalesce(region, F.lit("")), "[^0-9]", ""), 1, 2)
    return F.when(F.length(prefix) < 2, 0.0).when(prefix.isin(list(urban)), 0.10).otherwise(-0.05)


def inflation_factor(sign_date: Column, rate: float = 0.03, base: str = "2024-01-01") -> Column:
    """(1 + rate) to the years before the base date; 1 from it on."""
    moment = F.lit(base).cast("timestamp_ntz")
    years = F.greatest(F.lit(0), F.year(moment) - F.year(sign_date))
    return F.when(sign_date < moment, F.pow(F.lit(1 + rate), years)).otherwise(F.lit(1.0))


def severity(value: Column, high: float, medium: float) -> Column:
    """high above ``high``, medium from ``medium`` on, else low."""
    return F.when(value > high, "high").when(value >= medium, "medium").otherwise("low")


def fairness_severity(score: Column) -> Column:
    return F.when((score < 0.5) | (score > 2.0), "high").when((score < 0.6) | (score > 1.5), "medium").otherwise("low")


def stable_id(*parts: Column) -> Column:
    """A signed 64-bit id: the first eight bytes of the SHA-256 of the parts, joined by bars."""
    joined = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.sha2(joined, 256), 1, 16), 16, -10).cast("long")


def evidence(**fields: Column) -> Column:
    """JSON of the inputs of a decision, keys in order."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))))


def _category_means(contracts: DataFrame, min_sample: int) -> DataFrame:
    """(category, baseline, sample_size) of categories with at least ``min_sample`` rows; a row a category."""
    return contracts.groupBy("category").agg((F.sum("amount").cast("double") / F.count("amount")).alias("baseline"), F.count(F.lit(1)).alias("sample_size")).where(F.col("sample_size") >= min_sample)


def _with_expected(rows: DataFrame, rate: float, base: str, urban: Sequence[str]) -> DataFrame:
    expected = F.col("baseline") * inflation_factor(F.col("sign_date"), rate, base) * (1 + region_adjustment(F.col("region"), urban))
    rows = rows.withColumn("expected", expected)
    return rows.withColumn("deviation_pct", (F.col("amount").cast("double") - F.col("expected")) / F.col("expected") * 100)


def _overpriced(threshold_pct: float) -> Column:
    limit = F.round((F.col("expected") * (1 + threshold_pct / 100)).cast("decimal(28,8)"), 2)
    return (F.round(F.col("deviation_pct").cast("decimal(28,8)"), 2) > threshold_pct) & (F.col("amount") > limit)


def price_candidates(contracts: DataFrame, min_sample: int = 5, rate: float = 0.03, base: str = "2024-01-01", urban: Sequence[str] = URBAN_PREFIXES) -> DataFrame:
    """Contracts of categories with at least ``min_sample`` rows, with baseline, expected amount and deviation_pct.

    The category means (one row a category) are joined back to the contracts.
    """
    return _with_expected(contracts.join(_category_means(contracts, min_sample), "category"), rate, base, urban)


def price_run(contracts: DataFrame, min_sample: int = 5, rate: float = 0.03, base: str = "2024-01-01", threshold_pct: float = 30.0, urban: Sequence[str] = URBAN_PREFIXES) -> DataFrame:
    """One row: analysed, found and skipped contracts of a price run. The contracts are computed once, into the shared
    checkpoint folder, and all three are counted in one pass over them."""
    rows = kept(contracts.select("category", "region", "amount", "sign_date"))
    judged = _with_expected(rows.join(_category_means(rows, min_sample), "category", "left"), rate, base, urban)
    analysed = F.col("sample_size").isNotNull()
    return judged.agg(F.count_if(analysed).alias("analysed"), F.count_if(analysed & _overpriced(threshold_pct)).alias("found"), F.count_if(~analysed).alias("skipped"))


def price_anomalies(contracts: DataFrame, detected_at: str, min_sample: int = 5, rate: float = 0.03, base: str = "2024-01-01", threshold_pct: float = 30.0, urban: Sequence[str] = URBAN_PREFIXES) -> DataFrame:
    """Overpriced contracts: rounded deviation above the threshold and amount above the rounded limit."""
    rows = price_candidates(contracts, min_sample, rate, base, urban)
    found = rows.where(_overpriced(threshold_pct))
    return found.select(
        stable_id(F.lit("price"), F.lit("contract"), F.col("id"), F.col("category"), F.lit(detected_at)).alias("anomaly_id"),
        F.lit("price").alias("anomaly_type"), F.lit("contract").alias("entity_type"), F.col("id").alias("entity_id"), "customer", "category", "region", "sign_date",
        F.col("amount").cast("double").alias("actual"), F.col("expected"), F.col("deviation_pct"), severity(F.col("deviation_pct"), 100, 50).alias("severity"), "sample_size",
        evidence(baseline=F.col("baseline"), sample_size=F.col("sample_size"), expected=F.col("expected"), actual=F.col("amount").cast("double")).alias("evidence"),
        F.lit(detected_at).cast("timestamp_ntz").alias("detected_at"),
    )


def org_profiles(stats: DataFrame, names: DataFrame, thresholds: Mapping[str, float] = ORG_THRESHOLDS) -> DataFrame:
    """(customer, org_size, org_threshold) from contract counts and sums and the organisation's latest name.

    ``stats``: customer, contract_count, total_spend; ``names``: customer, name.
    """
    joined = stats.join(names.select(F.col("customer").alias("__c"), F.lower("name").alias("__name")), F.col("customer") == F.col("__c"), "left")
    by_volume = F.when((F.col("contract_count") >= 300) | (F.col("total_spend") >= 5_000_000_000), "large").when((F.col("contract_count") >= 80) | (F.col("total_spend") >= 500_000_000), "medium").otherwise("small")
    name = F.coalesce("__name", F.lit(""))
    lifted = F.when((by_volume == "small") & name.rlike("|".join(LARGE_ORG_TOKENS)), "medium").otherwise(by_volume)
    size = F.when((lifted != "large") & name.rlike("|".join(SMALL_ORG_TOKENS)), "small").otherwise(lifted)
    limits = F.create_map(*(x for k, v in thresholds.items() for x in (F.lit(k), F.lit(float(v)))))
    return joined.withColumn("org_size", size).select("customer", "org_size", F.coalesce(limits[F.col("org_size")], F.lit(ORG_THRESHOLDS["small"])).alias("org_threshold"))


def volume_baselines(rows: DataFrame, min_sample: int = 5) -> DataFrame:
    """``rows`` (category, sign_date, quantity) with the mean quantity of earlier years: of the same month if it has
    ``min_sample`` rows, else of all months; rows without a positive mean from enough rows are left out.

    Sums are pre-aggregated to (category, month, year) and (category, year), accumulated over earlier years there, and
    joined back, so no row meets its peers.
    """
    rows = rows.withColumns({"year": F.year("sign_date"), "month": F.month("sign_date")})
    q = F.col("quantity").cast("double")
    monthly = rows.groupBy("category", "month", "year").agg(F.sum(q).alias("s"), F.count(F.lit(1)).alias("n"))
    yearly = monthly.groupBy("category", "year").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    earlier = lambda *keys: Window.partitionBy(*keys).orderBy("year").rangeBetween(Window.unboundedPreceding, -1)
    season = monthly.select("category", "month", "year", F.sum("s").over(earlier("category", "month")).alias("s_sum"), F.coalesce(F.sum("n").over(earlier("category", "month")), F.lit(0)).alias("s_n"))
    annual = yearly.select("category", "year", F.sum("s").over(earlier("category")).alias("a_sum"), F.coalesce(F.sum("n").over(earlier("category")), F.lit(0)).alias("a_n"))
    joined = rows.join(season, ["category", "month", "year"]).join(annual, ["category", "year"])
    seasonal = F.col("s_n") >= min_sample
    sums, n = F.when(seasonal, F.col("s_sum")).otherwise(F.col("a_sum")), F.when(seasonal, F.col("s_n")).otherwise(F.col("a_n"))
    mean = F.round((sums / n).cast("decimal(28,8)"), 3).cast("double")
    joined = joined.withColumns({"sample_size": n, "baseline_kind": F.when(seasonal, "seasonal").otherwise("annual"), "baseline": F.when(n >= min_sample, mean)})
    return joined.where("baseline > 0").drop("s_sum", "s_n", "a_sum", "a_n")


def volume_anomalies(rows: DataFrame, profiles: DataFrame, detected_at: str, min_sample: int = 5, trigger: float = 3.0) -> DataFrame:
    """Quantities above ``trigger`` times their baseline, or above the threshold of the customer's size."""
    based = volume_baselines(rows, min_sample).join(profiles, "customer", "left").withColumn("org_threshold", F.coalesce("org_threshold", F.lit(ORG_THRESHOLDS["small"])))
    q = F.col("quantity").cast("double")
    third = lambda c: F.round(c.cast("decimal(28,8)"), 3).cast("double")
    based = based.withColumn("multiplier", third(q / F.col("baseline"))).withColumn("driver", F.greatest("multiplier", third(q / F.col("org_threshold"))))
    found = based.where((F.col("multiplier") > trigger) | (q > F.col("org_threshold")))
    lot = F.coalesce(F.col("lot_id"), F.lit(0)) > 0
    kind, who = F.when(lot, "lot").otherwise("contract"), F.when(lot, F.col("lot_id")).otherwise(F.col("id"))
    return found.select(
        stable_id(F.lit("volume"), kind, who, F.col("category"), F.col("sign_date"), F.lit(detected_at)).alias("anomaly_id"),
        F.lit("volume").alias("anomaly_type"), kind.alias("entity_type"), who.alias("entity_id"), "id", "customer", "category", "sign_date", q.alias("actual"),
        F.col("baseline").alias("expected"), "baseline_kind", "sample_size", "multiplier",
        F.round(((F.col("multiplier") - 1) * 100).cast("decimal(28,8)"), 2).cast("double").alias("deviation_pct"), severity(F.col("driver"), 10, 5).alias("severity"),
        evidence(baseline=F.col("baseline"), multiplier=F.col("multiplier"), org_threshold=F.col("org_threshold")).alias("evidence"),
        F.lit(detected_at).cast("timestamp_ntz").alias("detected_at"),
    )


def quarter_index(moment: Column) -> Column:
    return F.year(moment) * 4 + F.quarter(moment) - 1


#: What peers share beside the category and the time, from the narrowest scope to the widest.
SCOPES = {"exact": ["region_full"], "prefix": ["region2"], "category": []}


def _central(n: Column) -> list[Column]:
    """Ranks that hold the median of the others, whichever row is left out."""
    return [F.floor(n / 2).cast("long") + j for j in range(3)]


def _scope_table(rows: DataFrame, keys: list[str], prefix: str, limit: int, sized: bool) -> DataFrame:
    """Of each group its size, its central values and its sum; a row a group."""
    central = order_statistics(rows, keys, "amount_d", _central, limit, sized).withColumnsRenamed({"n": f"{prefix}_size", "at": f"{prefix}_at"})
    return central.join(rows.groupBy(*keys).agg(F.sum("amount").alias(f"{prefix}_total")), keys)


def _without_own(prefix: str) -> dict[str, Column]:
    """Count, median and mean of a row's group without the row.

    Taking one of several equal values away changes nothing below it and moves up what comes after the last of them. So
    the rank p of the others is the rank p of all if that value lies below the row's own, and rank p + 1 if not.
    """
    n, at, own = F.col(f"{prefix}_size"), F.col(f"{prefix}_at"), F.col("amount_d")
    pick = lambda p: F.when(own <= at[p], at[p + 1]).otherwise(at[p])
    median = F.when(n > 1, (pick(0) + F.when(n % 2 == 0, pick(0)).otherwise(pick(1))) / 2)
    mean = F.when(n > 1, (F.col(f"{prefix}_total") - F.col("amount")).cast("double") / (n - 1))
    return {f"{prefix}_n": n - 1, f"{prefix}_median": median, f"{prefix}_mean": mean}


def fairness_scores(contracts: DataFrame, min_sample: int = 5, limit: int = LIMIT) -> DataFrame:
    """Each contract's amount over the median of its peers: same category and quarter, without itself.

    The first scope with ``min_sample`` peers counts: same region, same two-character region, any region; if even the
    last has too few, the same three with one quarter more on either side. Rows without such a scope are left out.

    No row meets its peers: each group has one row with its size, sum and three central values, and the tables of the
    scopes are joined before the contracts are. A group of more than ``limit`` rows is not gathered either; its central
    values are found by counts (see ``order_statistics``). Neighbouring quarters are looked at only for the quarters
    whose own peers are too few. The contracts are computed once, into the shared checkpoint folder.
    """
    columns = {"amount_d": F.col("amount").cast("double"), "q": quarter_index(F.col("sign_date")), "region2": F.substring(F.coalesce("region", F.lit("")), 1, 2), "region_full": F.coalesce("region", F.lit(""))}
    rows = contracts.where(F.col("amount") > 0).select("id", "customer", "category", "region", "sign_date", "amount").withColumns(columns)
    rows = kept(rows.where(F.col("category").isNotNull() & F.col("q").isNotNull()))
    sizes = kept(rows.groupBy("category", "q").agg(F.count(F.lit(1)).alias("n")))
    sized = sizes.where(F.col("n") > limit).isEmpty()

    def groups(peers: DataFrame, time: str, kind: str) -> DataFrame:
        """(category, time, region_full) with what is known of each scope."""
        exact, prefix, whole = (_scope_table(peers, ["category", time, *keys], f"{kind}_{name}", limit, sized) for name, keys in SCOPES.items())
        return exact.withColumn("region2", F.substring("region_full", 1, 2)).join(prefix, ["category", time, "region2"]).join(whole, ["category", time]).drop("region2")

    joined = rows.join(groups(rows, "q", "same"), ["category", "q", "region_full"])
    few = sizes.where(F.col("n") <= min_sample).select("category", F.col("q").alias("bucket"))
    kinds = ["same"]
    if not few.isEmpty():
        near = few.select("category", "bucket", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("q"))
        wide = groups(rows.join(near, ["category", "q"]), "bucket", "wide").withColumnRenamed("bucket", "q")
        joined = joined.join(wide, ["category", "q", "region_full"], "left")
        kinds.append("wide")
    order = [f"{t}_{n}" for t in kinds for n in SCOPES]
    joined = joined.withColumns({k: c for p in order for k, c in _without_own(p).items()})
    scope = F.coalesce(*(F.when(F.col(f"{p}_n") >= min_sample, F.lit(p)) for p in order))
    chosen = lambda s: F.coalesce(*(F.when(F.col(f"{p}_n") >= min_sample, F.col(f"{p}_{s}")) for p in order))
    joined = joined.withColumns({"scope": scope, "peer_count": chosen("n"), "peer_median": chosen("median"), "peer_mean": chosen("mean")})
    joined = joined.where("peer_median > 0").withColumn("score", F.col("amount_d") / F.col("peer_median"))
    return joined.select("id", "customer", "category", "region", "sign_date", F.col("amount_d").alias("actual"), "scope", "peer_count", "peer_median", "peer_mean", "score")


def fairness_anomalies(contracts: DataFrame, detected_at: str, min_sample: int = 5, low: float = 0.7, high: float = 1.3, limit: int = LIMIT) -> DataFrame:
    """Contracts whose fairness score is below ``low`` or above ``high``."""
    found = fairness_scores(contracts, min_sample, limit).where((F.col("score") < low) | (F.col("score") > high))
    return found.select(
        stable_id(F.lit("fairness"), F.lit("contract"), F.col("id"), F.col("category"), F.lit(detected_at)).alias("anomaly_id"),
        F.lit("fairness").alias("anomaly_type"), F.lit("contract").alias("entity_type"), F.col("id").alias("entity_id"), "customer", "category", "region", "sign_date", "actual",
        F.col("peer_median").alias("expected"), "peer_mean", "peer_count", "scope", "score",
        F.round((F.abs(F.col("score") - 1) * 100).cast("decimal(28,8)"), 2).cast("double").alias("deviation_pct"), fairness_severity(F.col("score")).alias("severity"),
        evidence(peer_count=F.col("peer_count"), peer_median=F.col("peer_median"), scope=F.col("scope"), score=F.col("score")).alias("evidence"),
        F.lit(detected_at).cast("timestamp_ntz").alias("detected_at"),
    )


def run_summary(rows: DataFrame, analysed: DataFrame, found: DataFrame) -> DataFrame:
    """One row: analysed, found and skipped rows of a detector run."""
    parts = rows.select(F.lit("rows").alias("p")).unionByName(analysed.select(F.lit("analysed").alias("p"))).unionByName(found.select(F.lit("found").alias("p")))
    n = lambda p: F.count_if(F.col("p") == p)
    return parts.agg(n("analysed").alias("analysed"), n("found").alias("found"), (n("rows") - n("analysed")).alias("skipped"))


def outliers(df: DataFrame, group: str, value: str, limit: float = 2.0) -> DataFrame:
    """Groups whose average lies more than ``limit`` population deviations from the mean of group averages."""
    means = df.groupBy(group).agg(F.avg(value).cast("double").alias("average"))
    whole = means.agg(F.avg("average").alias("mean"), F.stddev_pop("average").alias("spread"))
    scored = means.crossJoin(F.broadcast(whole)).withColumn("z", (F.col("average") - F.col("mean")) / F.col("spread"))  # one row
    return scored.where((F.col("spread") > 0) & (F.abs(F.col("z")) > limit)).select(group, "average", "z")
