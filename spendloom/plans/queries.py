"""Registered queries of the spend operators and their SQL, over the given tables."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendloom.functions import order_stats, stats
from spendloom.operators import anomalies, rollups, scope, spend, versions
from spendloom.plans.presets import CONTRACTS_SQL, VERSION_COLUMNS, contracts, latest_lines, line_versions, region_names, table
from spendloom.sources.shared import shared_folder

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    """Registers a query under its function's name; ``sql`` may use the views li and contracts."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = CONTRACTS_SQL + sql if re.search(r"\b(FROM|JOIN) (contracts|li)\b", sql) else sql
        return f

    return add


def money(*columns: str) -> list:
    return [F.col(c).cast("double").alias(c) for c in columns]


TOTALS = "CAST(sum(amount) AS DOUBLE) AS total_spend, count(*) AS contract_count"


@query(f"SELECT customer, {TOTALS} FROM contracts WHERE amount > 0 AND customer > 0 GROUP BY customer")
def q1_total_by_customer(spark: SparkSession, sf: str) -> DataFrame:
    out = spend.total_by_customer(contracts(spark, sf, category=False, region=False).where(scope.contract_filter()))
    return out.select("customer", *money("total_spend"), "contract_count")


@query(f"SELECT category, {TOTALS} FROM contracts WHERE amount > 0 AND length(category) = 2 GROUP BY category")
def q2_by_category(spark: SparkSession, sf: str) -> DataFrame:
    out = spend.by_category(contracts(spark, sf, region=False).where(scope.contract_filter()), 2)
    return out.select("category", *money("total_spend"), "contract_count")


@query(f"""SELECT s.region, n_name AS region_name, total_spend, contract_count FROM
  (SELECT substr(region, 1, 2) AS region, {TOTALS} FROM contracts WHERE amount > 0 GROUP BY 1) s
  JOIN nation ON s.region = lpad(CAST(n_nationkey AS VARCHAR), 2, '0')""")
def q3_by_region(spark: SparkSession, sf: str) -> DataFrame:
    out = spend.by_region(contracts(spark, sf, category=False).where(scope.contract_filter()), region_names(spark, sf))
    return out.select("region", "region_name", *money("total_spend"), "contract_count")


@query("""SELECT customer, CAST(round(sum(share * share), 6) AS DOUBLE) AS hhi, count(*) AS supplier_count, CAST(max(share) AS DOUBLE) AS top_share FROM (
    SELECT p.customer, CAST(round(CAST(s AS DOUBLE) / CAST(t AS DOUBLE), 6) AS DECIMAL(12,6)) AS share FROM
      (SELECT customer, supplier, sum(amount) AS s FROM contracts WHERE amount > 0 AND customer > 0 GROUP BY 1, 2) p
      JOIN (SELECT customer, sum(amount) AS t, count(*) AS n FROM contracts WHERE amount > 0 GROUP BY 1 HAVING count(*) >= 5) c ON p.customer = c.customer
    WHERE supplier > 0 AND s > 0) x GROUP BY customer""")
def q4_supplier_concentration(spark: SparkSession, sf: str) -> DataFrame:
    out = spend.supplier_concentration(contracts(spark, sf, category=False, region=False).where(scope.contract_filter()))
    return out.select("customer", *money("hhi"), "supplier_count", *money("top_share"))


@query("""SELECT year, CAST(t AS DOUBLE) AS total_spend, contract_count, round((CAST(t AS DOUBLE) - CAST(p AS DOUBLE)) / CAST(p AS DOUBLE) * 100, 2) AS change_pct FROM (
    SELECT year, t, contract_count, lag(t) OVER (ORDER BY year) AS p FROM
      (SELECT year(sign_date) AS year, sum(amount) AS t, count(*) AS contract_count FROM contracts WHERE amount > 0 GROUP BY 1) y) z""")
def q5_year_over_year(spark: SparkSession, sf: str) -> DataFrame:
    out = spend.year_over_year(contracts(spark, sf, category=False, region=False).where(scope.contract_filter()))
    return out.select(F.col("year").cast("long").alias("year"), *money("total_spend"), "contract_count", *money("change_pct"))


@query("SELECT customer, count(*) AS contract_count, CAST(sum(amount) AS DOUBLE) AS total_spend FROM contracts WHERE year(sign_date) BETWEEN 1996 AND 1998 GROUP BY 1")
def q7_customer_volume(spark: SparkSession, sf: str) -> DataFrame:
    return spend.customer_volume(contracts(spark, sf, category=False, region=False), (1996, 1998)).select("customer", "contract_count", *money("total_spend"))


BUNDLE_SQL = """SELECT 'customer' AS section, CAST(customer AS VARCHAR) AS key, CAST(sum(amount) AS DOUBLE) AS value, count(*) AS contract_count FROM contracts WHERE customer > 0 GROUP BY customer
  UNION ALL SELECT 'category', category, CAST(sum(amount) AS DOUBLE), count(*) FROM contracts WHERE length(category) = 2 GROUP BY category
  UNION ALL SELECT 'region', substr(region, 1, 2), CAST(sum(amount) AS DOUBLE), count(*) FROM contracts GROUP BY 2
  UNION ALL SELECT 'concentration', CAST(customer AS VARCHAR), CAST(round(sum(share * share), 6) AS DOUBLE), count(*) FROM (
    SELECT p.customer, CAST(round(CAST(s AS DOUBLE) / CAST(t AS DOUBLE), 6) AS DECIMAL(12,6)) AS share FROM
      (SELECT customer, supplier, sum(amount) AS s FROM contracts WHERE customer > 0 GROUP BY 1, 2) p
      JOIN (SELECT customer, sum(amount) AS t, count(*) AS n FROM contracts GROUP BY 1 HAVING count(*) >= 5) c ON p.customer = c.customer
    WHERE supplier > 0 AND s > 0) x GROUP BY customer
  UNION ALL SELECT 'year', CAST(year(sign_date) AS VARCHAR), CAST(sum(amount) AS DOUBLE), count(*) FROM contracts GROUP BY 2
  UNION ALL SELECT 'total', 'all', CAST(sum(amount) AS DOUBLE), count(*) FROM contracts WHERE customer > 0"""


@query(BUNDLE_SQL)
def q8_analytics_bundle(spark: SparkSession, sf: str) -> DataFrame:
    return spend.analytics_bundle(contracts(spark, sf), region_names(spark, sf))


@query(BUNDLE_SQL)
def q8_analytics_bundle_whole(spark: SparkSession, sf: str) -> DataFrame:
    """All sections over all contracts, whatever their amount and date."""
    return spend.analytics_bundle(contracts(spark, sf), region_names(spark, sf))


@query("""SELECT customer, CAST(CAST(sign_date AS DATE) AS VARCHAR) AS day, CAST(strftime(sign_date, '%Y%m') AS INTEGER) AS month, CAST(sum(amount) AS DOUBLE) AS total_spend,
  count(*) AS contract_count FROM contracts WHERE amount > 0 GROUP BY 1, 2, 3""")
def s7_daily_by_customer(spark: SparkSession, sf: str) -> DataFrame:
    out = spend.daily_rollup(contracts(spark, sf, category=False, region=False), ["customer"])
    return out.select("customer", F.col("day").cast("string").alias("day"), "month", *money("total_spend"), "contract_count")


@query("""SELECT category, CAST(CAST(sign_date AS DATE) AS VARCHAR) AS day, CAST(strftime(sign_date, '%Y%m') AS INTEGER) AS month, CAST(sum(amount) AS DOUBLE) AS total_spend,
  count(*) AS contract_count FROM contracts WHERE amount > 0 AND length(category) = 2 GROUP BY 1, 2, 3""")
def s8_daily_by_category(spark: SparkSession, sf: str) -> DataFrame:
    out = spend.daily_rollup(contracts(spark, sf, region=False).where(F.length("category") == 2), ["category"])
    return out.select("category", F.col("day").cast("string").alias("day"), "month", *money("total_spend"), "contract_count")


@query("SELECT customer, CAST(sum(amount) AS DOUBLE) AS total_spend, count(*) AS contract_count FROM contracts WHERE amount > 0 GROUP BY customer")
def s9_merged_rollups(spark: SparkSession, sf: str) -> DataFrame:
    base = contracts(spark, sf, category=False, region=False)
    parts = [spend.daily_rollup(base.where(F.year("sign_date") % 2 == k), ["customer"]) for k in (0, 1)]
    return spend.merge_rollups(parts, ["customer"]).select("customer", *money("total_spend"), "contract_count")


@query("""SELECT l_suppkey AS supplier, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total_spend, count(*) AS contract_count
  FROM li WHERE l_extendedprice > 0 GROUP BY 1, 2""")
def s9_retracted_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """A stored daily rollup after two batches of versions, late ones among them, that change amounts, days and
    suppliers; it equals a fresh rollup of the latest versions of all."""
    columns = ["supplier", "amount", "sign_date", *VERSION_COLUMNS]
    rows = line_versions(spark, sf).withColumns({"supplier": F.col("l_suppkey"), "amount": F.col("l_extendedprice").cast("decimal(18,2)"), "sign_date": F.col("l_shipdate")})
    part = F.pmod(F.xxhash64("l_partkey"), F.lit(3))
    path = f"{shared_folder(spark)}/rollup-{uuid.uuid4().hex}"
    stored = versions.latest(rows.where(part == 0), ["id"], "l_shipdate", columns, VERSION_COLUMNS[1:])
    rollups.write_rollup(spend.daily_rollup(stored, ["supplier"]), path)
    for k in (1, 2):
        changes = rollups.snapshot_changes(stored, rows.where(part == k), ["id"], "l_shipdate", columns, VERSION_COLUMNS[1:])
        rollups.refresh_rollup(path, rollups.rollup_delta(changes, ["supplier"]), ["supplier"])
        stored = versions.latest(rows.where(part <= k), ["id"], "l_shipdate", columns, VERSION_COLUMNS[1:])
    return spark.read.parquet(path).select("supplier", F.col("day").cast("string").alias("day"), *money("total_spend"), "contract_count")


@query("SELECT l_orderkey * 10 + l_linenumber AS id, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS version, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag FROM li")
def u1_latest_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return latest_lines(spark, sf).select("id", F.to_date("l_shipdate").cast("string").alias("version"), "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) x WHERE rn = 1""")
def u2_dedup_batch(spark: SparkSession, sf: str) -> DataFrame:
    return versions.dedup_batch(table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type"), ["user_id"], "ts", "event_id").drop("ts")


CUTOFF = "1998-06-01"


def _batches(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = line_versions(spark, sf)
    return rows.where(F.col("l_shipdate") < F.lit(CUTOFF).cast("timestamp_ntz")), rows.where(F.col("l_shipdate") >= F.lit(CUTOFF).cast("timestamp_ntz"))


LATEST_OF = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC,
  l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) AS rn FROM lineitem WHERE {where}) v WHERE rn = 1)"""


@query(f"""SELECT n.l_orderkey * 10 + n.l_linenumber AS id, CASE WHEN o.l_orderkey IS NULL THEN 'new'
    WHEN n.l_suppkey = o.l_suppkey AND n.l_returnflag = o.l_returnflag THEN 'unchanged' ELSE 'changed' END AS change_type
  FROM {LATEST_OF.format(where=f"l_shipdate >= TIMESTAMP '{CUTOFF}'")} n LEFT JOIN {LATEST_OF.format(where=f"l_shipdate < TIMESTAMP '{CUTOFF}'")} o
  ON n.l_orderkey = o.l_orderkey AND n.l_linenumber = o.l_linenumber""")
def u3_change_types(spark: SparkSession, sf: str) -> DataFrame:
    stored, batch = (versions.latest(x, ["id"], "l_shipdate", VERSION_COLUMNS, VERSION_COLUMNS[1:]) for x in _batches(spark, sf))
    return versions.change_types(batch, stored, ["id"], ["l_suppkey", "l_returnflag"]).select("id", "change_type")


@query("""SELECT n.p_partkey, CASE WHEN o.p_partkey IS NULL THEN 'new' WHEN n.p_brand = o.p_brand AND n.p_type = o.p_type THEN 'unchanged' ELSE 'changed' END AS change_type
  FROM part n LEFT JOIN (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'old' ELSE p_brand END AS p_brand, p_type FROM part WHERE p_size > 15) o ON n.p_partkey = o.p_partkey""")
def u4_hash_upsert(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    stored = part.where("p_size > 15").withColumn("p_brand", F.when(F.col("p_size") % 5 == 0, "old").otherwise(F.col("p_brand")))
    return versions.hash_upsert(part, stored, ["p_partkey"], ["p_brand", "p_type"], "p_partkey").select("p_partkey", "change_type")


@query("""SELECT event_id FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 300 SECOND FROM events WHERE event_type = 'click')
  OR NOT EXISTS (SELECT 1 FROM events WHERE event_type = 'click')""")
def u5_newer_than_mark(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    return versions.newer_than_mark(events, events.where("event_type = 'click'"), "ts").select("event_id")


@query("""SELECT event_type, count(DISTINCT user_id) AS ids, CAST(max(ts) AS VARCHAR) AS last_modified FROM events
  WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' AND user_id > 0 GROUP BY event_type""")
def u6_sync_plan(spark: SparkSession, sf: str) -> DataFrame:
    stamp = lambda s: F.lit(s).cast("timestamp_ntz")
    return versions.sync_plan(table(spark, sf, "events"), stamp("2024-01-05"), stamp("2024-01-20"), "event_type", "user_id", "ts").withColumn("last_modified", F.col("last_modified").cast("string"))


@query("""SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders WHERE o_custkey IN
  (SELECT user_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06' AND user_id > 0)""")
def u6_changed_rows(spark: SparkSession, sf: str) -> DataFrame:
    stamp = lambda s: F.lit(s).cast("timestamp_ntz")
    ids = versions.changed_ids(table(spark, sf, "events"), stamp("2024-01-05"), stamp("2024-01-06"), "event_type", "user_id", "ts")
    orders = table(spark, sf, "orders").join(ids.select(F.col("user_id").alias("o_custkey")).distinct(), "o_custkey", "left_semi")
    return orders.select("o_orderkey", F.to_date("o_orderdate").cast("string").alias("day"))


@query("SELECT 'orders' AS t, CAST(max(o_orderdate) AS VARCHAR) AS baseline FROM orders UNION ALL SELECT 'none', '2024-01-01 00:00:00'")
def u7_baselines(spark: SparkSession, sf: str) -> DataFrame:
    now = F.lit("2024-01-02").cast("timestamp_ntz")
    orders = table(spark, sf, "orders")
    one = lambda df, name: versions.baseline(df, "o_orderdate", now).select(F.lit(name).alias("t"), F.col("baseline").cast("string").alias("baseline"))
    return one(orders, "orders").unionByName(one(orders.where("o_orderkey < 0"), "none"))


@query("""SELECT id, CASE WHEN o_orderkey IS NULL THEN 'missing_link' WHEN o_custkey NOT BETWEEN 2 AND 699 OR year(o_orderdate) NOT IN (1996, 1997) THEN 'out_of_scope'
    WHEN CASE WHEN own > 0 THEN own ELSE o_custkey END NOT BETWEEN 2 AND 699 THEN 'non_target' END AS reject_reason
  FROM (SELECT *, CASE WHEN quantity > 25 THEN supplier ELSE customer END AS own FROM contracts) c LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority <> '1-URGENT') o ON announcement_id = o_orderkey""")
def j1_announcement_scope(spark: SparkSession, sf: str) -> DataFrame:
    """Urgent orders are no announcements here; contracts of large quantity name their supplier as customer."""
    a = table(spark, sf, "orders").where("o_orderpriority <> '1-URGENT'").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), F.year("o_orderdate").alias("year"))
    rows = contracts(spark, sf, category=False, region=False).withColumn("customer", F.when(F.col("quantity") > 25, F.col("supplier")).otherwise(F.col("customer")))
    return scope.announcement_scope(rows, a, list(range(2, 700)), [1996, 1997]).select("id", "reject_reason")


@query("""SELECT l.l_orderkey * 10 + l.l_linenumber AS id, l.l_shipdate IS NOT NULL AS has_act, c.customer,
    CAST(round(CAST(l.l_extendedprice AS DECIMAL(18,2)) * 100 / CAST(c.amount AS DOUBLE), 2) AS DOUBLE) AS execution_pct
  FROM lineitem l LEFT JOIN contracts c ON l.l_orderkey * 10 + l.l_linenumber = c.id""")
def j2_contract_scope(spark: SparkSession, sf: str) -> DataFrame:
    acts = line_versions(spark, sf).select(F.col("id").alias("contract_id"), F.col("l_suppkey").alias("supplier"), F.col("l_extendedprice").alias("act_sum"), "l_shipdate")
    out = scope.contract_scope(acts, contracts(spark, sf).select("id", "customer", "supplier", "amount"))
    return out.select(F.col("contract_id").alias("id"), F.col("l_shipdate").isNotNull().alias("has_act"), "customer", *money("execution_pct"))


@query("SELECT id, CAST(p_size AS BIGINT) AS quantity FROM contracts LEFT JOIN (SELECT * FROM part WHERE p_size > 10) p ON lot_id = p_partkey")
def j3_lot_quantity(spark: SparkSession, sf: str) -> DataFrame:
    lots = table(spark, sf, "part").where("p_size > 10").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("quantity"))
    return scope.with_lot_quantity(contracts(spark, sf).drop("quantity"), lots).select("id", "quantity")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def j6_orphans(spark: SparkSession, sf: str) -> DataFrame:
    return scope.orphans(table(spark, sf, "orders"), table(spark, sf, "lineitem"), "o_orderkey", "l_orderkey").select("o_orderkey")


@query("""SELECT id, customer, CAST(amount AS DOUBLE) AS amount FROM contracts WHERE amount > 0 AND customer IN (1, 2, 3, 5, 8, 13, 21, 34) AND sign_date >= TIMESTAMP '1996-01-01'
  AND sign_date <= TIMESTAMP '1998-12-31' AND category IN ('11', '12', '23', '34') AND substr(region, 1, 2) IN ('01', '02', '03', '04', '05', '06', '07', '08', '09', '10')""")
def f1_contract_filter(spark: SparkSession, sf: str) -> DataFrame:
    wanted = scope.contract_filter([1, 2, 3, 5, 8, 13, 21, 34, 0, -1], "1996-01-01", "1998-12-31", ["11", "1-2", "23", "34"], [f"{k:02}.9" for k in range(1, 11)])
    return contracts(spark, sf).where(wanted).select("id", "customer", *money("amount"))


@query("""SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '00001') OR contains(lower(c_mktsegment), 'auto')""")
def f3_entity_filter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").where(scope.entity_filter(query="00001", names=["c_name"]) | scope.entity_filter(query="AUTO", names=["c_mktsegment"])).select("c_custkey", "c_name")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'licensed under')")
def f4_keyword_match(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(scope.keyword_match(F.col("text"), ["License"], "licensed under")).select("doc_id")


@query("""SELECT category, count(*) AS n, CAST(sum(amount) AS DOUBLE) / count(*) AS mean, round(median(CAST(amount AS DOUBLE)), 3) AS median, round(quantile_cont(CAST(amount AS DOUBLE), 0.25), 3) AS p25,
  round(quantile_cont(CAST(amount AS DOUBLE), 0.9), 3) AS p90, round(quantile_cont(CAST(amount AS DOUBLE), 0.99), 3) AS p99, round(mad(CAST(amount AS DOUBLE)), 3) AS mad,
  round(sum(CAST(amount AS DOUBLE) * quantity) / sum(quantity), 4) AS weighted, round(avg(CAST(amount AS DOUBLE)) - 1.959964 * stddev_samp(CAST(amount AS DOUBLE)) / sqrt(count(*)), 4) AS ci_low
  FROM contracts GROUP BY category""")
def t9_describe(spark: SparkSession, sf: str) -> DataFrame:
    base = contracts(spark, sf, region=False).withColumn("value", F.col("amount").cast("double"))
    d = stats.describe(base, ["category"], "value").select("category", "n", *(F.round(c, 3).alias(c) for c in ("median", "p25", "p90", "p99", "mad")), F.round("ci_low", 4).alias("ci_low"))
    w = base.groupBy("category").agg((F.sum("amount").cast("double") / F.count("amount")).alias("mean"), F.round(stats.weighted_mean(F.col("value"), F.col("quantity")), 4).alias("weighted"))
    return d.join(w, "category")


@query("""SELECT quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.95) AS p95, quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) AS iqr
  FROM lineitem WHERE l_quantity > 10""")
def t8_column_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("l_extendedprice")
    return table(spark, sf, "lineitem").where("l_quantity > 10").agg(stats.median(v).alias("median"), stats.percentile(v, 95).alias("p95"), stats.iqr(v).alias("iqr"))


@query("""SELECT category, count(*) AS n, round(quantile_cont(CAST(amount AS DOUBLE), 0.1), 6) AS p10, round(quantile_cont(CAST(amount AS DOUBLE), 0.5), 6) AS p50,
  round(quantile_cont(CAST(amount AS DOUBLE), 0.995), 6) AS p99_5 FROM contracts GROUP BY category""")
def t4_split_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Exact percentiles with every group of over 100 contracts split, as groups of over LIMIT rows are."""
    out = order_stats.group_percentiles(contracts(spark, sf, region=False), ["category"], "amount", [10, 50, 99.5], limit=100)
    return out.select("category", "n", *(F.round(F.col("percentiles")[k], 6).alias(c) for k, c in enumerate(("p10", "p50", "p99_5"))))


QS = (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


@query(f"""SELECT category, q, n, true AS within FROM (SELECT category, count(*) AS n FROM contracts GROUP BY category) c, (VALUES {", ".join(f"({q}::DOUBLE)" for q in QS)}) v(q)""")
def t8_merged_sketches(spark: SparkSession, sf: str) -> DataFrame:
    """Quantiles from sketches of single months, merged; within: whether the true rank of what they give is off by no
    more than the stated error (one value's rows aside)."""
    base = contracts(spark, sf, region=False).select("category", F.date_format("sign_date", "yyyyMM").alias("month"), F.col("amount").cast("double").alias("x"))
    monthly = order_stats.quantile_sketches(base, ["category", "month"], "x")
    merged = order_stats.merged_quantiles(monthly, ["category"], QS)
    asked = merged.select("category", "n", F.posexplode("quantiles").alias("k", "v")).withColumn("q", F.array(*map(F.lit, QS))[F.col("k")])
    ranks = base.join(asked, "category").groupBy("category", "q", "n").agg(F.count_if(F.col("x") < F.col("v")).alias("below"), F.count_if(F.col("x") <= F.col("v")).alias("upto"))
    error = order_stats.SKETCH_ERROR
    return ranks.select("category", "q", "n", ((F.col("below") / F.col("n") <= F.col("q") + error) & (F.col("upto") / F.col("n") >= F.col("q") - error)).alias("within"))


AT = "2026-01-01 00:00:00"
URBAN = ("01", "05", "09")
PRICE_SQL = """, m AS (SELECT category, CAST(sum(amount) AS DOUBLE) / count(*) AS baseline, count(*) AS sample_size FROM contracts GROUP BY category HAVING count(*) >= 5),
  e AS (SELECT c.*, sample_size, baseline * (CASE WHEN sign_date < TIMESTAMP '1999-01-01' THEN pow(1.03, greatest(0, 1999 - year(sign_date))) ELSE 1.0 END)
    * (1 + CASE WHEN substr(region, 1, 2) IN ('01', '05', '09') THEN 0.10e0 ELSE -0.05e0 END) AS expected FROM contracts c JOIN m ON c.category = m.category),
  d AS (SELECT *, (CAST(amount AS DOUBLE) - expected) / expected * 100 AS deviation_pct FROM e)
  SELECT id AS entity_id, CAST(amount AS DOUBLE) AS actual, round(expected, 4) AS expected, round(deviation_pct, 4) AS deviation_pct,
    CASE WHEN deviation_pct > 100 THEN 'high' WHEN deviation_pct >= 50 THEN 'medium' ELSE 'low' END AS severity, sample_size
  FROM d WHERE round(deviation_pct, 2) > 30 AND CAST(amount AS DOUBLE) > round(expected * 1.3, 2)"""


@query(PRICE_SQL)
def a1_price_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    out = anomalies.price_anomalies(contracts(spark, sf), AT, base="1999-01-01", urban=URBAN)
    return out.select("entity_id", "actual", F.round("expected", 4).alias("expected"), F.round("deviation_pct", 4).alias("deviation_pct"), "severity", "sample_size")


VOLUME_SQL = """, v AS (SELECT id, lot_id, customer, category, quantity, year(sign_date) AS y, month(sign_date) AS m FROM contracts WHERE quantity > 0),
  my AS (SELECT category, m, y, sum(quantity) AS s, count(*) AS n FROM v GROUP BY 1, 2, 3),
  sea AS (SELECT category, m, y, sum(s) OVER w AS s, coalesce(sum(n) OVER w, 0) AS n FROM my WINDOW w AS (PARTITION BY category, m ORDER BY y RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  yy AS (SELECT category, y, sum(s) AS s, sum(n) AS n FROM my GROUP BY 1, 2),
  ann AS (SELECT category, y, sum(s) OVER w AS s, coalesce(sum(n) OVER w, 0) AS n FROM yy WINDOW w AS (PARTITION BY category ORDER BY y RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  b AS (SELECT v.*, CASE WHEN sea.n >= 5 THEN 'seasonal' ELSE 'annual' END AS baseline_kind, CAST(CASE WHEN sea.n >= 5 THEN sea.n ELSE ann.n END AS BIGINT) AS sample_size,
    round(CASE WHEN sea.n >= 5 THEN sea.s / sea.n ELSE ann.s / ann.n END, 3) AS baseline FROM v
    JOIN sea ON v.category = sea.category AND v.m = sea.m AND v.y = sea.y JOIN ann ON v.category = ann.category AND v.y = ann.y),
  k AS (SELECT *, round(quantity / baseline, 3) AS multiplier FROM b WHERE sample_size >= 5 AND baseline > 0)
  SELECT id, CASE WHEN lot_id > 0 THEN lot_id ELSE id END AS entity_id, baseline_kind, sample_size, baseline AS expected, multiplier,
    CASE WHEN greatest(multiplier, round(quantity / 45.0, 3)) > 10 THEN 'high' WHEN greatest(multiplier, round(quantity / 45.0, 3)) >= 5 THEN 'medium' ELSE 'low' END AS severity
  FROM k WHERE multiplier > 1.6 OR quantity > 45"""


def _volume(rows: DataFrame) -> DataFrame:
    profiles = spend.customer_volume(rows, (1900, 2100)).select("customer", F.lit("small").alias("org_size"), F.lit(45.0).alias("org_threshold"))
    out = anomalies.volume_anomalies(rows, profiles, AT, trigger=1.6)
    return out.select("id", "entity_id", "baseline_kind", "sample_size", "expected", "multiplier", "severity")


@query(VOLUME_SQL)
def a2_volume_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    return _volume(contracts(spark, sf).where("quantity > 0"))


SIZE_SQL = """, p AS (SELECT s.customer, CASE WHEN size = 'small' AND contains(name, 'ministry') THEN 'medium' ELSE size END AS size FROM (
    SELECT customer, CASE WHEN n >= 300 OR t >= 5000000000 THEN 'large' WHEN n >= 80 OR t >= 500000000 THEN 'medium' ELSE 'small' END AS size FROM
      (SELECT customer, count(*) AS n, sum(amount) AS t FROM contracts WHERE quantity > 0 GROUP BY 1) x) s
    JOIN (SELECT c_custkey, replace(lower(c_name), '0001', 'ministry') AS name FROM customer) c ON s.customer = c_custkey),
  lim AS (SELECT customer, CASE size WHEN 'small' THEN 45.0 WHEN 'medium' THEN 47.0 ELSE 49.0 END AS org_threshold FROM p)"""


@query(SIZE_SQL + VOLUME_SQL.replace("k AS (SELECT *, round(quantity / baseline, 3) AS multiplier FROM b WHERE", "k AS (SELECT b.*, org_threshold, round(quantity / baseline, 3) AS multiplier FROM b JOIN lim ON b.customer = lim.customer WHERE").replace("45.0, 3", "org_threshold, 3").replace("quantity > 45", "quantity > org_threshold"))
def a2_volume_anomalies_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Volume anomalies against thresholds of the customers' own sizes, from their contracts and latest names."""
    rows = contracts(spark, sf).where("quantity > 0")
    names = table(spark, sf, "customer").select(F.col("c_custkey").alias("customer"), F.regexp_replace(F.lower("c_name"), "0001", "ministry").alias("name"))
    profiles = anomalies.org_profiles(spend.customer_volume(rows, (1900, 2100)), names, {"small": 45.0, "medium": 47.0, "large": 49.0})
    out = anomalies.volume_anomalies(rows, profiles, AT, trigger=1.6)
    return out.select("id", "entity_id", "baseline_kind", "sample_size", "expected", "multiplier", "severity")


@query("""SELECT customer, CASE WHEN size <> 'large' AND contains(name, '0001') THEN 'small' ELSE size END AS org_size FROM (
    SELECT s.customer, lower(c_name) AS name, CASE WHEN n >= 300 OR t >= 5000000000 THEN 'large' WHEN n >= 80 OR t >= 500000000 THEN 'medium' ELSE 'small' END AS size FROM
      (SELECT customer, count(*) AS n, sum(amount) AS t FROM contracts GROUP BY 1) s LEFT JOIN customer c ON s.customer = c_custkey) x""")
def a2a_org_profiles(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "customer").select(F.col("c_custkey").alias("customer"), F.regexp_replace("c_name", "0001", "school").alias("name"))
    stats_ = spend.customer_volume(contracts(spark, sf), (1900, 2100))
    return anomalies.org_profiles(stats_, names).select("customer", "org_size")


def _peers_sql(name: str, key: str, bucket: str, source: str) -> str:
    """Peers by brute force: all other rows of the key and bucket, median of their list."""
    return f"""{name} AS (SELECT a.id, count(b.id) AS n, median(b.amount) AS med FROM f a JOIN f b ON a.category = b.category AND {key} AND {bucket} AND a.id <> b.id GROUP BY a.id)"""


FAIR_SQL = (
    ", f AS (SELECT id, category, region, substr(region, 1, 2) AS r2, CAST(amount AS DOUBLE) AS amount, year(sign_date) * 4 + quarter(sign_date) - 1 AS q FROM contracts WHERE amount > 0), "
    + ", ".join(
        _peers_sql(f"{t}_{s}", k, b, "f")
        for t, b in (("same", "a.q = b.q"), ("wide", "abs(a.q - b.q) <= 1"))
        for s, k in (("exact", "a.region = b.region"), ("prefix", "a.r2 = b.r2"), ("category", "TRUE"))
    )
    + ", x AS (SELECT f.id, amount, CASE "
    + " ".join(f"WHEN {p}.n >= 5 THEN '{p}'" for p in ("same_exact", "same_prefix", "same_category", "wide_exact", "wide_prefix", "wide_category"))
    + " END AS scope, CASE "
    + " ".join(f"WHEN {p}.n >= 5 THEN {p}.n" for p in ("same_exact", "same_prefix", "same_category", "wide_exact", "wide_prefix", "wide_category"))
    + " END AS peer_count, CASE "
    + " ".join(f"WHEN {p}.n >= 5 THEN {p}.med" for p in ("same_exact", "same_prefix", "same_category", "wide_exact", "wide_prefix", "wide_category"))
    + " END AS med FROM f "
    + " ".join(f"LEFT JOIN {p} ON f.id = {p}.id" for p in ("same_exact", "same_prefix", "same_category", "wide_exact", "wide_prefix", "wide_category"))
    + ") SELECT id AS entity_id, scope, peer_count, med AS expected, amount / med AS score, CASE WHEN amount / med < 0.5 OR amount / med > 2 THEN 'high' "
    "WHEN amount / med < 0.6 OR amount / med > 1.5 THEN 'medium' ELSE 'low' END AS severity FROM x WHERE med > 0 AND (amount / med < 0.7 OR amount / med > 1.3)"
)


def _fairness(rows: DataFrame, **options: int) -> DataFrame:
    out = anomalies.fairness_anomalies(rows, AT, **options)
    return out.select("entity_id", "scope", F.col("peer_count").cast("long").alias("peer_count"), "expected", "score", "severity")


@query(FAIR_SQL)
def a3_fairness_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    return _fairness(contracts(spark, sf))


@query(FAIR_SQL)
def a3_fairness_anomalies_whole(spark: SparkSession, sf: str) -> DataFrame:
    """The same scores with every group of over 50 contracts split, as groups of over LIMIT rows are."""
    return _fairness(contracts(spark, sf), limit=50)


@query(PRICE_SQL.replace(">= 5)", ">= 2000)").replace("SELECT id AS entity_id, CAST(amount AS DOUBLE) AS actual, round(expected, 4) AS expected, round(deviation_pct, 4) AS deviation_pct,\n    CASE WHEN deviation_pct > 100 THEN 'high' WHEN deviation_pct >= 50 THEN 'medium' ELSE 'low' END AS severity, sample_size\n  FROM d WHERE round(deviation_pct, 2) > 30 AND CAST(amount AS DOUBLE) > round(expected * 1.3, 2)", """SELECT count(*) AS "analysed", count(*) FILTER (WHERE round(deviation_pct, 2) > 30 AND CAST(amount AS DOUBLE) > round(expected * 1.3, 2)) AS found, (SELECT count(*) FROM contracts) - count(*) AS skipped FROM d"""))
def a6_run_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a price run: those analysed (of categories with enough rows), found, and skipped."""
    return anomalies.price_run(contracts(spark, sf), 2000, base="1999-01-01", urban=URBAN)


@query("""SELECT supplier, round(average, 4) AS average, round(z, 6) AS z FROM (SELECT supplier, average, (average - avg(average) OVER ()) / stddev_pop(average) OVER () AS z FROM
  (SELECT supplier, avg(CAST(amount AS DOUBLE)) AS average FROM contracts GROUP BY supplier) m) x WHERE abs(z) > 2""")
def a7_outliers(spark: SparkSession, sf: str) -> DataFrame:
    out = anomalies.outliers(contracts(spark, sf).withColumn("v", F.col("amount").cast("double")), "supplier", "v")
    return out.select("supplier", F.round("average", 4).alias("average"), F.round("z", 6).alias("z"))
