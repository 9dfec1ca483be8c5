"""Registered queries of the record parsers, reference loads, sinks and listings, over records made from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendloom.functions import normalize as n
from spendloom.operators import anomalies, answers, quality, retrieval, spend
from spendloom.plans.presets import contracts, table
from spendloom.plans.queries import AT, PRICE_SQL, URBAN, query
from spendloom.plans.text_queries import D12_SQL, d12_quality_metrics
from spendloom.sources import records, tables
from spendloom.sources.shared import shared_folder

NOW = "2024-01-01 00:00:00"


def _text(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


def _comma(column: str) -> Column:
    """An amount as sources spell it: blanks between thousands, a decimal comma."""
    return F.regexp_replace(F.regexp_replace(F.format_number(F.col(column).cast("decimal(18,2)"), 2), ",", " "), r"\.", ",")


#: Records of a landed page, on average.
PAGE = 200


def _landed(spark: SparkSession, rows: DataFrame, key: str, record: Column, entity: str, n: int) -> DataFrame:
    """Records written as pages {"items": [...]} and read again; ``key`` tells rows apart and deals the ``n`` rows to
    pages of bounded size."""
    path = f"{shared_folder(spark)}/landed-{uuid.uuid4().hex}/{entity}"
    items = rows.groupBy(F.pmod(F.xxhash64(key), F.lit(max(1, n // PAGE))).alias("page")).agg(F.collect_list(record).alias("items")).select(F.to_json(F.struct("items", F.lit("next").alias("search_after"))).alias("value"))
    items.write.text(path)
    return records.read_records(spark, path, entity)[0]


def _id(column: str = "id") -> Column:
    return F.conv(F.hex(column), 16, 10).alias("id")


def _hash(*parts: str) -> str:
    """SQL of ``hash_id``, unsigned."""
    return f"CAST(CAST('0x' || substr(sha256({'|| chr(58) ||'.join(f'CAST({p} AS VARCHAR)' for p in parts)}), 1, 16) AS UBIGINT) AS VARCHAR)"


@query(f"""SELECT CASE WHEN l_orderkey IS NULL THEN CAST(o_orderkey AS VARCHAR) ELSE {_hash("o_orderkey", "l_linenumber")} END AS id, o_orderkey AS contract_id, coalesce(l_partkey, 0) AS lot_id, o_custkey AS customer,
    CAST(CASE WHEN l_orderkey IS NULL THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END AS DOUBLE) AS amount, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day,
    CASE WHEN o_orderkey = 0 THEN 'missing_id' WHEN o_custkey = 0 THEN 'non_target' WHEN year(o_orderdate) NOT IN (1996, 1997, 1998) THEN 'non_target_year' WHEN o_orderstatus = 'O' THEN 'status' END AS reject_reason
  FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey""")
def n20_contracts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as contracts; their lines as units at up to seven levels."""
    unit = F.struct(F.col("l_linenumber").alias("id"), F.col("l_partkey").alias("lot_id"), F.lit("26").alias("enstr_code"), _comma("l_extendedprice").alias("sum"), F.col("l_linenumber").alias("no"))
    units = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(unit).alias("units"))
    rows = table(spark, sf, "orders").join(units, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    some = lambda no: F.filter("units", lambda u: u["no"] == no)
    # a line lies as many levels down as its number says, under one key or another
    below = F.struct(F.filter("units", lambda u: u["no"] >= 7).alias("unit_list"))
    for no, key in zip((6, 5, 4, 3), ("rows", "items", "unit_list", "rows"), strict=True):
        below = F.struct(some(no).alias(key), below.alias("children") if no % 2 else F.array(F.array(below)).alias("specifications"))
    status = F.when(F.col("o_orderstatus") == "F", "Исполнен").when(F.col("o_orderstatus") == "O", "Отменен").otherwise("new")
    record = F.struct(
        F.col("o_orderkey").alias("id_contract"), _text("o_orderkey").alias("trdBuyId"), _text("o_custkey").alias("customerBin"), F.date_format("o_orderdate", "dd.MM.yyyy").alias("signed_date"), _comma("o_totalprice").alias("sum"),
        status.alias("status_name"), some(1).alias("contract_units"), F.struct(some(2).alias("items"), below.alias("children")).alias("specifications"),
    )
    parsed = records.parse_contracts(_landed(spark, rows, "o_orderkey", record, "contracts", table(spark, sf, "orders").count()), F.lit(NOW).cast("timestamp_ntz"), years=(1996, 1997, 1998))
    return parsed.select(_id(), "contract_id", "lot_id", "customer", F.col("amount").cast("double").alias("amount"), F.to_date("sign_date").cast("string").alias("day"), "reject_reason")


LOTS_SQL = f"""WITH c AS (SELECT p.*, unnest(CASE WHEN p_size % 5 = 0 THEN [NULL] ELSE [regexp_replace(p_brand, '[^0-9]', '', 'g'), '7' || CAST(p_size AS VARCHAR)] END) AS category FROM part p),
  r AS (SELECT c.*, unnest(CASE WHEN p_size % 2 = 0 THEN ['71', '75'] ELSE [''] END) AS region FROM c)
  SELECT {_hash("p_partkey", "'1'", "coalesce(category, '')", "region")} AS id, p_partkey AS source_id, category, region, CAST(p_size AS DOUBLE) AS quantity,
    CAST(round(CAST(CAST(p_retailprice AS DECIMAL(18,2)) / p_size AS DECIMAL(28,8)), 2) AS DOUBLE) AS unit_price, CASE WHEN p_partkey = 0 THEN 'missing_id' WHEN category IS NULL THEN 'missing_code' END AS reject_reason FROM r"""


@query(LOTS_SQL)
def n20_lots(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as lots of one point; codes as texts, numbers and nested objects, regions as objects."""
    p = table(spark, sf, "part")
    brand, own = F.regexp_replace("p_brand", "[^0-9]", ""), F.concat(F.lit("7"), _text("p_size"))
    deep = F.struct(own.cast("int").alias("code_lvl2"))
    for key in ("items", "children", "sub_items", "items", "enstru_list"):
        deep = F.struct(F.array(deep).alias(key))
    codes = F.struct(F.struct(brand.alias("code")).alias("a"), deep.alias("b"))
    point = F.struct(F.lit(1).alias("id"), _text("p_size").alias("count"), _text(F.col("p_retailprice").cast("decimal(18,2)")).alias("amount"), F.when(F.col("p_size") % 5 != 0, F.array(codes["a"])).alias("tru_list"))
    regions = F.when(F.col("p_size") % 2 == 0, F.array(F.struct(F.lit("71").alias("kato"), F.lit(None).cast("string").alias("code")), F.struct(F.lit(None).cast("string").alias("kato"), F.lit("75").alias("code"))))
    record = F.struct(F.col("p_partkey").alias("id"), (F.col("p_partkey") + 1).alias("buy_id"), F.array(point).alias("point_list"), F.when(F.col("p_size") % 5 != 0, codes["b"]).alias("enstru_list"), regions.alias("pln_point_kato_list"))
    parsed = records.parse_lots(_landed(spark, p, "p_partkey", record, "lots", p.count()), F.lit(NOW).cast("timestamp_ntz"))
    return parsed.select(_id(), "source_id", "category", "region", *(F.col(c).cast("double").alias(c) for c in ("quantity", "unit_price")), "reject_reason")


@query(f"""SELECT {_hash("c_custkey", "7")} AS id, c_name AS number, 1997 AS plan_year, '10' AS category, lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS region, 5.5e0 AS amount, CASE WHEN c_custkey = 0 THEN 'missing_id' WHEN c_custkey > 900 THEN 'non_target' END AS reject_reason FROM customer WHERE c_nationkey % 2 = 0
  UNION ALL SELECT {_hash("c_custkey", "1")}, c_name, 1997, '20', '35', CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE), CASE WHEN c_custkey = 0 THEN 'missing_id' WHEN c_custkey > 900 THEN 'non_target' END FROM customer WHERE c_nationkey % 2 = 0
  UNION ALL SELECT CAST(c_custkey AS VARCHAR), c_name, 1997, '', lpad(CAST(c_nationkey AS VARCHAR), 2, '0'), CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE), CASE WHEN c_custkey = 0 THEN 'missing_id' WHEN c_custkey > 900 THEN 'non_target' END FROM customer WHERE c_nationkey % 2 <> 0""")
def n20_plans(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as plans, with two points or none."""
    c = table(spark, sf, "customer")
    none = F.lit(None).cast("string")
    points = F.array(F.struct(F.lit("7").alias("id"), F.lit("10").alias("enstr_code"), none.alias("kato_code"), F.lit("5,5").alias("amount")), F.struct(none.alias("id"), F.lit("20").alias("enstr_code"), F.lit("35").alias("kato_code"), none.alias("amount")))
    record = F.struct(
        F.col("c_custkey").alias("plan_id"), F.col("c_name").alias("plan_number"), _text("c_custkey").alias("subject_biin"), F.lit("1997").alias("year"), F.lpad(_text("c_nationkey"), 2, "0").alias("kato_code"),
        _text(F.col("c_acctbal").cast("decimal(18,2)")).alias("sum"), F.when(F.col("c_nationkey") % 2 == 0, points).alias("pln_points"),
    )
    parsed = records.parse_plans(_landed(spark, c, "c_custkey", record, "plans", c.count()), F.lit(NOW).cast("timestamp_ntz"), range(1, 901))
    return parsed.select(_id(), "number", "plan_year", "category", "region", F.col("amount").cast("double").alias("amount"), "reject_reason")


@query("""SELECT o_orderkey AS id, CAST(CASE WHEN o_orderstatus = 'F' AND s IS NOT NULL THEN s WHEN o_orderstatus = 'F' THEN 0 ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS DOUBLE) AS total_sum, coalesce(k, 0) AS count_lots,
    CAST(o_orderdate + INTERVAL 10 HOUR AS VARCHAR) AS published, CAST(o_orderdate + INTERVAL 10 HOUR AS VARCHAR) AS start_date, CASE WHEN o_orderkey = 0 THEN 'missing_id' WHEN o_custkey = 0 THEN 'non_target' WHEN o_orderstatus = 'O' THEN 'status' END AS reject_reason
  FROM orders LEFT JOIN (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS s, count(*) AS k FROM lineitem GROUP BY 1) l ON o_orderkey = l_orderkey""")
def n20_announcements(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as announcements; where the total is missing it comes from the lots, and dates from those before them."""
    lot = F.struct(F.col("l_linenumber").alias("id"), _comma("l_extendedprice").alias("amount"))
    lots = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(lot).alias("lots"))
    rows = table(spark, sf, "orders").join(lots, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    status = F.when(F.col("o_orderstatus") == "O", "draft").otherwise("active")
    record = F.struct(F.col("o_orderkey").alias("trd_buy_id"), _text("o_custkey").alias("org_bin"), F.when(F.col("o_orderstatus") != "F", _comma("o_totalprice")).alias("sum"), status.alias("status_name"), F.date_format("o_orderdate", "yyyy-MM-dd'T'15:00:00+05:00").alias("date_publish"), "lots")
    parsed = records.parse_announcements(_landed(spark, rows, "o_orderkey", record, "announcements", table(spark, sf, "orders").count()), F.lit(NOW).cast("timestamp_ntz"))
    return parsed.select("id", F.col("total_sum").cast("double").alias("total_sum"), "count_lots", F.col("published").cast("string").alias("published"), F.col("start_date").cast("string").alias("start_date"), "reject_reason")


@query("""SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_suppkey = 3 THEN 0 ELSE l_orderkey END AS contract_id, l_suppkey AS supplier, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS act_sum, CASE WHEN l_linestatus = 'F' THEN 'approved' ELSE 'pending' END AS status,
    CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day, CASE WHEN l_suppkey = 3 OR l_orderkey = 0 THEN 'missing_contract' END AS reject_reason FROM lineitem""")
def n20_acts(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as acts, those of one supplier without their contract."""
    li = table(spark, sf, "lineitem")
    record = F.struct(
        _text(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("act_id"), F.when(F.col("l_suppkey") != 3, _text("l_orderkey")).alias("contractId"), F.col("l_suppkey").alias("supplier"), _comma("l_extendedprice").alias("act_sum"),
        F.when(F.col("l_linestatus") == "F", "Утвержден").otherwise("На согласовании").alias("status_name_ru"), F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("act_date"),
    )
    parsed = records.parse_acts(_landed(spark, li, "l_orderkey", record, "acts", li.count()), F.lit(NOW).cast("timestamp_ntz"))
    return parsed.select("id", "contract_id", "supplier", F.col("act_sum").cast("double").alias("act_sum"), "status", F.to_date("act_date").cast("string").alias("day"), "reject_reason")


@query("""SELECT s_suppkey AS id, 700 + s_suppkey AS bin, s_name AS name, CASE WHEN s_acctbal > 0 THEN 1 ELSE 0 END AS is_customer, 1 AS is_supplier, CASE WHEN s_nationkey < 9 THEN '1970-01-01' ELSE '2020-02-02' END AS day FROM supplier""")
def n20_subjects(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as subjects; dates before 1970 are moved there."""
    s = table(spark, sf, "supplier")
    record = F.struct(
        F.lit("").alias("zzz"), F.col("s_suppkey").alias("subject_id"), F.concat(F.lit("БИН "), _text(700 + F.col("s_suppkey"))).alias("biin"), F.lit("  ").alias("name_ru"), F.col("s_name").alias("full_name_ru"),
        F.when(F.col("s_acctbal") > 0, "yes").otherwise("no").alias("is_customer"), F.lit(True).alias("supplier_flag"), F.lit("1").alias("is_supplier"), F.when(F.col("s_nationkey") < 9, "1950-01-01").otherwise("2020-02-02").alias("last_modified"),
    )
    parsed = records.parse_subjects(_landed(spark, s, "s_suppkey", record, "subjects", s.count()), F.lit(NOW).cast("timestamp_ntz"))
    return parsed.select("id", "bin", "name", "is_customer", "is_supplier", F.to_date("updated_at").cast("string").alias("day"))


@query(f"SELECT coalesce(reject_reason, 'parsed') AS reject_reason, count(*) AS n FROM ({LOTS_SQL}) x GROUP BY 1")
def n21_ingest_stats(spark: SparkSession, sf: str) -> DataFrame:
    return records.ingest_stats(n20_lots(spark, sf))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_brand END AS first_text, CASE WHEN p_size % 3 = 0 THEN p_name ELSE '' END AS first_present, least(CAST(p_partkey * 40 AS BIGINT), 65535) AS small,
  substr(regexp_replace(p_brand, '[^0-9]', '', 'g'), 1, 1) AS prefix, round(CAST(CAST(p_retailprice AS DECIMAL(18,2)) / p_size AS DECIMAL(28,8)), 2) AS unit_price FROM part""")
def n_aliases(spark: SparkSession, sf: str) -> DataFrame:
    """First text and first present value of aliases, clamps, prefixes, derived prices."""
    p = table(spark, sf, "part")
    alias = F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise("")
    price = n.unit_price(F.lit(0).cast("decimal(18,2)"), F.col("p_retailprice").cast("decimal(18,2)"), F.col("p_size").cast("decimal(18,3)"))
    return p.select(
        "p_partkey", n.first_text(alias, F.lit(None).cast("string"), F.col("p_brand")).alias("first_text"), n.first_present(F.lit(None).cast("string"), alias, F.col("p_brand")).alias("first_present"), n.clamp(F.col("p_partkey") * 40, 16).cast("long").alias("small"),
        n.code_prefix(F.col("p_brand"), 1).alias("prefix"), price.cast("decimal(18,2)").alias("unit_price"),
    )


@query("""SELECT n.p_brand AS code, n.name, CASE WHEN o.name IS NULL THEN 'new' WHEN o.name = n.name THEN 'unchanged' ELSE 'changed' END AS change_type
  FROM (SELECT p_brand, max(p_name) AS name FROM part GROUP BY p_brand) n LEFT JOIN (SELECT p_brand, max(p_name) AS name FROM part WHERE p_brand >= 'Brand#2' AND p_size <= 40 GROUP BY p_brand) o ON n.p_brand = o.p_brand""")
def s3_reference_load(spark: SparkSession, sf: str) -> DataFrame:
    """Brands as a reference table, against a stored one that lacks some and has the names that smaller parts give."""
    p = table(spark, sf, "part").select(F.col("p_brand").alias("code"), F.col("p_name").alias("name_ru"), F.lit("kz").alias("name_kz"), "p_size")
    stored = p.where("code >= 'Brand#2' and p_size <= 40").groupBy("code").agg(F.max("name_ru").alias("name"), F.first("name_kz").alias("name_kz"))
    return tables.load_reference(p.drop("p_size"), stored).select("code", "name", "change_type")


@query("SELECT 'price' AS anomaly_type, CAST(0 AS BIGINT) AS n WHERE FALSE UNION ALL SELECT 'volume', count(*) FROM customer UNION ALL SELECT 'fairness', count(*) FROM supplier")
def s5_replaced_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    """Anomalies of three types are appended; a run over two of them finds one type only, and the other one's go."""
    path = f"{shared_folder(spark)}/anomalies-{uuid.uuid4().hex}"

    def made(rows: DataFrame, kind: str, key: str) -> DataFrame:
        empty = {f.split()[0]: F.lit(None).cast(f.split()[1]) for f in tables.SCHEMAS["anomalies"].split(", ")}
        return rows.select(*(v.alias(k) for k, v in (empty | {"anomaly_type": F.lit(kind), "anomaly_id": F.col(key).cast("long")}).items()))

    supplier, customer = table(spark, sf, "supplier"), table(spark, sf, "customer")
    tables.write_anomalies(made(supplier, "price", "s_suppkey").unionByName(made(supplier, "volume", "s_suppkey")).unionByName(made(supplier, "fairness", "s_suppkey")), path)
    tables.write_anomalies(made(customer, "volume", "c_custkey"), path, replace=True, types=("price", "volume"))
    return tables.scan(spark, path, "anomalies").groupBy("anomaly_type").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT s_suppkey, '{"s_suppkey":' || CAST(s_suppkey AS VARCHAR) || ',"price":"' || CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS VARCHAR) || '","missing":null}' AS value FROM supplier""")
def s6_json_rows(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").cast("decimal(18,2)").alias("price"), F.lit(None).cast("string").alias("missing"))
    return tables.json_rows(s).select(F.get_json_object("value", "$.s_suppkey").cast("long").alias("s_suppkey"), "value")


@query("""SELECT column_name AS "column", CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' ELSE 'timestamp_ntz' END AS type FROM (DESCRIBE lineitem)""")
def s10_table_schema(spark: SparkSession, sf: str) -> DataFrame:
    return quality.table_schema(table(spark, sf, "lineitem"), "lineitem").select("column", "type")


@query("""SELECT 'orders' AS "table", 'o_orderkey' AS "column", true AS present, count(*) AS "rows", count(o_orderkey) AS filled FROM orders UNION ALL SELECT 'orders', 'o_comment', false, count(*), 0 FROM orders
  UNION ALL SELECT 'part', 'p_brand', true, count(*), count(CASE WHEN p_size % 3 <> 0 THEN p_brand END) FROM part UNION ALL SELECT 'acts', NULL, false, 0, 0""")
def s10_presence(spark: SparkSession, sf: str) -> DataFrame:
    """Expected tables and columns: which are there, and in how many rows they have a value."""
    part = table(spark, sf, "part").withColumn("p_brand", F.when(F.col("p_size") % 3 != 0, F.col("p_brand")))
    return tables.presence({"orders": table(spark, sf, "orders"), "part": part}, {"orders": ["o_orderkey", "o_comment"], "part": ["p_brand"], "acts": ["id"]})


@query(PRICE_SQL.replace("SELECT id AS entity_id", "SELECT CAST(CAST('0x' || substr(sha256('price|contract|' || CAST(id AS VARCHAR) || '|' || category || '|2026-01-01 00:00:00'), 1, 16) AS UBIGINT) AS VARCHAR) AS anomaly_id, round(baseline, 4) AS baseline, id AS entity_id").replace("SELECT c.*, sample_size,", "SELECT c.*, sample_size, baseline,").replace("CAST(amount AS DOUBLE) AS actual, round(expected, 4) AS expected, round(deviation_pct, 4) AS deviation_pct,\n    CASE WHEN deviation_pct > 100 THEN 'high' WHEN deviation_pct >= 50 THEN 'medium' ELSE 'low' END AS severity, sample_size", "CAST(sample_size AS BIGINT) AS sample_size"))
def a4_ids_and_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Stable ids of price anomalies, and their evidence read back from JSON."""
    found = anomalies.price_anomalies(contracts(spark, sf), AT, base="1999-01-01", urban=URBAN)
    read = answers.parsed_evidence(found, "baseline double, sample_size long, expected double, actual double")
    return read.select(F.conv(F.hex("anomaly_id"), 16, 10).alias("anomaly_id"), F.round("evidence.baseline", 4).alias("baseline"), "entity_id", "evidence.sample_size")


@query(""", s AS (SELECT customer, count(*) AS n, sum(amount) AS t FROM contracts GROUP BY 1)
  SELECT customer, CASE WHEN n >= 300 OR t >= 5000000000 THEN 5e0 WHEN n >= 80 OR t >= 500000000 OR customer % 2 = 0 THEN 2e0 ELSE 1e0 END AS org_threshold FROM s""")
def a2b_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    """Thresholds by size: a name with the word for a ministry lifts a small organisation."""
    s = spend.customer_volume(contracts(spark, sf), (1900, 2100))
    names = s.select("customer", F.when(F.col("customer") % 2 == 0, "Министерство").otherwise("shop").alias("name"))
    return anomalies.org_profiles(s, names, {"small": 1.0, "medium": 2.0, "large": 5.0}).select("customer", "org_threshold")


LISTING_SQL = """, f AS (SELECT id, amount, sign_date FROM contracts WHERE amount > 20000 AND sign_date >= TIMESTAMP '1996-01-01' AND sign_date < TIMESTAMP '1998-01-01' AND contains(lower('{"c":"B' || category || '"}'), 'b1'))"""


@query(LISTING_SQL + " SELECT id AS anomaly_id, (SELECT count(*) FROM f) AS total FROM f ORDER BY sign_date DESC, id DESC LIMIT 100 OFFSET 40")
def e1_anomaly_page(spark: SparkSession, sf: str) -> DataFrame:
    """A page of filtered anomalies, newest first, with the total."""
    rows = contracts(spark, sf).where("amount > 20000").select(F.lit("price").alias("anomaly_type"), F.col("id").alias("anomaly_id"), "customer", F.concat(F.lit('{"c":"B'), "category", F.lit('"}')).alias("evidence"), F.col("sign_date").alias("detected_at"))
    keep = answers.anomaly_filter("price", contains="b1", start="1996-01-01", end="1997-12-31")
    return answers.listing(rows, keep, [F.desc("detected_at"), F.desc("anomaly_id")], 100, 40).select("anomaly_id", "total")


@query(", s AS (SELECT customer, count(*) AS n, avg(CASE WHEN quantity > 10 THEN 1.0e0 ELSE 0.0e0 END) AS c FROM contracts GROUP BY customer)" """
  SELECT customer, concat_ws(',', CASE WHEN n < 5 THEN 'few_rows' WHEN n < 10 THEN 'some_rows' END, CASE WHEN c < 0.5 THEN 'gaps' WHEN c < 0.8 THEN 'some_gaps' END, CASE WHEN customer % 2 = 0 THEN 'partial_period' END) AS codes,
    CASE WHEN n < 10 THEN CAST(n AS DOUBLE) END AS n FROM s""")
def g7_limitations(spark: SparkSession, sf: str) -> DataFrame:
    s = contracts(spark, sf).groupBy("customer").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("quantity") > 10).cast("double")).alias("c"))
    found = answers.limitations(F.col("n"), F.col("c"), F.col("customer") % 2 == 0)
    rows = s.select("customer", found.alias("f"))
    size = F.filter("f", lambda x: x["code"].endswith("_rows"))
    return rows.select("customer", F.array_join(F.transform("f", lambda x: x["code"]), ",").alias("codes"), F.get(size, 0)["value"].alias("n"))


@query(""" SELECT 'contract' AS entity_type, id AS entity_id, 'Contract C' || CAST(id AS VARCHAR) || ' ENSTR ' || category || ' KATO ' || region || ' amount ' || CAST(amount AS VARCHAR) AS content, customer, CAST(CAST(sign_date AS DATE) AS VARCHAR) AS day FROM contracts
  UNION ALL SELECT 'announcement', o_orderkey, 'Announcement A' || CAST(o_orderkey AS VARCHAR) || ' total_sum ' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) || ' lots 2', o_custkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) FROM orders
  UNION ALL SELECT 'lot', p_partkey, 'Lot #L. Lot ID ' || CAST(p_partkey AS VARCHAR) || '. Announcement . Customer BIN . Supplier BIN . ENSTR code ' || p_brand || '. KATO . Quantity ' || printf('%.3f', CAST(p_size AS DOUBLE)) || '. Amount ' || printf('%.2f', p_retailprice) || '. Created at .', NULL, NULL FROM part
  UNION ALL SELECT 'plan', c_custkey, 'Plan ' || c_name || ' ENSTR  KATO  amount ' || CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR), c_custkey, NULL FROM customer""")
def r2_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of four kinds of entities, three in short and one in long form, in one table."""
    c = contracts(spark, sf).withColumn("number", F.concat(F.lit("C"), _text("id")))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("A"), _text("o_orderkey")).alias("number"), F.col("o_custkey").alias("customer"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"), F.lit(2).alias("count_lots"), F.col("o_orderdate").alias("sign_date"))
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.lit("L").alias("number"), F.col("p_brand").alias("category"), F.col("p_size").alias("quantity"), F.col("p_retailprice").alias("amount"))
    k = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("number"), F.col("c_custkey").alias("customer"), F.col("c_acctbal").cast("decimal(18,2)").alias("amount"))
    made = [retrieval.entity_documents(rows, kind, retrieval.entity_text(rows, kind, kind == "lot"), entity_id="id") for rows, kind in ((c, "contract"), (o, "announcement"), (p, "lot"), (k, "plan"))]
    return retrieval.union_documents(*made).select("entity_type", "entity_id", "content", "customer", F.to_date("sign_date").cast("string").alias("day"))


@query(" SELECT id AS entity_id FROM contracts ORDER BY sign_date DESC, id LIMIT 200")
def r3_recent(spark: SparkSession, sf: str) -> DataFrame:
    c = contracts(spark, sf)
    return retrieval.recent(retrieval.entity_documents(c, "contract", F.lit("x"), entity_id="id")).select("entity_id")


@query("""SELECT doc_id AS entity_id, CAST(CAST('0x' || substr(sha256('document:' || CAST(doc_id AS VARCHAR) || ':0'), 1, 16) AS UBIGINT) AS VARCHAR) AS chunk_id, CASE WHEN doc_id >= 100 THEN 'new' ELSE 'old' END AS version FROM documents WHERE length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) > 0""")
def r8_index_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """First chunks of all documents; those from 100 on are upserted again."""
    d = table(spark, sf, "documents").select(F.lit("document").alias("entity_type"), F.col("doc_id").alias("entity_id"), F.col("text").alias("content"))
    first = retrieval.chunk_rows(d).where("chunk_no = 0").select("entity_id", "chunk_id")
    index = retrieval.upsert_index(first.withColumn("version", F.lit("old")), first.where("entity_id >= 100").withColumn("version", F.lit("new")))
    return index.select("entity_id", F.conv(F.hex("chunk_id"), 16, 10).alias("chunk_id"), "version")


@query(" SELECT id FROM contracts WHERE customer IN (1, 2, 3, 5, 7, 11, 13, 17, 19, 23, 29) AND contains(category, '1') AND sign_date >= TIMESTAMP '1996-01-01' AND sign_date < TIMESTAMP '1999-01-01'")
def r9_payload_filter(spark: SparkSession, sf: str) -> DataFrame:
    return contracts(spark, sf).where(retrieval.payload_filter((1, 2, 3, 5, 7, 11, 13, 17, 19, 23, 29), "1", "1996-01-01", "1998-12-31")).select("id")


@query("""WITH c AS (SELECT conv_id AS question_id, turn AS entity_id, CAST(length(text) AS DOUBLE) / 1000 AS fused, CAST(length(text) % 13 AS DOUBLE) AS rerank, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS place FROM conversations),
  t AS (SELECT *, CASE WHEN max(rerank) OVER w > min(rerank) OVER w THEN (rerank - min(rerank) OVER w) / (max(rerank) OVER w - min(rerank) OVER w) WHEN rerank > 0 THEN 1.0e0 ELSE 0.0e0 END AS s FROM c WHERE place <= 3 WINDOW w AS (PARTITION BY question_id))
  SELECT c.question_id, c.entity_id, round(coalesce(t.s, 0), 9) AS rerank_score, round(CASE WHEN t.s IS NULL THEN c.fused ELSE 0.6e0 * t.s + 0.4e0 * c.fused END, 9) AS score FROM c LEFT JOIN t ON c.question_id = t.question_id AND c.entity_id = t.entity_id""")
def r13_rerank(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("question_id"), F.col("turn").alias("entity_id"), F.char_length("text").alias("n"))
    fused = c.select("question_id", "entity_id", (F.col("n").cast("double") / 1000).alias("fused"))
    out = retrieval.rerank(fused, c.select("question_id", "entity_id", (F.col("n") % 13).cast("double").alias("rerank")), ["entity_id"], 3)
    return out.select("question_id", "entity_id", F.round("rerank_score", 9).alias("rerank_score"), F.round("score", 9).alias("score"))


@query("""WITH m AS (SELECT * FROM (VALUES ('contracts', 'required', 'amount'), ('contracts', 'status', 'status_id'), ('contracts', 'format', 'category')) t("table", "check", field)) SELECT m.*, CASE field WHEN 'amount' THEN (SELECT count(*) FROM orders WHERE round(o_totalprice) % 7 = 0)
  WHEN 'status_id' THEN (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') ELSE (SELECT count(*) FROM orders WHERE o_orderpriority < '3') END AS violations FROM m""")
def d9_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """The catalogue's rules for contracts, over orders with missing amounts, statuses of 0 and short codes."""
    o = table(spark, sf, "orders")
    rows = o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("announcement_id"), F.col("o_custkey").alias("customer"), F.when(F.round("o_totalprice") % 7 != 0, F.col("o_totalprice").cast("decimal(18,2)")).alias("amount"),
        *(F.col("o_orderdate").alias(c) for c in ("sign_date", "start_date", "end_date")), F.when(F.col("o_orderstatus") == "P", 0).otherwise(1).alias("status_id"), F.when(F.col("o_orderpriority") < "3", "7").otherwise("26.20").alias("category"),
    )
    found = quality.validate({"contracts": rows}).where("`check` in ('status', 'format') or field = 'amount' and `check` = 'required'")
    return found.select("table", "check", "field", "violations")


@query(f"""SELECT "table" || CASE WHEN field <> '' THEN '.' || field ELSE '' END AS field, "check", violations FROM ({D12_SQL}) m WHERE level <> 'ok' """)
def s11_report(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of the quality report, written, read and taken apart again."""
    path = f"{shared_folder(spark)}/report-{uuid.uuid4().hex}"
    tables.write_report(d12_quality_metrics(spark, sf), path)
    line = lambda group: F.regexp_extract("line", r"^(.*) (\w+) violations=(\d+)( .*)?$", group)
    return quality.report_text(spark.read.parquet(path)).select(line(1).alias("field"), line(2).alias("check"), line(3).cast("long").alias("violations"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d') || ',2025' END AS dates, '26.20,26.21' AS codes FROM orders""")
def c4_years_and_merge(spark: SparkSession, sf: str) -> DataFrame:
    """A year that a finer date has is dropped, another one stays; codes of two extractors are merged."""
    from spendloom.functions import text as tx

    o = table(spark, sf, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.concat_ws(" ", F.lit("договоры за"), day, F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("и "), F.year("o_orderdate").cast("string"), F.lit(" год"))).otherwise("и 2025 год"))
    dates = tx.date_tokens(text, (*range(1992, 2004), 2025))
    codes = tx.merge_lists(F.array(F.lit("26.20")), F.lit(None).cast("array<string>"), F.array(F.lit("26.21"), F.lit("26.20")))
    return o.select("o_orderkey", F.array_join(dates, ",").alias("dates"), F.array_join(codes, ",").alias("codes"))
