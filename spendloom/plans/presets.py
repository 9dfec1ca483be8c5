"""The given tables seen as procurement tables.

A line item is a version of a contract (its ship date the version), an order an announcement, a part a lot, a customer
a buyer; a nation's code (two digits) and its region's (two more) make the region code, a brand's digits the category.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendloom.operators.versions import latest

VERSION_COLUMNS = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All versions: id, version, and the columns that order versions of one day."""
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), *li.columns)


def latest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(line_versions(spark, sf_dir), ["id"], "l_shipdate", ["l_orderkey", *VERSION_COLUMNS], VERSION_COLUMNS[1:])


def region_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(F.concat(F.lpad(F.col("n_nationkey").cast("string"), 2, "0"), F.lpad(F.col("n_regionkey").cast("string"), 2, "0")).alias("code"), F.col("n_name").alias("name"))


def contracts(spark: SparkSession, sf_dir: str, *, category: bool = True, region: bool = True) -> DataFrame:
    """Latest snapshot: id, announcement_id, lot_id, customer, supplier, category, region, amount, quantity, sign_date,
    updated_at. Dimensions are joined after the snapshot, and only those asked for, since Spark keeps inner joins."""
    rows = latest_lines(spark, sf_dir)
    rows = rows.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    columns = [
        "id", F.col("l_orderkey").alias("announcement_id"), F.col("l_partkey").alias("lot_id"), F.col("o_custkey").alias("customer"), F.col("l_suppkey").alias("supplier"), F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"),
        F.col("l_quantity").alias("quantity"), F.col("o_orderdate").alias("sign_date"), F.col("l_shipdate").alias("updated_at"),
    ]
    if category:
        rows = rows.join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        columns.insert(5, F.regexp_replace("p_brand", "[^0-9]", "").alias("category"))
    if region:
        rows = rows.join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        rows = rows.join(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
        columns.insert(6 if category else 5, F.concat(F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.lpad(F.col("n_regionkey").cast("string"), 2, "0")).alias("region"))
    return rows.select(*columns)


#: The same views in SQL.
CONTRACTS_SQL = """
WITH li AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC,
      l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) AS rn FROM lineitem) x
  WHERE rn = 1),
contracts AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS announcement_id, l_partkey AS lot_id, o_custkey AS customer, l_suppkey AS supplier,
    regexp_replace(p_brand, '[^0-9]', '', 'g') AS category,
    lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || lpad(CAST(n_regionkey AS VARCHAR), 2, '0') AS region,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, l_quantity AS quantity, o_orderdate AS sign_date, l_shipdate AS updated_at
  FROM li JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey)
"""
