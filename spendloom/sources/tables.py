"""Typed table scans, reference tables and sinks."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendloom.functions import normalize as n
from spendloom.operators.versions import hash_upsert
from spendloom.sources.shared import created, listed, remove, renamed

#: Columns of the tables, as DDL.
SCHEMAS = {
    "subjects": "id long, bin long, name string, name_kz string, is_customer int, is_supplier int, region string, updated_at timestamp_ntz",
    "plans": "id long, number string, customer long, plan_year int, category string, region string, amount decimal(18,2), published timestamp_ntz, updated_at timestamp_ntz",
    "announcements": "id long, number string, customer long, total_sum decimal(18,2), count_lots long, status_id long, status string, published timestamp_ntz, start_date timestamp_ntz, end_date timestamp_ntz, updated_at timestamp_ntz",
    "lots": "id long, source_id long, announcement_id long, number string, customer long, category string, region string, quantity decimal(18,3), unit_price decimal(18,2), amount decimal(18,2), created_at timestamp_ntz, updated_at timestamp_ntz",
    "contracts": "id long, contract_id long, number string, announcement_id long, lot_id long, customer long, supplier long, category string, region string, amount decimal(18,2), amount_tax decimal(18,2), status_id long, sign_date timestamp_ntz, start_date timestamp_ntz, end_date timestamp_ntz, updated_at timestamp_ntz",
    "acts": "id long, contract_id long, number string, customer long, supplier long, act_sum decimal(18,2), status string, act_date timestamp_ntz, approved_at timestamp_ntz, updated_at timestamp_ntz",
    "categories": "code string, name string, name_kz string, parent string, level int, row_hash long",
    "regions": "code string, name string, name_kz string, parent string, level int, row_hash long",
    "units": "code string, name string, name_kz string, row_hash long",
    "anomalies": "anomaly_id long, anomaly_type string, entity_type string, entity_id long, customer long, category string, region string, sign_date timestamp_ntz, actual double, expected double, deviation_pct double, severity string, evidence string, detected_at timestamp_ntz",
}


def scan(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table with its declared types; tables with category codes get their prefixes of 2, 3 and 4 digits."""
    df = spark.read.schema(SCHEMAS[name]).parquet(path)
    if "category" in df.columns:
        df = df.withColumns({f"category_{k}": n.code_prefix(F.col("category"), k) for k in (2, 3, 4)})
    return df


def load_reference(records: DataFrame, stored: DataFrame | None, code: Sequence[str] = ("code",), name: Sequence[str] = ("name_ru", "name"), name_kz: Sequence[str] = ("name_kz",), arrival: str | None = None) -> DataFrame:
    """Rows of a reference table with ``change_type`` against the stored ones (all 'new' without them, which replaces
    the table). Rows without a code or either name are left out; of a code the record of highest ``arrival`` counts,
    then (or without that column) the one whose names order last."""
    own = lambda names: n.first_text(*(F.col(c) for c in names if c in records.columns))
    order = F.col(arrival) if arrival else F.lit(0)
    rows = records.select(own(code).alias("code"), own(name).alias("name"), own(name_kz).alias("name_kz"), order.alias("__arrival")).where("code <> '' and name <> '' and name_kz <> ''")
    rows = rows.withColumn("__arrival", F.struct("__arrival", "name", "name_kz"))
    before = stored if stored is not None else records.sparkSession.createDataFrame([], "code string, name string, name_kz string")
    return hash_upsert(rows, before, ["code"], ["name", "name_kz"], "__arrival").drop("__arrival")


def write_anomalies(rows: DataFrame, path: str, replace: bool = False, types: Sequence[str] = ()) -> None:
    """Appends anomalies by type; with ``replace`` the types in ``rows`` replace their partitions, others stay.

    ``types`` are those that a replacing run looked for: what it found nothing of loses its old rows, too. New
    partitions are written aside first, so a run that fails while it computes changes nothing; then each type's folder
    is moved out of the way and the new one moved in. If a move fails, the old folder is put back.
    """
    names = [f.split()[0] for f in SCHEMAS["anomalies"].split(", ")]
    writer = rows.select(*names).write.partitionBy("anomaly_type")
    if not replace:
        writer.mode("append").parquet(path)
        return
    spark, run = rows.sparkSession, uuid.uuid4().hex
    new, old = f"{path}/_new-{run}", f"{path}/_old-{run}"
    writer.parquet(new)
    found = {n for n in listed(spark, new) if n.startswith("anomaly_type=")}
    created(spark, old)
    for name in sorted(found | {f"anomaly_type={t}" for t in types}):
        before = name in listed(spark, path)
        if before:
            renamed(spark, f"{path}/{name}", f"{old}/{name}")
        if name in found:
            try:
                renamed(spark, f"{new}/{name}", f"{path}/{name}")
            except Exception:
                if before:
                    renamed(spark, f"{old}/{name}", f"{path}/{name}")
                raise
    remove(spark, new)
    remove(spark, old)


def json_rows(df: DataFrame) -> DataFrame:
    """One column ``value``: each row as JSON, decimals as strings."""
    fields = [F.col(f.name).cast("string").alias(f.name) if f.dataType.typeName() == "decimal" else F.col(f.name) for f in df.schema.fields]
    return df.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


def write_report(leveled: DataFrame, path: str) -> None:
    """A quality report: its metrics as Parquet."""
    leveled.write.mode("overwrite").parquet(path)


def presence(tables: Mapping[str, DataFrame], expected: Mapping[str, Sequence[str]]) -> DataFrame:
    """(table, column, present, rows, filled) of the expected columns: whether they are there, how many rows their table
    has, and in how many of them the column has a value; one pass over each table. Of a table that is not there, one
    row without a column."""
    parts = []
    for name, columns in expected.items():
        df = tables.get(name)
        if df is None:
            some = next(iter(tables.values()))
            parts.append(some.limit(0).agg(F.lit(name).alias("table"), F.lit(None).cast("string").alias("column"), F.lit(False).alias("present"), F.lit(0).cast("long").alias("rows"), F.lit(0).cast("long").alias("filled")))
            continue
        filled = lambda c, df=df: F.count(F.col(c)) if c in df.columns else F.lit(0).cast("long")
        counted = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(c in df.columns).alias("present"), filled(c).alias("filled")) for c in columns))
        one = df.agg(F.count(F.lit(1)).alias("rows"), counted.alias("all"))
        parts.append(one.select(F.lit(name).alias("table"), "rows", F.explode("all").alias("x")).select("table", "x.column", "x.present", "rows", "x.filled"))
    return reduce(DataFrame.unionByName, parts)


def missing(tables: Mapping[str, DataFrame], expected: Mapping[str, Sequence[str]]) -> list[tuple[str, str]]:
    """(table, column) of the expected columns that are not there; of a table that is not there, (table, '')."""
    out = []
    for name, columns in expected.items():
        df = tables.get(name)
        out += [(name, "")] if df is None else [(name, c) for c in columns if c not in df.columns]
    return out


def missing_columns(df: DataFrame, expected: Sequence[str]) -> list[str]:
    return [c for c in expected if c not in df.columns]
