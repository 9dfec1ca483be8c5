"""Data-quality rules as one long table of metrics: table, check, field, violations, pct, level."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ERROR_PCT, WARN_PCT = 5.0, 1.0


@dataclass(frozen=True)
class Rules:
    """Rules of one table."""

    required: Mapping[str, str] = field(default_factory=dict)  # field -> numeric, string or date
    key: str | None = None
    dates: Sequence[str] = ()
    years: Sequence[str] = ()
    owner: str | None = None
    status: str | None = None
    code: str | None = None
    types: Mapping[str, str] = field(default_factory=dict)  # field -> prefix of Spark's type name
    references: Mapping[str, tuple[str, str]] = field(default_factory=dict)  # field -> (table, its key)


#: Rules of the procurement tables.
CATALOGUE = {
    "subjects": Rules({"id": "numeric", "bin": "numeric", "name": "string"}, "id", owner="bin", types={"id": "bigint", "bin": "bigint", "name": "string"}),
    "plans": Rules({"id": "numeric", "customer": "numeric", "plan_year": "numeric"}, "id", ["published"], ["plan_year"], "customer", types={"id": "bigint", "customer": "bigint", "plan_year": "int", "published": "timestamp"}),
    "announcements": Rules({"id": "numeric", "customer": "numeric", "total_sum": "numeric"}, "id", ["published", "start_date", "end_date"], owner="customer", types={"id": "bigint", "total_sum": "decimal"}),
    "lots": Rules({"id": "numeric", "announcement_id": "numeric", "category": "string"}, "id", ["created_at"], owner="customer", code="category", types={"id": "bigint", "amount": "decimal"}, references={"announcement_id": ("announcements", "id"), "category": ("categories", "code")}),
    "contracts": Rules({"id": "numeric", "announcement_id": "numeric", "customer": "numeric", "amount": "numeric", "sign_date": "date"}, "id", ["sign_date", "start_date", "end_date"], owner="customer", status="status_id", code="category", types={"id": "bigint", "amount": "decimal", "sign_date": "timestamp"}, references={"announcement_id": ("announcements", "id"), "category": ("categories", "code")}),
    "acts": Rules({"id": "numeric", "contract_id": "numeric", "act_sum": "numeric"}, "id", ["act_date"], types={"id": "bigint", "act_sum": "decimal"}, references={"contract_id": ("contracts", "id")}),
    "categories": Rules({"code": "string", "name": "string"}, "code"),
    "regions": Rules({"code": "string", "name": "string"}, "code"),
    "units": Rules({"code": "string", "name": "string"}, "code"),
}


def _invalid(name: str, kind: str) -> Column:
    if kind == "string":
        return F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))) == ""
    return F.col(name).isNull() if kind == "date" else F.coalesce(F.col(name), F.lit(0)) == 0


def table_metrics(df: DataFrame, name: str, rules: Rules, owners: Sequence[int] = (), date_range: tuple[str, str] = ("2024-01-01", "2026-12-31"), year_range: tuple[int, int] = (2024, 2026)) -> DataFrame:
    """Metric rows of one table; all row-wise rules are one aggregation."""
    low, high = (F.lit(x).cast("timestamp_ntz") for x in date_range)
    checks: list[tuple[str, str, Column]] = [("rows", "", F.lit(True))]
    checks += [("required", f, _invalid(f, kind)) for f, kind in rules.required.items() if f in df.columns]
    checks += [("date_range", f, F.coalesce(~F.col(f).cast("timestamp_ntz").between(low, high), F.lit(False))) for f in rules.dates]
    checks += [("year_range", f, F.coalesce(~F.col(f).between(*year_range), F.lit(False))) for f in rules.years]
    if rules.owner and owners:
        checks.append(("owner_scope", rules.owner, (F.col(rules.owner) > 0) & ~F.col(rules.owner).isin(list(owners))))
    if rules.status:
        checks.append(("status", rules.status, F.coalesce(F.col(rules.status), F.lit(0)) == 0))
    if rules.code:
        checks.append(("format", rules.code, F.length(F.regexp_replace(F.coalesce(F.col(rules.code), F.lit("")), "[^0-9]", "")) < 2))
    one = df.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(f"c{k}") for k, (_, _, c) in enumerate(checks)))
    stacked = F.explode(F.array(*(F.struct(F.lit(kind).alias("check"), F.lit(f).alias("field"), F.col(f"c{k}").alias("violations")) for k, (kind, f, _) in enumerate(checks))))
    out = [one.select("n", stacked.alias("m")).select("m.*", "n")]
    if rules.key:
        repeated = df.groupBy(rules.key).count().where("count > 1")
        totals = repeated.agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("excess"))
        each = F.explode(F.array(F.struct(F.lit("duplicate_keys").alias("check"), F.col("keys").alias("violations")), F.struct(F.lit("duplicate_rows").alias("check"), F.col("excess").alias("violations"))))
        out.append(totals.select(each.alias("m")).select("m.check", F.lit(rules.key).alias("field"), "m.violations", F.lit(None).cast("long").alias("n")))
    wrong = [(f, df.schema[f].dataType.simpleString() if f in df.columns else "missing") for f, prefix in rules.types.items() if f not in df.columns or not df.schema[f].dataType.simpleString().startswith(prefix)]
    wrong += [(f, "missing") for f in rules.required if f not in df.columns and f not in rules.types]
    schema = T.StructType([T.StructField("check", T.StringType()), T.StructField("field", T.StringType()), T.StructField("violations", T.LongType()), T.StructField("n", T.LongType())])
    out.append(df.sparkSession.createDataFrame([("type", f"{f}: {found}", 1, None) for f, found in wrong], schema))
    rows = reduce(DataFrame.unionByName, out)
    return rows.select(F.lit(name).alias("table"), "check", "field", F.col("violations").cast("long").alias("violations"), F.when(F.col("n") > 0, F.round(F.col("violations") * 100.0 / F.col("n"), 2)).alias("pct"))


def reference_metrics(child: DataFrame, parent: DataFrame, name: str, key: str, parent_key: str) -> DataFrame:
    """Rows whose key (positive, or not blank) is missing in the parent."""
    text = isinstance(child.schema[key].dataType, T.StringType)
    asked = child.where(F.trim(F.col(key)) != "" if text else F.col(key) > 0)
    lost = asked.join(parent.select(F.col(parent_key).alias("__k")), F.col(key) == F.col("__k"), "left_anti")
    kind = "unknown_code" if text else "reference"
    return lost.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("table"), F.lit(kind).alias("check"), F.lit(key).alias("field"), "violations", F.lit(None).cast("double").alias("pct"))


def levels(metrics: DataFrame) -> DataFrame:
    """``metrics`` with ``level``: required fields by per cent, references and types are errors, other violations warnings."""
    bad = F.col("violations") > 0
    level = (
        F.when(F.col("check") == "rows", "ok")
        .when((F.col("check") == "required") & (F.col("pct") > ERROR_PCT), "error").when((F.col("check") == "required") & (F.col("pct") >= WARN_PCT), "warn").when(F.col("check") == "required", "ok")
        .when(bad & F.col("check").isin("reference", "type"), "error").when(bad, "warn").otherwise("ok")
    )
    return metrics.withColumn("level", level)


def score(leveled: DataFrame) -> DataFrame:
    """(errors, warnings, score): FAIL with an error, WARN with a warning, else PASS."""
    out = leveled.agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warn").alias("warnings"))
    return out.withColumn("score", F.when(F.col("errors") > 0, "FAIL").when(F.col("warnings") > 0, "WARN").otherwise("PASS"))


def validate(tables: Mapping[str, DataFrame], owners: Sequence[int] = (), catalogue: Mapping[str, Rules] = CATALOGUE, **ranges) -> DataFrame:
    """Leveled metrics of all given tables that have rules; references to tables not given are left out."""
    parts = []
    for name, df in tables.items():
        if rules := catalogue.get(name):
            parts.append(table_metrics(df, name, rules, owners, **ranges))
            parts += [reference_metrics(df, tables[t], name, f, k) for f, (t, k) in rules.references.items() if t in tables and f in df.columns]
    return levels(reduce(DataFrame.unionByName, parts))


def report_text(leveled: DataFrame) -> DataFrame:
    """(table, line): one readable line for each metric that is not ok."""
    line = F.concat_ws(" ", F.concat_ws(".", "table", F.nullif("field", F.lit(""))), F.col("check"), F.concat(F.lit("violations="), F.col("violations")), F.concat(F.col("pct").cast("string"), F.lit("%")))
    return leveled.where("level <> 'ok'").select("table", "level", line.alias("line"))


def table_schema(df: DataFrame, name: str) -> DataFrame:
    """(table, column, type) of a table."""
    return df.sparkSession.createDataFrame([(name, f.name, f.dataType.simpleString()) for f in df.schema.fields], "table string, column string, type string")
