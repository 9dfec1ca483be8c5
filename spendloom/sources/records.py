"""Landed JSON records: pages of items, parsed into typed rows with a reject reason; nothing is dropped silently."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendloom.functions import normalize as n

TEXT, TEXTS = T.StringType(), T.ArrayType(T.StringType())


def _fields(*names: str) -> list[T.StructField]:
    return [T.StructField(x, TEXT) for x in names]


# Aliases of the fields of each entity, first one first; values of any type are read as text.
ALIASES = {
    "subjects": {
        "id": ("pid", "id", "subject_id"), "bin": ("bin", "iin", "biin"), "name": ("name_ru", "full_name_ru", "name"), "name_kz": ("name_kz", "full_name_kz"),
        "is_customer": ("customer", "is_customer"), "is_supplier": ("supplier", "is_supplier"), "region": ("kato_code", "kato"), "updated_at": ("last_update_date", "updated_at", "last_modified"),
    },
    "plans": {
        "id": ("plan_id", "id"), "number": ("plan_number", "number"), "customer": ("customer_bin", "subject_biin", "bin"), "year": ("plan_year", "pln_point_year", "year"),
        "category": ("enstr_code", "enstru_code", "code"), "region": ("kato_code", "kato"), "amount": ("planned_amount", "amount", "sum"), "published": ("publish_date", "date_create"), "updated_at": ("updated_at", "last_modified", "timestamp"),
    },
    "announcements": {
        "id": ("id", "trd_buy_id"), "number": ("number_anno", "number"), "customer": ("customer_bin", "org_bin", "bin"), "total": ("total_sum", "sum"), "count_lots": ("count_lots", "lots_count"),
        "status_id": ("ref_buy_status_id", "status_id"), "status": ("status_name_ru", "status_name", "status"), "published": ("publish_date", "date_publish"), "start": ("start_date", "date_start"), "end": ("end_date", "date_end"), "updated_at": ("last_modified", "updated_at"),
    },
    "lots": {
        "id": ("lot_id", "id"), "announcement_id": ("trd_buy_id", "trdBuyId", "buy_id"), "number": ("lot_number", "number"), "customer": ("customer_bin", "customerBin", "bin"), "category": ("enstr_code", "enstru_code", "code"),
        "region": ("kato_code", "kato"), "quantity": ("quantity", "count"), "unit_price": ("unit_price", "price"), "amount": ("amount", "sum"), "created": ("created_at", "crdate"), "updated_at": ("last_modified", "updated_at"),
    },
    "contracts": {
        "id": ("contract_id", "id", "id_contract"), "announcement_id": ("trd_buy_id", "trdBuyId", "buy_id"), "number": ("contract_number", "number", "contract_no", "num"), "lot_id": ("lot_id", "lotId"),
        "customer": ("customer_bin", "customerBin", "bin"), "supplier": ("supplier_bin", "supplierBin", "supplier"), "category": ("enstr_code", "enstru_code", "tru_code", "code", "spec_enstr_code"),
        "region": ("kato_code", "kato", "katoCode"), "amount": ("contract_sum", "sum", "amount"), "amount_tax": ("contract_sum_wnds", "sum_wnds", "amount_wnds", "sumNds"),
        "status_id": ("ref_contract_status_id", "status_id", "statusId"), "status": ("contract_status_name_ru", "contract_status_name_kz", "status_name_ru", "status_name_kz", "status_name", "status"),
        "signed": ("sign_date", "signed_date", "date_sign"), "start": ("contract_date", "start_date", "date_begin"), "end": ("exec_date", "end_date", "date_end"), "updated_at": ("last_modified", "lastModified", "updated_at", "crdate"),
    },
    "acts": {
        "id": ("act_id", "id"), "contract_id": ("contract_id", "contractId"), "number": ("act_number", "number"), "customer": ("customer_bin", "bin"), "supplier": ("supplier_bin", "supplier"), "act_sum": ("act_sum", "sum", "amount"),
        "status_id": ("status_id", "ref_status_id"), "status": ("status_name_ru", "status_name", "status"), "dated": ("act_date", "date"), "approved": ("approve_date", "approved_at"), "updated_at": ("last_modified", "updated_at"),
    },
}
NESTED = {
    "lots": ("point_list", ("id", "enstr_code", "kato_code", "count", "amount", "unit_price")),
    "plans": ("pln_points", ("id", "enstr_code", "kato_code", "amount")),
    "announcements": ("lots", ("id", "amount")),
}


# Under which keys a contract or unit holds units, what a unit is told by, and the aliases of its fields.
UNIT_CHILDREN = ("specifications", "items", "children", "contract_units", "unit_list", "rows")
UNIT_FIELDS = {
    "id": ("id",), "lot_id": ("lot_id",), "enstr_code": ("enstr_code",), "kato_code": ("kato_code",), "quantity": ("quantity", "qty", "count"), "unit_price": ("unit_price", "price"), "sum": ("sum", "amount"),
}
UNIT_TELLING = ("lot_id", "enstr_code", "quantity", "unit_price", "sum")
# Where lots and their points name category and region codes, and where codes lie in the lists' objects.
CODE_LISTS, REGION_LIST = ("enstru_list", "enstr_list", "tru_list"), "pln_point_kato_list"
CODE_FIELDS = ("enstr_code", "enstru_code", "tru_code", "spec_enstr_code", "code")
REGION_FIELDS = ("kato_code", "kato", "katoCode")
CODE_KEYS = ("enstr_code", "enstru_code", "tru_code", "code", "code_lvl2", "code_lvl3", "code_lvl4", "lvl2", "lvl3", "lvl4")
CODE_CHILDREN = ("children", "items", "sub_items", "enstru_list")
REGION_KEYS = ("kato_code", "kato", "code", "katoCode")


def record_schema(entity: str) -> T.StructType:
    """Schema of a record: every alias as text, the nested list; lists whose objects vary are variants."""
    names = sorted({a for aliases in ALIASES[entity].values() for a in aliases})
    variants = lambda *keys: [T.StructField(k, T.VariantType()) for k in keys]
    if entity == "contracts":
        return T.StructType([*_fields(*names), *variants(*UNIT_CHILDREN)])
    fields = _fields(*names)
    if entity in NESTED:
        name, own = NESTED[entity]
        point = _fields(*own)
        if entity == "lots":
            point = [*_fields(*sorted({*own, *CODE_FIELDS, *REGION_FIELDS})), *variants(*CODE_LISTS, REGION_LIST)]
        fields = [f for f in fields if f.name != name] + [T.StructField(name, T.ArrayType(T.StructType(point)))]
    if entity == "lots":
        fields = [*_fields(*sorted({*names, *CODE_FIELDS, *REGION_FIELDS})), fields[-1], *variants(*CODE_LISTS, REGION_LIST)]
    return T.StructType(fields)


def read_records(spark: SparkSession, path: str, entity: str) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of landed pages {"items": [...], "search_after": ...}.

    A page that is no JSON object, has no list of items, or an item that is no object, is a reject and keeps its text.
    """
    item = T.ArrayType(record_schema(entity))
    # each text is parsed once: what a generator makes is not put into the filters after it
    once = lambda made: F.explode(F.array(made))
    lines = spark.read.text(path).select(F.col("value").alias("page"), F.input_file_name().alias("file"), once(F.get_json_object("value", "$.items")).alias("items"))
    bad = F.col("items").isNull() | ~F.col("items").startswith("[")
    parsed = lines.where(~bad).select("page", "file", once(F.from_json("items", item)).alias("parsed"))
    broken = F.col("parsed").isNull() | F.exists("parsed", lambda x: x.isNull())
    records = parsed.where(~broken).select(F.explode("parsed").alias("r")).select("r.*")
    rejects = lines.where(bad).select("file", "page", F.lit("no list of items").alias("reason"))
    return records, rejects.unionByName(parsed.where(broken).select("file", "page", F.lit("an item is no object").alias("reason")))


def _get(df: DataFrame, entity: str, field: str, text: bool = False) -> Column:
    own = [F.col(a) for a in ALIASES[entity][field] if a in df.columns]
    if not own:
        return F.lit("" if text else None).cast("string")
    return n.first_text(*own) if text else n.first_present(*own)


def _reasons(*rules: tuple[Column, str]) -> Column:
    out = F.lit(None).cast("string")
    for condition, name in reversed(rules):
        out = F.when(condition, name).otherwise(out)
    return out


def _in(column: str, values: Sequence[int]) -> Column:
    return (F.col(column) > 0) & (F.col(column).isin(list(values)) if values else F.lit(True))


NO_NODES = "array<variant>"


def _nodes(value: Column) -> Column:
    """A variant as an array of variants: a list's items, an object alone; none of null."""
    return F.coalesce(F.try_variant_get(value, "$", NO_NODES), F.when(value.isNotNull() & ~F.is_variant_null(value), F.array(value)), F.array().cast(NO_NODES))


def _reached(roots: Column, keys: Sequence[str], more: Callable[[Column], Column]) -> Column:
    """All nodes that can be reached from the array ``roots``, level after level, however deep: the items of lists, and
    what ``more`` gives for an object.

    A record is walked by one fold over its levels. Their number is at most one more than the times that its text has
    one of ``keys`` or a list in a list; a level without nodes costs next to nothing. A list is told from other nodes by
    taking its items, and ``more`` finds nothing in a scalar: no type is made of all that lies under a node, which would
    read each record once for each of its levels.
    """
    pattern = F.lit(rf'"(?:{"|".join(keys)})":|[\[,]\[')
    below = lambda v: F.coalesce(F.try_variant_get(v, "$", NO_NODES), more(v))
    # the next level is computed once, as the only element of an array; so are the roots
    step = lambda s, _: F.transform(F.array(F.flatten(F.transform(s["level"], below))), lambda x: F.struct(x.alias("level"), F.concat(s["all"], x).alias("all")))[0]
    depth = lambda r: F.aggregate(r, F.lit(1), lambda s, v: s + F.regexp_count(F.to_json(v), pattern))
    walk = lambda r: F.aggregate(F.sequence(F.lit(1), depth(r)), F.struct(r.alias("level"), r.alias("all")), step, lambda s: s["all"])
    return F.transform(F.array(roots), walk)[0]


def _kind(v: Column) -> Column:
    """The type of a variant's value as text: OBJECT<...>, ARRAY<...>, VOID or a scalar's."""
    return F.schema_of_variant(v)


def collect_units(roots: Sequence[Column]) -> Column:
    """All nodes under the roots, at any depth, that name a price, quantity, sum, code or lot; one level after another."""
    # an object's fields are taken at once: a path to a field that is not there costs an exception, and each variant taken
    # out of another is built anew
    of = lambda v, names, kind: F.try_variant_get(v, "$", f"struct<{','.join(f'{x}:{kind}' for x in names)}>")
    children = lambda s: F.flatten(F.transform(F.array_compact(F.array(*(s[k] for k in UNIT_CHILDREN))), _nodes))
    under = lambda v: F.transform(F.array(of(v, UNIT_CHILDREN, "variant")), children)[0]
    aliases = [x for names in UNIT_FIELDS.values() for x in names]
    objects = F.transform(_reached(F.flatten(F.array(*(_nodes(r) for r in roots))), UNIT_CHILDREN, under), lambda v: of(v, aliases, "string"))
    units = F.transform(objects, lambda s: F.struct(*(F.coalesce(*(s[x] for x in names)).alias(f) for f, names in UNIT_FIELDS.items())))
    return F.filter(units, lambda u: F.coalesce(*(u[f] for f in UNIT_TELLING)).isNotNull())


def collect_codes(lists: Sequence[Column], keys: Sequence[str], children: Sequence[str] = ()) -> Column:
    """Codes of lists, at any depth: of texts and numbers the value, of objects what stands under their ``keys`` (lists
    and objects there are walked too) and in the lists under ``children``; one level after another."""
    roots = F.flatten(F.array(*(_nodes(x) for x in lists)))
    get = lambda v, k: F.try_variant_get(v, f"$.{k}", "variant")
    when = lambda v, kinds: F.when(_kind(v).rlike(f"^({kinds})"), _nodes(v)).otherwise(F.array().cast(NO_NODES))
    under = lambda v: F.flatten(F.array(*(when(get(v, k), "OBJECT|ARRAY") for k in keys), *(when(get(v, k), "ARRAY") for k in children)))
    scalar = lambda v: F.when(v.isNotNull() & ~_kind(v).rlike("^(OBJECT|ARRAY|VOID)"), F.try_variant_get(v, "$", "string"))
    own = lambda v: F.when(_kind(v).startswith("OBJECT"), F.array(*(scalar(get(v, k)) for k in keys))).otherwise(F.array(scalar(v)))
    return F.array_compact(F.flatten(F.transform(_reached(roots, [*keys, *children], under), own)))


def parse_contracts(records: DataFrame, now: Column, customers: Sequence[int] = (), years: Sequence[int] = ()) -> DataFrame:
    """One row per contract unit, at whatever depth (or contract without units), with ``reject_reason``, null for good
    rows."""
    units = collect_units([F.col(k) for k in UNIT_CHILDREN])
    g = lambda f, text=False: _get(records, "contracts", f, text)
    rows = records.select(
        n.to_uint(g("id")).alias("contract_id"), n.to_uint(g("announcement_id")).alias("announcement_id"), g("number", True).alias("number"), n.to_uint(g("lot_id")).alias("root_lot"),
        n.to_uint(g("customer")).alias("customer"), n.to_uint(g("supplier")).alias("supplier"), g("category", True).alias("root_category"), g("region", True).alias("root_region"),
        n.to_decimal(g("amount")).alias("root_amount"), n.to_decimal(g("amount_tax"), 2, n.to_decimal(g("amount"))).alias("amount_tax"), n.to_uint(g("status_id")).alias("status_id"), g("status", True).alias("status"),
        n.to_timestamp(g("signed"), now).alias("sign_date"), g("start").alias("start_text"), g("end").alias("end_text"), g("updated_at").alias("updated_text"),
        units.alias("units"),
    ).withColumn("nested", F.size("units") > 0)
    rows = rows.withColumn("start_date", n.to_timestamp(F.col("start_text"), F.col("sign_date")))
    rows = rows.withColumn("end_date", n.to_timestamp(F.col("end_text"), F.col("start_date"))).withColumn("updated_at", n.to_timestamp(F.col("updated_text"), F.col("sign_date")))
    year = F.when(F.year("sign_date") > 1970, F.year("sign_date")).otherwise(F.year("start_date"))
    reason = _reasons(
        (F.col("contract_id") <= 0, "missing_id"), (F.col("announcement_id") <= 0, "missing_announcement"), (~_in("customer", customers), "non_target"),
        (~year.isin(list(years)) if years else F.lit(False), "non_target_year"), (~n.status_allowed(F.col("status_id"), F.col("status")), "status"),
    )
    rows = rows.withColumn("reject_reason", reason)
    one = rows.select("*", F.posexplode_outer("units").alias("unit_no", "u"))
    category, region = F.coalesce(F.nullif(F.trim("u.enstr_code"), F.lit("")), F.col("root_category")), F.coalesce(F.nullif(F.trim("u.kato_code"), F.lit("")), F.col("root_region"))
    lot = n.to_uint(F.coalesce(F.col("u.lot_id"), F.col("root_lot").cast("string")))
    many = F.col("nested") & F.col("u").isNotNull()
    unit = n.to_uint(F.col("u.id"))
    own_id = F.when(~many, F.col("contract_id")).when(unit > 0, n.hash_id(F.col("contract_id"), unit)).otherwise(n.hash_id(F.col("contract_id"), F.col("unit_no"), lot, category, region))
    return one.select(
        own_id.alias("id"), "contract_id", "number", "announcement_id", lot.alias("lot_id"), "customer", "supplier", category.alias("category"), region.alias("region"),
        n.to_decimal(F.col("u.sum"), 2, F.col("root_amount")).alias("amount"), "amount_tax", "status_id", "sign_date", "start_date", "end_date", "updated_at", "reject_reason",
    )


def parse_lots(records: DataFrame, now: Column, customers: Sequence[int] = ()) -> DataFrame:
    """One row per (point, category code, region code) with ``reject_reason``; a point without a code is a reject."""
    g = lambda f, text=False: _get(records, "lots", f, text)
    rows = records.select(
        n.to_uint(g("id")).alias("lot_id"), n.to_uint(g("announcement_id")).alias("announcement_id"), g("number", True).alias("number"), n.to_uint(g("customer")).alias("customer"),
        g("quantity").alias("root_quantity"), g("unit_price").alias("root_price"), g("amount").alias("root_amount"),
        n.to_timestamp(g("created"), now).alias("created_at"), g("updated_at").alias("updated_text"), "point_list", collect_codes([F.col(k) for k in CODE_LISTS], CODE_KEYS, CODE_CHILDREN).alias("categories"), collect_codes([F.col(REGION_LIST)], REGION_KEYS).alias("regions"),
        n.first_text(*(F.col(k) for k in CODE_FIELDS)).alias("own_category"), n.first_text(*(F.col(k) for k in REGION_FIELDS)).alias("own_region"),
    )
    rows = rows.withColumn("updated_at", n.to_timestamp(F.col("updated_text"), F.col("created_at")))
    one = rows.select("*", F.posexplode_outer("point_list").alias("point_no", "p"))
    point = lambda fields: F.array(n.first_text(*(F.col("p")[k] for k in fields)))
    listed = collect_codes([F.col("p")[k] for k in CODE_LISTS], CODE_KEYS, CODE_CHILDREN), collect_codes([F.col("p")[REGION_LIST]], REGION_KEYS)
    one = one.withColumn("codes", n.codes_of(point(CODE_FIELDS), F.array("own_category"), listed[0], F.col("categories")))
    one = one.withColumn("places", n.codes_of(point(REGION_FIELDS), F.array("own_region"), listed[1], F.col("regions")))
    one = one.withColumn("category", F.explode_outer("codes")).withColumn("region", F.explode(F.when(F.size("places") > 0, F.col("places")).otherwise(F.array(F.lit("")))))
    amount = n.to_decimal(F.coalesce(F.col("p.amount"), F.col("root_amount")))
    quantity = n.to_decimal(F.coalesce(F.col("p.count"), F.col("root_quantity")), 3)
    price = n.unit_price(n.to_decimal(F.coalesce(F.col("p.unit_price"), F.col("root_price"))), amount, quantity)
    plain = F.col("p").isNull() & (F.size("codes") <= 1) & (F.size("places") <= 1)
    unit = n.to_uint(F.col("p.id"))
    own_id = F.when(plain, F.col("lot_id")).otherwise(n.hash_id(F.col("lot_id"), F.when(unit > 0, unit).otherwise(F.col("point_no")), F.coalesce("category", F.lit("")), F.col("region")))
    reason = _reasons((F.col("lot_id") <= 0, "missing_id"), (F.col("announcement_id") <= 0, "missing_announcement"), (F.col("category").isNull(), "missing_code"), (F.lit(bool(customers)) & ~_in("customer", customers), "non_target"))
    return one.select(own_id.alias("id"), F.col("lot_id").alias("source_id"), "announcement_id", "number", "customer", "category", "region", quantity.alias("quantity"), price.alias("unit_price"), amount.alias("amount"), "created_at", "updated_at", reason.alias("reject_reason"))


def parse_plans(records: DataFrame, now: Column, customers: Sequence[int] = ()) -> DataFrame:
    """One row per plan point (or plan without points) with ``reject_reason``."""
    g = lambda f, text=False: _get(records, "plans", f, text)
    rows = records.select(
        n.to_uint(g("id")).alias("plan_id"), g("number", True).alias("number"), n.to_uint(g("customer")).alias("customer"), n.clamp(n.to_uint(g("year")), 16).cast("int").alias("plan_year"), g("category", True).alias("root_category"),
        g("region", True).alias("root_region"), n.to_decimal(g("amount")).alias("root_amount"), n.to_timestamp(g("published"), now).alias("published"), g("updated_at").alias("updated_text"), "pln_points",
    ).withColumn("updated_at", n.to_timestamp(F.col("updated_text"), F.col("published")))
    one = rows.select("*", F.posexplode_outer("pln_points").alias("point_no", "p"))
    point = n.to_uint(F.col("p.id"))
    own_id = F.when(F.col("p").isNull(), F.col("plan_id")).otherwise(n.hash_id(F.col("plan_id"), F.when(point > 0, point).otherwise(F.col("point_no"))))
    reason = _reasons((F.col("plan_id") <= 0, "missing_id"), (~_in("customer", customers), "non_target"))
    category, region = F.coalesce(F.nullif(F.trim("p.enstr_code"), F.lit("")), F.col("root_category")), F.coalesce(F.nullif(F.trim("p.kato_code"), F.lit("")), F.col("root_region"))
    return one.select(own_id.alias("id"), "number", "customer", "plan_year", category.alias("category"), region.alias("region"), n.to_decimal(F.col("p.amount"), 2, F.col("root_amount")).alias("amount"), "published", "updated_at", reason.alias("reject_reason"))


def parse_announcements(records: DataFrame, now: Column, customers: Sequence[int] = ()) -> DataFrame:
    """One row per announcement; missing totals and lot counts come from its nested lots."""
    g = lambda f, text=False: _get(records, "announcements", f, text)
    amounts = F.transform("lots", lambda x: n.to_decimal(x["amount"]))
    published = n.to_timestamp(g("published"), now)
    rows = records.select(
        n.to_uint(g("id")).alias("id"), g("number", True).alias("number"), n.to_uint(g("customer")).alias("customer"),
        n.total_or_nested(n.to_decimal(g("total")), F.coalesce(amounts, F.array().cast("array<decimal(18,2)>"))).alias("total_sum"),
        F.when(n.to_uint(g("count_lots")) > 0, n.to_uint(g("count_lots"))).otherwise(F.greatest(F.size("lots"), F.lit(0)).cast("long")).alias("count_lots"),
        n.to_uint(g("status_id")).alias("status_id"), g("status", True).alias("status"), published.alias("published"), g("start").alias("s"), g("end").alias("e"), g("updated_at").alias("u"),
    )
    rows = rows.withColumn("start_date", n.to_timestamp(F.col("s"), F.col("published"))).withColumn("end_date", n.to_timestamp(F.col("e"), F.col("start_date"))).withColumn("updated_at", n.to_timestamp(F.col("u"), F.col("published")))
    reason = _reasons((F.col("id") <= 0, "missing_id"), (~_in("customer", customers), "non_target"), (~n.status_allowed(F.col("status_id"), F.col("status")), "status"))
    return rows.withColumn("reject_reason", reason).drop("s", "e", "u")


def parse_acts(records: DataFrame, now: Column, customers: Sequence[int] = ()) -> DataFrame:
    """One row per act with its status class."""
    g = lambda f, text=False: _get(records, "acts", f, text)
    dated = n.to_timestamp(g("dated"), now)
    rows = records.select(
        n.to_uint(g("id")).alias("id"), n.to_uint(g("contract_id")).alias("contract_id"), g("number", True).alias("number"), n.to_uint(g("customer")).alias("customer"), n.to_uint(g("supplier")).alias("supplier"),
        n.to_decimal(g("act_sum")).alias("act_sum"), n.act_status(n.to_uint(g("status_id")), g("status", True)).alias("status"), dated.alias("act_date"), n.to_timestamp(g("approved"), dated).alias("approved_at"), n.to_timestamp(g("updated_at"), dated).alias("updated_at"),
    )
    reason = _reasons((F.col("id") <= 0, "missing_id"), (F.col("contract_id") <= 0, "missing_contract"), (F.lit(bool(customers)) & ~_in("customer", customers), "non_target"))
    return rows.withColumn("reject_reason", reason)


def parse_subjects(records: DataFrame, now: Column, customers: Sequence[int] = ()) -> DataFrame:
    g = lambda f, text=False: _get(records, "subjects", f, text)
    rows = records.select(
        n.to_uint(g("id")).alias("id"), n.to_uint(g("bin")).alias("bin"), g("name", True).alias("name"), g("name_kz", True).alias("name_kz"), n.to_flag(g("is_customer")).alias("is_customer"), n.to_flag(g("is_supplier")).alias("is_supplier"),
        g("region", True).alias("region"), n.clamp_timestamp(n.to_timestamp(g("updated_at"), now)).alias("updated_at"),
    )
    return rows.withColumn("reject_reason", _reasons((F.col("id") <= 0, "missing_id"), (~_in("bin", customers), "non_target")))


PARSERS = {"subjects": parse_subjects, "plans": parse_plans, "announcements": parse_announcements, "lots": parse_lots, "contracts": parse_contracts, "acts": parse_acts}


def ingest_stats(parsed: DataFrame) -> DataFrame:
    """(reject_reason, n): counters of a parse, 'parsed' for good rows."""
    return parsed.groupBy(F.coalesce("reject_reason", F.lit("parsed")).alias("reject_reason")).agg(F.count(F.lit(1)).alias("n"))
