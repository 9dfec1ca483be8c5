"""Edge cases of the spend operators on small frames, against plain Python where that is clearer than SQL."""

import glob
import json
import os
import random
import statistics
import tempfile
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from spendloom.functions import normalize as n
from spendloom.functions import stats
from spendloom.functions import text as tx
from spendloom.operators import anomalies, answers, quality, retrieval, scope, spend, versions
from spendloom.sources import records, tables
from spendloom.streaming.upsert import stored_rows, upsert_stream

CONTRACT = "id long, customer long, supplier long, category string, region string, amount decimal(18,2), sign_date timestamp_ntz, updated_at timestamp_ntz"


def at(day):
    return datetime.fromisoformat(day)


def contract(i, amount, day="2024-05-01", category="2620", region="7110", customer=1, supplier=2, updated="2024-06-01"):
    return (i, customer, supplier, category, region, Decimal(str(amount)), at(day), at(updated))


def frame(spark, rows):
    return spark.createDataFrame(rows, CONTRACT)


def value(spark, column, *literals):
    return spark.range(1).select(column.alias("v")).first().v


def test_latest_takes_one_row_and_breaks_ties(spark):
    rows = [contract(1, 5, updated="2024-01-01"), contract(1, 7, updated="2024-02-01"), contract(1, 9, updated="2024-02-01"), contract(2, 3)]
    got = versions.latest(frame(spark, rows), ["id"], "updated_at", ["amount"], ["amount"]).collect()
    assert {(r.id, r.amount) for r in got} == {(1, Decimal("9.00")), (2, Decimal("3.00"))}


def test_filter_comes_after_the_snapshot(spark):
    rows = [contract(1, 100, updated="2024-01-01"), contract(1, 0, updated="2024-02-01"), contract(2, 4)]
    now = versions.latest(frame(spark, rows), ["id"], "updated_at", ["customer", "amount", "sign_date", "category", "region"])
    assert [r.id for r in now.where(scope.contract_filter()).collect()] == [2]


def test_upsert_rows(spark):
    stored = frame(spark, [contract(1, 5), contract(2, 6)])
    batch = frame(spark, [contract(1, 5), contract(2, 7, updated="2024-07-01"), contract(3, 1), contract(3, 2, updated="2024-07-02")]).withColumn("seq", F.monotonically_increasing_id())
    got = versions.upsert_rows(batch, stored, ["id"], "updated_at", ["amount"], "seq").collect()
    assert {(r.id, int(r.amount), r.change_type) for r in got} == {(2, 7, "changed"), (3, 2, "new")}


def test_scope_reasons(spark):
    rows = spark.createDataFrame([(1, 10, 0), (2, 99, 5), (3, 11, 7), (4, 12, 8)], "id long, announcement_id long, customer long")
    a = spark.createDataFrame([(10, 5, 2024), (11, 5, 2023), (12, 5, 2024)], "id long, owner long, year int")
    got = {r.id: (r.customer, r.reject_reason) for r in scope.announcement_scope(rows, a, [5], [2024]).collect()}
    assert got == {1: (5, None), 2: (5, "missing_link"), 3: (7, "out_of_scope"), 4: (8, "non_target")}


def test_execution_share(spark):
    acts = spark.createDataFrame([(1, 10, 0, Decimal("50.00")), (2, 10, 4, Decimal("120.00")), (3, 11, 0, Decimal("1.00")), (4, 99, 0, Decimal("1.00"))], "id long, contract_id long, supplier long, act_sum decimal(18,2)")
    contracts = spark.createDataFrame([(10, 1, 2, Decimal("100.00")), (11, 1, 2, Decimal("0.00"))], "id long, customer long, supplier long, amount decimal(18,2)")
    out = scope.contract_scope(acts, contracts)
    got = {r.id: (r.supplier, r.execution_pct) for r in out.collect()}
    assert got[1] == (2, Decimal("50.00")) and got[2] == (4, Decimal("120.00")) and got[3][1] is None and got[4][1] is None
    assert tuple(scope.execution_counters(out).first()) == (2, 1, 1, 1)


def test_concentration(spark):
    rows = [contract(k, 10, supplier=s) for k, s in enumerate([1, 1, 2, 0, 3])] + [contract(9, 5, customer=2)]
    got = spend.supplier_concentration(frame(spark, rows)).collect()
    assert len(got) == 1 and got[0].supplier_count == 3 and got[0].top_share == Decimal("0.400000") and got[0].hhi == Decimal("0.240000") and got[0].band == "moderate"


def test_year_over_year_compares_present_years(spark):
    rows = [contract(1, 100, "2020-01-01"), contract(2, 150, "2022-01-01"), contract(3, 0, "2023-01-01"), contract(4, 10, "2024-01-01")]
    got = [(r.year, r.change_pct) for r in spend.year_over_year(frame(spark, rows), 2022).orderBy("year").collect()]
    assert got == [(2022, Decimal("50.00")), (2023, Decimal("-100.00")), (2024, None)]


def test_statistics_examples(spark):
    one = lambda values, column: spark.createDataFrame([(float(x),) for x in values], "x double").agg(column.alias("v")).first().v
    x = F.col("x")
    assert one([1, 2, 3, 4], stats.median(x)) == 2.5
    assert one([1, 2, 3, 4, 5], stats.percentile(x, 90)) == 4.6
    assert one(range(1, 11), stats.iqr(x)) == 4.5
    assert one([7], stats.iqr(x)) == 0
    assert tuple(one([5, 5, 5], stats.confidence_interval(x))) == (5.0, 5.0)
    assert one([], stats.median(x)) is None
    w = spark.createDataFrame([(10.0, 1.0), (20.0, 3.0)], "x double, w double")
    assert w.agg(stats.weighted_mean(x, F.col("w"))).first()[0] == 17.5
    assert w.agg(stats.weighted_mean(x, F.lit(0.0), strict=False)).first()[0] is None
    with pytest.raises(Exception, match="weights"):
        w.agg(stats.weighted_mean(x, F.lit(-1.0))).collect()
    g = spark.createDataFrame([(1, float(v)) for v in (10, 10, 11, 12, 100)], "g int, x double")
    assert stats.with_mad(g, ["g"], "x").first().mad == 1.0
    assert stats.describe(g, ["g"], "x").first().n == 5


def test_price_thresholds_are_exclusive(spark):
    rows = [contract(k, a, "2024-05-01", region="") for k, a in enumerate([100, 100, 100, 100, 175, 25])] + [contract(10 + k, 1, category="9999") for k in range(4)]
    found = {r.entity_id: r for r in anomalies.price_anomalies(frame(spark, rows), "2026-01-01").collect()}
    assert set(found) == {4} and found[4].severity == "medium" and found[4].deviation_pct == pytest.approx(75.0)
    assert json.loads(found[4].evidence)["sample_size"] == 6
    exact = [contract(k, a, region="") for k, a in enumerate([130, 70, 100, 100, 100])]
    assert anomalies.price_anomalies(frame(spark, exact), "2026-01-01").count() == 0


def test_adjustments(spark):
    assert value(spark, anomalies.region_adjustment(F.lit("7110"))) == 0.10
    assert value(spark, anomalies.region_adjustment(F.lit("35"))) == -0.05
    assert value(spark, anomalies.region_adjustment(F.lit("1"))) == 0.0
    assert value(spark, anomalies.inflation_factor(F.lit("2022-03-01").cast("timestamp_ntz"))) == pytest.approx(1.03**2)
    assert value(spark, anomalies.inflation_factor(F.lit("2024-01-01").cast("timestamp_ntz"))) == 1.0
    assert [value(spark, anomalies.severity(F.lit(x), 100, 50)) for x in (100.0, 100.1, 50.0, 49.9)] == ["medium", "high", "medium", "low"]


def fairness_brute(rows, least=5):
    out = {}
    q = lambda d: d.year * 4 + (d.month - 1) // 3
    for r in rows:
        for span in (0, 1):
            peers = [p for p in rows if p[0] != r[0] and p[3] == r[3] and abs(q(p[6]) - q(r[6])) <= span]
            scopes = [[p for p in peers if p[4] == r[4]], [p for p in peers if p[4][:2] == r[4][:2]], peers]
            own = next((s for s in scopes if len(s) >= least), None)
            if own:
                out[r[0]] = (len(own), float(r[5]) / statistics.median(float(p[5]) for p in own))
                break
    return out


def test_fairness_equals_brute_force(spark):
    r = random.Random(0)
    rows = [contract(k, r.randrange(1, 40), f"202{r.randrange(2, 5)}-{r.randrange(1, 13):02}-11", r.choice(["11", "12", "13"]), r.choice(["7110", "7120", "35", "36", ""])) for k in range(260)]
    got = {x.id: (x.peer_count, x.score) for x in anomalies.fairness_scores(frame(spark, rows)).collect()}
    wanted = fairness_brute(rows)
    assert got.keys() == wanted.keys()
    assert all(got[k][0] == wanted[k][0] and got[k][1] == pytest.approx(wanted[k][1]) for k in wanted)


def test_volume_equals_brute_force(spark):
    r = random.Random(1)
    rows = [(k, 0 if k % 3 else k + 1, 1, r.choice(["11", "12"]), datetime(r.choice([2020, 2021, 2022, 2023]), r.randrange(1, 13), 5), float(r.randrange(1, 30))) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, lot_id long, customer long, category string, sign_date timestamp_ntz, quantity double")
    got = {x.id: (x.baseline_kind, x.sample_size, x.baseline) for x in anomalies.volume_baselines(df).collect()}
    wanted = {}
    for x in rows:
        earlier = [p for p in rows if p[3] == x[3] and p[4].year < x[4].year]
        season = [p for p in earlier if p[4].month == x[4].month]
        kind, peers = ("seasonal", season) if len(season) >= 5 else ("annual", earlier)
        if len(peers) >= 5:
            wanted[x[0]] = (kind, len(peers), pytest.approx(sum(p[5] for p in peers) / len(peers), abs=6e-4))
    assert got.keys() == wanted.keys() and all(got[k] == wanted[k] for k in wanted)


def test_normalising(spark):
    d = lambda s: value(spark, n.to_decimal(F.lit(s)))
    assert [d(x) for x in ("1 234,50", "1,234.5", "2.345", "x", None)] == [Decimal("1234.50"), Decimal("1234.50"), Decimal("2.35"), Decimal("0.00"), Decimal("0.00")]
    u = lambda s: value(spark, n.to_uint(F.lit(s)))
    assert [u(x) for x in ("12", "-3", "a1b2", "true", "", None, "7.0")] == [12, 0, 12, 1, 0, 0, 7]
    t = lambda s: value(spark, n.to_timestamp(F.lit(s)))
    assert t("2024-05-01T10:00:00Z") == t("2024-05-01T15:00:00+05:00") == t("1714557600") == t("1714557600000") == t("01.05.2024 10:00:00") == datetime(2024, 5, 1, 10)
    assert t("01.05.2024") == datetime(2024, 5, 1) and t("soon") is None
    assert [value(spark, n.to_flag(F.lit(x))) for x in ("Yes", "0", "inactive", "3", None)] == [1, 0, 0, 1, 0]
    assert value(spark, n.first_text(F.lit(None).cast("string"), F.lit("  "), F.lit(" b "))) == "b"
    assert value(spark, n.status_allowed(F.lit(1), F.lit("Расторгнут, исполнен"))) is False
    assert [value(spark, n.act_status(F.lit(k), F.lit(x))) for k, x in ((9, "Утвержден"), (3, ""), (1, "?"), (9, "?"))] == ["approved", "approved", "pending", "other"]
    assert value(spark, n.clamp(F.lit(70000), 16)) == 65535


def test_records_are_parsed_or_rejected_with_a_reason(spark):
    path = tempfile.mkdtemp(prefix="spark-")
    unit = {"enstr_code": "26.20", "sum": "10,5", "items": [{"lot_id": "4", "quantity": "2"}]}
    good = {"id": 7, "trdBuyId": "5", "customer_bin": "000000000123", "sum": 100, "sign_date": "2024-02-03", "contract_units": [unit], "status": "signed"}
    items = [good, {**good, "contract_id": "8", "contract_units": []}, {"trdBuyId": 1}, {**good, "status": "Отменен"}, {**good, "customer_bin": "9"}, {**good, "sign_date": "2019-01-01"}]
    with open(f"{path}/page.json", "w") as f:
        f.write(json.dumps({"items": items, "search_after": 3}) + "\n" + json.dumps({"items": 5}) + "\n" + "no json\n")
    rows, rejects = records.read_records(spark, path, "contracts")
    assert rejects.count() == 2
    parsed = records.parse_contracts(rows, F.lit("2024-01-01").cast("timestamp_ntz"), [123], [2024]).collect()
    assert [r.reject_reason for r in parsed].count(None) == 3
    assert {r.reject_reason for r in parsed} == {None, "missing_id", "status", "non_target", "non_target_year"}
    fine = [r for r in parsed if r.reject_reason is None]
    assert {(r.contract_id, r.lot_id, str(r.amount), r.category) for r in fine} == {(7, 0, "10.50", "26.20"), (7, 4, "100.00", ""), (8, 0, "100.00", "")}
    assert len({r.id for r in fine}) == 3
    assert sum(r.n for r in records.ingest_stats(records.parse_contracts(rows, F.current_timestamp().cast("timestamp_ntz"))).collect()) == 10


def read_as(spark, rows, schema):
    return spark.createDataFrame([(json.dumps(r),) for r in rows], "j string").select(F.from_json("j", schema).alias("r")).select("r.*")


def test_units_of_any_depth(spark):
    deep = lambda k: {"id": k, "sum": k, "items": [deep(k - 1)]} if k else {"id": 0, "count": "3"}
    rows = [{"id": 1, "trd_buy_id": 2, "bin": 3, "rows": {"children": [{"price": "5"}, {"note": "no unit"}]}}, {"id": 4, "trd_buy_id": 2, "bin": 3, "unit_list": [deep(2)]}, {"id": 5, "trd_buy_id": 2, "bin": 3, "unit_list": [deep(4)]}, {"id": 6, "trd_buy_id": 2, "bin": 3, "specifications": [[{"rows": [[deep(60)]]}], 7, "x", None, {"children": {"items": {"qty": 1}}}]}, {"id": 7, "trd_buy_id": 2, "bin": 3, "items": None, "rows": []}]
    parsed = records.parse_contracts(read_as(spark, rows, records.record_schema("contracts")), F.lit("2024-01-01").cast("timestamp_ntz")).collect()
    assert sorted((r.contract_id, r.reject_reason) for r in parsed) == sorted([(1, None)] + [(4, None)] * 3 + [(5, None)] * 5 + [(6, None)] * 62 + [(7, None)])
    assert len({r.id for r in parsed}) == len(parsed)


def test_a_page_is_parsed_once_and_no_type_is_made_of_a_node(spark):
    path = tempfile.mkdtemp(prefix="spark-")
    with open(f"{path}/page.json", "w") as f:
        f.write(json.dumps({"items": [{"id": 7, "trdBuyId": 5, "bin": 3, "rows": [{"lot_id": {"a": 1}, "items": [[{"qty": 2}], 3]}]}]}) + "\n")
    rows = records.read_records(spark, path, "contracts")[0]
    parsed = records.parse_contracts(rows, F.lit("2024-01-01").cast("timestamp_ntz"))
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1 and plan.count("get_json_object(") == 1 and "schema_of_variant" not in plan.lower() and "schemaofvariant" not in plan.lower()
    assert parsed.count() == 2


def test_codes_of_texts_numbers_and_objects(spark):
    point = {"id": 1, "tru_code": "11", "tru_list": ["12", 13, {"code": "14", "lvl2": "1", "children": [{"enstru_code": 15}, "16"]}], "pln_point_kato_list": [{"kato": "71"}, {"code": "75"}]}
    got = records.parse_lots(read_as(spark, [{"id": 1, "buy_id": 2, "kato": "35", "point_list": [point]}], records.record_schema("lots")), F.lit("2024-01-01").cast("timestamp_ntz")).collect()
    assert {r.category for r in got} == {"11", "12", "13", "14", "1", "15", "16"} and {r.region for r in got} == {"35", "71", "75"} and len(got) == 21


def test_codes_of_any_depth(spark):
    deep = lambda k: {"code": f"c{k}", "items": [deep(k - 1)]} if k else {"lvl3": [["x", {"code": {"tru_code": 5}}], 6.5], "children": {"code": "ignored"}, "sub_items": [None, "", [["y"]]]}
    rows = [{"id": 1, "buy_id": 2, "enstru_list": [deep(40)], "point_list": [{"id": 1, "tru_list": [[["z"]]]}]}]
    got = records.parse_lots(read_as(spark, rows, records.record_schema("lots")), F.lit("2024-01-01").cast("timestamp_ntz")).collect()
    assert {r.category for r in got} == {*(f"c{k}" for k in range(1, 41)), "x", "5", "6.5", "y", "z"}


def test_lots_cross_codes_and_regions(spark):
    schema = records.record_schema("lots")
    empty = dict.fromkeys([f.name for f in schema.fields])
    rows = [{**empty, "lot_id": "1", "trd_buy_id": "2", "point_list": [{"id": "5", "enstr_code": "11", "count": "4", "amount": "10"}], "enstru_list": ["12", "11"], "pln_point_kato_list": ["71", "75"]}, {**empty, "id": "3", "trd_buy_id": "2"}]
    got = records.parse_lots(read_as(spark, rows, schema), F.lit("2024-01-01").cast("timestamp_ntz")).collect()
    assert {(r.category, r.region) for r in got if r.reject_reason is None} == {(c, p) for c in ("11", "12") for p in ("71", "75")}
    assert [r.reject_reason for r in got if r.source_id == 3] == ["missing_code"]
    assert {r.unit_price for r in got if r.source_id == 1} == {Decimal("2.50")} and len({r.id for r in got}) == 5


@pytest.mark.parametrize("entity", ["subjects", "plans", "announcements", "acts"])
def test_other_parsers_run_on_empty_records(spark, entity):
    schema = records.record_schema(entity)
    out = records.PARSERS[entity](read_as(spark, [{}], schema), F.lit("2024-01-01").cast("timestamp_ntz"))
    assert [r.reject_reason for r in out.collect()] == ["missing_id"]


def test_reference_load(spark):
    rows = spark.createDataFrame([("1", "a", "б"), ("1", "b", "б"), ("2", "", "x"), ("3", "c", "в")], "code string, name_ru string, name_kz string")
    stored = spark.createDataFrame([("3", "c", "в")], "code string, name string, name_kz string")
    got = {r.code: (r.name, r.change_type) for r in tables.load_reference(rows.coalesce(1), stored).collect()}
    assert got == {"1": ("b", "new"), "3": ("c", "unchanged")}


def test_anomaly_sink_replaces_only_its_type(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/a"
    row = lambda kind, k: (k, kind, "contract", 1, 2, "c", "r", at("2024-01-01"), 1.0, 1.0, 1.0, "low", "{}", at("2024-01-01"))
    make = lambda *rows: spark.createDataFrame(list(rows), tables.SCHEMAS["anomalies"])
    tables.write_anomalies(make(row("price", 1), row("volume", 2)), path)
    tables.write_anomalies(make(row("price", 3)), path, replace=True)
    assert {(r.anomaly_type, r.anomaly_id) for r in spark.read.parquet(path).collect()} == {("price", 3), ("volume", 2)}
    assert tables.scan(spark, path, "anomalies").select("category_2").count() == 2


def test_json_rows(spark):
    assert [json.loads(r.value) for r in tables.json_rows(spark.createDataFrame([(1, Decimal("2.50"), None)], "a int, b decimal(5,2), c string")).collect()] == [{"a": 1, "b": "2.50", "c": None}]


def test_stream_in_pieces_equals_snapshot_and_replay_adds_nothing(spark):
    base = tempfile.mkdtemp(prefix="spark-")
    rows = [(k % 7, at(f"2024-01-{1 + k * 5 % 28:02}"), k % 3) for k in range(60)]
    schema = "id long, version timestamp_ntz, v long"
    for part in (rows[:20], rows[20:40], rows[10:60]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(schema).parquet(f"{base}/in")
        upsert_stream(stream, f"{base}/out", f"{base}/state", ["id"], "version").awaitTermination()
    stored = stored_rows(spark, f"{base}/out", spark.createDataFrame([], f"{schema}, late boolean").schema)
    # a batch keeps the last row of a key, so there are no more rows than were delivered
    assert stored.count() <= len(set(rows)) and stored.count() == stored.distinct().count()
    now = versions.latest(stored, ["id"], "version", ["version", "v"], ["v"])
    wanted = versions.latest(spark.createDataFrame(rows, schema), ["id"], "version", ["version", "v"], ["v"])
    assert sorted(map(tuple, now.collect())) == sorted(map(tuple, wanted.collect()))
    assert stored.where("late").count() > 0
    # a batch that was written, but whose commit was lost, is repeated and replaces itself
    before = sorted(map(str, stored.collect()))
    commits = sorted(glob.glob(f"{base}/state/commits/[0-9]*"), key=lambda f: int(f.rsplit("/", 1)[1]))
    for f in (commits[-1], os.path.join(os.path.dirname(commits[-1]), f".{os.path.basename(commits[-1])}.crc")):
        if os.path.exists(f):
            os.remove(f)
    upsert_stream(spark.readStream.schema(schema).parquet(f"{base}/in"), f"{base}/out", f"{base}/state", ["id"], "version").awaitTermination()
    again = stored_rows(spark, f"{base}/out", stored.schema)
    assert sorted(map(str, again.collect())) == before
    # delivered again, unchanged: nothing is appended
    spark.createDataFrame(rows[20:40], schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
    upsert_stream(spark.readStream.schema(schema).parquet(f"{base}/in"), f"{base}/out", f"{base}/state", ["id"], "version").awaitTermination()
    kept = stored_rows(spark, f"{base}/out", stored.schema)
    now = versions.latest(kept, ["id"], "version", ["version", "v"], ["v"])
    assert sorted(map(tuple, now.collect())) == sorted(map(tuple, wanted.collect()))


def chunk_brute(text, most, overlap):
    import re

    flat = re.sub(r"\s+", " ", text).strip()
    if overlap >= most:
        overlap = most // 4
    out, now = [], ""

    def windows(s):
        k = 0
        while True:
            piece = s[k : k + most].strip()
            if piece:
                out.append(piece)
            if k + most >= len(s):
                return
            k += max(1, most - overlap)

    for s in [x.strip() for x in re.split(r"(?<=[.!?])\s+", flat) if x.strip()]:
        if len(s) > most:
            if now:
                out.append(now)
            now = ""
            windows(s)
        elif not now:
            now = s
        elif len(now) + 1 + len(s) <= most:
            now = f"{now} {s}"
        else:
            out.append(now)
            now = f"{now[-overlap:] if overlap else ''} {s}".strip()
            if len(now) > most:
                windows(now)
                now = ""
    return [*out, now] if now else out


def test_chunks_equal_brute_force(spark):
    r = random.Random(3)
    texts = ["", "  ", "one", "A. B! C? D"] + ["".join(r.choice("ab. !?\nж") for _ in range(r.randrange(5, 400))) for _ in range(60)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    for most, overlap in ((40, 10), (25, 0), (20, 30)):
        got = {x.k: x.c for x in df.select("k", tx.chunks(F.col("t"), most, overlap).alias("c")).collect()}
        assert all(got[k] == chunk_brute(t, most, overlap) for k, t in enumerate(texts))


def test_questions(spark):
    a = lambda c, s: value(spark, c(F.lit(s)))
    assert a(tx.date_tokens, "с 2025-02-01 по 01.02.2025, 2025-02, 2026 год") == ["2025-02-01", "01.02.2025", "2025-02", "2026"]
    assert a(tx.date_tokens, "январь и февраль 2025") == ["февраль 2025", "январь 2025"]
    assert a(tx.date_tokens, "за 2025 год, в марте 2025") == ["марте 2025"]
    assert a(tx.date_tokens, "Март ,  Сәуір 2026; 2024г., x2025y 2024-13 2025-05-aa 2026-01-0") == ["2025-05", "2026-01", "2024", "Сәуір 2026", "Март 2026"]
    assert a(tx.date_tokens, "2025-2025-03 2024-031 12.01.2023. 1.01.2024 2031-02-30 20251 2025-го 2027") == ["2031-02-30", "12.01.2023", "2025-03", "2024"]
    assert a(tx.date_tokens, "мартиапрель 2025, май2026 июнь и 2024") == ["2025", "2026", "2024"]
    assert a(tx.category_codes, "1.26.20 26.20.11.2233.44.55 12.3 33.12345 77.10x 88.99.1x aa.11.22") == ["26.20", "26.20.11.2233", "44.55", "88.99", "11.22"]
    assert a(tx.owner_ids, "x123456789012 1234567890123 (123456789012)") == ["123456789012"]
    assert value(spark, tx.owner_ids(F.lit("000000000001 и 000000000002 и 000000000001"), ["000000000002"])) == ["000000000002"]
    assert a(tx.category_codes, "код 26.20.11 и 26.20") == ["26.20.11", "26.20"]
    assert [a(tx.language, s) for s in ("баға қандай", "цена объекта", "hello", "сравнить цена")] == ["kazakh", "russian", "unknown", "russian"]
    assert a(tx.intent, "сравнить vs найти").query_type == "COMPARISON" and a(tx.intent, "hm").method == "fallback"
    assert a(tx.intent, "найти разница").query_type == "SEARCH"
    p = value(spark, tx.period(F.array(F.lit("февраль 2025"), F.lit("2025-01-03")), "2024-01-01", "2026-12-31"))
    assert (p.start, p.end) == (datetime(2025, 1, 3), datetime(2025, 2, 28, 23, 59, 59))
    assert len(value(spark, tx.periods(F.array(F.lit("2024"), F.lit("2025")), "2024-01-01", "2026-12-31"))) == 2
    assert value(spark, tx.period(F.array().cast("array<string>"), "2024-01-01", "2026-12-31")).start == datetime(2024, 1, 1)


def test_context_window_skips_what_does_not_fit(spark):
    rows = [(1, k, "w " * size) for k, size in enumerate([5, 9, 0, 4, 3, 2])]
    df = spark.createDataFrame(rows, "question_id long, entity_id long, content string")
    got = [(r.entity_id, r.token_count) for r in retrieval.context_window(df, 3, 12, 6, order=["entity_id"]).orderBy("place").collect()]
    used, wanted = 0, []
    for k, size in enumerate([5, 9, 0, 4, 3, 2]):
        size = min(size, 6)
        if size and len(wanted) < 3 and used + size <= 12:
            used += size
            wanted.append((k, size))
    assert got == wanted


def test_fusion_edges(spark):
    v = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.5), (2, 1, 0.0)], "question_id long, entity_id long, score double")
    k = spark.createDataFrame([(1, 2, 3.0), (1, 3, 1.0)], "question_id long, entity_id long, score double")
    got = {(r.question_id, r.entity_id): round(r.fused, 6) for r in retrieval.fuse(v, k, ["entity_id"]).collect()}
    assert got == {(1, 1): 0.7, (1, 2): 1.0, (1, 3): 0.0, (2, 1): 0.0}
    again = retrieval.rerank(retrieval.fuse(v, k, ["entity_id"]), spark.createDataFrame([(1, 3, 9.0), (1, 1, 1.0)], "question_id long, entity_id long, rerank double"), ["entity_id"])
    scores = {(r.question_id, r.entity_id): round(r.score, 6) for r in again.collect()}
    assert scores[1, 3] == 0.6 and scores[1, 1] == 0.28 and scores[1, 2] == 1.0


def test_quality_levels(spark):
    rows = [(k, "" if k < 6 else "x") for k in range(100)] + [(5, "x")]
    df = spark.createDataFrame(rows, "id long, name string")
    out = quality.levels(quality.table_metrics(df, "t", quality.Rules({"id": "numeric", "name": "string"}, "id", types={"id": "string"})))
    got = {(r.check, r.field): (r.violations, r.level) for r in out.collect()}
    assert got["required", "name"] == (6, "error") and got["required", "id"] == (1, "ok") and got["duplicate_rows", "id"] == (1, "warn") and got["type", "id: bigint"][1] == "error"
    assert quality.score(out).first().score == "FAIL"
    assert quality.report_text(out).count() == 4


def test_confidence(spark):
    c = lambda n_, q: value(spark, answers.confidence(F.lit(n_), F.lit(1.0), F.lit(True), F.lit(0.5), F.lit("SEARCH"), F.lit(q), F.lit(0.02)))
    assert c(0, "PASS") == 0.0 and c(4, "PASS") == pytest.approx(0.44) and c(100, "FAIL") == pytest.approx(0.69)
    assert value(spark, answers.simple_confidence(F.lit(20), F.lit(0.5), F.lit(True))) == 0.45
    assert [(x.code, x.value) for x in value(spark, answers.limitations(F.lit(3), F.lit(0.4), F.lit(True)))] == [("few_rows", 3.0), ("gaps", 0.6), ("partial_period", None)]


def test_high_water_mark_and_plan(spark):
    j = spark.createDataFrame([("a", 1, at("2024-01-01T00:00:00")), ("a", 1, at("2024-01-01T00:10:00")), ("b", -1, at("2024-01-01T00:01:00"))], "entity string, entity_id long, modified_at timestamp_ntz")
    assert versions.newer_than_mark(j, j, "modified_at").count() == 1
    assert versions.newer_than_mark(j, j.limit(0), "modified_at").count() == 3
    ids = versions.changed_ids(j, F.lit("2024-01-01").cast("timestamp_ntz"), F.lit("2024-01-02").cast("timestamp_ntz")).collect()
    assert [(r.entity, r.entity_id, r.last_modified) for r in ids] == [("a", 1, at("2024-01-01T00:10:00"))]
