"""Pages after a cursor, periods of many questions, replaced partitions, presence."""

import random
import statistics
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from spendloom.operators import answers
from spendloom.sources import tables
from spendloom.sources.shared import listed


def test_pages_after_a_cursor_are_the_whole_listing(spark):
    r = random.Random(1)
    rows = [(r.randrange(6), r.choice("abc"), k) for k in range(200)]
    df = spark.createDataFrame(rows, "day int, name string, id long")
    order = [("day", True), ("name", False), ("id", True)]
    seen, cursor = [], None
    while True:
        page = answers.search(df, F.col("id") != 7, order, 37, cursor).orderBy(F.desc("day"), "name", F.desc("id")).collect()
        if not page:
            break
        assert all(x.total == 199 for x in page)
        seen += [(x.day, x.name, x.id) for x in page]
        cursor = seen[-1]
    assert seen == sorted((x for x in rows if x[2] != 7), key=lambda x: (-x[0], x[1], -x[2]))


def test_no_page_of_nothing(spark):
    df = spark.createDataFrame([(1,)], "id long")
    assert answers.search(df, F.lit(False), [("id", True)]).collect() == []


def test_periods_of_many_questions(spark):
    r = random.Random(2)
    at = lambda k: datetime(1999, 11, 20) + timedelta(days=k)
    facts = [(f"g{r.randrange(4)}", float(r.randrange(100)), at(r.randrange(130)) + timedelta(hours=r.randrange(24))) for _ in range(300)] + [("g1", None, at(3)), (None, 5.0, at(4))]
    periods = []
    for q in range(40):
        for label in ("a", "b", "c")[: 1 + q % 3]:
            low = r.randrange(-20, 140)
            periods.append((q, label, at(low), at(low + r.choice([0, 1, 2, 5, 31, 64, 100])) + timedelta(seconds=86399)))
    periods += [(90, "reversed", at(9), at(3)), (91, "whole", datetime(1, 1, 1), datetime(9999, 12, 31))]
    f = spark.createDataFrame(facts, "g string, x double, sign_date timestamp_ntz")
    p = spark.createDataFrame(periods, "question_id int, label string, start timestamp_ntz, end timestamp_ntz")
    out = answers.by_periods_of_questions(f, p, "g", "x")
    got = {(x.question_id, x.label): (x.mean, x.median, x.groups) for x in out.collect()}
    every = list(periods)
    for q in {p[0] for p in periods}:
        own = [p for p in periods if p[0] == q]
        every.append((q, "all", min(p[2] for p in own), max(p[3] for p in own)))
    want = {}
    for q, label, low, high in every:
        groups = {}
        for g, x, d in facts:
            if x is not None and low <= d <= high and low <= high:
                groups.setdefault(g, []).append(x)
        if groups:
            means = [sum(xs) / len(xs) for xs in groups.values()]
            want[(q, label)] = (pytest.approx(sum(means) / len(means)), pytest.approx(statistics.median(means)), len(means))
    assert got == want and len(want) > 80
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def anomaly(spark, *rows):
    kinds = [f.split() for f in tables.SCHEMAS["anomalies"].split(", ")]
    df = spark.createDataFrame(list(rows), "anomaly_type string, anomaly_id long")
    return df.select(*(F.col(n) if n in df.columns else F.lit(None).cast(k).alias(n) for n, k in kinds))


def test_a_failed_run_replaces_nothing(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/anomalies"
    read = lambda: sorted((r.anomaly_type, r.anomaly_id) for r in spark.read.parquet(path).collect())
    tables.write_anomalies(anomaly(spark, ("price", 1), ("volume", 2)), path)
    broken = anomaly(spark, ("price", 3)).withColumn("anomaly_id", F.raise_error(F.lit("no result")).cast("long"))
    with pytest.raises(Exception, match="no result"):
        tables.write_anomalies(broken, path, replace=True, types=("price",))
    assert read() == [("price", 1), ("volume", 2)]
    tables.write_anomalies(anomaly(spark, ("price", 4), ("price", 5)), path, replace=True, types=("price", "fairness"))
    assert read() == [("price", 4), ("price", 5), ("volume", 2)]
    tables.write_anomalies(anomaly(spark, ("fairness", 6)), path, replace=True, types=("price",))
    assert read() == [("fairness", 6), ("volume", 2)]
    tables.write_anomalies(anomaly(spark, ("fairness", 7)), path)
    assert read() == [("fairness", 6), ("fairness", 7), ("volume", 2)]


def test_presence(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    got = sorted(map(str, tables.presence({"t": df}, {"t": ["a", "b", "c"], "u": ["a"]}).collect()))
    assert len(got) == 4 and "present=True, rows=2, filled=1" in got[1] and "present=False, rows=2, filled=0" in got[2] and "column=None, present=False, rows=0" in got[3]
    assert listed(spark, tempfile.mkdtemp(prefix="spark-") + "/nothing") == []
