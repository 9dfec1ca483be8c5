"""What the shared helpers leave behind."""

import time
from pathlib import Path

from pyspark.sql import functions as F

from spendloom.llm.columns import CUTS, cut


def test_driver_lets_go_of_finished_steps(spark):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if any(x in b.getName() for x in ("Old", "MarkSweep")))
    files = lambda: set(Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*.data"))
    began, there, df = full(), files(), spark.range(1000)
    step = lambda df: cut(df.groupBy(((F.col("id") * 7) % 1000).alias("id")).count().select("id"))
    df = step(df)
    first = files() - there
    for _ in range(6 * CUTS):
        df = step(df)
    assert full() >= began + 6
    end = time.time() + 10
    while first & files() and time.time() < end:
        time.sleep(0.2)
    assert not first & files()
    assert df.count() == 1000
