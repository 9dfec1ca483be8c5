"""Versioned rows: latest snapshot, changed-only upsert, incremental filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], version: str, columns: Sequence[str], ties: Sequence[str] = ()) -> DataFrame:
    """The row of the highest ``version`` for each key, with ``columns``; ``ties`` order rows of one version.

    One shuffle on the keys with partial aggregation. The columns travel as one struct, so they come from one row.
    Nulls in ``version`` and ``ties`` order lowest.
    """
    order = F.struct(version, *[t for t in ties if t != version])
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("r"))
    return best.select(*keys, "r.*")


def dedup_batch(df: DataFrame, keys: Sequence[str], version: str | None, arrival: str) -> DataFrame:
    """The last row of each key in a batch: highest version, then latest arrival (only arrival without a version)."""
    columns = [c for c in df.columns if c not in keys]
    return latest(df, keys, version or arrival, columns, [arrival]).select(*df.columns)


def change_types(batch: DataFrame, stored: DataFrame, keys: Sequence[str], compared: Sequence[str]) -> DataFrame:
    """``batch`` (one row a key) with ``change_type``: new, changed or unchanged against ``stored`` (one row a key)."""
    old = stored.select(*(F.col(k).alias(f"__{k}") for k in keys), F.struct(*compared).alias("__old"))
    joined = batch.join(old, [F.col(k) == F.col(f"__{k}") for k in keys], "left")
    kind = F.when(F.col("__old").isNull(), "new").when(F.struct(*compared).eqNullSafe(F.col("__old")), "unchanged").otherwise("changed")
    return joined.select(*batch.columns, kind.alias("change_type"))


def upsert_rows(batch: DataFrame, stored: DataFrame, keys: Sequence[str], version: str, compared: Sequence[str], arrival: str) -> DataFrame:
    """Rows of ``batch`` to append: its last row of each key, if new or different from the latest stored one."""
    ties = [c for c in compared if c not in keys]
    now = latest(stored, keys, version, list(dict.fromkeys([version, *ties])), ties)
    changed = change_types(dedup_batch(batch, keys, version, arrival), now, keys, compared)
    return changed.where("change_type <> 'unchanged'")


def row_hash(columns: Sequence[str]) -> Column:
    """A change token of the columns."""
    return F.xxhash64(*columns)


def hash_upsert(batch: DataFrame, stored: DataFrame, keys: Sequence[str], columns: Sequence[str], arrival: str) -> DataFrame:
    """``batch``'s last row of each key with ``change_type``, compared by ``row_hash`` alone."""
    hashed = lambda df: df.withColumn("row_hash", row_hash(columns))
    return change_types(hashed(dedup_batch(batch, keys, None, arrival)), hashed(stored), keys, ["row_hash"])


def newer_than_mark(df: DataFrame, seen: DataFrame, version: str, replay_seconds: int = 300) -> DataFrame:
    """Rows whose version is at or after the highest one in ``seen`` less the replay window; all if nothing was seen."""
    mark = seen.agg((F.max(version) - F.expr(f"interval {replay_seconds} seconds")).alias("__mark"))
    return df.join(F.broadcast(mark)).where(F.col("__mark").isNull() | (F.col(version) >= F.col("__mark"))).drop("__mark")  # one row


def changed_ids(journal: DataFrame, start: Column, end: Column, entity: str = "entity", entity_id: str = "entity_id", modified: str = "modified_at") -> DataFrame:
    """(entity, entity_id, last_modified) of the positive ids that the journal names between two instants."""
    window = journal.where(F.col(modified).between(start, end) & (F.col(entity_id) > 0))
    return window.groupBy(entity, entity_id).agg(F.max(modified).alias("last_modified"))


def sync_plan(journal: DataFrame, start: Column, end: Column, entity: str = "entity", entity_id: str = "entity_id", modified: str = "modified_at") -> DataFrame:
    """Distinct ids and last change of each entity type."""
    ids = changed_ids(journal, start, end, entity, entity_id, modified)
    return ids.groupBy(entity).agg(F.count(F.lit(1)).alias("ids"), F.max("last_modified").alias("last_modified"))


def baseline(df: DataFrame, column: str, now: Column, hours: int = 24) -> DataFrame:
    """One row: the highest value of ``column``, else ``now`` less ``hours``."""
    return df.agg(F.coalesce(F.max(column), now - F.expr(f"interval {hours} hours")).alias("baseline"))
