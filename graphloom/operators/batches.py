"""Batches of records: union, keyed dedupe, audits, gaps and shards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import stored

#: Where rows without an index are sorted.
NO_INDEX = 10**12


def union_batches(*frames: DataFrame) -> DataFrame:
    """Union by name; columns that a batch lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def dedupe(df: DataFrame, key: str, order: str, keep: str = "first") -> DataFrame:
    """One row per key, null keys apart, with ``slot``: the order at which the
    key first appeared, which the kept row takes even if it is the last one."""
    if keep not in ("first", "last"):
        raise ValueError("keep is first or last")
    rest = [c for c in df.columns if c != key]
    pick = (F.min if keep == "first" else F.max)(F.struct(order, *(c for c in rest if c != order))).alias("row")
    some = df.where(F.col(key).isNotNull()).groupBy(key).agg(pick, F.min(order).alias("slot")).select(*(F.col(c) if c == key else F.col(f"row.`{c}`").alias(c) for c in df.columns), "slot")
    return some.unionByName(df.where(F.col(key).isNull()).withColumn("slot", F.col(order)))


def duplicates(df: DataFrame, key: str, order: str, with_null: bool = True) -> DataFrame:
    """A row per repeat of a key after its first: the key and its order.  With
    ``with_null``, null counts as a key."""
    rows = df if with_null else df.where(F.col(key).isNotNull())
    repeats = Window.partitionBy(key).orderBy(order)
    return rows.select(key, order).withColumn("n", F.row_number().over(repeats)).where("n > 1").select(key, order)


def gaps(df: DataFrame, key: str) -> DataFrame:
    """Whole numbers between the least and the largest key that no row has."""
    ends = df.agg(F.min(key).cast("bigint").alias("lo"), F.max(key).cast("bigint").alias("hi"))
    # a row per stretch of the range first, so that it is made in many tasks
    step = 100_000
    stretches = ends.where("lo is not null").select("hi", F.explode(F.sequence("lo", "hi", F.lit(step).cast("bigint"))).alias("low"))
    wanted = stretches.repartition("low").select(F.explode(F.sequence("low", F.least(F.col("low") + (step - 1), F.col("hi")))).alias(key))
    return wanted.join(df.select(F.col(key).cast("bigint").alias(key)).distinct(), key, "left_anti")


def index_range(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count("*").alias("records"))


def places(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``place`` from 0 in the given order and ``total``.  Places come
    from counts per range partition, so that no task sorts everything.  The
    ranges are stored, as a second deal might draw other bounds."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    ranged = ranged.withColumn("_part", F.shiftright("_id", 33)).withColumn("_own", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id")
    ranged = stored(ranged, "places")
    # a row per partition
    counts = ranged.groupBy("_part").agg(F.count("*").alias("rows"))
    sofar = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = counts.select(F.col("_part").alias("_p"), F.coalesce(F.sum("rows").over(sofar), F.lit(0)).alias("_before"), F.sum("rows").over(whole).alias("total"))
    return ranged.join(before, F.col("_part") == F.col("_p")).withColumn("place", F.col("_own") + F.col("_before")).drop("_part", "_own", "_p", "_before")


def with_index(df: DataFrame, *order: str, offset: int = 0, name: str = "global_idx") -> DataFrame:
    """``df`` with whole numbers from ``offset`` on, without gaps, in the given order."""
    return places(df, *order).withColumn(name, F.col("place") + offset).drop("place", "total")


def shards(df: DataFrame, order: str, parts: int) -> DataFrame:
    """``shard`` from 1: contiguous ranges by ``order``, the first ones a row
    longer; parts are at least 1 and at most the rows."""
    n = F.greatest(F.lit(1), F.least(F.lit(parts).cast("bigint"), F.col("total")))
    place, size, extra = F.col("place"), F.floor(F.col("total") / n), F.col("total") % n
    shard = F.when(place < extra * (size + 1), F.floor(place / (size + 1))).otherwise(extra + F.floor((place - extra * (size + 1)) / size))
    return places(df, order).withColumn("shard", (shard + 1).cast("int")).drop("place", "total")


def failure_total(joined: DataFrame) -> DataFrame:
    """Failures that the sidecars of all batches name; none where they say nothing."""
    return joined.agg(F.coalesce(F.sum("metadata_failures"), F.lit(0)).cast("bigint").alias("sidecar_failures"))


def finish_reasons(diagnostics: DataFrame) -> DataFrame:
    """Per batch (``path``) why the model stopped, in the order of its calls;
    null where a call does not say.  A batch is one file's calls."""
    rows = diagnostics.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("pos", "finish_reason"))).alias("r"))
    return rows.select("path", F.transform("r", lambda x: x["finish_reason"]).alias("finish_reasons"))


def join_sidecars(batches: DataFrame, sidecars: DataFrame) -> DataFrame:
    """``batches(path, records)`` with what their sidecar says.  A sidecar is
    found under ``X.metadata.json`` or else ``X.json.metadata.json``."""
    stem = F.regexp_replace("path", r"\.json$", "")
    first, second = sidecars.select(F.col("sidecar").alias("s1"), *(F.col(c).alias(f"{c}1") for c in ("records", "failures"))), sidecars.select(F.col("sidecar").alias("s2"), *(F.col(c).alias(f"{c}2") for c in ("records", "failures")))
    out = batches.join(first, F.concat(stem, F.lit(".metadata.json")) == F.col("s1"), "left").join(second, F.concat(stem, F.lit(".json.metadata.json")) == F.col("s2"), "left")
    has = F.col("s1").isNotNull()
    return out.select("path", "records", F.when(has, F.col("records1")).otherwise(F.col("records2")).alias("metadata_records"), F.when(has, F.col("failures1")).otherwise(F.col("failures2")).alias("metadata_failures"))


def audit(records: DataFrame, key: str, order: str, keep: str = "last") -> DataFrame:
    """One row on a union of batches: rows before and after the dedupe, repeated
    keys, missing indexes, and the range."""
    kept = dedupe(records, key, order, keep)
    before = records.agg(F.count("*").alias("records_before_dedupe"))
    after = kept.agg(F.count("*").alias("records"), F.min(key).alias("first"), F.max(key).alias("last"))
    again = duplicates(records, key, order, False).agg(F.array_sort(F.collect_list(key)).alias("deduped_keys"))
    missing = gaps(kept, key).agg(F.array_sort(F.collect_list(key)).alias("missing_global_idx"))
    # four frames of one row each
    return before.join(after).join(again).join(missing)
