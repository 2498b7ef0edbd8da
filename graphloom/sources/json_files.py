"""JSON files in and out: explicit schemas, root shapes, globs and sidecars."""

from __future__ import annotations

import json
from fnmatch import fnmatch

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROPERTIES = T.MapType(T.StringType(), T.StringType())
ENTITY = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "label", "name")] + [T.StructField("properties", PROPERTIES)])
RELATION = T.StructType([T.StructField(n, T.StringType()) for n in ("source", "target", "relation_type", "relation_name", "relation", "evidence")])
GRAPH = T.StructType([T.StructField(n, T.StringType()) for n in ("source_id", "code", "title")] + [T.StructField("entities", T.ArrayType(ENTITY)), T.StructField("relations", T.ArrayType(RELATION)), T.StructField("relationships", T.ArrayType(RELATION))])
EXTRACTION = T.StructType([
    *(T.StructField(n, T.StringType()) for n in ("input", "cot", "cot_style", "error", "source_id", "code", "title", "extraction_mode")),
    T.StructField("input_used", T.StringType()),
    T.StructField("success", T.BooleanType()),
    *(T.StructField(n, T.LongType()) for n in ("global_idx", "input_chars", "original_input_chars", "chunk_count", "successful_chunks", "failed_chunks")),
    T.StructField("output", GRAPH),
])


def documents(spark: SparkSession, *paths: str) -> DataFrame:
    """``(path, value)``: whole files as text."""
    return spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def root_records(docs: DataFrame, wrapper: str = "entities") -> DataFrame:
    """``(path, ord, record)`` with each record as JSON text: a list's elements,
    the list under ``wrapper``, or the root itself.  Order is the file's."""
    lists = "array<variant>"
    root = F.try_parse_json("value")
    inside = F.try_variant_get(root, f"$.{wrapper}", lists)
    kind = F.schema_of_variant(root)
    rows = F.when(kind.startswith("ARRAY"), F.try_variant_get(root, "$", lists)).when(inside.isNotNull(), inside).otherwise(F.array(root))
    return docs.where(root.isNotNull()).select("path", F.posexplode(rows).alias("ord", "record")).select("path", "ord", F.to_json("record").alias("record"))


def listed_records(docs: DataFrame, wrapper: str = "entities") -> DataFrame:
    """As :func:`root_records` for files that have to be lists: an object with
    ``wrapper`` stands for what is under it, of whatever type, and anything that
    is no list is an error."""
    root = F.try_parse_json("value")
    wrapped = F.schema_of_variant(root).startswith("OBJECT") & F.array_contains(F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>")), wrapper)
    inside = F.when(wrapped, F.try_variant_get(root, f"$.{wrapper}", "variant")).otherwise(root)
    rows = F.when(F.coalesce(F.schema_of_variant(inside).startswith("ARRAY"), F.lit(False)), F.try_variant_get(inside, "$", "array<variant>")).otherwise(F.raise_error(F.concat(F.lit("no list of records in "), "path")).cast("array<variant>"))
    return docs.where(root.isNotNull()).select("path", F.posexplode(rows).alias("ord", "record")).select("path", "ord", F.to_json("record").alias("record"))


def rejects(docs: DataFrame) -> DataFrame:
    """Files that are no JSON."""
    return docs.where(F.try_parse_json("value").isNull()).select("path")


def checked_records(docs: DataFrame, wrapper: str = "records", required: str = "source_id") -> DataFrame:
    """As :func:`root_records`; a record without the required field is an error."""
    rows = root_records(docs, wrapper)
    value = F.get_json_object("record", f"$.{required}")
    return rows.withColumn("record", F.when(F.coalesce(value, F.lit("")) == "", F.raise_error(F.concat(F.lit(f"no {required} in "), "path")).cast("string")).otherwise(F.col("record")))


def typed(records: DataFrame, schema: T.StructType) -> DataFrame:
    """Record texts as columns of an explicit schema, with path and order."""
    return records.select("path", "ord", F.from_json("record", schema).alias("r"), F.col("record").alias("raw")).select("path", "ord", "r.*", "raw")


def objects_of(value: Column, field: str, kind: T.StructType) -> Column:
    """The objects of the list under ``field`` of a JSON text, in order; other
    elements are left out.  Null if there is no such list."""
    items = F.try_variant_get(F.try_parse_json(value), f"$.{field}", "array<variant>")
    return F.transform(F.filter(items, lambda x: F.schema_of_variant(x).startswith("OBJECT")), lambda x: F.from_json(F.to_json(x), kind))


def input_used(raw: Column) -> Column:
    """``input_used`` of a raw record as a list, whether it was one or a text."""
    value = F.get_json_object(raw, "$.input_used")
    return F.when(F.substring(F.ltrim(value), 1, 1) == "[", F.from_json(value, "array<string>")).when(value.isNotNull(), F.array(value))


def keep_path(name: str, excludes: list[str] = ()) -> bool:
    """Whether a file name is data: no sidecar and none of the patterns."""
    return not name.endswith(".metadata.json") and not any(fnmatch(name, e) for e in excludes)


def input_paths(spark: SparkSession, explicit: list[str] = (), folders: list[str] = (), patterns: list[str] = ("*.json",), excludes: list[str] = (), outputs: list[str] = ()) -> list[str]:
    """Explicit paths, then each folder's matches per pattern in order, once
    each, without sidecars, excluded names and outputs.  Any file system that
    Spark knows is listed."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def resolved(path: str) -> str:
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(conf).makeQualified(p).toString()

    found = [resolved(p) for p in explicit]
    for folder in folders:
        for pattern in patterns:
            p = jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
            found += sorted(s.getPath().toString() for s in (p.getFileSystem(conf).globStatus(p) or []))
    skip = {resolved(p) for p in outputs}
    return [p for p in dict.fromkeys(found) if p not in skip and keep_path(p.rpartition("/")[2], list(excludes))]


def latest(spark: SparkSession, folder: str, pattern: str) -> str | None:
    """The matching path whose name sorts last."""
    return max(input_paths(spark, folders=[folder], patterns=[pattern]), default=None)


def write_pretty(df: DataFrame, path: str, order: str | None = None, newline: bool = True) -> int:
    """One JSON list with an indent of two, streamed row by row to a single
    file; for exports, as Parquet is what stages exchange.  ``df`` has a column
    ``record`` of JSON texts.  Returns the number of records."""
    rows = (df.orderBy(order) if order else df).select("record")
    jvm = df.sparkSession._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).create(target, True)
    n = 0
    try:
        for r in rows.toLocalIterator():
            text = json.dumps(json.loads(r.record), ensure_ascii=False, indent=2).replace("\n", "\n  ")
            out.write(bytearray(((",\n  " if n else "[\n  ") + text).encode()))
            n += 1
        out.write(bytearray((("\n]" if n else "[]") + "\n" * newline).encode()))
    finally:
        out.close()
    return n


def write_raw_and_filtered(records: DataFrame, kept: Column, folder: str, stamp: str) -> None:
    """Two Parquet tables of one run: all records, and those that are kept."""
    records.persist()
    try:
        records.write.parquet(f"{folder}/raw_{stamp}")
        records.where(kept).write.parquet(f"{folder}/filtered_{stamp}")
    finally:
        records.unpersist()


def write_shards(df: DataFrame, path: str, column: str = "shard") -> None:
    """A folder per shard, model or other key; the whole is the same table."""
    df.write.partitionBy(column).parquet(path)


def append_new(results: DataFrame, path: str, key: str = "global_idx") -> DataFrame:
    """Checkpoint: append results whose key the table does not have; the table."""
    spark = results.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        results = results.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")
    results.write.mode("append").parquet(path)
    return spark.read.schema(results.schema).parquet(path)
