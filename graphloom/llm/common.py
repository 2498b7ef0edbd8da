"""What the operators of this subpackage share: the scratch folder, tables
that cut lineage, Arrow helpers and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``.

    Only where that is unset and Spark runs in this process (tests) is a
    folder of our own made; a cluster without the setting is an error."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir") or spark.conf.get("graphloom.scratch.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="graphloom-")
    spark.sparkContext.setCheckpointDir(path)
    spark.conf.set("graphloom.scratch.dir", path)
    return path


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here,
    and the rows survive the loss of any executor."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete the files under a table made by :func:`stored`."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def utf8_column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and its n+1 offsets, nulls as empty."""
    col = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        width = np.int64
    else:
        width = np.int32
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    _, offsets, data = col.buffers()
    n = len(col)
    if not n or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, width)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def texts_of(batch: pa.RecordBatch, name: str = "text") -> Iterator[str]:
    """The strings of a column one by one, nulls as empty."""
    col = batch.column(batch.schema.get_field_index(name))
    for i in range(len(col)):
        yield col[i].as_py() or ""


def bytes_of(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    """The UTF-8 bytes of a string column one by one, nulls as empty."""
    raw, at = utf8_column(batch, name)
    view = memoryview(raw)
    for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
        yield bytes(view[s:e])


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def connected_components(edges: DataFrame, label: str = "components", max_rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each node of ``edges(u, v)`` (bigint).

    Alternating large-star and small-star rounds on DataFrames; every round is
    written to the shared folder, and only two numbers of it reach the driver.
    Returns ``(node, root)`` for nodes that have an edge to another node."""

    def stars(pairs: DataFrame, large: bool) -> DataFrame:
        if large:  # every neighbour counts; larger ones move to the smallest
            both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:  # u > v: u and its smaller neighbours move to the smallest
            both = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        linked = both.join(low, "u")
        if large:
            out = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
            keep = low.where(F.col("m") < F.col("u")).select("u", F.col("m").alias("v"))
        else:
            out = linked.where(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
            keep = low.select("u", F.col("m").alias("v"))
        return out.union(keep).where(F.col("u") != F.col("v")).distinct()

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), label)
    seen = mark(now)
    for _ in range(max_rounds if seen[0] else 0):
        new = stored(stars(stars(now, True), False), label)
        drop_stored(now)
        now, was, seen = new, seen, mark(new)
        if seen == was:
            break
    else:
        if seen[0]:
            raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
