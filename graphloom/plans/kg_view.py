"""A deterministic property graph over the order tables.

The tables hold no graph, so one is derived: an order is a record, its lines are
entities and edges in three chunks.  Names differ in case and spacing, ids
repeat, and edges point to ids, to names, and to nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Labels by part number modulo nine; the last has no id prefix of its own.
LABELS = ["Disease", "Symptom", "Diagnostic Criteria", "Interview Tool", "Patient Information", "Medication", "Communication Method", "Risk Information", "Other"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", "p_size")
    chunk = (F.col("l_linenumber") % 3).cast("int")
    order = Window.partitionBy("l_orderkey").orderBy(chunk, "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return line.withColumn("ord", F.row_number().over(order)).withColumn("chunk", chunk).join(part, F.col("l_partkey") == F.col("p_partkey"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, chunk, ord, local_id, label, name, size, flag."""
    labels = F.array(*map(F.lit, LABELS))
    noisy = F.when(F.col("chunk") == 0, F.upper("p_brand")).when(F.col("chunk") == 1, F.concat(F.lit("  "), F.col("p_brand"), F.lit(" "))).otherwise(F.replace(F.col("p_brand"), F.lit("#"), F.lit(" \t#")))
    return lines(spark, sf_dir).select(
        F.col("l_orderkey").alias("rec"), "chunk", "ord",
        F.concat(F.lit("P"), (F.col("l_partkey") % 5).cast("string")).alias("local_id"),
        F.element_at(labels, (F.col("l_partkey") % 9 + 1).cast("int")).alias("label"),
        noisy.alias("name"), F.col("p_size").cast("string").alias("size"), F.col("l_returnflag").alias("flag"),
    )


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, chunk, ord, source, target, relation_type, relation_name, relation."""
    target = F.when(F.col("l_suppkey") % 7 == 0, F.concat(F.lit("Q"), F.col("l_suppkey").cast("string"))).when(F.col("l_suppkey") % 3 == 0, F.lower("p_brand")).otherwise(F.concat(F.lit("P"), (F.col("l_suppkey") % 5).cast("string")))
    return lines(spark, sf_dir).select(
        F.col("l_orderkey").alias("rec"), "chunk", "ord",
        F.concat(F.lit("P"), (F.col("l_partkey") % 5).cast("string")).alias("source"), target.alias("target"),
        F.col("p_type").alias("relation_type"), F.col("l_returnflag").alias("relation_name"), F.col("l_linestatus").alias("relation"),
    )


#: The same views for DuckDB.
VIEW_SQL = """
WITH lines AS (
  SELECT l_orderkey AS rec, CAST(l_linenumber % 3 AS INTEGER) AS chunk,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber % 3, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS ord,
         l_partkey, l_suppkey, l_returnflag, l_linestatus, p_type, p_brand, p_size
  FROM lineitem JOIN part ON l_partkey = p_partkey),
ent AS (
  SELECT rec, chunk, ord, 'P' || (l_partkey % 5) AS local_id,
         (['Disease','Symptom','Diagnostic Criteria','Interview Tool','Patient Information','Medication','Communication Method','Risk Information','Other'])[CAST(l_partkey % 9 AS INTEGER) + 1] AS label,
         (['D','S','DC','IT','PI','M','CM','R','E'])[CAST(l_partkey % 9 AS INTEGER) + 1] AS prefix,
         CASE chunk WHEN 0 THEN upper(p_brand) WHEN 1 THEN '  ' || p_brand || ' ' ELSE replace(p_brand, '#', ' ' || chr(9) || '#') END AS name,
         CAST(p_size AS VARCHAR) AS size, l_returnflag AS flag
  FROM lines),
ek AS (SELECT *, trim(regexp_replace(lower(name), '\\s+', ' ', 'g')) AS norm, regexp_replace(name, '^\\s+|\\s+$', '', 'g') AS clean FROM ent),
rel AS (
  SELECT rec, chunk, ord, 'P' || (l_partkey % 5) AS source,
         CASE WHEN l_suppkey % 7 = 0 THEN 'Q' || l_suppkey WHEN l_suppkey % 3 = 0 THEN lower(p_brand) ELSE 'P' || (l_suppkey % 5) END AS target,
         p_type AS relation_type, l_returnflag AS relation_name, l_linestatus AS relation
  FROM lines),
rk AS (SELECT *, trim(regexp_replace(lower(target), '\\s+', ' ', 'g')) AS tnorm, trim(regexp_replace(lower(source), '\\s+', ' ', 'g')) AS snorm FROM rel)
"""
