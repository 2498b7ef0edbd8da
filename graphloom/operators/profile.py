"""Profiles of extraction files and of models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parse import is_json


def four(c: Column, name: str) -> list[Column]:
    """Least, exact median, largest and mean (two places, ties to even); null
    without values."""
    return [F.min(c).cast("double").alias(f"{name}_min"), F.median(c).cast("double").alias(f"{name}_median"), F.max(c).cast("double").alias(f"{name}_max"), F.bround(F.avg(c), 2).alias(f"{name}_mean")]


def extraction_profile(records: DataFrame, *by: str) -> DataFrame:
    """``records`` with ``entity_count``, ``relation_count``, ``input_length``,
    ``input_parts``, ``cot_length``, ``chunk_count`` (null if not chunked) and
    counts of property values, in one aggregate."""
    columns = ["entity_count", "relation_count", "input_length", "input_parts", "cot_length", "chunk_count", "successful_chunks"]
    have = [c for c in columns if c in records.columns]
    ratio = F.bround(F.sum("empty_values") / F.when(F.sum("property_values") > 0, F.sum("property_values")), 4).alias("empty_property_ratio")
    return records.groupBy(*by).agg(F.count("*").alias("count"), *(x for c in have for x in four(F.col(c), c)), ratio)


def model_profile(results: DataFrame, model: str = "model", valid: Column | None = None) -> DataFrame:
    """Per model: cases, valid JSON outputs and their share, and the four numbers
    of ``entity_count`` and ``relation_count`` over valid ones only; the ids of
    invalid cases in order."""
    rows = results.withColumn("valid", is_json("output") if valid is None else valid)
    only = lambda c: F.when(F.col("valid"), F.col(c))
    return rows.groupBy(model).agg(F.count("*").alias("total_cases"), F.count_if("valid").alias("valid_json_cases"), F.bround(F.count_if("valid") / F.count("*"), 4).alias("valid_json_ratio"), *four(only("entity_count"), "entity_count"), *four(only("relation_count"), "relation_count"), F.array_sort(F.collect_list(F.when(~F.col("valid"), F.col("id")))).alias("invalid_ids"))


def summary(profile: DataFrame, *by: str) -> DataFrame:
    """A profile of few rows as one JSON object: of its row, or by the values of ``by``."""
    rest = F.struct(*(c for c in profile.columns if c not in by))
    if not by:
        return profile.select(F.to_json(rest).alias("summary"))
    name = F.concat_ws("/", *by)
    return profile.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name.alias("k"), rest.alias("v")))))).alias("summary"))


def long_form(wide: DataFrame, outputs: str = "outputs") -> DataFrame:
    """A row per case and model of a map from model to output; a model that a
    case lacks has a null output there."""
    models = wide.select(F.explode(F.map_keys(outputs)).alias("model")).distinct()
    cells = wide.select("id", F.explode(outputs).alias("model", "output"))
    # the models are few: one name per evaluated model
    return wide.select("id").join(models).join(cells, ["id", "model"], "left")


def cases_by_models(cases: DataFrame, models: list[str], case_ids: list | None = None, known: set[str] | None = None) -> DataFrame:
    """Every selected case for every model."""
    if known is not None and not set(models) <= known:
        raise ValueError(f"unknown models: {sorted(set(models) - known)}")
    chosen = cases if case_ids is None else cases.where(F.col("id").isin(*case_ids))
    return chosen.withColumn("model", F.explode(F.array(*map(F.lit, models))))


def selected(cases: DataFrame, wanted: DataFrame) -> DataFrame:
    """The cases whose id is asked for; asking for none that exists is an error
    for the caller to see as an empty result."""
    return cases.join(wanted.select("id").distinct(), "id", "left_semi")


def positional(cases: DataFrame, records: DataFrame) -> DataFrame:
    """Cases with their source record: their own, else the one at position ``id``."""
    at = records.select(F.col("ord").alias("at"), F.col("text").alias("found"))
    return cases.join(at, F.col("id") == F.col("at"), "left").withColumn("text", F.coalesce("source_text", "found")).drop("at", "found")
