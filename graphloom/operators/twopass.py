"""Vertical split of source records, reference resolution and two-pass merge."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.parse import canonical_json
from ..functions.text import reference_keys, scoped_id, strip, text

#: Fields that only the long-text pass sees, and the hierarchy fields.
LONG_TEXT = ["diagnosticCriteria", "definition", "longDefinition", "narrowerTerms"]
HIERARCHY = ["parent", "child", "ancestor", "descendant"]
#: Fixed value: the address that linearised ids are also known under.
FOUNDATION = "http://id.who.int/icd/entity/"


def lookup(entities: DataFrame) -> DataFrame:
    """``(key, id, code, title, classKind)``: the last entity of each key.  An
    entity has its id, the id's last segment and, if it is of a linearised
    release, its foundation address and number."""
    released = F.col("id").contains("/release/") & F.col("id").contains("/mms/")
    number = F.expr("substring(id, locate('/mms/', id) + 5)")
    keys = F.concat(reference_keys(F.col("id")), F.when(released, F.array(F.concat(F.lit(FOUNDATION), number), number)).otherwise(F.array().cast("array<string>")))
    rows = entities.select("ord", F.posexplode(keys).alias("pos", "key"), *(text(F.col(c)).alias(c) for c in ("id", "code", "title", "classKind")))
    return rows.groupBy("key").agg(F.max(F.struct("ord", "pos", "id", "code", "title", "classKind")).alias("m")).select("key", *(F.col(f"m.{c}").alias(c) for c in ("id", "code", "title", "classKind")))


def resolve(references: DataFrame, found: DataFrame) -> DataFrame:
    """``references(rec, pos, reference)`` with the entity meant: by the whole
    reference, else by its last segment, else a stub of the reference itself."""
    whole, tail = (found.select(F.col("key").alias(f"k{i}"), F.struct("id", "code", "title", "classKind").alias(f"m{i}")) for i in (1, 2))
    keys = reference_keys(F.col("reference"))
    out = references.withColumn("_tail", F.get(keys, F.lit(1)))
    out = out.join(whole, F.col("reference") == F.col("k1"), "left").join(tail, F.col("_tail") == F.col("k2"), "left")
    m = F.coalesce("m1", "m2")
    return out.select("rec", "pos", "reference", F.coalesce(m["id"], "reference").alias("id"), F.coalesce(m["code"], F.lit("")).alias("code"), F.coalesce(m["title"], F.lit("")).alias("title"), m["classKind"].alias("class_kind"))


def resolved_arrays(resolved: DataFrame) -> DataFrame:
    """The resolved references of each record in their order."""
    rows = resolved.groupBy("rec").agg(F.array_sort(F.collect_list(F.struct("pos", "reference", "id", "code", "title", "class_kind"))).alias("r"))
    return rows.select("rec", F.transform("r", lambda x: x.dropFields("pos")).alias("resolved"))


def structure(entities: DataFrame) -> DataFrame:
    """All columns but the long texts, with ``source_id``."""
    return entities.drop(*LONG_TEXT).withColumn("source_id", F.col("id"))


def long_text(entities: DataFrame) -> DataFrame:
    return entities.select(*(text(F.col(c)).alias(c) for c in ("id", "code", "title", "definition", "diagnosticCriteria")), F.coalesce("narrowerTerms", F.array().cast("array<string>")).alias("narrowerTerms"), F.col("id").alias("source_id"))


def manifest(entities: DataFrame) -> DataFrame:
    return entities.select(F.col("id").alias("source_id"), text(F.col("code")).alias("code"), text(F.col("title")).alias("title"), F.coalesce(F.length("diagnosticCriteria") > 0, F.lit(False)).alias("has_diagnosticCriteria"), F.greatest(F.coalesce(F.size("narrowerTerms"), F.lit(0)), F.lit(0)).alias("narrowerTerms_count"))


def require_source_ids(records: DataFrame) -> DataFrame:
    """The records; reading one without a source id is an error."""
    bad = text(F.col("source_id")) == ""
    return records.withColumn("source_id", F.when(bad, F.raise_error(F.lit("a record has no source_id")).cast("string")).otherwise(F.col("source_id")))


def merge_headers(listed: DataFrame, passes: dict[str, DataFrame]) -> DataFrame:
    """``source_id, code, title`` and a flag per pass, over everything that the
    manifest lists or a pass has; blanks are filled by the first pass that can."""
    frames = [listed.select("source_id", "code", "title", F.lit(0).alias("turn"), F.lit("").alias("scope"))]
    frames += [df.select("source_id", "code", "title", F.lit(i).alias("turn"), F.lit(name).alias("scope")) for i, (name, df) in enumerate(passes.items(), 1)]
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f)

    def first(c: str) -> Column:
        return F.coalesce(F.min(F.when(text(F.col(c)) != "", F.struct("turn", c)))[c], F.lit("")).alias(c)

    return rows.groupBy("source_id").agg(first("code"), first("title"), *(F.bool_or(F.col("scope") == n).alias(n) for n in passes))


def merge_entities(entities: DataFrame) -> DataFrame:
    """Scoped entities as one graph per source.

    ``entities(source_id, turn, scope, ord, id, label, name)`` of both passes;
    the key is label and name in lower case, stripped; rows without a whole key
    never meet.  Returns them with ``scoped`` (their own id) and ``merged_id``
    (that of the first row of their key)."""
    label, name = F.lower(strip(text(F.col("label")))), F.lower(strip(text(F.col("name"))))
    own = strip(text(F.col("id")))
    rows = entities.withColumn("key", F.when((label != "") & (name != ""), F.struct(label.alias("l"), name.alias("n"))))
    rows = rows.withColumn("scoped", F.when(own != "", scoped_id(F.col("scope"), own)).otherwise(F.concat("scope", F.lit("_E"), F.col("ord").cast("string"))))
    first = rows.where("key is not null").groupBy(F.col("source_id").alias("s2"), F.col("key").alias("k2")).agg(F.min(F.struct("turn", "ord", "scoped"))["scoped"].alias("merged_id"))
    return rows.join(first, (F.col("source_id") == F.col("s2")) & (F.col("key") == F.col("k2")), "left").withColumn("merged_id", F.coalesce("merged_id", "scoped")).drop("s2", "k2")


def remap_ends(relations: DataFrame, merged: DataFrame) -> DataFrame:
    """Edges whose ends are the merged ids; an end that no entity of the pass
    has stays as it is.  Equal edges of a source come once, the first one."""
    ids = merged.where(strip(text(F.col("id"))) != "").groupBy(F.col("source_id").alias("s2"), F.col("scope").alias("c2"), strip(F.col("id")).alias("i2")).agg(F.max(F.struct("ord", "merged_id"))["merged_id"].alias("to"))
    out = relations
    for end in ("source", "target"):
        out = out.join(ids, (F.col("source_id") == F.col("s2")) & (F.col("scope") == F.col("c2")) & (strip(text(F.col(end))) == F.col("i2")), "left").withColumn(end, F.coalesce("to", end)).drop("s2", "c2", "i2", "to")
    keys = [c for c in out.columns if c not in ("turn", "ord", "scope")]
    return out.groupBy(*keys).agg(F.min(F.struct("turn", "ord")).alias("first")).select(*keys, F.col("first.turn").alias("turn"), F.col("first.ord").alias("ord"))


def _with_part(known: str, new: str) -> str:
    """A list of parts between semicolons, with one more unless it is there."""
    parts = [*filter(None, map(str.strip, known.split(";")))]
    return "; ".join(parts + [new.strip()] * (new.strip() not in parts))


def _with_keys(known: dict, new: dict) -> dict:
    return known | new | {k: merge_value(known[k], new[k]) for k in known.keys() & new.keys()}


#: How two different values of one type become one; of other types the first stays.
MERGES = {str: _with_part, dict: _with_keys}


def merge_value(known, new):
    """One property value of two passes."""
    for value, other in ((known, new), (new, known)):
        if value is None or isinstance(value, (str, list, dict)) and not value:
            return other
    merge = MERGES.get(type(known)) if type(known) is type(new) and known != new else None
    return merge(known, new) if merge else known


@F.pandas_udf(StringType())
def merge_properties(ordered: pd.Series) -> pd.Series:
    """Folds JSON objects, given in order as an array of texts, into one."""

    def fold(values) -> str | None:
        out: dict = {}
        for v in () if values is None else values:
            out = merge_value(out, json.loads(v) if v else {}) or {}
        return json.dumps(out, ensure_ascii=False)

    return ordered.map(fold)


def in_order(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """``value`` of each group as an array by ``order``."""
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("r"))
    return rows.select(*keys, F.transform("r", lambda x: x[value]).alias(value))


def distinct_in_order(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """As :func:`in_order`, with each JSON value once, where it comes first:
    values are equal if their canonical texts are, whatever the order of keys."""
    once = df.withColumn("_same", F.coalesce(canonical_json(value), value)).groupBy(*keys, "_same").agg(F.min(F.struct(order, value)).alias("_first"))
    return in_order(once.select(*keys, f"_first.{order}", f"_first.{value}"), keys, order, value)


def split_source(entities: DataFrame) -> dict[str, DataFrame]:
    """The three frames of a vertical split: ``structure`` (all but the long
    texts, references resolved), ``long_text`` and ``manifest``.  Records are
    named by their ``ord``."""
    found = lookup(entities)
    out = structure(entities)
    for field in HIERARCHY:
        if field in entities.columns:
            refs = entities.select(F.col("ord").alias("rec"), F.posexplode(field).alias("pos", "reference"))
            lists = resolved_arrays(resolve(refs, found)).select(F.col("rec").alias("_rec"), F.col("resolved").alias(f"{field}Resolved"))
            out = out.join(lists, F.col("ord") == F.col("_rec"), "left").drop("_rec")
            out = out.withColumn(f"{field}Resolved", F.coalesce(f"{field}Resolved", F.array().cast(out.schema[f"{field}Resolved"].dataType)))
    return {"structure": out, "long_text": long_text(entities), "manifest": manifest(entities)}


def write_split(entities: DataFrame, folder: str, prefix: str) -> None:
    """The frames of :func:`split_source` as Parquet tables ``<prefix>.<name>``."""
    for name, df in split_source(entities).items():
        df.write.parquet(f"{folder}/{prefix}.{name}")
