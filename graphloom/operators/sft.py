"""Chat-style training samples from conversations and extraction records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parse import pretty_json
from ..functions.text import normalize_role, rewrite_think_tags, strip, text

#: Roles that a sample may have.
ROLES = ("system", "user", "assistant")
MESSAGE = "struct<role:string,content:string>"


@dataclass(frozen=True)
class Prompts:
    """Wording of the prompts; hand in your own to reproduce a given dataset."""

    system: str = "You extract entities and relations from medical text and answer with JSON only."
    coverage: str = "Keep every symptom, criterion, subtype, differential diagnosis, patient feature and risk factor that the text states; add nothing that it does not."
    specific: str = "<think>\nNote the few decisions that are particular to this text.\n</think>\n<output>\nThe JSON object.\n</output>"
    template: str = "<think>\nReason in at most six short steps.\n</think>\n<output>\nThe JSON object.\n</output>"
    heading: str = "Medical text:"


def user_prompt(prompts: Prompts, body: Column, with_trace: Column, style: Column) -> Column:
    """With a trace: the style's instruction (any style but ``specific`` takes
    the template), the coverage rules and the text; without: text, then rules."""
    part = F.concat(F.lit(prompts.heading + "\n"), body)
    lead = F.when(style == "specific", prompts.specific).otherwise(prompts.template)
    return F.when(with_trace, F.concat(lead, F.lit(f"\n{prompts.coverage}\n\n"), part)).otherwise(F.concat(part, F.lit(f"\n\n{prompts.coverage}\n\n")))


def assistant_text(output: Column, cot: Column) -> Column:
    """Pretty JSON, after a think block if there is a trace."""
    trace = strip(text(cot))
    return F.when(trace != "", F.concat(F.lit("<think>\n"), trace, F.lit("\n</think>\n"), pretty_json(output), F.lit("\n"))).otherwise(pretty_json(output))


def from_turns(turns: DataFrame, conv: str, turn: str, role: str, content: str, least: int = 2) -> DataFrame:
    """``(conv, messages)`` of conversations in rows: known roles with a content,
    in order, if at least two are left."""
    rows = turns.select(F.col(conv), F.col(turn), normalize_role(F.col(role)).alias("role"), rewrite_think_tags(F.col(content)).alias("content")).where(F.col("role").isin(*ROLES) & F.col("content").isNotNull())
    found = rows.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), "role", "content"))).alias("m")).where(F.size("m") >= least)
    return found.select(conv, F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def from_conversations(df: DataFrame, column: str = "conversations") -> DataFrame:
    """The same for records that hold an array of ``from`` and ``value``."""
    clean = F.transform(F.filter(column, lambda m: m.isNotNull()), lambda m: F.struct(normalize_role(text(m["from"])).alias("role"), rewrite_think_tags(m["value"]).alias("content")))
    kept = F.filter(clean, lambda m: m["role"].isin(*ROLES) & m["content"].isNotNull())
    return df.withColumn("messages", kept).where(F.size("messages") >= 2)


def from_records(df: DataFrame, style: Column, prompts: Prompts = Prompts()) -> DataFrame:
    """Samples of extraction records ``(input_used array<string>, input, output
    JSON text, cot, success)``: all but those that failed or have no output.
    The parts of a chunked input are joined by blank lines."""
    used = F.array_join(F.filter("input_used", lambda p: F.coalesce(p, F.lit("")) != ""), "\n\n")
    body = F.when(F.size("input_used") > 0, used).otherwise(F.col("input"))
    trace = strip(text(F.col("cot"))) != ""
    good = df.where(~F.col("success").eqNullSafe(F.lit(False)) & F.col("input").isNotNull() & F.col("output").isNotNull())
    return good.withColumn("messages", F.array(F.struct(F.lit("system").alias("role"), F.lit(prompts.system).alias("content")), F.struct(F.lit("user").alias("role"), user_prompt(prompts, body, trace, style).alias("content")), F.struct(F.lit("assistant").alias("role"), assistant_text(F.col("output"), F.col("cot")).alias("content"))))


def from_chunk_traces(df: DataFrame, style: Column, prompts: Prompts = Prompts()) -> DataFrame:
    """A sample per chunk trace ``(chunk_index, success, input_used, output, cot,
    cot_style)`` that did not fail and has input and output."""
    rows = df.withColumn("t", F.explode("chunk_traces")).where(~F.col("t.success").eqNullSafe(F.lit(False)) & F.col("t.output").isNotNull() & F.col("t.input_used").isNotNull())
    trace = strip(text(F.col("t.cot"))) != ""
    return rows.select(*df.columns, F.col("t.chunk_index").alias("chunk_index"), F.array(F.struct(F.lit("system").alias("role"), F.lit(prompts.system).alias("content")), F.struct(F.lit("user").alias("role"), user_prompt(prompts, F.col("t.input_used"), trace, F.coalesce("t.cot_style", style)).alias("content")), F.struct(F.lit("assistant").alias("role"), assistant_text(F.col("t.output"), F.col("t.cot")).alias("content"))).alias("messages"))


def convert(df: DataFrame, style: Column, include_traces: bool = False, traces_only: bool = False, prompts: Prompts = Prompts()) -> DataFrame:
    """Messages of records that are conversations or extractions: a record with
    conversations is one whatever else it has.  Traces alone need both flags."""
    talks = from_conversations(df.where("conversations is not null")).select("ord", F.lit(0).alias("part"), "messages")
    rest = df.where("conversations is null")
    out = talks
    if not traces_only:
        out = out.unionByName(from_records(rest, style, prompts).select("ord", F.lit(0).alias("part"), "messages"))
    if include_traces:
        out = out.unionByName(from_chunk_traces(rest, style, prompts).select("ord", F.col("chunk_index").alias("part"), "messages"))
    return out


def tag_guard(df: DataFrame, column: str) -> DataFrame:
    """How many texts hold a tag that should have been rewritten."""
    return df.agg(F.count_if(F.col(column).contains("<thinking>") | F.col(column).contains("</thinking>")).alias("contaminated"), F.count("*").alias("total"))


def upsert_registry(registry: DataFrame, name: str, file_name: str) -> DataFrame:
    """The registry ``(name, file_name, formatting, columns, tags)`` with this
    entry made or replaced, the others kept."""
    spark = registry.sparkSession
    new = spark.range(1).select(F.lit(name).alias("name"), F.lit(file_name).alias("file_name"), F.lit("sharegpt").alias("formatting"), F.create_map(F.lit("messages"), F.lit("messages")).alias("columns"), F.create_map(*(F.lit(x) for kv in {"role_tag": "role", "content_tag": "content", "user_tag": "user", "assistant_tag": "assistant", "system_tag": "system"}.items() for x in kv)).alias("tags"))
    return registry.where(F.col("name") != name).unionByName(new)
