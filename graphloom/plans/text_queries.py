"""Queries over texts and small derived strings, each with its DuckDB form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse, text as t
from ..functions.chunks import chunk
from ..operators import profile, sft
from .kg_view import table

LIMIT, CHUNK, OVERLAP, LEAST = 600, 1500, 200, 50
QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _rfind(w: str, marker: str) -> str:
    lit = " || ".join(f"chr({ord(c)})" for c in marker)
    back = " || ".join(f"chr({ord(c)})" for c in marker[::-1])
    return f"CASE WHEN instr(reverse({w}), {back}) > 0 THEN length({w}) - instr(reverse({w}), {back}) - length({lit}) + 1 ELSE -1 END"


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^\\s+', ''), '\\s+$', '')"


def _truncated(source: str, limit: int) -> str:
    """SQL for ``source(text, ...)`` with a column ``cut``: the fold over the markers."""
    sql = f"SELECT *, substr(text, 1, {limit}) AS w, -1 AS b0 FROM ({source})"
    for i, m in enumerate(t.CUT_MARKERS):
        sql = f"SELECT *, CASE WHEN r{i} > b{i} THEN r{i} + {len(m.rstrip())} ELSE b{i} END AS b{i + 1} FROM (SELECT *, {_rfind('w', m)} AS r{i} FROM ({sql}))"
    b = f"b{len(t.CUT_MARKERS)}"
    return f"SELECT *, CASE WHEN length(text) <= {limit} THEN text ELSE regexp_replace(CASE WHEN {b} >= {int(limit * t.CUT_SHARE)} THEN substr(w, 1, {b}) ELSE w END, '\\s+$', '') END AS cut FROM ({sql})"


def four_sql(x: str, name: str) -> str:
    return f"CAST(min({x}) AS DOUBLE) AS {name}_min, CAST(median({x}) AS DOUBLE) AS {name}_median, CAST(max({x}) AS DOUBLE) AS {name}_max, round_even(avg({x}), 2) AS {name}_mean"


@query("SELECT min(doc_id) AS doc_id, md5(k) AS key_md5, count(*) AS copies FROM (SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS k FROM documents) GROUP BY k")
def text_key_dedupe(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "documents").select("doc_id", t.normalize_key(F.col("text")).alias("k"))
    return keys.groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", F.md5("k").alias("key_md5"), "copies")


@query(f"SELECT doc_id, CAST(length(cut) AS INTEGER) AS n, md5(cut) AS cut_md5 FROM ({_truncated('SELECT doc_id, text FROM documents', LIMIT)})")
def truncate_boundary(spark: SparkSession, d: str) -> DataFrame:
    cut = t.truncate(F.col("text"), LIMIT)
    return table(spark, d, "documents").select("doc_id", cut.alias("cut")).select("doc_id", F.length("cut").alias("n"), F.md5("cut").alias("cut_md5"))


@query(f"SELECT lang, count(*) AS n, {four_sql('length(cut)', 'chars')} FROM ({_truncated('SELECT lang, text FROM documents', LIMIT)}) WHERE length(cut) >= {LEAST} GROUP BY lang")
def profile_truncated(spark: SparkSession, d: str) -> DataFrame:
    # the length is what an exchange has: the cut itself is made once
    chars = table(spark, d, "documents").select("lang", F.length(t.truncate(F.col("text"), LIMIT)).alias("chars")).repartition("lang", "chars").where(F.col("chars") >= LEAST)
    return chars.groupBy("lang").agg(F.count("*").alias("n"), *profile.four(F.col("chars"), "chars"))


#: ``(doc_id, chunk_index, piece)``: the chunks of all documents.
CHUNKS = f"""c AS (
  SELECT doc_id, text, 0 AS start, 0 AS n, false AS done, CAST(NULL AS VARCHAR) AS piece FROM documents WHERE length(text) > {CHUNK}
  UNION ALL
  SELECT doc_id, text, greatest(e - {OVERLAP}, start + 1), n + 1, e >= length(text), {_strip('substr(text, start + 1, e - start)')}
  FROM (SELECT *, CASE WHEN start + {CHUNK} < length(text) AND b > {CHUNK * 0.6} THEN start + b + 1 ELSE least(start + {CHUNK}, length(text)) END AS e
        FROM (SELECT *, greatest({_rfind('w', chr(10) * 2)}, {_rfind('w', chr(10))}, {_rfind('w', '. ')}) AS b
              FROM (SELECT *, substr(text, start + 1, {CHUNK}) AS w FROM c WHERE NOT done)))),
chunks AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) AS INTEGER) AS chunk_index, piece FROM c WHERE n > 0 AND piece <> ''
UNION ALL SELECT doc_id, 1, text FROM documents WHERE length(text) <= {CHUNK})"""


@query(f"WITH RECURSIVE {CHUNKS} SELECT doc_id, chunk_index, CAST(length(piece) AS INTEGER) AS chars, md5(piece) AS chunk_md5 FROM chunks")
def chunk_text(spark: SparkSession, d: str) -> DataFrame:
    rows = chunk(table(spark, d, "documents").select("doc_id", "text"), "text", CHUNK, OVERLAP)
    return rows.select("doc_id", "chunk_index", F.length("chunk").alias("chars"), F.md5("chunk").alias("chunk_md5"))


@query("SELECT doc_id, concat_ws(chr(10), nullif(lang, ''), nullif(CASE WHEN doc_id % 2 = 0 THEN '' ELSE source END, ''), nullif(text, '')) AS joined FROM documents")
def field_concat(spark: SparkSession, d: str) -> DataFrame:
    fields = F.col("lang"), F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("source")), F.col("text")
    return table(spark, d, "documents").select("doc_id", t.concat_fields(*fields).alias("joined"))


@query("""SELECT doc_id, concat_ws(chr(10) || chr(10), nullif(source, ''), nullif(text, ''), CASE WHEN doc_id % 3 = 0 THEN lang END,
  CASE WHEN doc_id % 2 = 0 THEN 'Narrower terms: ["' || lang || '", "' || source || '"]' END) AS joined FROM documents""")
def labelled_concat(spark: SparkSession, d: str) -> DataFrame:
    narrower = F.when(F.col("doc_id") % 2 == 0, F.array("lang", "source")).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "documents").select("doc_id", t.labelled_text(F.col("source"), F.col("text"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise(""), narrower).alias("joined"))


@query(f"SELECT doc_id, length(text) >= {LEAST} AS long_enough, {_strip('text')} <> '' AS not_blank FROM documents")
def min_length_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", (F.length("text") >= LEAST).alias("long_enough"), (t.strip(F.col("text")) != "").alias("not_blank"))


MESSAGES = ["Read TIMED OUT after", "HTTP 429 too many", "403 Forbidden for", "model Not Found", "SSL handshake 429", "odd failure"]


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'network' WHEN 1 THEN 'rate_limit' WHEN 2 THEN 'auth' WHEN 3 THEN 'not_found' WHEN 4 THEN 'network' ELSE 'other' END AS class FROM events""")
def error_classify(spark: SparkSession, d: str) -> DataFrame:
    message = F.concat(F.element_at(F.array(*map(F.lit, MESSAGES)), (F.col("event_id") % 6 + 1).cast("int")), F.lit(" "), "event_type")
    return table(spark, d, "events").select("event_id", t.classify_error(message).alias("class"))


@query("""SELECT event_id, trim(s) LIKE '{%' AND length(s) - length(replace(s, '{', '')) > length(s) - length(replace(s, '}', '')) AS truncated
FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN ' ' || substr(props, 1, 5) WHEN 1 THEN props ELSE substr(props, 2) END AS s FROM events)""")
def truncated_json_flag(spark: SparkSession, d: str) -> DataFrame:
    s = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), F.substring("props", 1, 5))).when(F.col("event_id") % 3 == 1, F.col("props")).otherwise(F.expr("substring(props, 2)"))
    return table(spark, d, "events").select("event_id", t.looks_truncated(s).alias("truncated"))


@query("""SELECT page_id, CAST(k.pos - 1 AS INTEGER) AS pos, k.key AS key FROM (SELECT page_id, unnest([{'pos': 1, 'key': url}, {'pos': 2, 'key': list_last(string_split(regexp_replace(url, '/+$', ''), '/'))}]) AS k FROM pages) WHERE k.key <> ''""")
def ref_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.posexplode(t.reference_keys(F.col("url"))).alias("pos", "key"))


@query("""SELECT * FROM (SELECT s_suppkey AS id, CASE WHEN s_nationkey % 2 = 0 THEN 'D' ELSE 'E' END AS prefix, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'structure_' || s_suppkey END AS scoped FROM supplier)""")
def id_scoping(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("s_nationkey") % 2 == 0, "Disease").otherwise("Anything else")
    own = F.when(F.col("s_suppkey") % 4 == 0, "").otherwise(F.col("s_suppkey").cast("string"))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), t.label_prefix(label).alias("prefix"), t.scoped_id(F.lit("structure"), own).alias("scoped"))


@query("""SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'assistant' ELSE lower(role) END AS role,
  replace(replace('<thinking>' || text || '</thinking><Thinking>', '<thinking>', '<think>'), '</thinking>', '</think>') AS content FROM conversations""")
def role_and_tags(spark: SparkSession, d: str) -> DataFrame:
    role = F.when(F.col("turn") % 3 == 0, " Human").when(F.col("turn") % 3 == 1, "GPT ").otherwise(F.upper("role"))
    content = F.concat(F.lit("<thinking>"), F.col("text"), F.lit("</thinking><Thinking>"))
    return table(spark, d, "conversations").select("conv_id", "turn", t.normalize_role(role).alias("role"), t.rewrite_think_tags(content).alias("content"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'template' WHEN doc_id % 2 = 0 THEN 'specific' WHEN doc_id % 3 = 0 THEN 'template' ELSE 'fallback' END AS style FROM documents""")
def style_infer(spark: SparkSession, d: str) -> DataFrame:
    own = F.when(F.col("doc_id") % 5 == 0, "template").when(F.col("doc_id") % 7 == 0, "unknown")
    name = F.when(F.col("doc_id") % 2 == 0, "Pro_SPECIFIC.json").when(F.col("doc_id") % 3 == 0, "run_standard.json").otherwise("run.json")
    return table(spark, d, "documents").select("doc_id", t.infer_style(own, name, "fallback").alias("style"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name || '|x' END AS items, CAST(CASE WHEN n_nationkey % 2 = 0 THEN 2 END AS INTEGER) AS n FROM nation""")
def csv_arguments(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit(" ,"), "n_name", F.lit(" , x ,"))).otherwise(" , ")
    items = t.csv_list(raw)
    return table(spark, d, "nation").select("n_nationkey", F.array_join(items, "|").alias("items"), F.when(items.isNotNull(), F.size(items)).alias("n"))


def _response(kind, body):
    """A response around a JSON text, in six shapes."""
    return (
        F.when(kind == 0, F.concat(F.lit("<THINKING> why </thinking>\n<output>```json\n"), body, F.lit("\n```</OUTPUT>")))
        .when(kind == 1, F.concat(F.lit("<thinking>open <output>"), body))
        .when(kind == 2, F.concat(F.lit("<thinking>done</thinking> "), body))
        .when(kind == 3, F.concat(F.lit("<thinking>never ends "), body))
        .when(kind == 4, F.concat(F.lit("  "), body, F.lit(" ")))
        .otherwise(F.concat(F.lit("<output> "), body, F.lit("</output> tail")))
    )


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'why' WHEN 1 THEN 'open' WHEN 2 THEN 'done' WHEN 3 THEN 'never ends ' || props ELSE '' END AS cot,
  CASE event_id % 6 WHEN 0 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 3 THEN '' ELSE props END AS json_text FROM events""")
def trace_split(spark: SparkSession, d: str) -> DataFrame:
    got = parse.split_trace(_response(F.col("event_id") % 6, F.col("props")))
    return table(spark, d, "events").select("event_id", got.alias("g")).select("event_id", "g.cot", "g.json_text")


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'a b' ELSE '' END AS cot, CASE event_id % 3 WHEN 2 THEN NULL ELSE props END AS object_text FROM events""")
def tag_extract(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_id") % 3
    raw = F.when(kind == 0, F.concat(F.lit("<Think> a b </think>x{<output>```json "), "props", F.lit("```</output>"))).when(kind == 1, F.concat(F.lit("pre "), "props", F.lit(" post"))).otherwise("nothing here")
    return table(spark, d, "events").select("event_id", parse.tagged_response(raw).alias("g")).select("event_id", "g.cot", "g.object_text")


@query("""SELECT event_id, event_id % 4 < 2 AS valid FROM events""")
def strict_parse(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_id") % 4
    raw = F.when(kind == 0, F.col("props")).when(kind == 1, F.concat(F.lit(" ["), "props", F.lit("] "))).when(kind == 2, F.concat("props", F.lit(" x"))).otherwise("null")
    return table(spark, d, "events").select("event_id", parse.is_json(raw).alias("valid"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{"k": ' || json_extract_string(props, '$.k') || ', "t": "a - b"}' WHEN 1 THEN props END AS repaired FROM events""")
def robust_parse(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_id") % 3
    k = F.get_json_object("props", "$.k")
    raw = F.when(kind == 0, F.concat(F.lit('```JSON\n<output>{"k": '), k, F.lit(', "t": "a – b",}</output>```'))).when(kind == 1, F.concat(F.lit("Here: "), "props", F.lit(" done"))).otherwise(F.concat(F.lit("{'k': "), k, F.lit("}")))
    return table(spark, d, "events").select("event_id", parse.robust_parse(raw).alias("repaired"))


@query("""SELECT event_id, '{' || chr(10) || '  "k": ' || json_extract_string(props, '$.k') || chr(10) || '}' AS pretty, '{"k":' || json_extract_string(props, '$.k') || '}' AS canonical FROM events""")
def json_rendering(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", parse.pretty_json("props").alias("pretty"), parse.canonical_json("props").alias("canonical"))


@query("""SELECT event_id, event_type || CASE WHEN event_id % 2 = 0 THEN chr(10) || 'x' ELSE '' END AS text, CASE WHEN event_id % 5 = 0 THEN 'whole' ELSE event_type END AS answer,
  CASE WHEN event_id % 2 = 0 THEN 'x' ELSE '' END AS thoughts FROM events""")
def response_parts(spark: SparkSession, d: str) -> DataFrame:
    part = lambda text_, thought: F.struct(text_.alias("text"), F.lit(thought).alias("thought"))
    parts = F.array(part(F.col("event_type"), False), part(F.when(F.col("event_id") % 2 == 0, " x").otherwise(""), True), part(F.lit(None).cast("string"), False))
    only = F.when(F.col("event_id") % 5 == 0, F.filter(parts, lambda p: p["thought"])).otherwise(parts)
    got = parse.answer_and_thoughts(only, F.lit("whole"))
    plain = F.replace(parse.response_text(parts), F.lit("\n "), F.lit("\n"))
    return table(spark, d, "events").select("event_id", plain.alias("text"), got["answer"].alias("answer"), got["thoughts"].alias("thoughts"))


@query("""SELECT conv_id, CAST(count(*) AS INTEGER) AS n, string_agg(role || ':' || md5(text), ',' ORDER BY turn) AS messages FROM conversations
  WHERE role IN ('system', 'user', 'assistant') AND text IS NOT NULL GROUP BY conv_id HAVING count(*) >= 2""")
def sft_messages(spark: SparkSession, d: str) -> DataFrame:
    got = sft.from_turns(table(spark, d, "conversations"), "conv_id", "turn", "role", "text")
    return got.select("conv_id", F.size("messages").alias("n"), F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), F.md5(m["content"]))), ",").alias("messages"))


def _sft_sql() -> str:
    p = sft.Prompts()
    q = lambda s: "'" + s.replace("'", "''") + "'"
    pretty = """'{' || chr(10) || '  "k": ' || json_extract_string(props, '$.k') || chr(10) || '}'"""
    return f"""SELECT event_id, md5(CASE WHEN event_id % 2 = 0 THEN (CASE WHEN event_id % 3 = 0 THEN {q(p.specific)} ELSE {q(p.template)} END) || {q(chr(10) + p.coverage + chr(10) * 2)} || {q(p.heading + chr(10))} || event_type || chr(10) || chr(10) || 'more'
      ELSE {q(p.heading + chr(10))} || event_type || chr(10) || chr(10) || 'more' || {q(chr(10) * 2 + p.coverage + chr(10) * 2)} END) AS user_md5,
      CASE WHEN event_id % 2 = 0 THEN '<think>' || chr(10) || 'because' || chr(10) || '</think>' || chr(10) || {pretty} || chr(10) ELSE {pretty} END AS assistant
      FROM events WHERE event_id % 5 <> 0"""


@query(_sft_sql())
def sft_records(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(
        "event_id", F.array(F.col("event_type"), F.lit(""), F.lit("more")).alias("input_used"), F.col("event_type").alias("input"), F.col("props").alias("output"),
        F.when(F.col("event_id") % 2 == 0, " because ").otherwise(" ").alias("cot"), F.when(F.col("event_id") % 5 == 0, False).alias("success"), F.when(F.col("event_id") % 3 == 0, "specific").otherwise("template").alias("style"),
    )
    got = sft.from_records(rows, F.col("style"))
    return got.select("event_id", F.md5(F.get("messages", F.lit(1))["content"]).alias("user_md5"), F.get("messages", F.lit(2))["content"].alias("assistant"))


@query("SELECT count(*) FILTER (text LIKE '%<thinking>%' OR text LIKE '%</thinking>%') AS contaminated, count(*) AS total FROM conversations")
def tag_guard(spark: SparkSession, d: str) -> DataFrame:
    return sft.tag_guard(table(spark, d, "conversations"), "text")


@query("SELECT source, count(*) FILTER (regexp_matches(text, '[一-鿿]')) AS cjk, count(*) AS total FROM documents GROUP BY source")
def audit_cjk(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.count_if(F.col("text").rlike("[一-鿿]")).alias("cjk"), F.count("*").alias("total"))


@query(f"SELECT role, count(*) FILTER ({_strip('text')} = '') AS empty, count(*) FILTER (length(text) > 200) AS over_limit, count(*) AS total FROM conversations GROUP BY role")
def audit_empty(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("role").agg(F.count_if(t.strip(F.col("text")) == "").alias("empty"), F.count_if(F.length("text") > 200).alias("over_limit"), F.count("*").alias("total"))


@query("""WITH m AS (SELECT conv_id, sum(length(text)) FILTER (role = 'user') AS asked, sum(length(text)) FILTER (role = 'assistant') AS told FROM conversations GROUP BY conv_id)
SELECT count(*) AS conversations, round_even(median(asked / told), 4) AS median_ratio, median(asked) AS median_asked, median(told) AS median_told FROM m WHERE told > 0 AND asked IS NOT NULL""")
def length_ratio(spark: SparkSession, d: str) -> DataFrame:
    sums = table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(F.when(F.col("role") == "user", F.length("text"))).alias("asked"), F.sum(F.when(F.col("role") == "assistant", F.length("text"))).alias("told"))
    return sums.where("told > 0 AND asked IS NOT NULL").agg(F.count("*").alias("conversations"), F.bround(F.median(F.col("asked") / F.col("told")), 4).alias("median_ratio"), F.median("asked").alias("median_asked"), F.median("told").alias("median_told"))
