"""Queries over the derived property graph and over batches of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import batches, extract, graph, profile, quality, twopass
from ..sources.json_files import GRAPH
from . import kg_view as kg
from .kg_view import VIEW_SQL as K
from .kg_view import table
from .text_queries import CHUNK, CHUNKS, OVERLAP, _truncated, four_sql

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


CANON = K + """, can AS (SELECT rec, label, prefix, norm, arg_min(clean, ord) AS name, min(ord) AS first_ord, arg_min(chunk, ord) AS first_chunk, arg_min(local_id, ord) AS own_id FROM ek GROUP BY rec, label, prefix, norm),
g AS (SELECT *, prefix || row_number() OVER (PARTITION BY rec, prefix ORDER BY first_ord, label, norm) AS id FROM can)"""
SINGLE = CANON + """, users AS (SELECT rec, local_id, min(ord) AS by_ord FROM ek GROUP BY rec, local_id),
kept AS (SELECT can.*, by_ord = first_ord AS keeps FROM can JOIN users ON can.rec = users.rec AND own_id = local_id),
s AS (SELECT *, CASE WHEN keeps THEN own_id ELSE prefix || row_number() OVER (PARTITION BY rec, prefix, keeps ORDER BY first_ord) END AS id FROM kept),
names AS (SELECT rec, norm, arg_min(id, first_ord) AS id FROM s GROUP BY rec, norm),
res AS (SELECT rk.*, coalesce(a.id, b.id) AS source_id, coalesce(c.id, e.id) AS target_id FROM rk
  LEFT JOIN (SELECT DISTINCT rec, id FROM s) a ON a.rec = rk.rec AND a.id = rk.source LEFT JOIN names b ON b.rec = rk.rec AND b.norm = rk.snorm
  LEFT JOIN (SELECT DISTINCT rec, id FROM s) c ON c.rec = rk.rec AND c.id = rk.target LEFT JOIN names e ON e.rec = rk.rec AND e.norm = rk.tnorm)"""
CHUNKED = CANON + """, er AS (SELECT ek.rec, ek.chunk, ek.ord, ek.local_id, ek.norm, g.id FROM ek JOIN g USING (rec, label, norm)),
loc AS (SELECT rec, chunk, local_id, arg_max(id, ord) AS id FROM er GROUP BY ALL), ch AS (SELECT rec, chunk, norm, arg_max(id, ord) AS id FROM er GROUP BY ALL),
fst AS (SELECT rec, norm, arg_min(id, first_ord) AS id, arg_min(first_chunk, first_ord) AS since FROM g GROUP BY ALL),
cres AS (SELECT rk.*, coalesce(l1.id, c1.id, f1.id) AS source_id, coalesce(l2.id, c2.id, f2.id) AS target_id FROM rk
  LEFT JOIN loc l1 ON l1.rec = rk.rec AND l1.chunk = rk.chunk AND l1.local_id = rk.source LEFT JOIN ch c1 ON c1.rec = rk.rec AND c1.chunk = rk.chunk AND c1.norm = rk.snorm LEFT JOIN fst f1 ON f1.rec = rk.rec AND f1.norm = rk.snorm AND f1.since <= rk.chunk
  LEFT JOIN loc l2 ON l2.rec = rk.rec AND l2.chunk = rk.chunk AND l2.local_id = rk.target LEFT JOIN ch c2 ON c2.rec = rk.rec AND c2.chunk = rk.chunk AND c2.norm = rk.tnorm LEFT JOIN fst f2 ON f2.rec = rk.rec AND f2.norm = rk.tnorm AND f2.since <= rk.chunk),
edges AS (SELECT rec, source_id AS source, target_id AS target, relation_type, relation_name, relation, min(ord) AS ord FROM cres WHERE source_id IS NOT NULL AND target_id IS NOT NULL GROUP BY ALL)"""
GHOSTS = K + """, known AS (SELECT DISTINCT rec, local_id AS k FROM ent UNION SELECT DISTINCT rec, name FROM ent),
bad AS (SELECT DISTINCT rec, ord FROM (SELECT rec, ord, source AS e FROM rel UNION ALL SELECT rec, ord, target FROM rel) x WHERE NOT EXISTS (SELECT 1 FROM known WHERE known.rec = x.rec AND known.k IS NOT DISTINCT FROM x.e)),
reasons AS (SELECT o_orderkey AS rec, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 10 = 0 THEN 'call_failed' WHEN coalesce(n, 0) < 3 THEN 'few_entities' WHEN b.rec IS NOT NULL THEN 'ghost_relation' END AS reason
  FROM orders LEFT JOIN (SELECT rec, count(*) AS n FROM ent GROUP BY rec) c ON c.rec = o_orderkey LEFT JOIN (SELECT DISTINCT rec FROM bad) b ON b.rec = o_orderkey)"""


def _chunked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = kg.entities(spark, d)
    g = graph.issue_ids(graph.canonical(e))
    return g, graph.resolve_chunked(kg.relations(spark, d), e, g)


def _single(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    g = graph.keep_ids(kg.entities(spark, d))
    return g, graph.resolve_single(kg.relations(spark, d), g)


def _reasons(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "orders").select(F.col("o_orderkey").alias("rec"), (~((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 10 == 0))).alias("success"))
    return quality.reject_reasons(records, kg.entities(spark, d), kg.relations(spark, d))


@query(CANON + " SELECT rec, label, norm, name, id FROM g")
def entity_canonical(spark: SparkSession, d: str) -> DataFrame:
    return graph.issue_ids(graph.canonical(kg.entities(spark, d))).select("rec", "label", "norm", "name", "id")


@query(SINGLE + " SELECT rec, label, norm, id FROM s")
def entity_single_ids(spark: SparkSession, d: str) -> DataFrame:
    return graph.keep_ids(kg.entities(spark, d)).select("rec", "label", "norm", "id")


def _folded(c: str) -> str:
    return f"SELECT rec, label, norm, string_agg({c}, ' | ' ORDER BY o) AS {c} FROM (SELECT rec, label, norm, {c}, min(ord) AS o FROM ek GROUP BY ALL) GROUP BY rec, label, norm"


@query(K + f" SELECT a.rec, a.label, a.norm, size, flag FROM ({_folded('size')}) a JOIN ({_folded('flag')}) b USING (rec, label, norm)")
def property_fold(spark: SparkSession, d: str) -> DataFrame:
    return graph.fold_properties(kg.entities(spark, d), ["size", "flag"])


@query(SINGLE + " SELECT rec, ord, source, target, source_id, target_id FROM res")
def endpoint_resolve_single(spark: SparkSession, d: str) -> DataFrame:
    return _single(spark, d)[1].select("rec", F.col("ord").cast("bigint").alias("ord"), "source", "target", "source_id", "target_id")


@query(CHUNKED + " SELECT rec, ord, source, target, source_id, target_id FROM cres")
def endpoint_resolve_chunked(spark: SparkSession, d: str) -> DataFrame:
    return _chunked(spark, d)[1].select("rec", F.col("ord").cast("bigint").alias("ord"), "source", "target", "source_id", "target_id")


@query(CHUNKED + " SELECT * FROM edges")
def relation_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return graph.distinct_edges(_chunked(spark, d)[1]).withColumn("ord", F.col("ord").cast("bigint"))


@query(SINGLE + """ SELECT rec, coalesce(n, 0) AS entity_count, coalesce(r, 0) AS relation_count, coalesce(x, 0) AS dropped FROM (SELECT rec, count(*) AS n FROM s GROUP BY rec)
FULL JOIN (SELECT rec, count(DISTINCT CASE WHEN source_id IS NOT NULL AND target_id IS NOT NULL THEN source_id || '/' || target_id || '/' || relation_type || '/' || relation_name || '/' || relation END) AS r, count(*) FILTER (source_id IS NULL OR target_id IS NULL) AS x FROM res GROUP BY rec) USING (rec)""")
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return graph.stats(*_single(spark, d))


@query(CHUNKED + """ SELECT n.rec, ids, links FROM (SELECT rec, string_agg(id, ',' ORDER BY id) AS ids FROM g GROUP BY rec) n
LEFT JOIN (SELECT rec, string_agg(source || '>' || target, ',' ORDER BY source, target, relation, relation_name, ord) AS links FROM edges GROUP BY rec) e ON e.rec = n.rec""")
def graph_order(spark: SparkSession, d: str) -> DataFrame:
    g, r = _chunked(spark, d)
    out = graph.sorted_graph(g, graph.distinct_edges(r))
    return out.select("rec", F.array_join(F.transform("entities", lambda e: e["id"]), ",").alias("ids"), F.when(F.col("relations").isNotNull(), F.array_join(F.transform("relations", lambda e: F.concat(e["source"], F.lit(">"), e["target"])), ",")).alias("links"))


@query(GHOSTS + " SELECT rec, CAST(ord AS BIGINT) AS ord FROM bad")
def ghost_filter(spark: SparkSession, d: str) -> DataFrame:
    return quality.ghost_edges(kg.relations(spark, d), kg.entities(spark, d)).select("rec", F.col("ord").cast("bigint").alias("ord"))


@query(SINGLE + """ SELECT rec, coalesce(nullif(concat_ws(',', CASE WHEN n < 3 THEN 'few_entities' END, CASE WHEN x > 0 THEN 'ghosts_removed:' || x END, CASE WHEN rec % 11 = 0 THEN 'repair_pass_failed' END), ''), '') AS flags
FROM (SELECT rec, count(*) AS n FROM s GROUP BY rec) JOIN (SELECT rec, count(*) FILTER (source_id IS NULL OR target_id IS NULL) AS x FROM res GROUP BY rec) USING (rec)""")
def quality_flags(spark: SparkSession, d: str) -> DataFrame:
    return graph.stats(*_single(spark, d)).select("rec", F.array_join(quality.quality_flags(F.col("entity_count"), F.col("dropped"), F.col("rec") % 11 == 0), ",").alias("flags"))


@query(GHOSTS + " SELECT reason, count(*) AS n FROM reasons WHERE reason IS NOT NULL GROUP BY reason")
def reject_histogram(spark: SparkSession, d: str) -> DataFrame:
    return quality.histogram(_reasons(spark, d))


@query(GHOSTS + " SELECT count(*) FILTER (reason IS NULL) AS kept, count(*) AS total, CAST(100 * count(*) FILTER (reason IS NULL) // count(*) AS BIGINT) AS pct FROM reasons")
def retention_pct(spark: SparkSession, d: str) -> DataFrame:
    return quality.retention(_reasons(spark, d))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.when(F.col("user_id") % 17 != 0, F.col("user_id")).alias("user_id"), "event_id", "event_type", "value")


E = "WITH ev AS (SELECT CASE WHEN user_id % 17 <> 0 THEN user_id END AS user_id, event_id, event_type, value FROM events)"


def _dedupe_sql(which: str) -> str:
    return E + f""" SELECT user_id, {which}(event_id, event_id) AS event_id, {which}(event_type, event_id) AS event_type, min(event_id) AS slot FROM ev WHERE user_id IS NOT NULL GROUP BY user_id
UNION ALL SELECT user_id, event_id, event_type, event_id FROM ev WHERE user_id IS NULL"""


@query(_dedupe_sql("arg_min"))
def dedupe_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return batches.dedupe(_events(spark, d).drop("value"), "user_id", "event_id", "first")


@query(_dedupe_sql("arg_max"))
def dedupe_keep_last(spark: SparkSession, d: str) -> DataFrame:
    return batches.dedupe(_events(spark, d).drop("value"), "user_id", "event_id", "last")


@query(E + " SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM ev) WHERE n > 1")
def duplicate_report(spark: SparkSession, d: str) -> DataFrame:
    return batches.duplicates(_events(spark, d), "user_id", "event_id")


@query("SELECT r.doc_id FROM (SELECT unnest(generate_series((SELECT min(doc_id) FROM labels), (SELECT max(doc_id) FROM labels))) AS doc_id) r ANTI JOIN labels l ON l.doc_id = r.doc_id")
def missing_ids(spark: SparkSession, d: str) -> DataFrame:
    return batches.gaps(table(spark, d, "labels"), "doc_id")


@query('SELECT min(doc_id) AS "first", max(doc_id) AS "last", count(*) AS records FROM labels')
def index_range(spark: SparkSession, d: str) -> DataFrame:
    return batches.index_range(table(spark, d, "labels"), "doc_id")


@query("""WITH b AS (SELECT o_orderkey AS k, o_orderkey * 2 AS ord FROM orders UNION ALL SELECT o_orderkey, 1000000000 + o_orderkey FROM orders WHERE o_orderkey % 50 = 0),
k AS (SELECT DISTINCT k FROM b WHERE k IS NOT NULL)
SELECT (SELECT count(*) FROM b) AS records_before_dedupe, (SELECT count(*) FROM k) AS records, (SELECT min(k) FROM k) AS "first", (SELECT max(k) FROM k) AS "last",
  (SELECT count(*) FROM b) - (SELECT count(*) FROM k) AS n_duplicates, (SELECT max(k) - min(k) + 1 - count(*) FROM k) AS n_missing""")
def batch_audit(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    first = orders.select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") * 2).alias("ord"), F.lit("a").alias("path"))
    again = orders.where("o_orderkey % 50 = 0").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") + 1_000_000_000).alias("ord"))
    got = batches.audit(batches.union_batches(first, again), "k", "ord")
    return got.select("records_before_dedupe", "records", "first", "last", F.size("deduped_keys").cast("bigint").alias("n_duplicates"), F.size("missing_global_idx").cast("bigint").alias("n_missing"))


@query("""SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN s_nationkey WHEN 1 THEN s_nationkey + 100 END AS metadata_records, CAST(CASE s_suppkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 END AS INTEGER) AS metadata_failures FROM supplier""")
def sidecar_join(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    name = F.concat(F.lit("batch_"), F.col("s_suppkey").cast("string"), F.lit(".json"))
    data = s.select(name.alias("path"), F.col("s_suppkey").alias("records"))
    plain = s.where("s_suppkey % 3 = 0").select(F.regexp_replace(name, r"\.json$", ".metadata.json").alias("sidecar"), F.col("s_nationkey").alias("records"), F.lit(1).alias("failures"))
    other = s.where("s_suppkey % 3 < 2").select(F.concat(name, F.lit(".metadata.json")).alias("sidecar"), (F.col("s_nationkey") + 100).alias("records"), F.lit(2).alias("failures"))
    return batches.join_sidecars(data, plain.union(other)).select(F.col("records").alias("id"), "metadata_records", "metadata_failures")


@query("SELECT doc_id, CAST(ntile(7) OVER (ORDER BY doc_id) AS INTEGER) AS shard FROM documents")
def shard_assign(spark: SparkSession, d: str) -> DataFrame:
    return batches.shards(table(spark, d, "documents").select("doc_id"), "doc_id", 7).select("doc_id", "shard")


@query(E + " SELECT event_id, row_number() OVER (ORDER BY coalesce(user_id, 1000000000000), event_id) - 1 AS place FROM ev")
def index_sort(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).select("event_id", F.coalesce("user_id", F.lit(batches.NO_INDEX)).alias("idx"))
    return batches.places(rows, "idx", "event_id").select("event_id", "place")


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 20 OFFSET 15")
def offset_window(spark: SparkSession, d: str) -> DataFrame:
    return extract.window(table(spark, d, "documents").select("doc_id"), "doc_id", 15, 20)


def _icd(spark: SparkSession, d: str) -> DataFrame:
    """Pages as hierarchy records: every third url also has a release form."""
    pages = table(spark, d, "pages")
    released = F.concat(F.lit("http://x/release/11/mms/"), F.col("page_id").cast("string"))
    return pages.select(F.col("page_id").alias("ord"), F.when(F.col("page_id") % 3 == 0, released).otherwise(F.col("url")).alias("id"), F.col("page_id").cast("string").alias("code"), F.col("url").alias("title"), F.when(F.col("page_id") % 2 == 0, "category").alias("classKind"), "url")


@query("""WITH e AS (SELECT page_id AS ord, CASE WHEN page_id % 3 = 0 THEN 'http://x/release/11/mms/' || page_id ELSE url END AS id, CAST(page_id AS VARCHAR) AS code FROM pages),
k AS (SELECT ord, id, code, 0 AS pos, id AS key FROM e UNION ALL SELECT ord, id, code, 1, list_last(string_split(regexp_replace(id, '/+$', ''), '/')) FROM e
  UNION ALL SELECT ord, id, code, 2, 'http://id.who.int/icd/entity/' || ord FROM e WHERE ord % 3 = 0 UNION ALL SELECT ord, id, code, 3, CAST(ord AS VARCHAR) FROM e WHERE ord % 3 = 0),
m AS (SELECT key, arg_max(id, ord * 4 + pos) AS id, arg_max(code, ord * 4 + pos) AS code FROM k WHERE key <> '' GROUP BY key),
r AS (SELECT page_id AS rec, CASE page_id % 4 WHEN 0 THEN 'http://id.who.int/icd/entity/' || page_id WHEN 1 THEN url || '/' WHEN 2 THEN 'none/' || page_id || 'x' ELSE list_last(string_split(url, '/')) END AS reference FROM pages)
SELECT rec, reference, coalesce(a.id, b.id, reference) AS id, coalesce(a.code, b.code, '') AS code FROM r LEFT JOIN m a ON a.key = reference LEFT JOIN m b ON b.key = list_last(string_split(regexp_replace(reference, '/+$', ''), '/')) AND reference <> ''""")
def ref_resolve(spark: SparkSession, d: str) -> DataFrame:
    kind, number = F.col("page_id") % 4, F.col("page_id").cast("string")
    ref = F.when(kind == 0, F.concat(F.lit(twopass.FOUNDATION), number)).when(kind == 1, F.concat("url", F.lit("/"))).when(kind == 2, F.concat(F.lit("none/"), number, F.lit("x"))).otherwise(F.element_at(F.split("url", "/"), -1))
    refs = table(spark, d, "pages").select(F.col("page_id").alias("rec"), F.lit(0).alias("pos"), ref.alias("reference"))
    return twopass.resolve(refs, twopass.lookup(_icd(spark, d))).select("rec", "reference", "id", "code")


@query("""SELECT CAST(doc_id AS VARCHAR) AS source_id, lang AS code, source AS title, coalesce(quality > 0, false) AS "has_diagnosticCriteria", CAST(CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END AS INTEGER) AS "narrowerTerms_count" FROM documents LEFT JOIN labels USING (doc_id)""")
def manifest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    criteria = F.when(F.col("quality") > 0, "text").when(F.col("quality") == 0, "")
    return twopass.manifest(rows.select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("code"), F.col("source").alias("title"), criteria.alias("diagnosticCriteria"), F.when(F.col("doc_id") % 3 == 0, F.array("lang", "source")).alias("narrowerTerms")))


@query("""WITH m AS (SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END AS code, CASE WHEN doc_id % 3 = 0 THEN source ELSE '' END AS title FROM documents WHERE doc_id % 10 <> 9),
s AS (SELECT doc_id AS id, 's' || quality AS code, '' AS title FROM labels), l AS (SELECT item_id AS id, 'l' AS code, text AS title FROM benchmark)
SELECT CAST(id AS VARCHAR) AS source_id, coalesce(nullif(m.code, ''), nullif(s.code, ''), l.code, '') AS code, coalesce(nullif(m.title, ''), nullif(s.title, ''), l.title, '') AS title, s.id IS NOT NULL AS structure, l.id IS NOT NULL AS long_text
FROM m FULL JOIN s USING (id) FULL JOIN l USING (id)""")
def twopass_headers(spark: SparkSession, d: str) -> DataFrame:
    doc, label, item = table(spark, d, "documents"), table(spark, d, "labels"), table(spark, d, "benchmark")
    listed = doc.where("doc_id % 10 <> 9").select(F.col("doc_id").cast("string").alias("source_id"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("").alias("code"), F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise("").alias("title"))
    structure = label.select(F.col("doc_id").cast("string").alias("source_id"), F.concat(F.lit("s"), F.col("quality").cast("string")).alias("code"), F.lit("").alias("title"))
    long_text = item.select(F.col("item_id").cast("string").alias("source_id"), F.lit("l").alias("code"), F.col("text").alias("title"))
    return twopass.merge_headers(listed, {"structure": structure, "long_text": long_text})


def _passes(spark: SparkSession, d: str, df: DataFrame) -> DataFrame:
    """Chunk 0 is the structure pass, the others are the long-text pass."""
    turn = F.when(F.col("chunk") == 0, 1).otherwise(2)
    return df.withColumn("turn", turn).withColumn("scope", F.when(turn == 1, "structure").otherwise("long_text")).withColumnRenamed("rec", "source_id")


TWO = K + """, pe AS (SELECT rec AS source_id, CASE chunk WHEN 0 THEN 1 ELSE 2 END AS turn, CASE chunk WHEN 0 THEN 'structure' ELSE 'long_text' END AS scope, ord, local_id AS id, lower(label) AS l, lower(clean) AS n FROM ek),
first AS (SELECT source_id, l, n, arg_min(scope || '_' || id, turn * 100000 + ord) AS merged_id FROM pe GROUP BY source_id, l, n),
me AS (SELECT pe.*, scope || '_' || id AS scoped, merged_id FROM pe JOIN first USING (source_id, l, n)),
ids AS (SELECT source_id, scope, id, arg_max(merged_id, ord) AS mid FROM me GROUP BY ALL),
pr AS (SELECT rel.*, rec AS source_id, CASE chunk WHEN 0 THEN 1 ELSE 2 END AS turn, CASE chunk WHEN 0 THEN 'structure' ELSE 'long_text' END AS scope FROM rel),
mr AS (SELECT pr.source_id, coalesce(a.mid, source) AS source, coalesce(b.mid, target) AS target, relation_type, relation_name, relation, turn, ord FROM pr
  LEFT JOIN ids a ON a.source_id = pr.source_id AND a.scope = pr.scope AND a.id = source LEFT JOIN ids b ON b.source_id = pr.source_id AND b.scope = pr.scope AND b.id = target)"""


@query(TWO + " SELECT source_id, ord, scoped, merged_id FROM me")
def twopass_entities(spark: SparkSession, d: str) -> DataFrame:
    e = _passes(spark, d, kg.entities(spark, d)).withColumnRenamed("local_id", "id")
    return twopass.merge_entities(e).select("source_id", F.col("ord").cast("bigint").alias("ord"), "scoped", "merged_id")


@query(TWO + " SELECT source_id, source, target, relation_type, relation_name, relation, min(turn * 100000 + ord) AS place FROM mr GROUP BY ALL")
def twopass_relations(spark: SparkSession, d: str) -> DataFrame:
    e = twopass.merge_entities(_passes(spark, d, kg.entities(spark, d)).withColumnRenamed("local_id", "id"))
    r = _passes(spark, d, kg.relations(spark, d)).drop("chunk")
    out = twopass.remap_ends(r, e)
    return out.select("source_id", "source", "target", "relation_type", "relation_name", "relation", (F.col("turn") * 100000 + F.col("ord")).cast("bigint").alias("place"))


@query(K + ", x AS (SELECT rec, 'structure_' || source AS s, 'structure_' || target AS t, relation FROM rel WHERE chunk = 0), y AS (SELECT rec, 'structure_' || source AS s, 'structure_' || target AS t, relation FROM rel WHERE chunk < 2) SELECT * FROM x UNION SELECT * FROM y")
def scoped_union_distinct(spark: SparkSession, d: str) -> DataFrame:
    r = kg.relations(spark, d)
    scoped = r.select("rec", "chunk", t.scoped_id(F.lit("structure"), F.col("source")).alias("s"), t.scoped_id(F.lit("structure"), F.col("target")).alias("t"), "relation")
    return scoped.where("chunk = 0").drop("chunk").union(scoped.where("chunk < 2").drop("chunk")).distinct()


@query(SINGLE + f""", per AS (SELECT rec, count(*) AS n, max(x) AS r, max(c) AS c FROM s LEFT JOIN (SELECT rec, count(*) AS x, count(DISTINCT chunk) AS c FROM rel GROUP BY rec) USING (rec) GROUP BY rec),
pv AS (SELECT rec, count(*) AS total, count(*) FILTER (CAST(size AS INTEGER) % 10 = 0) AS empty FROM ent GROUP BY rec)
SELECT o_orderpriority, count(*) AS count, {four_sql('coalesce(n, 0)', 'entity_count')}, {four_sql('coalesce(r, 0)', 'relation_count')}, {four_sql('CASE WHEN c > 1 THEN c END', 'chunk_count')}, round_even(sum(empty) / sum(total), 4) AS empty_property_ratio
FROM orders LEFT JOIN per ON per.rec = o_orderkey LEFT JOIN pv ON pv.rec = o_orderkey GROUP BY o_orderpriority""")
def extraction_profile(spark: SparkSession, d: str) -> DataFrame:
    e = kg.entities(spark, d)
    nodes = graph.keep_ids(e).groupBy("rec").agg(F.count("*").alias("n"))
    edges = kg.relations(spark, d).groupBy("rec").agg(F.count("*").alias("r"), F.count_distinct("chunk").alias("c"))
    values = e.groupBy("rec").agg(F.count("*").alias("property_values"), F.count_if(F.col("size").cast("int") % 10 == 0).alias("empty_values"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("rec"), "o_orderpriority").join(nodes, "rec", "left").join(edges, "rec", "left").join(values, "rec", "left")
    zero = F.lit(0)
    rows = rows.withColumn("entity_count", F.coalesce("n", zero)).withColumn("relation_count", F.coalesce("r", zero)).withColumn("chunk_count", F.when(F.col("c") > 1, F.col("c")))
    return profile.extraction_profile(rows, "o_orderpriority")


MODELS = f"""SELECT model, count(*) AS total_cases, count(*) FILTER (valid) AS valid_json_cases, round_even(count(*) FILTER (valid) / count(*), 4) AS valid_json_ratio,
{four_sql('CASE WHEN valid THEN k END', 'entity_count')}, {four_sql('CASE WHEN valid THEN k % 7 END', 'relation_count')}, count(*) FILTER (NOT valid) AS n_invalid FROM r GROUP BY model"""


def _profiled(df: DataFrame) -> DataFrame:
    return profile.model_profile(df).withColumn("n_invalid", F.size("invalid_ids").cast("bigint")).drop("invalid_ids")


@query("WITH r AS (SELECT event_type AS model, event_id % 9 <> 0 AS valid, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) " + MODELS)
def model_profile_long(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    rows = table(spark, d, "events").select(F.col("event_type").alias("model"), F.col("event_id").alias("id"), F.when(F.col("event_id") % 9 == 0, F.concat("props", F.lit("}"))).otherwise(F.col("props")).alias("output"), k.alias("entity_count"), (k % 7).alias("relation_count"))
    return _profiled(rows)


@query("""WITH m AS (SELECT unnest(['base', 'specific', 'standard']) AS model), r AS (SELECT model, CASE model WHEN 'base' THEN event_id % 2 = 0 WHEN 'specific' THEN true ELSE event_id % 5 <> 0 END AS valid, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events, m) """ + MODELS)
def model_profile_wide(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    some = F.map_filter(F.create_map(F.lit("base"), F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise("no"), F.lit("specific"), "props", F.lit("standard"), F.when(F.col("event_id") % 5 != 0, F.col("props"))), lambda _, v: v.isNotNull())
    k = F.get_json_object("props", "$.k").cast("bigint")
    wide = events.select(F.col("event_id").alias("id"), some.alias("outputs"))
    counts = events.select(F.col("event_id").alias("id"), k.alias("entity_count"), (k % 7).alias("relation_count"))
    return _profiled(profile.long_form(wide).join(counts, "id"))


@query("SELECT doc_id AS id, model FROM labels, (SELECT unnest(['base', 'specific']) AS model)")
def case_model_cross(spark: SparkSession, d: str) -> DataFrame:
    cases = table(spark, d, "labels").select(F.col("doc_id").alias("id"))
    return profile.cases_by_models(cases, ["base", "specific"], None, {"base", "specific", "standard"})


@query("SELECT doc_id AS id FROM labels WHERE doc_id IN (SELECT item_id FROM benchmark)")
def case_selection(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "benchmark").select(F.col("item_id").alias("id"))
    return profile.selected(table(spark, d, "labels").select(F.col("doc_id").alias("id")), wanted)


@query("SELECT item_id AS id, CASE WHEN item_id % 4 = 0 THEN 'own' ELSE d.text END AS text FROM benchmark LEFT JOIN documents d ON d.doc_id = item_id")
def positional_lookup(spark: SparkSession, d: str) -> DataFrame:
    cases = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.when(F.col("item_id") % 4 == 0, "own").alias("source_text"))
    records = table(spark, d, "documents").select(F.col("doc_id").alias("ord"), "text")
    return profile.positional(cases, records).select("id", "text")


#: The stub extractor in SQL: the first five capitalised words of ``texts(id, part, text)``.
ECHO = """words AS (SELECT id, part, ord, trim(w, '.,;:') AS name FROM (SELECT id, part, unnest(ws) AS w, generate_subscripts(ws, 1) AS ord FROM (SELECT id, part, string_split_regex(text, '\\s+') AS ws FROM texts)) WHERE w <> '' AND w[1] = upper(w[1]) AND w[1] <> lower(w[1])),
found AS (SELECT id, part, name, min(ord) AS ord FROM words GROUP BY id, part, name QUALIFY row_number() OVER (PARTITION BY id, part ORDER BY min(ord)) <= 5)"""


@query(f"""WITH cuts AS ({_truncated("SELECT doc_id, text FROM documents", 4000)}), texts AS (SELECT doc_id AS id, 1 AS part, cut AS text FROM cuts WHERE length(text) >= 50), {ECHO}
SELECT doc_id AS global_idx, length(text) < 50 AS skip, length(text) >= 50 AS success, CASE WHEN length(text) >= 50 THEN length(cut) END AS input_chars, CASE WHEN length(text) >= 50 THEN length(text) END AS original_input_chars,
CASE WHEN length(text) >= 50 THEN coalesce(names, '') END AS names FROM cuts LEFT JOIN (SELECT id, string_agg(name, ',' ORDER BY ord) AS names FROM found GROUP BY id) ON id = doc_id""")
def extraction_run(spark: SparkSession, d: str) -> DataFrame:
    """Every document through the stub extractor, in one call each."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("global_idx"), "text")
    got = extract.run(docs, extract.echo_extractor, str, extract.Settings(max_chars=4000))
    names = F.transform(F.from_json("output", GRAPH)["entities"], lambda e: e["name"])
    return got.select("global_idx", "skip", "success", "input_chars", "original_input_chars", F.when(~F.col("skip"), F.array_join(names, ",")).alias("names"))


@query(f"""WITH RECURSIVE {CHUNKS}, texts AS (SELECT doc_id AS id, chunk_index AS part, piece AS text FROM chunks), {ECHO},
named AS (SELECT id, part, ord, trim(regexp_replace(lower(name), '\\s+', ' ', 'g')) AS norm FROM found),
heads AS (SELECT id, part, arg_min(norm, ord) AS norm FROM named GROUP BY ALL),
e AS (SELECT id, count(DISTINCT norm) AS n_entities FROM named GROUP BY id),
r AS (SELECT id, count(DISTINCT h.norm || '/' || n.norm) AS n_relations FROM (SELECT *, row_number() OVER (PARTITION BY id, part ORDER BY ord) AS place FROM named) n JOIN heads h USING (id, part) WHERE place > 1 GROUP BY id)
SELECT doc_id AS global_idx, trim(text) = '' AS skip, trim(text) <> '' AS success, k AS chunk_count, k AS successful_chunks, CASE WHEN trim(text) <> '' THEN coalesce(n_entities, 0) END AS n_entities, CASE WHEN trim(text) <> '' THEN coalesce(n_relations, 0) END AS n_relations
FROM documents LEFT JOIN (SELECT doc_id, CAST(count(*) AS INTEGER) AS k FROM chunks GROUP BY doc_id) USING (doc_id) LEFT JOIN e ON e.id = doc_id LEFT JOIN r ON r.id = doc_id""")
def extraction_run_chunked(spark: SparkSession, d: str) -> DataFrame:
    """Every document through the stub extractor, chunk by chunk, graphs merged."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("global_idx"), "text")
    got = extract.run(docs, extract.echo_extractor, str, extract.Settings(max_chars=CHUNK, overlap=OVERLAP), by_chunks=True)
    g = F.from_json("output", GRAPH)
    return got.select("global_idx", "skip", "success", "chunk_count", "successful_chunks", *(F.when(~F.col("skip"), F.size(g[c]).cast("bigint")).alias(f"n_{c}") for c in ("entities", "relations")))


@query(f"""WITH cuts AS ({_truncated("SELECT doc_id, text FROM documents", 4000)}), texts AS (SELECT doc_id AS id, 1 AS part, cut AS text FROM cuts WHERE length(text) >= 50), {ECHO}, n AS (SELECT id, count(*) AS n FROM found GROUP BY id),
all_ AS (SELECT doc_id AS id, length(text) AS chars, row_number() OVER (ORDER BY doc_id) - 1 AS place, count(*) OVER () AS total FROM documents)
SELECT CAST(CASE WHEN place < total % 4 * (total // 4 + 1) THEN place // (total // 4 + 1) ELSE total % 4 + (place - total % 4 * (total // 4 + 1)) // (total // 4) END + 1 AS INTEGER) AS shard,
CASE WHEN coalesce(n, 0) < 3 THEN 'few_entities' END AS reason, count(*) AS records FROM all_ LEFT JOIN n USING (id) WHERE chars >= 50 GROUP BY ALL""")
def sharded_run(spark: SparkSession, d: str) -> DataFrame:
    """The driver over four shards, with the quality filter: records by shard and reason."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("global_idx"), "text")
    return extract.sharded(docs, extract.echo_extractor, str, extract.Settings(max_chars=4000), workers=4).groupBy("shard", "reason").agg(F.count("*").alias("records"))
