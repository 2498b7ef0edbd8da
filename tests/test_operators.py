"""Operators on small graphs and batches with known answers."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom.operators import batches, extract, graph, profile, quality, sft, twopass


def entities(spark, rows):
    return spark.createDataFrame(rows, "rec long, chunk int, ord long, local_id string, label string, name string, note string")


def relations(spark, rows):
    return spark.createDataFrame([(*r, "", "", "rel") for r in rows], "rec long, chunk int, ord long, source string, target string, relation_type string, relation_name string, relation string")


def test_repeated_ids_stay_unique_and_aliases_are_lost(spark):
    e = entities(spark, [(1, 0, 1, "D1", "Disease", "Flu", ""), (1, 0, 2, "S1", "Symptom", "Cough", ""), (1, 0, 3, "D1", "Disease", "Cold", ""), (1, 0, 4, "D2", "Disease", "flu ", ""), (1, 0, 5, "", "Odd", "x", ""), (1, 0, 6, "E9", "Odd", " ", "")])
    g = graph.keep_ids(e)
    ids = {r.norm: r.id for r in g.collect()}
    assert ids["flu"] == "D1" and ids["cough"] == "S1" and len(set(ids.values())) == 4 and ids["x"] == "E1"
    r = graph.resolve_single(relations(spark, [(1, 0, 1, "D2", "S1"), (1, 0, 2, "FLU", "cough"), (1, 0, 3, "", "S1")]), g).orderBy("ord").collect()
    assert (r[0].source_id, r[0].target_id) in ((None, "S1"), (ids["cold"], "S1"))  # the alias D2 names no flu
    assert (r[1].source_id, r[1].target_id) == ("D1", "S1") and r[2].source_id is None


def test_chunked_resolution_looks_back_only(spark):
    e = entities(spark, [(1, 0, 1, "D1", "Disease", "Flu", ""), (1, 1, 2, "D1", "Disease", "Cold", ""), (1, 2, 3, "S1", "Symptom", "Cough", "")])
    g = graph.issue_ids(graph.canonical(e))
    ids = {r.norm: r.id for r in g.collect()}
    r = graph.resolve_chunked(relations(spark, [(1, 0, 1, "D1", "cough"), (1, 1, 2, "D1", "flu"), (1, 2, 3, "cough", "Cold")]), e, g).orderBy("ord").collect()
    assert (r[0].source_id, r[0].target_id) == (ids["flu"], None)
    assert (r[1].source_id, r[1].target_id) == (ids["cold"], ids["flu"])
    assert (r[2].source_id, r[2].target_id) == (ids["cough"], ids["cold"])
    assert graph.distinct_edges(graph.resolve_chunked(relations(spark, [(1, 1, 2, "D1", "flu"), (1, 1, 3, "D1", "FLU")]), e, g)).count() == 1


def test_fold_is_no_distinct(spark):
    rows = [(1, 0, i, "", "L", "n", v) for i, v in enumerate(["a | b", "a", "b ", "a | b", " ", None, "c"], 1)]
    got = graph.fold_properties(entities(spark, rows), ["note"]).first()
    assert got.note == "a | b | c"


def test_ids_sort_as_text(spark):
    e = entities(spark, [(1, 0, i, "", "Disease", f"n{i}", "") for i in range(1, 13)])
    g = graph.issue_ids(graph.canonical(e))
    out = graph.sorted_graph(g, graph.distinct_edges(graph.resolve_single(relations(spark, []), g))).first()
    assert [x.id for x in out.entities][:4] == ["D1", "D10", "D11", "D12"]


def test_ghosts_see_nulls(spark):
    e = entities(spark, [(1, 0, 1, None, "L", "n", ""), (2, 0, 1, "a", "L", "n", "")])
    r = spark.createDataFrame([(1, 1, None, "n"), (2, 1, None, "a"), (2, 2, "a", "n")], "rec long, ord long, source string, target string")
    assert [(x.rec, x.ord) for x in quality.ghost_edges(r, e).collect()] == [(2, 1)]


def test_combined_audit(spark):
    """The published audit: 466 records, 456 after the dedupe, 15 gaps."""
    parts = [range(5), range(5, 110), range(110, 210), range(210, 310), range(310, 410), range(400, 405), range(405, 410), *(range(s, s + 5) for s in range(410, 450, 5)), [450], [455], [470], [451], [452, 453]]
    rows = [(i, n) for n, i in enumerate(i for p in parts for i in p)]
    got = batches.audit(spark.createDataFrame(rows, "global_idx long, ord long"), "global_idx", "ord").first()
    assert (got.records_before_dedupe, got.records, got.first, got.last) == (466, 456, 0, 470)
    assert got.deduped_keys == list(range(400, 410)) and got.missing_global_idx == [454, *range(456, 470)]


def test_last_takes_the_first_slot(spark):
    df = spark.createDataFrame([(1, 0, "a"), (None, 1, "b"), (1, 2, "c"), (None, 3, "d"), (2, 4, "e")], "k long, ord long, v string")
    assert [(r.slot, r.v) for r in batches.dedupe(df, "k", "ord", "last").orderBy("slot").collect()] == [(0, "c"), (1, "b"), (3, "d"), (4, "e")]
    assert batches.dedupe(batches.dedupe(df, "k", "ord").drop("slot"), "k", "ord").count() == 4
    assert [(r.k, r.ord) for r in batches.duplicates(df, "k", "ord").orderBy("ord").collect()] == [(1, 2), (None, 3)]


@pytest.mark.parametrize("rows, parts, sizes", [(8, 3, [3, 3, 2]), (2, 5, [1, 1]), (5, 0, [5])])
def test_shards(spark, rows, parts, sizes):
    got = batches.shards(spark.range(rows).withColumnRenamed("id", "ord"), "ord", parts).groupBy("shard").count().orderBy("shard").collect()
    assert [r["count"] for r in got] == sizes


def test_gaps_of_nothing(spark):
    assert batches.gaps(spark.createDataFrame([], "k long"), "k").count() == 0


def test_two_pass_merge(spark):
    e = spark.createDataFrame([("s", 1, "structure", 1, "D1", "Disease", "Flu"), ("s", 2, "long_text", 2, "D1", "disease", " flu"), ("s", 2, "long_text", 3, "", "", "x")], "source_id string, turn int, scope string, ord int, id string, label string, name string")
    merged = twopass.merge_entities(e)
    assert [r.merged_id for r in merged.orderBy("ord").collect()] == ["structure_D1", "structure_D1", "long_text_E3"]
    r = spark.createDataFrame([("s", 2, "long_text", 1, "D1", "ghost", "r"), ("s", 2, "long_text", 2, "D1", "ghost", "r")], "source_id string, turn int, scope string, ord int, source string, target string, relation string")
    assert [(x.source, x.target) for x in twopass.remap_ends(r, merged).collect()] == [("structure_D1", "ghost")]


def test_missing_source_id_is_an_error(spark):
    with pytest.raises(Exception, match="source_id"):
        twopass.require_source_ids(spark.createDataFrame([("",)], "source_id string")).collect()


def test_property_merge_in_order(spark):
    df = spark.createDataFrame([("k", 1, '{"a": "x"}'), ("k", 2, '{"a": "y", "b": {"c": 1}}')], "k string, ord int, p string")
    got = twopass.in_order(df, ["k"], "ord", "p").select(twopass.merge_properties("p").alias("p")).first()
    assert json.loads(got.p) == {"a": "x; y", "b": {"c": 1}}


def test_conversion(spark):
    trace = "array<struct<chunk_index:int,success:boolean,input_used:string,output:string,cot:string,cot_style:string>>"
    schema = f"ord long, conversations array<struct<from:string,value:string>>, input string, input_used array<string>, output string, cot string, success boolean, chunk_traces {trace}"
    rows = [
        (1, [("human", "<thinking>q"), ("gpt", "a"), ("tool", "t"), ("gpt", None)], None, None, None, None, None, None),
        (2, [("human", "q")], None, None, None, None, None, None),
        (3, None, "in", ["p", "", "q"], '{"a":1}', " why ", None, [(1, True, "c", "{}", "", None), (2, False, "d", "{}", "", None)]),
        (4, None, "in", None, '{"a":1}', None, False, None),
    ]
    df = spark.createDataFrame(rows, schema)
    got = {(r.ord, r.part): r.messages for r in sft.convert(df, F.lit("specific"), include_traces=True).collect()}
    assert set(got) == {(1, 0), (3, 0), (3, 1)}
    assert [(m.role, m.content) for m in got[1, 0]] == [("user", "<think>q"), ("assistant", "a")]
    assert got[3, 0][2].content == '<think>\nwhy\n</think>\n{\n  "a": 1\n}\n' and "p\n\nq" in got[3, 0][1].content
    assert {r.ord for r in sft.convert(df, F.lit("x"), traces_only=True).collect()} == {1}


def test_registry(spark):
    empty = spark.createDataFrame([], "name string, file_name string, formatting string, columns map<string,string>, tags map<string,string>")
    one = sft.upsert_registry(sft.upsert_registry(sft.upsert_registry(empty, "a", "1"), "b", "2"), "a", "3")
    assert {r.name: r.file_name for r in one.collect()} == {"a": "3", "b": "2"}


def test_mean_ties_go_to_even(spark):
    got = spark.createDataFrame([(0.12,), (0.13,)], "x double").agg(*profile.four(F.col("x"), "x")).first()
    assert got.x_mean == 0.12 and got.x_median == 0.125
    assert spark.createDataFrame([], "x double").agg(*profile.four(F.col("x"), "x")).first().x_mean is None


def test_unknown_model(spark):
    with pytest.raises(ValueError):
        profile.cases_by_models(spark.range(3), ["nope"], None, {"base"})


def test_calls_are_retried_and_shortened(spark, tmp_path):
    log = str(tmp_path / "calls")

    def flaky(prompt):
        with open(log, "a+") as f:
            f.seek(0)
            before = len(f.read().split())
            f.write(f"{len(prompt)}\n")
        if not before:
            raise TimeoutError("timed out")
        return '<thinking>t</thinking><output>{"a": 1}</output>' if len(prompt) < 1500 else '{"a": {'

    one = spark.createDataFrame([(1, "x" * 2000)], "global_idx long, text string")
    got = extract.call(one, flaky, str, extract.Settings(retries=4)).first()
    assert got.success and got.cot == "t" and got.output == '{"a": 1}' and len(got.input_used) == 1400
    with open(log) as f:
        assert f.read().split() == ["2000", "2000", "1400"]
    bad = extract.call(one, lambda p: "", str, extract.Settings(retries=1)).first()
    assert bad.error == "other[ValueError]: empty response" and not bad.success
    assert extract.call(one, lambda p: "no", str, extract.Settings(retries=2)).first().error == extract.NO_JSON
    assert extract.call(one.limit(0), str, str).collect() == []


def test_single_run_marks_what_it_skips(spark):
    df = spark.createDataFrame([(1, "short"), (2, None), (3, "Long enough " * 10)], "global_idx long, text string")
    got = {r.global_idx: r for r in extract.single(df, extract.echo_extractor, str).collect()}
    assert got[1].skip and got[2].skip and not got[1].success and got[1].error == extract.SKIPPED
    assert got[3].success and not got[3].skip and json.loads(got[3].output)["entities"][0]["name"] == "Long"
    assert extract.counters(extract.single(df, extract.echo_extractor, str)).first().asDict() == {"total": 3, "succeeded": 1, "failed": 0, "skipped": 2, "failed_chunks": 0}


def test_chunked_run_with_repair(spark):
    df = spark.createDataFrame([(1, "Ann met Bob. " * 12), (2, "  "), (3, "fails")], "global_idx long, text string")

    def model(prompt):
        if "repair" in prompt:
            return '{"entities": [{"id": "a", "label": "L", "name": "whole"}], "relations": []}'
        if "fails" in prompt:
            raise RuntimeError("429")
        return extract.echo_extractor(prompt)

    small = extract.Settings(max_chars=60, overlap=0, retries=1)
    got = {r.global_idx: r for r in extract.chunked(df, model, str, small).collect()}
    assert got[1].success and got[1].chunk_count == got[1].successful_chunks > 2 and got[2].skip
    graph_ = json.loads(got[1].output)
    assert [(e["id"], e["name"]) for e in graph_["entities"]] == [("E1", "Ann"), ("E2", "Bob")] and [(r["source"], r["target"]) for r in graph_["relations"]] == [("E1", "E2")]
    assert not got[3].success and got[3].error == extract.NO_CHUNK and got[3].failed_chunk_indexes == [1] and got[3].chunk_traces[0].error == "rate_limit[RuntimeError]: 429"
    fixed = {r.global_idx: r for r in extract.chunked(df, model, str, small, lambda text, graph, failed: f"repair {len(text)} {failed}").collect()}
    assert [e["name"] for e in json.loads(fixed[1].output)["entities"]] == ["whole"]
    kept = {r.global_idx: r for r in extract.chunked(df, model, str, small, lambda text, graph, failed: "fails").collect()}
    assert json.loads(kept[1].output) == graph_ and kept[1].success and "429" in kept[1].error


def test_graphs_of_chunks_are_merged(spark):
    a = {"entities": [1, {"id": "D1", "label": "Disease", "name": "Flu", "properties": {"p": "x"}}], "relationships": [{"source": "D1", "target": "flu", "relation": "is"}]}
    b = {"entities": [{"id": "D1", "label": "Disease", "name": " flu", "properties": {"p": "y", "q": ""}}, {"id": "S1", "label": "Symptom", "name": "Cough"}], "relations": [{"source": "S1", "target": "D1", "relation": "of"}, {"source": "S1", "target": "ghost", "relation": "of"}]}
    rows = [(1, 1, json.dumps(a)), (1, 2, json.dumps(b)), (2, 1, "{}")]
    got = {r.rec: json.loads(r.output) for r in extract.merge_graphs(spark.createDataFrame(rows, "rec long, chunk int, output string")).collect()}
    assert got[1]["entities"] == [{"id": "D1", "label": "Disease", "name": "Flu", "properties": {"p": "x | y"}}, {"id": "S1", "label": "Symptom", "name": "Cough", "properties": {}}]
    assert [(r["source"], r["target"], r["relation"]) for r in got[1]["relations"]] == [("D1", "D1", "is"), ("S1", "D1", "of")]
    assert got[2] == {"entities": [], "relations": []}


def test_sharded_run_and_its_tables(spark, tmp_path):
    df = spark.createDataFrame([(i, f"Ann{i} Bob{i} Cid{i} " + "and so on " * 6 if i % 2 else "Nobody else is here " + "x " * 30) for i in range(9)] + [(9, "x")], "global_idx long, text string")
    got = extract.sharded(df, extract.echo_extractor, str, workers=4, folder=str(tmp_path), stamp="t")
    assert sorted((r.global_idx, r.shard, r.reason) for r in got.collect()) == [(i, s, None if i % 2 else "few_entities") for i, s in zip(range(9), [1, 1, 1, 2, 2, 2, 3, 3, 4])]
    assert spark.read.parquet(f"{tmp_path}/raw_t").count() == 9 and spark.read.parquet(f"{tmp_path}/filtered_t").count() == 4


def test_split_inputs(spark):
    rows = [("s1", "c1", None, '{"x": 1}'), ("s2", None, "t2", "boom"), ("s3", "c3", "t3", "prose"), ("s4", "c4", "t4", "empty")]

    def model(prompt):
        if prompt == "boom":
            raise ConnectionError("connection lost")
        answers = {"prose": "no object", "empty": "{}"}
        return {"text": answers.get(prompt, '```json\n{"source_id": "", "title": null, "relations": [1]}\n```'), "finish_reason": "STOP", "total_token_count": 7}

    good, bad = extract.split_inputs(spark.createDataFrame(rows, "source_id string, code string, title string, body string"), model, str)
    got = {r.source_id: r for r in good.collect()}
    assert json.loads(got["s1"].record) == {"source_id": "", "title": None, "relations": [1], "code": "c1", "entities": []}
    assert json.loads(got["s4"].record) == {"source_id": "s4", "code": "c4", "title": "t4", "entities": [], "relations": []}
    assert got["s1"].diagnostics.asDict() == {"prompt_chars": 8, "finish_reason": "STOP", "prompt_token_count": None, "candidates_token_count": None, "total_token_count": 7, "thoughts_token_count": None, "cached_content_token_count": None}
    assert {r.source_id: r.error for r in bad.collect()} == {"s2": "network[ConnectionError]: connection lost", "s3": extract.NO_JSON}


def test_traces(spark):
    rows = [(1, "a", "", "", "one"), (2, "b", "", "", "two"), (3, "c", "", "", "three"), (4, "d", "", "", "four")]

    def model(prompt):
        if prompt == "four":
            raise ValueError("401")
        return {
            "one": "<think>why</think><output>{\"a\": 1}</output>",
            "two": {"parts": [{"text": "thinking aloud", "thought": True}, {"text": '{"b": 2}', "thought": False}], "finish_reason": "STOP"},
            "three": "nothing to parse",
        }[prompt]

    good, bad = extract.traces(spark.createDataFrame(rows, "global_idx long, source_id string, code string, title string, text string"), model, str, "specific")
    got = {r.global_idx: r for r in good.collect()}
    assert (got[1].cot, json.loads(got[1].output), got[1].response_had_think_tag, got[1].response_had_output_tag, got[1].response_had_thought_parts) == ("why", {"a": 1}, True, True, False)
    assert (got[2].cot, json.loads(got[2].output), got[2].response_had_thought_parts, got[2].diagnostics.finish_reason) == ("thinking aloud", {"b": 2}, True, "STOP")
    assert {r.global_idx: r.error for r in bad.collect()} == {3: extract.NO_JSON, 4: "auth[ValueError]: 401"}


def test_vertical_split_and_its_tables(spark, tmp_path):
    schema = "ord long, id string, code string, title string, classKind string, definition string, diagnosticCriteria string, narrowerTerms array<string>, longDefinition string, parent array<string>, child array<string>"
    rows = [(0, "http://x/a", "A", "ta", "k", "d", "crit", ["n"], "l", [], ["http://x/b", "?"]), (1, "http://x/b", "B", "tb", "k", None, None, None, None, ["a"], None)]
    twopass.write_split(spark.createDataFrame(rows, schema), str(tmp_path), "p")
    s = {r.source_id: r for r in spark.read.parquet(f"{tmp_path}/p.structure").collect()}
    assert "definition" not in s["http://x/a"].asDict() and [(r.reference, r.code) for r in s["http://x/a"].childResolved] == [("http://x/b", "B"), ("?", "")]
    assert [r.id for r in s["http://x/b"].parentResolved] == ["http://x/a"] and s["http://x/b"].childResolved == []
    assert spark.read.parquet(f"{tmp_path}/p.long_text").where("get(narrowerTerms, 0) = 'n'").count() == 1
    assert [(r.has_diagnosticCriteria, r.narrowerTerms_count) for r in spark.read.parquet(f"{tmp_path}/p.manifest").orderBy("source_id").collect()] == [(True, 1), (False, 0)]


def test_whole_values_come_once_in_order(spark):
    df = spark.createDataFrame([(1, 3, '{"b": 1, "a": 2}'), (1, 1, '{"a":2,"b":1}'), (1, 2, '{"a": 3}'), (1, 4, "no json"), (2, 1, "no json")], "k int, pos int, v string")
    assert {r.k: r.v for r in twopass.distinct_in_order(df, ["k"], "pos", "v").collect()} == {1: ['{"a":2,"b":1}', '{"a": 3}', "no json"], 2: ["no json"]}


def test_finish_reasons_and_failures(spark):
    calls = spark.createDataFrame([("p", 2, "STOP"), ("p", 1, None), ("q", 1, "MAX_TOKENS")], "path string, pos int, finish_reason string")
    assert {r.path: r.finish_reasons for r in batches.finish_reasons(calls).collect()} == {"p": [None, "STOP"], "q": ["MAX_TOKENS"]}
    failures = spark.createDataFrame([(2,), (None,), (3,)], "metadata_failures long")
    assert batches.failure_total(failures).first()[0] == 5 and batches.failure_total(failures.limit(0)).first()[0] == 0


def test_summary_is_one_object(spark):
    rows = spark.createDataFrame([("b", 2), ("a", 1)], "model string, n long")
    assert json.loads(profile.summary(rows, "model").first().summary) == {"a": {"n": 1}, "b": {"n": 2}}
    assert json.loads(profile.summary(rows.agg(F.sum("n").alias("n"))).first().summary) == {"n": 3}


def test_resume_and_window(spark):
    records = spark.range(5).withColumnRenamed("id", "global_idx")
    done = spark.createDataFrame([(1, True), (2, False)], "global_idx long, success boolean")
    assert sorted(r.global_idx for r in extract.resume(records, done).collect()) == [0, 2, 3, 4]
    assert extract.window(records, "global_idx", 1, 0).count() == 0 and extract.window(records, "global_idx", 1, 0, True).count() == 4


def test_indexes_are_contiguous(spark):
    df = spark.createDataFrame([(f"k{i % 3}", i) for i in range(50)], "k string, o int")
    got = batches.with_index(df, "k", "o", offset=7).orderBy("k", "o").collect()
    assert [r.global_idx for r in got] == list(range(7, 57))
    assert batches.with_index(df.limit(0), "k").collect() == []
