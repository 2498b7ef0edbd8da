"""The pipeline against a plain version of its stages, and odd rows through all."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphloom.llm import pii, quality, simhash

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def shingles(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = {r.doc_id: r.text for r in docs.collect()}
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = sorted(i for i, t in rows.items() if model.score(np.array([quality.statistics(t.encode())]))[0] >= 0.5)
    # near copies: a chain of pairs whose five-word shingles have a Jaccard similarity of 0.8
    sets = {i: shingles(rows[i]) for i in good}
    root = {i: i for i in good}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(good):
        for j in good[:n]:
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    kept = [i for i in good if top(i) == i and not any(b in rows[i] for b in bench)]
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in pipeline.run(spark, SF).collect()}
    assert sorted(got) == kept
    for i, r in got.items():
        assert hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest() == r.ids_sha256
        if not pii.base_spans(rows[i]) and "token" not in rows[i]:
            assert r.ids == own.encode(rows[i], add_special_tokens=False).ids
        else:
            assert not pii.base_spans(own.decode(r.ids))


def test_near_copies_at_the_threshold(spark):
    rng = np.random.default_rng(0)
    words = [f"word{n}" for n in rng.integers(0, 5000, 600)]
    near, far = list(words), list(words)
    for p in range(0, 600, 60):
        near[p] = f"other{p}"
    for p in range(0, 600, 7):
        far[p] = f"other{p}"
    rows = [(5, " ".join(words)), (3, " ".join(near)), (9, " ".join(far)), (8, " ".join(words)), (8, " ".join(words)), (None, " ".join(words)), (20, None), (21, ""), (22, "a b"), (23, "A b"), (30, "x " * 9000), (None, "alone here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("key", F.lit("clash")).withColumn("kept", F.lit(False))
    j = len(shingles(rows[0][1]) & shingles(rows[1][1])) / len(shingles(rows[0][1]) | shingles(rows[1][1]))
    assert j > 0.8
    got = simhash.without_near_copies(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == [(False, 3), (False, 9), (False, 20), (False, 22), (False, 30), (True, 0)]
    assert simhash.without_near_copies(df.limit(0)).collect() == []


def test_a_large_class_is_split_and_stays_one(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 10)
    base = [f"term{i}" for i in range(300)]
    rows = []
    for n in range(60):
        words = list(base)
        words[n * 5] = f"edit{n}"
        rows.append((n, " ".join(words)))
    got = simhash.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.doc_id for r in got] == [0]


def test_odd_rows_through_every_stage(spark):
    rows = [(1, None, "en", "s", None), (2, "", None, None, 0), (None, "text of a row without an id", "en", "s", 27), (4, "plain words here " * 3000, "en", "s", 51000), (4, "plain words here " * 3000, "en", "s", 51000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("id", F.lit(0)).withColumn("score", F.lit(0))
    for name, stage in pipeline.STAGES:
        for df in (docs, docs.limit(0)):
            out = stage(spark, df, SF)
            assert out.count() <= df.count()
            if name != pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns


def test_near_copies_are_those_of_brute_force_jaccard(spark):
    """A family of revised texts on both sides of 0.8: bits alone lose some pairs
    at 0.8 and link some below it."""
    rng = np.random.default_rng(5)
    rows, n = [], 0
    for family in range(60):
        base = [f"w{x}" for x in rng.integers(0, 3000, int(rng.integers(40, 300)))]
        for share in (0, 0.005, 0.01, 0.015, 0.02, 0.025, 0.03, 0.05):
            words = [f"e{rng.integers(10**6)}" if rng.random() < share * 1.5 else w for w in base]
            rows.append((n, " ".join(words) + f" tail{family}" * (family % 3) * 40))
            n += 1
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in range(i // 8 * 8, i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    got = simhash.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == [i for i in sets if top(i) == i]


def test_near_copies_of_the_table_are_those_of_brute_force_jaccard(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    assert sorted(r.doc_id for r in simhash.without_near_copies(docs).collect()) == sorted(i for i in sets if top(i) == i)
