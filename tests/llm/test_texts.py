"""Operators on documents against plain versions, odd rows included."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import accumulate

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphloom.llm import bpe, media, pii, quality, simhash, suffixes
from graphloom.llm.common import connected_components

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a", "\n\n", "é" * 30, "word " * 4000, "x" * 70000, "a b c", "A B  C", "The same text twice. " * 5, "The same text twice. " * 5]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts with a repeated row, a shared id, null ids, and columns whose names clash."""
    rows = [(i, x) for i, x in enumerate(ODD)] + [(10, ODD[10]), (3, "another text under an id that is taken"), (None, "The same text twice. " * 5), (None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("score", F.lit(1)).withColumn("node", F.lit(0)).withColumn("part", F.lit(0))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(df):
    return [(r.doc_id, (r.text or "").encode()) for r in df.select("doc_id", "text").collect()]


def removed(rows, length=50):
    """Brute force of the removal of repeats."""
    key = lambda i: (i is None, i or 0)
    first = {}
    for i, b in rows:
        for p in range(len(b) - length + 1):
            k = b[p : p + length]
            first[k] = min(first.get(k, key(i)), key(i))
    for i, b in rows:
        cover = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < key(i):
                cover[p : p + length] = b"\1" * length
        kept = bytes(x for x, c in zip(b, cover) if not c)
        yield i, len(b), sum(cover), len([r for r in bytes(cover).split(b"\0") if r]), hashlib.sha256(kept).hexdigest()


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def test_repeats(spark, docs, odd):
    for df in (docs, odd):
        got = suffixes.remove_repeats(df, with_text=False)
        assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        assert ordered(got.collect()) == ordered(removed(texts(df)))
    assert suffixes.remove_repeats(odd.limit(0)).collect() == []


def test_repeats_in_many_batches(spark, docs):
    got = suffixes.remove_repeats(docs.repartition(13, "doc_id")).collect()
    assert ordered((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == ordered(removed(texts(docs)))
    for r, b in ((r, dict(texts(docs))[r.doc_id]) for r in got if r.n_spans):
        left = b"".join(b[s:e] for s, e in zip([0, *(x.end for x in r.spans)], [*(x.start for x in r.spans), len(b)]))
        assert left == bytes(r.kept) and sum(x.end - x.start for x in r.spans) == r.n_removed


@given(st.lists(st.text(alphabet="ab", min_size=40, max_size=140), min_size=1, max_size=6))
@settings(max_examples=40, deadline=None)
def test_windows_are_sorted_into_classes(pieces):
    data = [p.encode() for p in pieces if len(p) >= suffixes.LENGTH]
    if not data:
        return
    least = np.arange(len(data), dtype=np.int64)
    got = suffixes.smallest_documents(data, least)
    for p, answer in zip(data, got):
        for i, x in enumerate(answer):
            w = p[i : i + 50]
            assert x == min(j for j, q in enumerate(data) if w in q)


def test_suffix_order_is_lexicographic():
    rng = np.random.default_rng(3)
    text = rng.integers(97, 99, 4000).astype(np.uint8)
    text[1000:1600] = text[:600]
    at = np.arange(len(text) - 50)
    order, new = suffixes.window_classes(text, at)
    windows = [text[p : p + 50].tobytes() for p in order]
    assert windows == sorted(windows) and [a != b for a, b in zip(windows, windows[1:])] == new[1:].tolist()


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_bpe_equals_the_library(spark, docs, odd, reference):
    extra = spark.createDataFrame([(900, "<|endoftext|>a <|endoftext|><|endoftext|> \n  b\t\n"), (901, "it's  we'll x 12345 ½ 漢字 😀 \r\n \n x"), (902, "ababababababab aaaaaaa")], "doc_id long, text string")
    for df in (docs, odd, extra):
        rows = {(r.doc_id, r.ids_sha256): r for r in bpe.encode(df, public_tokenizers.path("byte_bpe_50k.json"), with_text=True).collect()}
        for i, b in texts(df):
            ids = reference.encode(b.decode(), add_special_tokens=False).ids
            r = rows[i, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()]
            decoded = reference.decode(ids, skip_special_tokens=False)
            assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == decoded and r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.encode(odd, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False).count() == odd.count()
    assert bpe.encode(odd.limit(0), public_tokenizers.path("byte_bpe_50k.json")).collect() == []


@given(st.text(alphabet=st.sampled_from("ab c1'\n\t sé.,!漢"), max_size=40))
@settings(max_examples=300, deadline=None)
def test_bpe_on_random_texts(reference, text):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        own = bpe.loaded(f.read())
    (ids,) = own.encode_all([text])
    assert ids.tolist() == reference.encode(text, add_special_tokens=False).ids and own.decode(ids) == text


def test_bpe_on_every_code_point(reference):
    """Letters, numbers and spaces are those of the library's Unicode version."""
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        own = bpe.loaded(f.read())
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    for low in range(0, len(points), 4096):
        text = "\n".join(x for c in points[low : low + 4096] for x in ((c + "'s", " " + c, c + c, c + "!", "1" + c) if low < 0x10000 else (c + "!", "a" + c + "1")))
        ends = [o[1] for _, o in reference.pre_tokenizer.pre_tokenize_str(text)]
        assert list(accumulate(map(len, own.words(text)))) == ends, hex(low)
    for low in [*range(0, 0x3000, 4096), *range(0x10000, 0x1F000, 0x5000)]:
        text = " ".join(points[low : low + 4096])
        (ids,) = own.encode_all([text])
        assert ids.tolist() == reference.encode(text, add_special_tokens=False).ids, hex(low)
    own.forget()


def test_bpe_in_small_steps(spark, docs, reference, monkeypatch):
    """Bounds of memory change no id."""
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        own = bpe.PairIndexBpe(f.read())
    monkeypatch.setattr(bpe, "MERGED", 7)
    monkeypatch.setattr(bpe, "KEPT_BYTES", 3000)
    monkeypatch.setattr(bpe, "FRESH", 40)
    monkeypatch.setattr(bpe, "LISTED", 1)
    rows = [b.decode() for _, b in texts(docs)][:60] + ["", "a  b", "x" * 3000]
    got = list(own.encode_all(rows, budget=500))
    assert [g.tolist() for g in got] == [e.ids for e in reference.encode_batch(rows, add_special_tokens=False)]


def test_quality_scores(spark, odd):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    model = quality.train(docs, labels)
    rows = quality.score(docs, model).join(labels.withColumnRenamed("doc_id", "d"), F.col("doc_id") == F.col("d")).collect()
    out = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.predicted == r.quality for r in out) / len(out) > 0.95
    got = quality.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert quality.keep_good(odd, model).columns == odd.columns


def test_quality_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score(docs.limit(5), quality.train(docs, none)).collect()} == {0.5}
    nulls = spark.createDataFrame([(None, 1), (2, None)], none.schema)
    assert quality.train(docs, nulls).score(np.zeros((1, len(quality.STATISTICS))))[0] == 0.5


def test_held_out_rows_teach_nothing(spark):
    docs = spark.createDataFrame([(i, "good text here" if i % 2 else "%%% ### $$$") for i in range(300)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.score(docs, quality.train(docs, x)).orderBy("doc_id").collect() for x in (labels, flipped))
    assert a == b


def test_media_round_trip(spark, docs, odd):
    for df in (docs, odd):
        rows = media.store_texts(df).collect()
        assert len(rows) == df.count()
        known = defaultdict(set)
        for i, b in texts(df):
            p = b + b" " * (max(1, -(-len(b) // 192)) * 192 - len(b))
            known[i].add((len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
        for r in rows:
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) in known[r.doc_id]
            assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest() and re.fullmatch("[0-9a-f]{16}", r.feature)


def test_media_formats(spark):
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (7, 5, 3)).astype(np.uint8)
    assert (media.decode(media.encode_ppm(image)) == image).all() and (media.decode(media.encode_bmp(image)) == image).all()
    assert media.decode(b"P1 # c\n2 2\n1 0\n0 1").ravel().tolist() == [0, 255, 255, 0]
    assert media.decode(b"P4\n3 1\n\xa0").ravel().tolist() == [0, 255, 0]
    assert media.decode(b"P2\n2 1\n255\n7 200").ravel().tolist() == [7, 200] and media.decode(b"P5 1 1 65535\n\x01\x02").ravel().tolist() == [258]
    assert media.decode(b"P3 1 1 255 1 2 3").ravel().tolist() == [1, 2, 3]
    small = media.area_resize(image.astype(float), 3, 2)
    assert np.isclose(small.sum() / 6, image.mean(axis=(0, 1)).sum()) and np.isclose(media.area_resize(image, 7, 5), image).all()
    files = spark.createDataFrame([(1, media.encode_bmp(image)), (2, None), (3, b"P6 9"), (4, b"GIF")], "k int, f binary")
    rows = media.tiles(files, "k", "f", 4).collect()
    good = [r for r in rows if r.id == 1]
    assert [(r.height, r.width) for r in good] == [(4, 4), (4, 1), (3, 4), (3, 1)] and {r.id for r in rows if r.error} == {2, 3, 4}
    assert media.tiles(files.limit(0), "k", "f").collect() == []


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_classes(spark, docs, odd):
    near = spark.createDataFrame([(1000 + i, "one two three four five " * 20 + w) for i, w in enumerate(["six", "six", "seven", "Six", ""])], "doc_id long, text string")
    for df in (docs.select("doc_id", "text").union(near), odd):
        rows = texts(df)
        prints = [(i, plain_fingerprint(b.decode())) for i, b in rows]
        ids = sorted({i for i, _ in prints if i is not None})
        root = {i: i for i in ids}

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        known = [(i, p) for i, p in prints if i is not None]
        for n, (i, p) in enumerate(known):
            for j, q in known[:n]:
                if (p ^ q).bit_count() <= 2 or i == j:
                    a, b = sorted((top(i), top(j)))
                    root[b] = a
        want = [(i, f"{p:016x}", top(i) if i is not None else min((top(j) for j, q in known if q == p), default=None)) for i, p in prints]
        assert ordered(simhash.near_duplicates(df).collect()) == ordered(want)
    assert simhash.near_duplicates(odd.limit(0)).collect() == []


@given(st.lists(st.integers(0, 255), unique=True, max_size=40), st.integers(0, 3))
@settings(max_examples=100, deadline=None)
def test_trees_find_all_neighbours(values, radius):
    tree = simhash.BkTree()
    for v in values:
        tree.add(v)
    for w in (0, 7, 255):
        assert sorted(tree.value[n] for n in tree.search(w, radius)) == sorted(v for v in values if (v ^ w).bit_count() <= radius)


def test_shards_meet_every_close_pair():
    rng = random.Random(2)
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        assert any((a & m & (2**64 - 1)) == (b & m & (2**64 - 1)) for m in simhash.MASKS)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 50), (60, 100), (7, 7), (3, 2)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got.get(i, i) for i in range(1, 41)} == {1} and got[100] == got[60] == 50
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def plain_spans(text):
    out = []
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


@given(st.text(alphabet="0123456789.-+ ()@ab%_é4", max_size=50))
@settings(max_examples=500, deadline=None)
def test_base_spans(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_pii_report(spark, docs, odd):
    for df in (docs, odd):
        want = defaultdict(list)
        for i, b in texts(df):
            s = plain_spans(b.decode())
            joined = ",".join(f"{k}:{a}:{e}" for k, a, e in s)
            want[i].append(([sum(k == x for k, _, _ in s) for x in pii.KINDS], hashlib.sha256(joined.encode()).hexdigest(), joined))
        rows = pii.report(df).collect()
        assert len(rows) == df.count()
        for r in rows:
            assert any([r.n_email, r.n_ip, r.n_card, r.n_phone] == c and r.base_sha256 == h and r.spans.startswith(j) for c, h, j in want[r.doc_id])
    assert pii.report(odd.limit(0)).collect() == []


def test_bootstrapping_finds_unseen_identifiers(spark):
    good = [c for c in (str(4539578763621000 + n) for n in range(1, 400)) if pii.luhn(c)][:15]
    bad = str(int(good[0]) + 1)
    rows = [(100 + i, f"pay with card {c} today") for i, c in enumerate(good)] + [(10, f"pay with card {bad} today"), (11, "in 2024 we met, version 3.14"), (12, 'password=1f3d5b7a9c please, token = "aa11bb22cc33dd44"')]
    found = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[10] == "id:14:30" and found[11] == "" and found[12] == "id:9:19,id:37:53"


def test_planted_kinds_are_found(spark):
    """Recall of what the fixed patterns do not know: secrets of any form after a cue,
    and identifiers that only their contexts give away."""
    rng = random.Random(6)
    good = [c for c in (str(4539578763621000 + n) for n in range(1, 800)) if pii.luhn(c)][:30]
    rows = [(i, f"The account number is {c} as agreed") for i, c in enumerate(good)]
    planted = {}
    for n in range(60):
        secret = ["correcthorse", "Hunter2", f"k{rng.getrandbits(40):x}", "pässwörter"][n % 4]
        planted[1000 + n] = [f"login with password={secret} please", f"my secret: {secret}, he said"][n % 4 in (1, 2)], secret
        if n < 10:  # one in four of the context's strings is no base span
            bad = str(int(good[n]) + 1)
            planted[2000 + n] = f"The account number is {bad} as agreed", bad
    rows += [(i, text) for i, (text, _) in planted.items()] + [(i, f"In {1900 + i % 100} there were {i} of them, version 2.{i}.") for i in range(3000, 3060)] + [(4000, "the secret: nobody knows"), (4001, "IBAN DE89 3704 0044 0532 0130 00 here")]
    found = {r.doc_id: [x.split(":") for x in r.spans.split(",") if x] for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hit = [i for i, (text, secret) in planted.items() if any(text[int(s) : int(e)] == secret for _, s, e in found[i])]
    assert len(hit) >= 0.9 * len(planted)
    assert not any(found[i] for i in range(3000, 3060))
    text = rows[-1][1]
    assert [text[s:e] for s, e, _ in pii.instances(text, [])] == ["DE89 3704 0044 0532 0130 00"]


def test_redaction(spark):
    df = spark.createDataFrame([(1, "mail a.b@c.de or +1 (555) 123-4567.", "x"), (2, None, "y"), (3, "nothing", "z"), (1, "mail a.b@c.de or +1 (555) 123-4567.", "x")], "doc_id long, text string, start string")
    got = pii.redact(df)
    assert got.columns == df.columns and sorted(r.text or "" for r in got.collect()) == ["", "mail <EMAIL> or <PHONE>.", "mail <EMAIL> or <PHONE>.", "nothing"]
