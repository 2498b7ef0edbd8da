"""Pages, archives, benchmarks and conversations."""

import base64
import hashlib
import json
import re
from collections import defaultdict
from html import unescape

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import chat, decontaminate, html, warc

SF = "/root/testdata/sf0.001"


def article(page):
    inner = page[page.index("<article>") + 9 : page.index("</article>")]
    blocks = (" ".join(unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:h1|p)>", inner))
    return "\n".join(b for b in blocks if b)


def test_main_text_of_the_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in html.extract(pages).collect()}
    assert len(got) == pages.count()
    for p in pages.collect():
        assert got[p.page_id].text == article(p.html) and got[p.page_id].n_chars == len(got[p.page_id].text) and got[p.page_id].url == p.url


PAGE = """<html><head><title>t</title><style>x</style></head><body class="home"><header><h2>Site</h2></header><nav>menu</nav>
<div class="cookie-notice">We use cookies</div><main><h1>Big &amp; small</h1><p>First   para&shy;.<br>More <b>bold</b> text</p><div class="ad">buy</div>
<ul><li>one<li>two</ul><form><p>search</p></form><section id="comments"><p>nice!</p></section></main><aside>side</aside><script>if (a<b) "</p>"</script><footer>&copy;</footer></body></html>"""


def test_noise_goes(spark):
    rows = [(1, "http://h/a", PAGE), (2, "http://h/b", PAGE.replace("First", "Other")), (3, None, None), (4, "http://h/c", ""), (5, "no url", "just text < 5 &lt;"), (None, "http://H:80/a", PAGE), (1, "http://h/a", PAGE)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("labels", F.lit("x")).withColumn("text", F.lit("y"))
    got = defaultdict(list)
    for r in html.extract(df).collect():
        got[r.page_id].append(r.text)
    want = "Big & small\nFirst para\xad. More bold text\none\ntwo"
    assert got[1] == [want, want] and got[None] == [want] and got[3] == [""] and got[4] == [""] and got[5] == ["just text < 5 <"]
    assert html.extract(df.limit(0)).collect() == []


def test_page_without_article_is_read_by_mass(spark):
    body = "<html><body><div class='top'>Shop</div><div id='wrap'><div class='story'><p>{}</p><p>{}</p></div></div><div class='x'>{}</div></body></html>"
    rows = [(i, "http://s/", body.format(f"sentence {i} " * 20, f"more {i} " * 30, "Shop info")) for i in range(5)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()
    assert got[2].text == "\n".join(" ".join(x.split()) for x in ("sentence 2 " * 20, "more 2 " * 30))


def plain_slots(spark, template, n=6, host="http://t/"):
    rows = [(i, host, template.format(i=i, text=f"open sentence number {i} " * 5)) for i in range(n)]
    return {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_template_text_inside_articles_goes_by_the_wrapper(spark):
    """Nothing but the host's other pages tells the box and the licence line from text."""
    page = "<body><article><h1>Title {i}</h1><div class='hinweis'>Always the same words</div><p>{text}</p><section><p>Licence: as is.</p></section></article></body>"
    want = {i: f"Title {i}\n" + " ".join((f"open sentence number {i} " * 5).split()) for i in range(6)}
    assert plain_slots(spark, page) == want
    alone = plain_slots(spark, page, 1)
    assert alone[0] == "Title 0\nAlways the same words\n" + want[0].split("\n")[1] + "\nLicence: as is."


def test_copies_of_a_page_are_no_template(spark):
    page = "<article><h1>T</h1><div class='x'><p>same text</p></div></article>"
    rows = [(i, "http://c/", page) for i in range(9)] + [(9, "http://c/", "<article><h1>Other</h1><p>text</p></article>")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {"T\nsame text", "Other\ntext"}


def test_words_of_slugs_and_paragraphs_are_no_noise(spark):
    page = "<article><h1>T</h1><h2 id='related-work'>Related work</h2><p class='notice-text'>Body one.</p><section class='social history'><p>Social history of X</p></section><p>x <math><mi>y</mi></math> z</p><p><object>Fall back</object></p><svg><text>drawn</text></svg><div class='ad-banner'>buy</div><div class='cookie-notice box'>ok?</div><section id='comments'>nice</section><div class='share'>share</div></article>"
    got = html.extract(spark.createDataFrame([(1, "http://x/", page)], "page_id long, url string, html string")).first().text
    assert got == "T\nRelated work\nBody one.\nSocial history of X\nx y z\nFall back\ndrawn"


def test_long_footers_without_an_article(spark):
    foot = "All rights reserved by the makers of this site. " * 7
    assert len(foot) > 325
    page = "<body><div class='story'><p>{text}</p></div><div class='x'>" + foot + "</div></body>"
    assert plain_slots(spark, page) == {i: " ".join((f"open sentence number {i} " * 5).split()) for i in range(6)}


def test_a_very_long_page(spark):
    page = "<article>" + "".join(f"<p>paragraph {i}</p>" for i in range(20000)) + "</article>"
    got = html.extract(spark.createDataFrame([(1, "http://x/", page)], "page_id long, url string, html string")).first().text
    assert got == "\n".join(f"paragraph {i}" for i in range(20000))


def test_wrapper_is_union_free():
    a = html.stream_of("<ul><li>a</li><li>b</li><li>c</li></ul><p>Same</p>")
    b = html.stream_of("<ul><li>x</li></ul><hr><i>note</i><p>Same</p>")
    assert html.expression(a) == "<ul>(<li>#</li>)+</ul><p>Same</p>"
    both = html.expression(html.align(a, b))
    assert both.endswith("<p>Same</p>") and ")?" in both and "|" not in both


def test_archives(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    odd = spark.createDataFrame([(-5, "u", "dup"), (900, "u\r\n v", "dup"), (900, "u", "dup"), (901, None, None), (902, "u", ""), (None, "u", "dup"), (None, "u", "lonely"), (903, "u", "WARC/1.1\r\n\r\n" * 3 + "é")], pages.schema)
    df = pages.union(odd).withColumn("hash", F.lit(1)).withColumn("first", F.lit("z"))
    least = {}
    for p in df.collect():
        if p.page_id is not None:
            least[p.html or ""] = min(least.get(p.html or "", p.page_id), p.page_id)
    want = []
    for p in df.collect():
        data, first = (p.html or "").encode(), least.get(p.html or "")
        again = first is not None and p.page_id != first
        want.append((p.page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first if again else None))
    got = [tuple(r) for r in warc.round_trip(df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert warc.round_trip(df.limit(0)).collect() == []
    assert {r.record_type for r in warc.round_trip(odd, least_bytes=10**6).collect()} == {"response"}


def test_normaliser():
    records = [warc.make_record(str(i), f"http://x/{i}", b"\r\n\r\nWARC/1.1 " * i * 50, None, False) for i in range(40)]
    monoliths = list(warc.monoliths(records, limit=20_000))
    assert len(monoliths) > 3
    out = []
    for m in monoliths:
        data, sidecar = warc.normalise(m)
        entries = [json.loads(x) for x in sidecar.split("\n")]
        assert [e["offset"] for e in entries] == list(np.cumsum([0, *(e["length"] for e in entries)])[:-1])
        out += [warc.read_member(data, e["offset"], e["length"])[0]["x-page-id"] for e in entries]
        assert warc.normalise(data) == (data, sidecar)  # members stay as they are
    assert out == [str(i) for i in range(40)]
    for bad in (monoliths[0][:-20], warc.gzip_member(b"junk\r\n\r\n"), warc.gzip_member(records[1][:-30])):
        try:
            warc.normalise(bad)
            raise AssertionError("a damaged archive was read")
        except ValueError:
            pass


def test_export(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    warc.export_files(warc.write_archives(pages), f"file://{tmp_path}")
    files = sorted(tmp_path.iterdir())
    assert {f.suffix for f in files} == {".gz", ".idx"}
    assert sum(len(f.read_text().split("\n")) for f in files if f.suffix == ".idx") == pages.count()


def test_leaks_of_the_table(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "benchmark"))
    want = {(d.doc_id, b.item_id) for b in bench.collect() for d in docs.collect() if b.text in d.text}
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    assert want and got == want
    kept = decontaminate.without_leaks(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - len({d for d, _ in want})


def test_reworded_leaks(spark):
    item = "The harbour master counted seven grey ships before the storm closed the northern gate. Which gate closed first? The northern gate."
    words = item.split()
    reworded = " ".join(w for i, w in enumerate(words) if i not in (3, 9))
    filler = " ".join(f"filler{i} text{i * 7 % 13}" for i in range(60))
    rows = [(1, f"{filler} {item} {filler}"), (2, f"{filler} {reworded} {filler}"), (3, filler), (4, " ".join(reversed(words)) + filler), (5, None), (6, ""), (None, item), (1, f"{filler} {item}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash")).withColumn("bucket", F.lit(1))
    bench = spark.createDataFrame([(7, item), (8, None), (9, "too short"), (7, item)], "item_id long, text string").withColumn("block", F.lit(3))
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == {(1, 7), (2, 7), (None, 7)}
    assert sorted(r.doc_id for r in decontaminate.without_leaks(docs, bench).collect()) == [3, 4, 5, 6]
    assert decontaminate.leaks(docs, bench.limit(0)).collect() == [] and decontaminate.leaks(docs.limit(0), bench).collect() == []


def test_long_items_are_judged_in_parts(spark):
    words = [f"w{i}x{i * i % 97}" for i in range(200)]
    docs = spark.createDataFrame([(1, " ".join(words[70:126])), (2, "else " * 50)], "doc_id long, text string")
    bench = spark.createDataFrame([("a", " ".join(words))], "item_id string, text string")
    assert [r.doc_id for r in decontaminate.leaks(docs, bench).collect()] == [1]


def test_short_and_equal_items(spark):
    rows = [(1, "We saw four grey ships. Then rain."), (2, "four ships grey sailed"), (3, "four, GREY ships"), (4, "四隻灰色的船 " * 3), (5, "x"), (6, "four grey"), (7, "word " * 30000 + "four grey ships")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, "four grey ships"), (2, "Four grey ships"), (2, "Four grey ships"), (3, "four grey ships"), (4, "..."), (None, "rain"), (6, "saw four grey ships")], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()), key=repr)
    assert got == sorted([(d, i) for d in (1, 3, 7) for i in (1, 2, 3)] + [(1, None), (1, 6)], key=repr)


def test_rewordings_at_a_fifth(spark):
    """At least nine in ten of the table's items are found after a fifth of their words
    was deleted, replaced or swapped with its neighbour, and no others."""
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "benchmark"))
    rng = np.random.default_rng(11)
    items = [(r.item_id, r.text) for r in bench.collect()]
    planted = {d for d, _ in {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}}
    clean = [r.text.split() for r in docs.collect() if r.doc_id not in planted and len(r.text.split()) > 60][: len(items)]

    def swapped(words):
        out, i = list(words), 0
        while i + 1 < len(out):
            if rng.random() < 0.2:
                out[i], out[i + 1] = out[i + 1], out[i]
                i += 1
            i += 1
        return out

    changes = [lambda w: [x for x in w if rng.random() >= 0.2], lambda w: [x if rng.random() >= 0.2 else str(rng.choice(clean[0])) for x in w], swapped]
    for change in changes:
        rows = [(i, " ".join([*c[:30], *change(text.split()), *c[30:]])) for (i, text), c in zip(items, clean)]
        got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select("doc_id", "text").where("false")), bench).collect()}
        assert all(d == i for d, i in got) and len(got) >= 0.9 * len(rows)


def test_stretches_in_any_order():
    rng = np.random.default_rng(4)
    for _ in range(100):
        x, y = rng.integers(0, 6, 30).astype(np.uint64), rng.integers(0, 6, 8).astype(np.uint64)
        most = max(sum(min(list(x[i : i + 10]).count(w), list(y).count(w)) for w in set(y.tolist())) for i in range(30))
        assert decontaminate.shuffled(x, y) == most / 8


def test_svd_and_subsequences():
    rng = np.random.default_rng(0)
    a = rng.standard_normal((30, 4)) @ rng.standard_normal((4, 50))
    v = decontaminate.randomised_svd(a, 4)
    assert np.allclose(a @ v @ v.T, a, atol=1e-4)
    for _ in range(50):
        x, y = rng.integers(0, 4, 12).astype(np.uint64), rng.integers(0, 4, 9).astype(np.uint64)
        table = np.zeros((13, 10), int)
        for i in range(12):
            for j in range(9):
                table[i + 1, j + 1] = table[i, j] + 1 if x[i] == y[j] else max(table[i, j + 1], table[i + 1, j])
        assert decontaminate.common_words(x, decontaminate.masks_of(y), 9) == table[12, 9]


def test_words_are_hashed_alike():
    codes, at = decontaminate.word_codes(["Été one", "", "one, two", "éTÉ"])
    assert np.diff(at).tolist() == [2, 0, 2, 1] and codes[1] == codes[2] and codes[0] == codes[4] and len(set(codes.tolist())) == 3


def test_quotes_are_linked(spark):
    rows = [
        (1, 0, "User", "Hello there, my friend.\nHow are you?"),
        (1, 1, "assistant", "Ann wrote:\n> How are you?\nFine, thanks."),
        (1, 2, "user", "unrelated"),
        (1, 3, "user", "> > How are you?\n> fine thanks!\nGood to hear."),
        (1, 4, None, "> unrelated\nyes"),
        (1, None, "system", None),
        (None, 0, "user", "> never said\nx"),
        (2, 0, "user", "> How are you?\nother conversation"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash")).withColumn("lines", F.lit(0))
    got = {r.conv_id: r for r in chat.conversations(df).collect()}
    one = got[1]
    assert one.turns == [None, 0, 1, 3, 2, 4] and one.parents == [None, None, 0, 1, None, 2]
    assert (one.n_messages, one.n_quotes, one.n_linked, one.depth) == (6, 4, 3, 2)
    assert ">" not in re.sub(r"<\|\w*\|>", "", one.chat) and "wrote" not in one.chat and "<||>\nyes\n<|end|>" in one.chat
    assert got[2].n_linked == 0 and got[None].chat == "<|user|>\nx\n<|end|>\n"
    assert chat.conversations(df.limit(0)).collect() == []


def test_passages_are_linked_whatever_their_lines(spark):
    long = "We should move the meeting to Thursday because the room is taken on Tuesday. The agenda stays as it was last week."
    wrapped = "> We should move the meeting\n> to Thursday because the room\n> is taken on Tuesday."
    rows = [
        (1, 0, "user", long),
        (1, 1, "bot", wrapped + "\nFine with me, see you all then on Thursday."),
        (1, 2, "user", "something else entirely that nobody ever quotes"),
        (1, 3, "user", "> > agenda stays as it was\n> see you all then on Thursday\nGreat."),
        (1, 4, "user", "> > > The agenda stays as it was last week.\n> never written by anyone here at all\nHm."),
        (1, 4, "user", "> > > The agenda stays as it was last week.\n> never written by anyone here at all\nHm."),
        (1, 5, "user", "Zed " + "x" * 300 + " wrote:\n> Great.\nok"),
    ]
    one = chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert dict(zip(one.turns, one.parents)) == {0: None, 1: 0, 2: None, 3: 1, 4: 0, 5: 3}
    assert one.n_quotes == 8 and one.n_passages == 6 and "wrote" not in one.chat


def test_links_are_those_of_brute_force(spark):
    """Random quoting: the latest earlier message with most of a passage's hashes."""
    rng = np.random.default_rng(9)
    vocabulary = [f"v{i}" for i in range(12)]
    rows, bodies, want = [], {}, {}
    for c in range(4):
        for t in range(80):
            body = " ".join(rng.choice(vocabulary, int(rng.integers(1, 12))))
            text = body
            if t and rng.random() < 0.6:
                o = int(rng.integers(0, t))
                w = bodies[c, o].split()
                s = int(rng.integers(0, len(w)))
                passage = " ".join(w[s:])
                text = "\n".join("> " + x for x in passage.split(" ", 1)) + "\n" + body
                asked = chat.runs(passage.replace(" ", "\n", 1)) or chat.units(passage.replace(" ", "\n", 1))
                latest = [max((p for p in range(t) if h in chat.runs(bodies[c, p]) | chat.units(bodies[c, p])), default=None) for h in asked]
                latest = [x for x in latest if x is not None]
                if latest:
                    want[c, t] = max(set(latest), key=lambda x: (latest.count(x), x))
            bodies[c, t] = body
            rows.append((c, t, "user", text))
    got = chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r.conv_id, t): p for r in got for t, p in zip(r.turns, r.parents) if p is not None} == want and len(want) > 50


def test_long_conversations_come_in_parts(spark):
    df = spark.range(25).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("> message "), (F.col("id") - 1).cast("string"), F.lit("\nmessage "), F.col("id").cast("string")).alias("text"))
    rows = chat.conversations(df, part=10).orderBy("part").collect()
    assert [r.n_messages for r in rows] == [10, 10, 5] and sum(r.n_linked for r in rows) == 24


def test_quoted_lines_that_many_share(spark):
    df = spark.range(400).select((F.col("id") % 2).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.lit("> same line\nsame line").alias("text"))
    rows = chat.conversations(df).collect()
    assert all(r.parents == [None, *r.turns[:-1]] for r in rows)


def test_plain_conversations(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = chat.conversations(df).collect()
    want = defaultdict(list)
    for r in df.orderBy("conv_id", "turn").collect():
        want[r.conv_id].append(f"<|{r.role}|>\n{r.text}\n<|end|>\n")
    assert {r.conv_id: r.chat for r in rows} == {k: "".join(v) for k, v in want.items()}


def test_parts_one_after_another_are_the_whole_conversation(spark):
    rows = [(c, t * 1000, "user", f"> line {t - 20} of {c}\nline {t} of {c}" if t % 3 == 0 else f"line {t} of {c}") for c in (1, 2, None) for t in range(60)]
    rows += [(1, None, "user", f"no turn {n % 9}") for n in range(30)] + [(1, 5000, "bot", f"again {n % 7}") for n in range(30)] + [(3, 0, "user", "short")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = {r.conv_id: r for r in chat.conversations(df, part=1000).collect()}
    parts = defaultdict(list)
    for r in chat.conversations(df, part=8).orderBy("part").collect():
        parts[r.conv_id].append(r)
    assert set(parts) == set(whole) and any(p is not None and t < 40_000 for t, p in zip(whole[2].turns, whole[2].parents))
    for c, found in parts.items():
        assert [r.part for r in found] == list(range(len(found))) and all(r.n_messages == 8 for r in found[:-1])
        assert "".join(r.chat for r in found) == whole[c].chat
        assert [t for r in found for t in r.turns] == whole[c].turns and [p for r in found for p in r.parents] == whole[c].parents
        assert sum(r.n_linked for r in found) == whole[c].n_linked


def test_a_host_that_mixes_templates(spark):
    plain = "<html><body><div class='top'>Shop</div><div class='content'><p>{}</p></div></body></html>"
    marked = "<html><body><div class='content'><p>Shop {}</p></div><article><p>{}</p></article></body></html>"
    rows = [(i, url, (marked if i % 3 == 0 else plain).format(*[f"sentence {i} " * 20] * 2)) for i in range(9) for url in ("http://s/", None)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 18 and all(r.text == f"sentence {r.page_id} " * 19 + f"sentence {r.page_id}" for r in got)
