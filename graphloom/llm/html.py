"""Main text of web pages through union-free wrappers of their hosts.

Each page becomes a stream of tags and text slots in which repeated runs are
folded into groups.  The streams of one host are aligned one after another:
what only some have becomes optional, texts that differ become open slots,
texts that never differ stay part of the template.  The wrapper so inferred is
a regular expression without unions.  Its slots decide what the paths of
containers hold: constant slots that most pages have are template, wherever they
stand; open ones are text, unless a container says that it holds something else.
Pages are read through these labels.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import reduce
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, stored

#: Fixed values of the HTML standard: elements without content, elements whose
#: content is no markup, and elements that end a block of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe title".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Elements that hold no article text, and the words of class, role or id that say so:
#: some whatever stands beside them, others only if no word of another kind does.
NOISE_TAGS = frozenset("head nav footer aside form button select menu dialog search input label fieldset".split())
SURE_WORDS = frozenset("ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comments cookie cookies disqus gdpr masthead nav navbar navigation newsletter pagination promo sidebar sponsored".split())
NOISE_WORDS = SURE_WORDS | frozenset("banner banners comment consent footer menu modal notice notices popup promoted recommended related respond share sharing skip social sponsor subscribe toolbar widget".split())
NEUTRAL_WORDS = frozenset("area bar block box buttons col container content form group icons inner item items left links list panel posts right row section slot small top unit wrap wrapper".split())
#: Elements that can be a container of something else than text.
HOLDERS = frozenset("article aside details dialog div dl fieldset figure footer form header iframe li main menu nav ol section table ul".split())
#: Distinct pages that a template text is on at least, and their share of a host's pages.
TEMPLATE_PAGES, TEMPLATE_SHARE = 3, 0.5
CONTENT_TAGS = frozenset(["article", "main"])
#: Elements whose end tag may be missing: a new one, or the end of its container, closes them.
LOOSE = frozenset("p li dt dd tr td th option b i em strong span a u small font".split())
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"(?i)\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
#: Longest unit of a repetition that is folded, in stream elements; longer ones stay as they are.
UNIT = 10
#: Wrappers of one host that a task aligns.
FAN = 16


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): kind is one of "start", "end" and "text"; rest are the
    attributes or the text.  Comments and raw elements are left out."""
    at, n = 0, len(html)
    while at < n:
        m = TOKEN.search(html, at)
        if not m:
            yield "text", "", html[at:]
            return
        if m.start() > at:
            yield "text", "", html[at : m.start()]
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            yield "end", name, ""
            continue
        rest = m[3] if m[2] else m[6]
        if name in RAW and not rest.endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            at = end.end() if end else n
            continue
        yield "start", name, rest


def says_noise(name: str, token: str, alone: bool) -> bool:
    """Whether a class, role or id says that its element holds no article text;
    ``alone`` if no word of another kind stands beside it."""
    parts = set(re.split("[-_]+", token))
    if parts <= SURE_WORDS or name in HOLDERS and parts <= NOISE_WORDS | NEUTRAL_WORDS and parts & SURE_WORDS:
        return True
    return alone and name in HOLDERS and bool(parts & NOISE_WORDS) and parts <= NOISE_WORDS | NEUTRAL_WORDS


def container(name: str, rest: str) -> str:
    """A start tag with its classes and role, without their digits, and with
    ``!`` if they or its id say that it holds no article text: ``div.ad.box!``."""
    words, own = set(), ""
    for m in ATTRIBUTE.finditer(rest) if rest else ():
        tokens_ = [t for t in (re.sub("[^a-z_-]", "", t).strip("-_") for t in (m[2] or m[3] or m[4] or "").lower().split()) if t]
        if m[1].lower() == "id":
            own = "".join(tokens_)
        else:
            words.update(tokens_)
    plain = any(not set(re.split("[-_]+", t)) <= NOISE_WORDS | NEUTRAL_WORDS for t in words)
    noise = name not in CONTENT_TAGS and name not in ("body", "html") and (any(says_noise(name, t, not plain) for t in words) or bool(own) and says_noise(name, own, not plain))
    return ".".join([name, *sorted(words)]) + "!" * noise


class Walk:
    """Reads a page: for each text its path of containers, and block by block."""

    def __init__(self, html: str):
        self.stack: list[str] = []
        self.events: list[tuple[str, str]] = []  # ("tag", token), ("text", raw), ("block", "")
        for kind, name, rest in tokens(html):
            if kind == "text":
                self.events.append(("text", rest))
            elif kind == "start":
                key = container(name, rest)
                self.events.append(("open", key))
                if name in VOID:
                    self.events.append(("close", name))
            elif name not in VOID:
                self.events.append(("close", name))

    def texts(self) -> Iterator[tuple[str, str, bool]]:
        """(path, raw text, whether a block ended before it)."""
        stack: list[str] = []
        path, cut = "", True
        for kind, what in self.events:
            name = what.rstrip("!").split(".", 1)[0]
            if kind == "text":
                yield path, what, cut
                cut = False
                continue
            cut |= name in BLOCK
            if name in VOID:
                if name == "br":
                    yield path, " ", cut
                    cut = False
                continue
            if kind == "open":
                if name in LOOSE:
                    if name in BLOCK and stack and stack[-1].rstrip("!").split(".", 1)[0] == name:
                        stack.pop()
                    if name not in BLOCK:
                        continue  # inline elements make no container
                stack.append(what)
            else:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].rstrip("!").split(".", 1)[0] == name:
                        del stack[i:]
                        break
                    if name in LOOSE and stack[i].rstrip("!").split(".", 1)[0] not in LOOSE:
                        break  # a stray end tag closes no container
            path = "/".join(s for s in stack if s.rstrip("!").split(".", 1)[0] not in LOOSE or "." in s or "!" in s)


# A stream element is a list: ["T", tag], ["S", constant or None, chars, times, path, some of its pages],
# ["R", elements] for a group seen once or more, ["O", elements] for one that may be missing.


def shape(e: list) -> str:
    if e[0] == "T":
        return e[1]
    return f"#{e[4]}#" if e[0] == "S" else "(" + "".join(map(shape, e[1])) + (")+" if e[0] == "R" else ")?")


def unite(a: list, b: list) -> list:
    """Two elements of one shape as one."""
    if a[0] == "T":
        return a
    if a[0] == "S":
        return ["S", a[1] if a[1] == b[1] else None, a[2] + b[2], a[3] + b[3], a[4], sorted({*a[5], *b[5]})[:TEMPLATE_PAGES]]
    return [a[0], [unite(x, y) for x, y in zip(a[1], b[1])]]


def fold(stream: list[list]) -> list[list]:
    """Fold runs of equally shaped units into repeated groups, short units first."""
    for unit in range(1, UNIT + 1):
        shapes, out, i = [shape(e) for e in stream], [], 0
        while i < len(stream):
            j = i + unit
            if shapes[i:j] != shapes[j : j + unit] or shapes[i][0] == "#" and unit == 1:
                out.append(stream[i])
                i += 1
                continue
            group = stream[i:j]
            while shapes[i : i + unit] == shapes[j : j + unit]:
                group = [unite(a, b) for a, b in zip(group, stream[j : j + unit])]
                j += unit
            out.append(group[0] if unit == 1 and group[0][0] == "R" else ["R", group])
            i = j
        stream = out
    return stream


def stream_of(html: str) -> list[list]:
    """A page as a folded stream."""
    walk = Walk(html)
    page = hashlib.blake2b(html.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()
    out: list[list] = []
    texts = walk.texts()
    for kind, what in walk.events:
        name = what.rstrip("!").split(".", 1)[0]
        if kind == "text":
            path, raw, _ = next(texts)
            text = " ".join(unescape(raw).split())
            if text:
                # a long constant is known by its digest
                constant = text if len(text) <= 200 else "\0" + hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
                out.append(["S", constant, len(text), 1, path, [page]])
        elif name == "br" and kind == "open":
            next(texts)
            out.append(["T", "<br>"])
        elif name not in VOID:
            out.append(["T", f"<{what}>" if kind == "open" else f"</{name}>"])
    return fold(out)


def align(a: list[list], b: list[list]) -> list[list]:
    """The wrapper of two streams or wrappers: a longest common subsequence of
    shapes stays, all else becomes optional."""
    sa, sb = [shape(e) for e in a], [shape(e) for e in b]
    if sa == sb:
        return [unite(x, y) for x, y in zip(a, b)]
    strip = lambda e: e[1] if e[0] == "O" else [e]
    fa, fb = [(x, e[0] == "O") for e in a for x in strip(e)], [(x, e[0] == "O") for e in b for x in strip(e)]
    ka, kb = [shape(x) for x, _ in fa], [shape(x) for x, _ in fb]
    head = 0
    while head < min(len(ka), len(kb)) and ka[head] == kb[head]:
        head += 1
    tail = 0
    while tail < min(len(ka), len(kb)) - head and ka[-1 - tail] == kb[-1 - tail]:
        tail += 1
    n, m = len(ka) - head - tail, len(kb) - head - tail
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below, x = best[i], best[i + 1], ka[head + i]
        for j in range(m - 1, -1, -1):
            row[j] = below[j + 1] + 1 if x == kb[head + j] else max(below[j], row[j + 1])
    flat: list[tuple[list, bool]] = [(unite(fa[i][0], fb[i][0]), fa[i][1] or fb[i][1]) for i in range(head)]
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and ka[head + i] == kb[head + j]:
            (x, o), (y, p) = fa[head + i], fb[head + j]
            flat.append((unite(x, y), o or p))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            flat.append((fa[head + i][0], True))
            i += 1
        else:
            flat.append((fb[head + j][0], True))
            j += 1
    flat += [(unite(fa[len(ka) - k][0], fb[len(kb) - k][0]), fa[len(ka) - k][1] or fb[len(kb) - k][1]) for k in range(tail, 0, -1)]
    out: list[list] = []
    for e, optional in flat:
        if not optional:
            out.append(e)
        elif out and out[-1][0] == "O":
            out[-1][1].append(e)
        else:
            out.append(["O", [e]])
    # optional runs that have become repetitions are folded again
    return [["O", fold(e[1])] if e[0] == "O" else e for e in out]


def expression(wrapper: list[list]) -> str:
    """The wrapper as a union-free regular expression; ``#`` is an open text slot."""
    return "".join(e[1] if e[0] == "T" else (e[1] if e[0] == "S" and e[1] is not None else "#") if e[0] == "S" else "(" + expression(e[1]) + (")+" if e[0] == "R" else ")?") for e in wrapper)


def noisy(path: str) -> bool:
    """Whether a container on the path holds no article text."""
    inside = False
    for part in path.split("/"):
        name = part.rstrip("!").split(".", 1)[0]
        if name in NOISE_TAGS or name == "header" and not inside or part.endswith("!"):
            return True
        inside |= name in CONTENT_TAGS
    return False


def content(path: str) -> bool:
    """Whether the path leads through an article or main element, and no noise."""
    return any(s.rstrip("!").split(".")[0] in CONTENT_TAGS for s in path.split("/")) and not noisy(path)


def marked(elements: list[list]) -> bool:
    """Whether a stream has text under an article or main element."""
    return any(content(e[4]) if e[0] == "S" else e[0] in "RO" and marked(e[1]) for e in elements)


def label(wrapper: list[list], pages: int) -> dict[str, bool]:
    """For each path of the wrapper's slots, whether it holds article text.

    A path all of whose slots are constant, on three distinct pages at least and
    as often as on half of the host's, is template.  Other slots under an article
    or main element are text, noise aside.  A wrapper without such an element is
    read by mass: the deepest container that holds four fifths of the open text."""
    mass: dict[str, list[int]] = {}  # path -> [open characters, characters]
    fixed: dict[str, bool] = {}

    def visit(elements: list[list]) -> None:
        for e in elements:
            if e[0] == "S":
                template = e[1] is not None and len(e[5]) >= TEMPLATE_PAGES and e[3] >= TEMPLATE_SHARE * pages
                fixed[e[4]] = fixed.get(e[4], True) and template
                m = mass.setdefault(e[4], [0, 0])
                m[1] += e[2]
                m[0] += 0 if template else e[2]
            elif e[0] in "RO":
                visit(e[1])

    visit(wrapper)
    clean = {p: m for p, m in mass.items() if not noisy(p) and not fixed[p]}
    marked = {p for p in clean if any(s.split(".")[0] in CONTENT_TAGS for s in p.split("/"))}
    if not marked and clean:
        whole, prefix = sum(m[0] for m in clean.values()), ""
        while True:
            below: dict[str, int] = {}
            for p, m in clean.items():
                if p.startswith(prefix) and (rest := p[len(prefix) :].lstrip("/")):
                    step = f"{prefix}/{rest.split('/')[0]}" if prefix else rest.split("/")[0]
                    below[step] = below.get(step, 0) + m[0]
            heavy = max(below, key=below.get, default=None)
            if heavy is None or below[heavy] < 0.8 * whole:
                break
            prefix = heavy
        marked = {p for p in clean if (p == prefix or p.startswith(prefix + "/") or not prefix) and clean[p][0]}
    return {p: p in marked for p in mass}


def main_text(html: str, of_marked: dict[str, bool], of_others: dict[str, bool]) -> str:
    """The text under paths that are labelled so, a line per block.  The labels
    are those of the host's pages that mark an article, if this one does, or of
    the others."""
    blocks: list[list[str]] = []
    good, fresh = False, True
    texts = list(Walk(html).texts())
    # slots under content paths are the only ones with a label that is true in marked pages
    labels = of_marked if any(of_marked.get(path) and unescape(raw).split() for path, raw, _ in texts) else of_others
    for path, raw, cut in texts:
        if path not in labels:  # a path of white space only
            labels[path] = False
        good = labels[path]
        fresh |= cut
        if not good:
            fresh = True
            continue
        if fresh:
            blocks.append([])
            fresh = False
        blocks[-1].append(raw)
    lines = (" ".join(unescape("".join(b)).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without port; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url.cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def infer(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(host, marked, wrapper, labels)``: per host, for its pages that mark an
    article and for those that do not, the expression and, as JSON, the label of
    each path.  Every page is aligned: first within a task, then the
    wrappers of tasks ``FAN`` at a time, so that a hot host is no single task's."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, bool], dict[str, list[list]]] = {}  # host and marked, shape of a page, stream
        counts: dict[tuple[str, bool], int] = {}
        held = 0

        def out() -> pa.RecordBatch:
            wrappers = {key: reduce(align, streams.values()) for key, streams in found.items()}
            return pa.RecordBatch.from_arrays([pa.array([h for h, _ in wrappers], pa.string()), pa.array([m for _, m in wrappers], pa.bool_()), pa.array([counts[k] for k in wrappers], pa.int64()), pa.array(map(json.dumps, wrappers.values()), pa.string())], ["host", "marked", "pages", "stream"])

        for batch in batches:
            for host, html in zip(column(batch, "host").to_pylist(), column(batch, "html")):
                stream = stream_of(html.as_py())
                # pages of one shape are united at once and aligned as one
                kind = (host, marked(stream))
                key, same = "".join(map(shape, stream)), found.setdefault(kind, {})
                counts[kind] = counts.get(kind, 0) + 1
                held += key not in same
                same[key] = align(same[key], stream) if key in same else stream
                if held > 5000:
                    yield out()
                    found, counts, held = {}, {}, 0
        yield out()

    def merged(pdf: pd.DataFrame) -> list[list]:
        # sorted, so that the result does not depend on the order of arrival
        return reduce(align, [json.loads(s) for s in sorted(pdf["stream"])])

    def some(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": pdf["host"].iloc[:1], "marked": pdf["marked"].iloc[:1], "pages": [int(pdf["pages"].sum())], "stream": [json.dumps(merged(pdf))]})

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        wrapper = merged(pdf)
        return pd.DataFrame({"host": pdf["host"].iloc[:1], "marked": pdf["marked"].iloc[:1], "wrapper": [expression(wrapper)], "labels": [json.dumps(label(wrapper, int(pdf["pages"].sum())))]})

    rows = pages.select(host_of(pages[url_col]).alias("host"), F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("html"))
    parts = rows.mapInArrow(partial, "host string, marked boolean, pages bigint, stream string")
    groups = rows.rdd.getNumPartitions() // FAN
    while groups > 1:  # a host has about a wrapper per task at first
        parts = parts.groupBy("host", "marked", F.pmod(F.xxhash64("stream"), F.lit(groups)).alias("salt")).applyInPandas(some, "host string, marked boolean, pages bigint, stream string")
        groups //= FAN
    return parts.groupBy("host", "marked").applyInPandas(final, "host string, marked boolean, wrapper string, labels string")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` per row of ``pages``.

    Null and empty pages have an empty text; pages without a usable URL share
    the wrapper of the empty host.  Repeated rows give repeated rows, null ids
    stay, other columns are ignored."""
    hosts = stored(infer(pages, url_col, html_col), "wrappers").groupBy(F.col("host").alias("h")).agg(F.max(F.when(F.col("marked"), F.col("labels"))).alias("of_marked"), F.max(F.when(~F.col("marked"), F.col("labels"))).alias("of_others"))
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), pages[html_col].cast("string").alias("html"), host_of(pages[url_col]).alias("host"))
    joined = rows.join(hosts, F.col("host") == F.col("h"), "left").select("id", "url", "html", "of_marked", "of_others")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: dict[str, dict[str, bool]] = {}
        for batch in batches:
            out = []
            for html, *labels in zip(*(column(batch, c) for c in ("html", "of_marked", "of_others"))):
                keys = [x.as_py() or "{}" for x in labels]
                if len(read) > 1000:
                    read.clear()
                for key in keys:
                    if key not in read:
                        read[key] = json.loads(key)
                out.append(main_text(html.as_py() or "", *(read[k] for k in keys)))
            yield pa.RecordBatch.from_arrays([column(batch, "id"), column(batch, "url"), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], [id_col, url_col, "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return joined.mapInArrow(run, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars bigint")
