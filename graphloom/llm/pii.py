"""Personal data: fixed patterns, and identifiers found by bootstrapping.

Matches of the fixed patterns are the seeds, and values assigned to a cue word
such as ``password`` are likely ones.  Every identifier-like string of the corpus is
an instance; its shape and the words before and after it are lexical patterns.
Spark scores the graph of patterns and instances in rounds: a pattern is worth
the mean score of its instances, an instance what its cue and its best supported
patterns together make likely.  Strings that come out likely are added.
"""

from __future__ import annotations

import re
from bisect import bisect, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, stored, texts_of

KINDS = ("email", "ip", "card", "phone")
#: Kind of the spans that bootstrapping adds.
ADDED = "id"

#: What follows an address's local part, its characters, and the other patterns.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: A cue word, and the value that is assigned to it.
CUE = re.compile(r"(?<![A-Za-z])(?:token|password|passwd|secret|api[_-]?key|access[_-]?key)\s*([=:])\s*[\"']?([^\s\"'<>]+)", re.I)
#: How likely a value is by its cue alone: assigned or with a digit; and a word after a colon.
ASSIGNED, NAMED = 0.9, 0.5
#: Characters of an identifier-like string, and the least of characters and digits that
#: define one where no cue does; groups of it that single spaces part.
PART = LOCAL | frozenset("@/_")
LEAST_CHARS, LEAST_DIGITS = 8, 3
GROUPS = re.compile(r"(?: [0-9A-Z]{4}\b){2,}(?: [0-9A-Z]{1,4}\b)?")
#: Rounds of scoring; instances that a pattern must have; scores of high confidence.
ROUNDS, SUPPORT, CONFIDENT = 3, 3, 0.8
#: Parts that the instances of a pattern are dealt to.
SALTS = 8


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``,
    found from the at sign: the match begins where the run of local characters
    before it does, or the match before ends."""
    done = 0
    for m in DOMAIN.finditer(text) if "@" in text else ():
        s = m.start()
        while s > done and text[s - 1] in LOCAL:
            s -= 1
        if s < m.start():
            done = m.end()
            yield s, done


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind and start, in code points."""
    out = [("email", s, e) for s, e in emails(text)]
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def shape(value: str) -> str:
    """Character classes with run lengths; hexadecimal strings as one run."""
    if re.fullmatch(r"[0-9a-f]+", value) and not value.isdigit():
        return f"x{len(value)}"
    if re.fullmatch(r"[0-9A-Z]+", value) and not value.isdigit():
        return f"{value[:4] if value[:4].isalpha() else ''}U{len(value)}"
    runs = re.findall(r"[0-9]+|[a-z]+|[A-Z]+|[^0-9a-zA-Z]+", value)
    return "".join(f"d{len(r)}" if r[0].isdigit() else ("a" if r.islower() else "A") + str(min(len(r), 9)) if r.isalpha() else r for r in runs)


def _near(text: str, start: int, step: int, words: int) -> list[str]:
    """At least ``words`` whole strings before (``step`` -1) or after a place, if there are."""
    reach = 64
    while True:
        part = text[max(0, start - reach) : start] if step < 0 else text[start : start + reach]
        found = re.sub(r"[0-9]", "0", part.lower()).split()
        if len(found) > words or reach >= len(text):
            return found
        reach *= 4


def lexical(text: str, start: int, end: int) -> list[str]:
    """The patterns of an occurrence: its shape, the last and the last three
    strings before it, and the next one after it."""
    before, after = _near(text, start, -1, 3), _near(text, end, 1, 1)
    out = ["S|" + shape(text[start:end])]
    if before:
        out += ["L|" + before[-1], "M|" + " ".join(before[-3:])]
    if after:
        out.append("R|" + after[0])
    return out


def instances(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int, float]]:
    """(start, end, how likely it is by itself): base spans are certain; values of
    cue words and other identifier-like strings, which overlap no base span and
    not each other."""
    out = [(s, e, 1.0) for _, s, e in base]
    taken = sorted((s, e) for s, e, _ in out)

    def free(s: int, e: int) -> bool:
        i = bisect(taken, (s, e))
        return (i == len(taken) or taken[i][0] >= e) and not any(b > s for _, b in taken[max(0, i - 4) : i])

    for m in CUE.finditer(text):
        s, e = m.span(2)
        while e > s and not text[e - 1].isalnum():
            e -= 1
        if e > s and free(s, e):
            out.append((s, e, ASSIGNED if m[1] == "=" or DIGIT.search(text, s, e) else NAMED))
            insort(taken, (s, e))
    done = 0
    for m in DIGIT.finditer(text):
        s = m.start()
        if s < done:
            continue
        e = s + 1
        while s > done and text[s - 1] in PART:
            s -= 1
        while e < len(text) and text[e] in PART:
            e += 1
        if groups := GROUPS.match(text, e):
            if DIGIT.search(groups[0]):
                e = groups.end()
        done = e
        while s < e and not text[s].isalnum():
            s += 1
        while e > s and not text[e - 1].isalnum():
            e -= 1
        if e - s >= LEAST_CHARS and sum(c.isdigit() for c in text[s:e]) >= LEAST_DIGITS and free(s, e):
            out.append((s, e, 0.0))
    return out


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, a hash of the text, base spans, and the instances of all lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, seen = [], []
            for text in texts_of(batch, "text"):
                spans = base_spans(text)
                base.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
                seen.append([{"start": s, "end": e, "value": text[s:e], "prior": prior, "patterns": lexical(text, s, e)} for s, e, prior in instances(text, spans)])
            yield pa.RecordBatch.from_arrays([column(batch, "id"), column(batch, "text_hash"), pa.array(base, span), pa.array(seen, instance)], ["id", "text_hash", "base", "instances"])

    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    instance = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("prior", pa.float64()), ("patterns", pa.list_(pa.string()))]))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(run, f"id {kind}, text_hash bigint, base array<struct<kind string, start bigint, end bigint>>, instances array<struct<start bigint, end bigint, value string, prior double, patterns array<string>>>")


def bootstrap(scanned: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confident: float = CONFIDENT) -> DataFrame:
    """``(value, score)`` of the strings that are no base span but come out likely.

    Edges are distinct pairs of pattern and value, so copies of a document
    count once; sums are combined before they are shuffled, and the instances of
    a pattern are dealt to ``SALTS`` parts where its worth is handed on."""
    seen = scanned.select(F.explode("instances").alias("i")).select("i.value", "i.prior", "i.patterns")
    edges = stored(seen.select("value", "prior", F.explode("patterns").alias("pattern")).groupBy("pattern", "value").agg(F.max("prior").alias("prior")), "pii-edges")
    priors = edges.groupBy("value").agg(F.max("prior").alias("prior"))
    values = stored(priors.select("value", "prior", F.col("prior").alias("score")), "pii-values")
    salted = edges.select("pattern", "value", F.pmod(F.xxhash64("value"), F.lit(SALTS)).alias("salt"))
    for _ in range(rounds):
        # a pattern's worth: mean score of its values, drawn down while it has few
        worth = edges.select("pattern", "value").join(values, "value").groupBy("pattern").agg((F.sum("score") / (F.count("*") + 1)).alias("worth"), F.count("*").alias("n"), F.max("prior").alias("seeded"))
        strong = worth.where((F.col("n") >= support) & (F.col("seeded") >= ASSIGNED) & (F.col("worth") >= confident / 2)).select("pattern", "worth", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt"))
        # an instance's score: one minus the chance that its cue and all its patterns are wrong
        named = salted.join(strong, ["pattern", "salt"]).groupBy("value").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("worth"), F.lit(1e-6)))))).alias("likely"), F.max("worth").alias("best"))
        found = F.when(F.col("best") >= confident, F.col("likely")).otherwise(F.coalesce("likely", F.lit(0.0)) * 0.5)
        values = stored(values.join(named, "value", "left").select("value", "prior", (1 - (1 - F.col("prior")) * (1 - found)).alias("score")), "pii-values")
    return values.where((F.col("prior") < 1) & (F.col("score") >= confident)).select("value", "score")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text_hash, base, added)`` per row: base spans, and the spans that
    bootstrapping adds, as arrays of (kind, start, end)."""
    scanned = stored(scan(docs, id_col, text_col), "pii-scan")
    known = bootstrap(scanned).select("value")
    rows = scanned.select("id", "text_hash", F.explode("instances").alias("i")).where("i.prior < 1").select("id", "text_hash", "i.start", "i.end", "i.value").distinct()
    found = rows.join(known, "value", "left_semi")
    added = found.groupBy("id", "text_hash").agg(F.sort_array(F.collect_set(F.struct(F.col("start"), F.col("end")))).alias("more"))
    added = added.select(F.col("id").alias("i2"), F.col("text_hash").alias("h2"), F.transform("more", lambda s: F.struct(F.lit(ADDED).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("more"))
    joined = scanned.join(added, F.col("id").eqNullSafe(F.col("i2")) & (F.col("text_hash") == F.col("h2")), "left")
    return joined.select("id", "text_hash", "base", F.coalesce("more", F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")).alias("added"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)`` per row.

    Counts and hash are of the fixed patterns; ``spans`` also has what the
    method adds, last.  Null texts are empty: no spans, the hash of nothing.
    Repeated rows give repeated rows, null ids stay, other columns are ignored."""
    found = spans(docs, id_col, text_col)

    def of(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [of(k) for k in KINDS]
    return found.select(F.col("id").alias(id_col), *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "added")).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets.  Spans
    that overlap are replaced together, under the first one's kind.  All
    columns stay; null texts stay null."""
    # spans of a row are the same for every copy of the row
    found = spans(docs, id_col, text_col).where(F.size("base") + F.size("added") > 0).select(F.col("id").alias("pii_id"), F.col("text_hash").alias("pii_hash"), F.concat("base", "added").alias("pii_spans")).dropDuplicates(["pii_id", "pii_hash"])
    names = docs.columns
    marked = docs.select(F.struct(*(docs[c] for c in names)).alias("row"))
    key = F.xxhash64(F.coalesce(F.col(f"row.`{text_col}`"), F.lit("")))
    joined = marked.join(found, F.col(f"row.`{id_col}`").eqNullSafe(F.col("pii_id")) & (key == F.col("pii_hash")), "left")
    ordered = F.sort_array(F.transform("pii_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    # fold over the spans: text so far, and where the next stretch begins
    text = F.col(f"row.`{text_col}`")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))
    step = lambda acc, s: F.when(s["start"] < acc["at"], F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))).otherwise(F.struct(F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("<"), F.upper(s["kind"]), F.lit(">")).alias("out"), s["end"].alias("at")))
    clean = F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    return joined.select(*((F.when(F.col("pii_spans").isNull(), text).otherwise(clean) if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in names))
