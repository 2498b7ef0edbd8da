"""Conversations without quotations, in the order of their replies.

Messages are split into their own text and quoted passages of every level.
Passages are normalised to words and hashed, whatever their line breaks: by runs
of ``RUN`` words, or, if they are shorter, by lines and sentences.  The hashes are
joined to the latest earlier message of the conversation whose own text has them;
the message that most of a passage's hashes lead to is the one it is from, and
that of the outermost passage is the one that is answered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, drop_stored, stored

#: Messages of a conversation that one row holds; longer ones come in parts of so many.
PART = 1024
#: Words of a run that is hashed.
RUN = 5
SENTENCE = re.compile(r"\n|(?<=[.!?])\s+")
QUOTED = re.compile(r"[ \t]*((?:>[ \t]?)+)(.*)", re.S)
#: A line that introduces a quotation, as mail programs write it.
ATTRIBUTION = re.compile(r"^.*(?:wrote|writes|schrieb|a écrit|escribió)\s*:\s*$", re.I)


def parse(text: str) -> tuple[str, list[tuple[int, str]]]:
    """A message's own text, and its quoted passages as (level, lines)."""
    own: list[str] = []
    quoted: list[tuple[int, list[str]]] = []
    inside = 0
    for line in text.split("\n"):
        m = QUOTED.match(line)
        if not m:
            inside = 0
            own.append(line)
            continue
        level = m[1].count(">")
        if not inside and own and ATTRIBUTION.match(own[-1]):
            own.pop()
        if level != inside:
            quoted.append((level, []))
        inside = level
        quoted[-1][1].append(m[2].rstrip("\r"))
    body = re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip()
    return body if quoted else text, [(level, "\n".join(lines)) for level, lines in quoted]


def _hash(words: list[str]) -> int:
    return xxhash.xxh64_intdigest(" ".join(words).encode()) - (1 << 63)


def runs(text: str) -> set[int]:
    """Signed XXH64 of every run of ``RUN`` words, in lower case and without
    punctuation; none for a shorter text."""
    words = re.findall(r"\w+", text.lower())
    return {_hash(words[i : i + RUN]) for i in range(len(words) - RUN + 1)}


def units(text: str) -> set[int]:
    """The same of lines and sentences that have fewer words than a run."""
    found = (re.findall(r"\w+", part.lower()) for whole in text.split("\n") for part in {whole, *SENTENCE.split(whole)})
    return {_hash(words) for words in found if 0 < len(words) < RUN}


def messages(chats: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per message: its own text, the number of quoted passages and their depth,
    and the passages with their levels and hashes."""
    asked_type = pa.list_(pa.struct([("passage", pa.int32()), ("level", pa.int32()), ("hashes", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw in column(batch, "text").to_pylist():
                body, quoted = parse(raw or "")
                asked = [{"passage": n, "level": level, "hashes": sorted(runs(passage) or units(passage))} for n, (level, passage) in enumerate(quoted)]
                rows.append((body, len(quoted), max((level for level, _ in quoted), default=0), asked))
            cols = list(zip(*rows)) or [()] * 4
            kinds = [pa.string(), pa.int32(), pa.int32(), asked_type]
            yield pa.RecordBatch.from_arrays([column(batch, c) for c in ("conv", "turn", "role")] + [pa.array(c, k) for c, k in zip(cols, kinds)], ["conv", "turn", "role", "body", "n_quotes", "depth", "asked"])

    kind = chats.schema[conv_col].dataType.simpleString()
    rows = chats.select(chats[conv_col].alias("conv"), chats[turn_col].cast("bigint").alias("turn"), F.coalesce(F.lower(F.trim(chats[role_col])), F.lit("")).alias("role"), chats[text_col].alias("text"))
    return rows.mapInArrow(run, f"conv {kind}, turn bigint, role string, body string, n_quotes int, depth int, asked array<struct<passage int, level int, hashes array<bigint>>>")


def own_hashes(parsed: DataFrame) -> DataFrame:
    """``(conv, turn, hash)``: the hashes of the messages' own texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([sorted(runs(b) | units(b)) for b in column(batch, "body").to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([column(batch, "conv"), column(batch, "turn"), found], ["conv", "turn", "said"])

    kind = parsed.schema["conv"].dataType.simpleString()
    return parsed.select("conv", "turn", "body").mapInArrow(run, f"conv {kind}, turn bigint, said array<bigint>").select("conv", "turn", F.explode("said").alias("hash"))


def latest_before(both: DataFrame) -> DataFrame:
    """``(conv, turn, passage, level, hash, origin)`` of the rows of ``both`` that
    ask (``passage`` not null): the latest turn before theirs at which the hash is
    said.  Ranges of (conv, hash, turn) are walked one by one, so that a passage
    that a whole conversation quotes is no single task's; what a range does not
    know it takes from the ends of the ranges before it."""
    fields = both.select("conv", "hash", "turn", "passage", "level").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        me, key, last, before = TaskContext.get().partitionId(), None, None, None
        for batch in batches:
            hashes, turns, asks = (column(batch, c).to_pylist() for c in ("hash", "turn", "passage"))
            convs = column(batch, "conv").to_pylist()
            origins: list[int | None] = []
            for c, h, t, a in zip(convs, hashes, turns, asks):
                if (c, h) != key:
                    key, last, before = (c, h), None, None
                if a is None:
                    if t != last:
                        last, before = t, last
                    origins.append(t)
                else:
                    origins.append(last if last is not None and last < t else before)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(origins, pa.int64()), pa.array(np.full(batch.num_rows, me), pa.int32())], [*batch.schema.names, "origin", "range"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    ranged = both.select("conv", "hash", "turn", "passage", "level").repartitionByRange("conv", "hash", "turn").sortWithinPartitions("conv", "hash", "turn", F.col("passage").isNotNull())
    walked = stored(ranged.mapInArrow(run, f"{kinds}, origin bigint, range int"), "chat-walked")
    asked = walked.where("passage is not null")
    # a hash that goes on over ranges: a row per range that has it
    ends = walked.where("passage is null").groupBy(F.col("conv").alias("c2"), F.col("hash").alias("h2"), F.col("range").alias("r2")).agg(F.max("turn").alias("said"))
    open_ = asked.where("origin is null").select("conv", "hash", "range").distinct()
    known = open_.join(ends, F.col("conv").eqNullSafe(F.col("c2")) & (F.col("hash") == F.col("h2")) & (F.col("r2") < F.col("range"))).groupBy(F.col("conv").alias("c3"), F.col("hash").alias("h3"), F.col("range").alias("r3")).agg(F.max("said").alias("carried"))
    out = asked.join(known, F.col("conv").eqNullSafe(F.col("c3")) & (F.col("hash") == F.col("h3")) & (F.col("range") == F.col("r3")), "left").withColumn("origin", F.coalesce("origin", "carried"))
    return out.where("origin is not null").select("conv", "turn", "passage", "level", "hash", "origin")


def replies(parsed: DataFrame) -> DataFrame:
    """``(conv, turn, parent, n_passages)``: the turn that each quoting message
    answers, and how many of its passages are known.

    A hash is looked up by a walk over the turns that have it, so a passage that
    many messages share never makes pairs of them.  Of turns with equally many
    hashes the latest is taken, of passages the first of the lowest level."""
    asked = parsed.where((F.size("asked") > 0) & F.col("turn").isNotNull()).select("conv", "turn", F.explode("asked").alias("a")).select("conv", "turn", "a.passage", "a.level", F.explode("a.hashes").alias("hash"))
    asked = stored(asked.distinct(), "chat-asked")
    # only what somebody quotes in the conversation matters
    wanted = asked.select(F.col("conv").alias("c2"), F.col("hash").alias("h2")).distinct()
    quoting = asked.select(F.col("conv").alias("c1")).distinct()
    said = own_hashes(parsed.where("turn is not null").join(quoting, F.col("conv").eqNullSafe(F.col("c1")), "left_semi"))
    said = said.join(wanted, F.col("conv").eqNullSafe(F.col("c2")) & (F.col("hash") == F.col("h2")), "left_semi").distinct()
    none = F.lit(None).cast("int")
    found = latest_before(said.select("conv", "turn", none.alias("passage"), none.alias("level"), "hash").unionByName(asked))
    votes = found.groupBy("conv", "turn", "passage", "level", "origin").agg(F.count("*").alias("n"))
    passages = votes.groupBy("conv", "turn", "passage", "level").agg(F.max(F.struct("n", "origin"))["origin"].alias("origin"))
    return passages.groupBy("conv", "turn").agg(F.min(F.struct("level", "passage", "origin"))["origin"].alias("parent"), F.count("*").alias("n_passages"))


def threads(links: DataFrame, label: str = "chat-roots") -> DataFrame:
    """``(conv, turn, parent, root)``: the first turn of each reply's thread, by
    pointer jumping; each round halves the way and is written out."""
    now = stored(links.select("conv", "turn", "parent", F.col("parent").alias("root")), label)
    while True:
        up = now.select(F.col("conv").alias("c2"), F.col("turn").alias("t2"), F.col("root").alias("r2"))
        new = stored(now.join(up, F.col("conv").eqNullSafe(F.col("c2")) & (F.col("root") == F.col("t2")), "left").select("conv", "turn", "parent", F.coalesce("r2", "root").alias("root"), F.col("r2").isNotNull().alias("moved")), label)
        drop_stored(now)
        moved = new.where("moved").limit(1).count()
        now = new.drop("moved")
        if not moved:
            return now


def positions(rows: DataFrame) -> DataFrame:
    """``rows`` with ``place``: the number of a message in its conversation by
    thread, turn, role, text and parent.  Ranges of the order are sorted by
    themselves, and begin where the ones before them end."""
    order = ["conv", "thread", "turn", "role", "body", "parent"]
    # a range is named by the beginnings of texts only, which the driver samples
    ranged = rows.withColumn("begin", F.substring("body", 1, 32)).repartitionByRange("conv", "thread", "turn", "role", "begin").drop("begin").sortWithinPartitions(*order)
    numbered = stored(ranged.withColumn("range", F.spark_partition_id()).withColumn("number", F.monotonically_increasing_id()), "chat-order")
    sizes = numbered.groupBy("conv", "range").agg(F.count("*").alias("n"), F.min("number").alias("first"))
    before = Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("conv").alias("c4"), F.col("range").alias("r4"), "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))  # a row per conversation and range
    joined = numbered.join(starts, F.col("conv").eqNullSafe(F.col("c4")) & (F.col("range") == F.col("r4")))
    return joined.withColumn("place", F.col("number") - F.col("first") + F.col("ahead")).select(*rows.columns, "place")


def conversations(chats: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part: int = PART) -> DataFrame:
    """One row per conversation: ``conv_id, part, n_messages, n_quotes, n_linked,
    n_passages, depth, turns, parents, chat``; ``n_linked`` messages answer one that
    is known, and the originals of ``n_passages`` quoted passages are known.

    Messages come thread by thread, a thread where its first message stands and
    in the order of turns, so every reply follows what it answers.  A
    conversation of more than ``part`` messages comes in parts of that many in
    this order, which bounds a row: the parts one after another are the whole.
    Null texts are empty messages, null
    roles an empty role; messages without a turn stand first and answer
    nothing; null conversation ids are one conversation; repeated rows stay;
    other columns are ignored."""
    parsed = stored(messages(chats, conv_col, turn_col, role_col, text_col), "chat-messages")
    answered = stored(replies(parsed), "chat-replies")
    counts = answered.select(F.col("conv").alias("c5"), F.col("turn").alias("t5"), "n_passages")
    links = threads(answered).join(counts, F.col("conv").eqNullSafe(F.col("c5")) & (F.col("turn") == F.col("t5"))).select(F.col("conv").alias("c2"), F.col("turn").alias("t2"), "parent", "root", "n_passages")
    whole = parsed.groupBy("conv").agg(F.count("*").alias("size")).where(F.col("size") > part).select(F.col("conv").alias("c3"), F.lit(True).alias("long"))
    rows = parsed.join(links, F.col("conv").eqNullSafe(F.col("c2")) & (F.col("turn") == F.col("t2")), "left").join(whole, F.col("conv").eqNullSafe(F.col("c3")), "left")
    rows = rows.withColumn("thread", F.coalesce("root", "turn")).select("conv", "turn", "role", "body", "n_quotes", "depth", "parent", F.coalesce("n_passages", F.lit(0)).alias("n_passages"), "thread", "long")
    rows = stored(rows, "chat-rows")
    short = rows.where("long is null").withColumn("part", F.lit(0).cast("bigint"))
    longer = positions(rows.where("long")).withColumn("part", F.floor(F.col("place") / part).cast("bigint")).drop("place")
    rows = short.unionByName(longer)
    grouped = rows.groupBy("conv", "part").agg(
        F.count("*").alias("n_messages"),
        F.sum("n_quotes").alias("n_quotes"),
        F.count("parent").alias("n_linked"),
        F.sum("n_passages").alias("n_passages"),
        F.max("depth").alias("depth"),
        F.sort_array(F.collect_list(F.struct("thread", "turn", "role", "body", "parent"))).alias("m"),
    )
    chat = F.array_join(F.transform("m", lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["body"], F.lit("\n<|end|>\n"))), "")
    return grouped.select(F.col("conv").alias(conv_col), "part", "n_messages", "n_quotes", "n_linked", "n_passages", "depth", F.transform("m", lambda m: m["turn"]).alias("turns"), F.transform("m", lambda m: m["parent"]).alias("parents"), chat.alias("chat"))
