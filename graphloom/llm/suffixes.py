"""Removal of repeated passages, exact to the byte, by blockwise suffix sorting.

A suffix matters up to ``LENGTH`` bytes only: its window.  The window's bucket is
the smallest hash among its 20-byte strings, so that equal windows share a
bucket and neighbouring windows mostly do too, and a stretch of text travels
once.  Buckets that only one document has are found first and go nowhere.  The
suffixes of the others are sorted one block of buckets at a time: by their first
bytes, and where these tie by the ranks of a difference cover sample that is
sorted beforehand.  Each class of equal windows then knows its smallest document.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, scratch_path, stored, utf8_column

#: Bytes of a window, and of the strings whose hashes name its bucket.
LENGTH, GRAM = 50, 20
#: Text bytes of a batch of documents; a longer document is a batch of its own.
BATCH_BYTES = 4 << 20
#: Batches per partition of buckets; window positions that are sorted at a time.
BATCHES_PER_PART, BLOCK_WINDOWS = 3, 1 << 18
#: Bytes that are compared before the cover sample decides, and the cover: every
#: difference modulo 7 is one of two members of {0, 1, 3}.
PREFIX, PERIOD, COVER = 24, 7, (0, 1, 3)
#: Bytes by which the sample is ranked: the furthest sample still ends in the window.
SAMPLE = LENGTH - PREFIX
NEVER = np.iinfo(np.int64).max
_B = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)

#: For two suffixes by position modulo the period, the distance, at most PREFIX, to sampled positions of both.
SHIFT = np.array([[max(d for d in range(PREFIX + 1) if (r + d) % PERIOD in COVER and (s + d) % PERIOD in COVER) for s in range(PERIOD)] for r in range(PERIOD)], np.int64)
assert SHIFT.min() > PREFIX - PERIOD and SHIFT.min() + SAMPLE >= LENGTH - 8


def bucket_keys(text: np.ndarray) -> np.ndarray:
    """For each window start the smallest mixed hash of its GRAM-byte strings."""
    if len(text) < LENGTH:
        return np.zeros(0, np.uint64)
    powers = {n: np.uint64(pow(int(_B), n, 1 << 64)) for n in (1, 2, 4, 8)}
    h = text.astype(np.uint64) + np.uint64(1)
    four = None
    for n in (1, 2, 4, 8):
        h = h[:-n] * powers[n] + h[n:]
        four = h if n == 2 else four
    h = h[: -(GRAM - 16)] * powers[4] + four[16:]
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    for n in (1, 2, 4, 8):
        h = np.minimum(h[:-n], h[n:])
    width = LENGTH - GRAM + 1
    return np.minimum(h[: len(h) - (width - 16)], h[width - 16 :])


class Batch:
    """A batch of documents with its stretches: runs of windows of one bucket."""

    def __init__(self, blob: bytes, parts: int):
        raw = zstandard.decompress(blob)
        (n,) = struct.unpack_from("<q", raw)
        self.ids = np.frombuffer(raw, np.int64, n, 8)
        self.sizes = np.frombuffer(raw, np.int64, n, 8 + 8 * n)
        self.data = raw[8 + 16 * n :]
        ends = np.cumsum(self.sizes)
        self.starts = ends - self.sizes
        keys = bucket_keys(np.frombuffer(self.data, np.uint8))
        # windows that end in another document than they start in are none
        edge = np.zeros(len(keys) + 1, np.int64)
        low = np.minimum(np.maximum(self.starts, ends - LENGTH + 1), len(keys))
        np.add.at(edge, low, 1)
        np.add.at(edge, np.minimum(ends, len(keys)), -1)
        valid = np.cumsum(edge[:-1]) == 0
        first = np.ones(len(keys), bool)
        first[1:] = (keys[1:] != keys[:-1]) | ~valid[:-1]
        first[self.starts[self.starts < len(keys)]] = True
        cut = np.flatnonzero(first & valid)
        stop = np.flatnonzero(np.append((first | ~valid)[1:], True) & valid) if len(keys) else cut
        self.cut, self.windows, self.key = cut, stop - cut + 1, keys[cut]
        self.doc = np.searchsorted(ends, cut, "right")
        self.part = ((self.key * _B >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys by part and key: part, key, whether two documents of the
        batch have it, and the number of each stretch's key among them."""
        order = np.lexsort((self.key, self.part))
        key, part, ids = self.key[order], self.part[order], self.ids[self.doc[order]]
        new = np.append(True, (key[1:] != key[:-1]) | (part[1:] != part[:-1]))[: len(key)]
        cuts = np.flatnonzero(new)
        if not len(cuts):
            return part, key, np.zeros(0, bool), np.zeros(0, np.int64)
        shared = np.minimum.reduceat(ids, cuts) != np.maximum.reduceat(ids, cuts)
        number = np.empty(len(key), np.int64)
        number[order] = np.cumsum(new) - 1
        return part[cuts], key[cuts], shared, number

    def repeated(self, parts: list[int], bits: list[bytes]) -> np.ndarray:
        """Stretches whose bucket another document has, from the parts' answers."""
        part, _, _, number = self.distinct()
        flags = np.zeros(len(part), bool)
        bounds = np.searchsorted(part, np.array(parts)), np.searchsorted(part, np.array(parts), "right")
        for s, e, b in zip(*bounds, bits):
            flags[s:e] = np.unpackbits(np.frombuffer(b, np.uint8), count=e - s)
        return np.flatnonzero(flags[number]) if len(number) else number

    def stretches(self, which: np.ndarray) -> tuple[dict[int, list[bytes]], dict[int, list[int]], list[tuple[int, int]]]:
        """Per part the distinct stretches of bytes and the smallest document that
        has each; and for each of ``which`` its part and number there."""
        texts: dict[int, list[bytes]] = {}
        least: dict[int, list[int]] = {}
        seen: dict[bytes, tuple[int, int]] = {}
        places = []
        ids = self.ids[self.doc[which]].tolist()
        for s, n, p, i in zip(self.cut[which].tolist(), self.windows[which].tolist(), self.part[which].tolist(), ids):
            piece = self.data[s : s + n + LENGTH - 1]
            at = seen.get(piece)
            if at is None:
                mine = texts.setdefault(p, [])
                at = seen[piece] = (p, len(mine))
                mine.append(piece)
                least.setdefault(p, []).append(i)
            elif i < least[p][at[1]]:
                least[p][at[1]] = i
            places.append(at)
        return texts, least, places


def prefix_sort(at: np.ndarray, words, offsets: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Order of positions by the 8-byte words at the offsets, and whether each
    one in that order begins a new group; only ties are looked at again."""
    key = words(at + offsets[0])
    order = np.argsort(key)
    key = key[order]
    new = np.append(True, key[1:] != key[:-1])[: len(key)]
    for offset in offsets[1:]:
        group = np.cumsum(new)
        tied = np.flatnonzero(~new | ~np.append(new[1:], True))
        if not len(tied):
            break
        own = group[tied]
        key = words(at[order[tied]] + offset)
        o = np.lexsort((key, own))
        order[tied] = order[tied][o]
        key = key[o]
        new[tied[1:]] |= key[1:] != key[:-1]
    return order, new


def window_classes(text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of the windows at the given positions of ``text``, and
    whether each one in that order differs from the one before it."""
    padded = np.append(text, np.zeros(64, np.uint8))
    grams = np.lib.stride_tricks.sliding_window_view(padded, 8)

    def words(p: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(grams[p]).view(">u8").ravel().astype(np.uint64)

    order, new = prefix_sort(at, words, tuple(range(0, PREFIX, 8)))
    tied = np.flatnonzero(~new | ~np.append(new[1:], True))
    if not len(tied):
        return order, new
    # the cover sample, where a tied suffix can ask for it
    needed = np.zeros(len(padded), bool)
    for shift in range(PREFIX - PERIOD + 1, PREFIX + 1):
        needed[at[order[tied]] + shift] = True
    sample = np.flatnonzero(needed)
    sample = sample[np.isin(sample % PERIOD, COVER)]
    by, fresh = prefix_sort(sample, words, (*range(0, SAMPLE - 8, 8), SAMPLE - 8))
    rank = np.zeros(len(padded), np.int64)
    rank[sample[by]] = np.cumsum(fresh)
    open_ = np.zeros(len(order), bool)
    open_[tied] = True
    while True:  # three-way quicksort of all tied groups at once
        todo = np.flatnonzero(open_)
        if not len(todo):
            return order, new
        begins = new[todo]
        pivot = todo[begins][np.cumsum(begins) - 1]
        i, j = at[order[todo]], at[order[pivot]]
        shift = SHIFT[i % PERIOD, j % PERIOD]
        side = np.sign(rank[i + shift] - rank[j + shift])
        same = np.flatnonzero(side == 0)
        a, b = words(i[same] + LENGTH - 8), words(j[same] + LENGTH - 8)
        side[same] = (a > b).astype(np.int64) - (a < b)
        o = np.lexsort((side, pivot))
        order[todo] = order[todo][o]
        side, pivot = side[o], pivot[o]
        new[todo[1:]] = (side[1:] != side[:-1]) | (pivot[1:] != pivot[:-1])
        alone = new[todo] & np.append(new[todo[1:]], True)
        open_[todo] = (side != 0) & ~alone


def smallest_documents(pieces: list[bytes], least: np.ndarray) -> list[np.ndarray]:
    """For each stretch (of one block of buckets) and each of its windows the
    smallest document among all that have the window."""
    text = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    windows = sizes - LENGTH + 1
    ends = np.cumsum(windows)
    owner = np.repeat(np.arange(len(pieces)), windows)
    at = np.arange(len(owner)) + owner * (LENGTH - 1)
    order, new = window_classes(text, at)
    cuts = np.flatnonzero(new)
    low = np.minimum.reduceat(least[owner[order]], cuts)
    out = np.empty(len(owner), np.int64)
    out[order] = low[np.cumsum(new) - 1]
    return np.split(out, ends[:-1])


def pack_stretches(texts: list[bytes], least: list[int]) -> bytes:
    head = np.fromiter(map(len, texts), np.int64, len(texts)).tobytes() + np.array(least, np.int64).tobytes()
    return zstandard.compress(struct.pack("<q", len(texts)) + head + b"".join(texts), 1)


def unpack_stretches(blob: bytes) -> tuple[list[bytes], np.ndarray]:
    raw = zstandard.decompress(blob)
    (n,) = struct.unpack_from("<q", raw)
    ends = (8 + 16 * n + np.cumsum(np.frombuffer(raw, np.int64, n, 8))).tolist()
    return [raw[s:e] for s, e in zip([8 + 16 * n, *ends], ends)], np.frombuffer(raw, np.int64, n, 8 + 8 * n)


def pack_runs(values: list[np.ndarray]) -> bytes:
    """Per stretch the runs of equal smallest documents."""
    flat = np.concatenate(values)
    sizes = np.fromiter(map(len, values), np.int64, len(values))
    first = np.append(True, flat[1:] != flat[:-1])
    first[np.cumsum(sizes)[:-1]] = True
    cuts = np.flatnonzero(first)
    runs = np.diff(np.append(cuts, len(flat)))
    return zstandard.compress(struct.pack("<qq", len(values), len(cuts)) + sizes.tobytes() + runs.tobytes() + flat[cuts].tobytes(), 1)


def unpack_runs(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All windows' smallest documents, and the offset of each stretch."""
    raw = zstandard.decompress(blob)
    n, m = struct.unpack_from("<qq", raw)
    sizes = np.frombuffer(raw, np.int64, n, 16)
    flat = np.repeat(np.frombuffer(raw, np.int64, m, 16 + 8 * n + 8 * m), np.frombuffer(raw, np.int64, m, 16 + 8 * n))
    return flat, np.cumsum(sizes) - sizes


def count_keys(table: pa.Table) -> pa.Table:
    """For each batch, which of its keys of a part another document has."""
    blobs, own = table.column("keys").to_pylist(), table.column("shared").to_pylist()
    sizes = [len(b) // 6 for b in blobs]
    raw = np.zeros((sum(sizes), 8), np.uint8)
    raw[:, :6] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 6)
    all_ = raw.view(np.uint64).ravel()
    shared = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in zip(own, sizes)]).astype(bool)
    order = np.argsort(all_)
    sorted_ = all_[order]
    new = np.append(True, sorted_[1:] != sorted_[:-1])
    cuts = np.flatnonzero(new)
    many = np.logical_or.reduceat(shared[order], cuts) | (np.diff(np.append(cuts, len(order))) > 1)
    flags = np.empty(len(order), bool)
    flags[order] = many[np.cumsum(new) - 1]
    bits = [np.packbits(f).tobytes() for f in np.split(flags, np.cumsum(sizes)[:-1])]
    return pa.table({"batch": table.column("batch"), "part": table.column("part"), "bits": pa.array(bits, pa.binary())})


def sort_part(table: pa.Table) -> pa.Table:
    """For each batch, the smallest documents of the windows of its stretches."""
    seen: dict[bytes, int] = {}
    numbers: list[np.ndarray] = []
    least: list[np.ndarray] = []
    for blob in table.column("stretches"):
        texts, docs_ = unpack_stretches(blob.as_py())
        numbers.append(np.array([seen.setdefault(t, len(seen)) for t in texts], np.int64))
        least.append(docs_)
    low = np.full(len(seen), NEVER, np.int64)
    np.minimum.at(low, np.concatenate(numbers), np.concatenate(least))
    pieces = list(seen)
    # one block of buckets at a time: equal windows have equal keys, so blocks are ranges of a hash of the key
    own = bucket_keys(np.frombuffer(b"".join([p[:LENGTH] for p in pieces]), np.uint8))[::LENGTH]
    windows = np.fromiter(map(len, pieces), np.int64, len(pieces)) - LENGTH + 1
    blocks = max(1, int(windows.sum()) // BLOCK_WINDOWS)
    block = (own * _MIX >> np.uint64(33)) % np.uint64(blocks)
    answers: list[np.ndarray] = [None] * len(pieces)
    order = np.argsort(block, kind="stable")
    for mine in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
        for i, answer in zip(mine.tolist(), smallest_documents([pieces[i] for i in mine.tolist()], low[mine])):
            answers[i] = answer
    runs = [pack_runs([answers[i] for i in n.tolist()]) for n in numbers]
    return pa.table({"batch": table.column("batch"), "part": table.column("part"), "runs": pa.array(runs, pa.binary())})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Remove each byte of a text's UTF-8 form that a 50-byte string covers which
    also starts in a document with a smaller id; overlaps count, and strings are
    judged on the input.  Returns ``id_col, n_bytes, n_removed, n_spans,
    kept_sha256`` and, with ``with_text``, ``spans`` (start and end of removed
    runs, in bytes) and ``kept binary``.

    Null texts are empty.  Rows that share an id are one document: they remove
    nothing from each other.  A null id counts as larger than all others.
    Repeated rows give repeated rows; other columns are ignored.  Memory of a
    task follows ``BATCH_BYTES`` or the longest document."""
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        data: list[bytes] = []
        held = 0

        def full() -> pa.RecordBatch:
            i, s = np.concatenate(ids), np.concatenate(sizes)
            blob = zstandard.compress(struct.pack("<q", len(i)) + i.tobytes() + s.tobytes() + b"".join(data), 1)
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | number], pa.int64()), pa.array([blob], pa.binary())], ["batch", "blob"])

        for batch in batches:
            own = column(batch, "id").fill_null(NEVER).to_numpy(zero_copy_only=False)
            raw, at = utf8_column(batch, "text")
            low = 0
            while low < len(own):
                high = max(low + 1, int(np.searchsorted(at, at[low] + BATCH_BYTES - held, "right")) - 1)
                ids.append(own[low:high])
                sizes.append(np.diff(at[low : high + 1]))
                data.append(raw[at[low] : at[high]].tobytes())
                held += int(at[high] - at[low])
                low = high
                if low < len(own) or held >= BATCH_BYTES:
                    yield full()
                    number += 1
                    ids, sizes, data, held = [], [], [], 0
        if ids:
            yield full()

    # Buckets of a table by batch: what comes back for a batch is shuffled to it, not the texts.
    packed = rows.mapInArrow(pack, "batch bigint, blob binary")
    name, deal = "batches_" + scratch_path(spark, "x").rpartition("-")[2], max(1, min(4096, docs.rdd.getNumPartitions() * 2))
    packed.write.bucketBy(deal, "batch").sortBy("batch").option("path", scratch_path(spark, "batches")).saveAsTable(name)
    batches = spark.table(name)
    parts = max(1, batches.count() // BATCHES_PER_PART)

    def keys(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for records in found:
            for number, blob in zip(column(records, "batch").to_pylist(), column(records, "blob")):
                part, key, shared, _ = Batch(blob.as_py(), parts).distinct()
                cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)])
                out = [(int(part[s]), number, key[s:e].view(np.uint8).reshape(-1, 8)[:, :6].tobytes(), np.packbits(shared[s:e]).tobytes()) for s, e in zip(cuts, [*cuts[1:], len(part)])]
                cols = list(zip(*out)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], ["part", "batch", "keys", "shared"])

    hits = batches.mapInArrow(keys, "part int, batch bigint, keys binary, shared binary").groupBy("part").applyInArrow(count_keys, "batch bigint, part int, bits binary")
    hits = stored(hits, "suffix-hits")

    def repeated(left: pa.Table, right: pa.Table) -> tuple[Batch, np.ndarray]:
        batch = Batch(left.column("blob")[0].as_py(), parts)
        return batch, batch.repeated(right.column("part").to_pylist(), right.column("bits").to_pylist())

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        batch, which = repeated(left, right)
        texts, least, _ = batch.stretches(which)
        order = sorted(texts)
        number = left.column("batch")[0].as_py()
        return pa.table({"part": pa.array(order, pa.int32()), "batch": pa.array([number] * len(order), pa.int64()), "stretches": pa.array([pack_stretches(texts[p], least[p]) for p in order], pa.binary())})

    sent = batches.groupBy("batch").cogroup(hits.groupBy("batch")).applyInArrow(send, "part int, batch bigint, stretches binary")
    answers = stored(sent.groupBy("part").applyInArrow(sort_part, "batch bigint, part int, runs binary"), "suffix-answers")

    def finish(left: pa.Table, right: pa.Table, ids: pa.Table) -> pa.Table:
        batch, which = repeated(left, right)
        _, _, places = batch.stretches(which)
        runs = {p.as_py(): unpack_runs(r.as_py()) for p, r in zip(ids.column("part"), ids.column("runs")) if p.is_valid}
        # all windows of the stretches at once: where each starts, and who has it first
        bases, flats, total = {}, [], 0
        for part, (flat, starts) in runs.items():
            bases[part] = starts + total
            flats.append(flat)
            total += len(flat)
        begins = np.zeros(len(batch.data) + 1, bool)
        if len(which):
            answers_at = np.fromiter((bases[part][n] for part, n in places), np.int64, len(places))
            windows = batch.windows[which]
            owner = np.repeat(np.arange(len(which)), windows)
            step = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
            gone = np.concatenate(flats)[answers_at[owner] + step] < batch.ids[batch.doc[which]][owner]
            begins[(batch.cut[which][owner] + step)[gone]] = True
        upto = np.cumsum(begins[:-1])
        covered = upto > 0
        covered[LENGTH:] = upto[LENGTH:] > upto[:-LENGTH]
        any_ = np.concatenate(([0], np.cumsum(covered)))
        raw = np.frombuffer(batch.data, np.uint8)
        out: dict[str, list] = {n: [] for n in names}
        for i, s, n in zip(batch.ids.tolist(), batch.starts.tolist(), batch.sizes.tolist()):
            lost = int(any_[s + n] - any_[s])
            if lost:
                c = covered[s : s + n]
                edge = np.flatnonzero(np.diff(c, prepend=False, append=False))
                kept = raw[s : s + n][~c].tobytes()
            else:
                edge, kept = np.zeros(0, np.int64), batch.data[s : s + n]
            values = (None if i == NEVER else i, n, lost, len(edge) // 2, hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist())] if with_text else None, kept if with_text else None)
            for name_, v in zip(names, values):
                out[name_].append(v)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
        return pa.table([pa.array(out[n], k) for n, k in zip(names, kinds)], names=names)

    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["spans", "kept"] * with_text
    # both kinds of answers of a batch come in one table
    both = hits.join(answers.select("batch", "part", "runs"), ["batch", "part"], "left").select("batch", "part", "bits", "runs")
    schema = "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", spans array<struct<start bigint, end bigint>>, kept binary" * with_text

    def ending(left: pa.Table, right: pa.Table) -> pa.Table:
        have = right.filter(pc.is_valid(right.column("runs")))
        return finish(left, right, have)

    result = batches.groupBy("batch").cogroup(both.groupBy("batch")).applyInArrow(ending, schema)
    return result.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), *(names[1:]))
