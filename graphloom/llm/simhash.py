"""SimHash near-duplicates, linked through BK-trees.

Texts with equal fingerprints are one node.  Two fingerprints that differ in
at most two of 64 bits agree on six of eight bytes, so each fingerprint is
dealt to one shard for every choice of six bytes; a shard's BK-tree (children
keyed by their Hamming distance to the parent) is searched along the edges
within the radius only.  A shard holds at most 2**16 fingerprints, as only two
bytes of its members vary, however many documents there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, column, connected_components, stored

RADIUS = 2
SHINGLE = 3
SEED = 42


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """SimHash over the XXH64 of word shingles, repeats included; 0 without words."""
    words = text.lower().split()  # on bytes: A-Z only, and ASCII white space
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(line, SEED)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], stops[:-size])).tolist()
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(line[s:e], SEED) for s, e in zip(starts, (stops[size - 1 :] - 1).tolist())])
    n = len(hashes) // 8
    ones = np.zeros(64, np.int64)
    grid = np.frombuffer(hashes, np.uint8).reshape(n, 8)
    for at in range(0, n, 65536):
        ones += np.unpackbits(grid[at : at + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp bigint)`` per row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t) for t in bytes_of(batch)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"doc_id {kind}, fp bigint")


class BkTree:
    """Fingerprints by Hamming distance; children keyed by the distance to their parent."""

    def __init__(self) -> None:
        self.value: list[int] = []
        self.children: list[dict[int, int]] = []

    def search(self, want: int, radius: int) -> list[int]:
        """Nodes within the radius, following only edges that can lead there."""
        found, todo = [], [0] if self.value else []
        while todo:
            node = todo.pop()
            d = (self.value[node] ^ want).bit_count()
            if d <= radius:
                found.append(node)
            children = self.children[node]
            if len(children) <= 2 * radius + 1:
                todo += [c for k, c in children.items() if d - radius <= k <= d + radius]
            else:
                todo += [children[k] for k in range(d - radius, d + radius + 1) if k in children]
        return found

    def add(self, value: int) -> int:
        new = len(self.value)
        self.value.append(value)
        self.children.append({})
        at = 0 if new else None
        while at is not None:
            d = (self.value[at] ^ value).bit_count()
            at, parent = self.children[at].get(d), at
            if at is None:
                self.children[parent][d] = new
        return new


def forest(values: list[int], radius: int, holds: Callable[[int, int], bool] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among fingerprints; with ``holds``, of
    those links only for which it is true of the two places."""
    tree, root, links = BkTree(), list(range(len(values))), []

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, v in enumerate(values):
        for j in tree.search(v, radius):
            a, b = top(i), top(j)
            if a != b and (holds is None or holds(i, j)):
                root[a] = b
                links.append((i, j))
        tree.add(v)
    return links


#: For each choice of six bytes, the mask that keeps them (as a signed 64-bit number).
MASKS = [int(np.array(sum(255 << 8 * b for b in keep), np.uint64).view(np.int64)) for keep in combinations(range(8), 6)]


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links among the distinct ``fp`` of ``nodes(fp, node)`` that join the same
    classes as all links within ``radius`` (at most two): ``(u, v)`` node ids."""
    if radius > 2:
        raise ValueError("eight bytes find pairs of at most two bits")
    spread = nodes.select("fp", "node", F.explode(F.array(*(F.struct(F.lit(i).cast("tinyint").alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(MASKS)))).alias("shard")).select("shard.choice", "shard.key", "fp", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def joined(choice: np.ndarray, key: np.ndarray, fp: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
            cut = np.flatnonzero(np.append(True, (choice[1:] != choice[:-1]) | (key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
            size = np.diff(np.append(cut, len(key)))
            u: list[int] = []
            v: list[int] = []
            for s, n in zip(cut[size > 1].tolist(), size[size > 1].tolist()):
                for i, j in forest(fp[s : s + n].tolist(), radius):
                    u.append(int(node[s + i]))
                    v.append(int(node[s + j]))
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        rest: list[np.ndarray] | None = None
        for batch in batches:
            cols = [column(batch, c).to_numpy(zero_copy_only=False) for c in ("choice", "key", "fp", "node")]
            cols[2] = cols[2].view(np.uint64)
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols)]
            if not len(cols[0]):
                continue
            # the last shard may go on in the next batch
            last = int(np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))[-1]) + 1 if ((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1])).any() else 0
            yield joined(*(c[:last] for c in cols))
            rest = [c[last:] for c in cols]
        if rest is not None:
            yield joined(*rest)

    return spread.repartition("choice", "key").sortWithinPartitions("choice", "key").mapInArrow(run, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``(id_col, fingerprint, component_id)`` per row of ``docs``.

    ``component_id`` is the smallest id reachable over links of at most
    ``radius`` differing bits, the row's own id included.  Texts without words
    (null, empty, white space) have fingerprint zero and are linked like any
    other.  Rows without an id take the class of rows of their fingerprint
    that have one, else a null ``component_id``; they link nothing.  Rows that
    share an id are one document.  Repeated rows give repeated rows; other
    columns are ignored."""
    found = stored(fingerprints(docs, id_col, text_col), "simhash-fp")
    nodes = stored(found.groupBy("fp").agg(F.min(F.col("doc_id").cast("bigint")).alias("node")), "simhash-nodes")
    named = nodes.where("node is not null")
    roots = connected_components(links(named, radius), "simhash-cc")
    classes = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return found.join(classes, "fp", "left").select(F.col("doc_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component_id").cast(docs.schema[id_col].dataType))


# Near-duplicate documents at a Jaccard similarity of 0.8 or more, for filtering
# a corpus.  Candidates come from 256-bit fingerprints of the distinct five-word
# shingles: texts at 0.8 differ in 39 bits on average (standard deviation 6), at
# most in 48 where they have few shingles.  At such a radius no choice of equal
# bytes helps, so shards are named by bands of four minimum hashes; a pair at 0.8
# misses all 18 bands once in 13,000.  Every link is then verified on the sets of
# shingles themselves (their 64-bit hashes), before classes are made.

WIDE_SHINGLE, WIDE_BITS, WIDE_RADIUS = 5, 256, 46
#: Differing bits of a candidate: four standard deviations over the mean at 0.8.
CANDIDATE_RADIUS = 72
BANDS, BAND_ROWS = 18, 4
#: Members and shingles of a shard that one BK-tree holds; larger shards are dealt to cells of two slices.
SHARD, SHARD_SHINGLES = 2000, 1 << 21

_SEEDS = np.random.default_rng(42).integers(1, 2**63, (2, BANDS * BAND_ROWS), np.uint64) | np.uint64(1)
_SPREAD = np.random.default_rng(43).integers(1, 2**63, WIDE_BITS // 64, np.uint64) | np.uint64(1)


def shingle_set(text: bytes) -> np.ndarray:
    """The sorted distinct XXH64 of a text's five-word shingles; a shorter text is one."""
    words = text.lower().split()
    line, size = b" ".join(words), WIDE_SHINGLE
    if len(words) <= size:
        shingles = [line]
    else:
        stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], stops[:-size])).tolist()
        shingles = [line[s:e] for s, e in zip(starts, (stops[size - 1 :] - 1).tolist())]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s, SEED) for s in shingles), np.uint64, len(shingles)))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of 0.8 or more."""
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 5 * common >= 4 * (len(both) - common)


def wide_fingerprint(text: bytes) -> tuple[bytes, np.ndarray]:
    """The 256-bit SimHash of a text, and the 18 keys of its bands."""
    h = shingle_set(text)
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(WIDE_BITS, np.int64)
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for low in range(0, len(h), 8192):
        part = h[low : low + 8192, None]
        wide = part * _SPREAD
        wide ^= wide >> np.uint64(31)
        wide *= np.uint64(0xD6E8FEB86659FD93)
        wide ^= wide >> np.uint64(32)
        ones += np.unpackbits(np.ascontiguousarray(wide).view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
        least = np.minimum(least, (part * _SEEDS[0] + _SEEDS[1]).min(axis=0))
    keys = [digest(row.tobytes(), band) for band, row in enumerate(least.reshape(BANDS, BAND_ROWS))]
    return np.packbits(2 * ones > len(h)).tobytes(), np.array(keys, np.uint64).view(np.int64)


def in_shards(shards: DataFrame, joined: Callable[[list[list]], pa.RecordBatch], names: tuple[str, ...]) -> DataFrame:
    """``(u, v)`` that ``joined`` gives for whole shards (``key``, ``a``, ``b``): it
    gets a list of the shards and one of each column of ``names``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[list] = [[] for _ in range(len(names) + 1)]
        for batch in batches:
            keys = list(zip(*(column(batch, c).to_pylist() for c in ("key", "a", "b"))))
            cols = [r + c for r, c in zip(rest, (keys, *(column(batch, c).to_pylist() for c in names)))]
            last = len(cols[0])
            while last and cols[0][last - 1] == cols[0][-1]:  # the last shard may go on in the next batch
                last -= 1
            yield joined([c[:last] for c in cols])
            rest = [c[last:] for c in cols]
        yield joined(rest)

    return shards.select("key", "a", "b", *names).repartition("key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(run, "u bigint, v bigint")


def cells(spread: DataFrame, slices: Column) -> DataFrame:
    """``spread`` with ``a`` and ``b``: shards of more than one of ``slices`` (an
    aggregate over a shard) are dealt to cells, one for every two slices."""
    large = spread.groupBy("key").agg(slices.cast("bigint").alias("slices")).where("slices > 1").select(F.col("key").alias("k2"), "slices")
    dealt = spread.join(large, F.col("key") == F.col("k2"), "left").withColumn("mine", F.when(F.col("slices").isNotNull(), F.pmod(F.xxhash64("node"), F.col("slices"))))
    out = dealt.withColumn("other", F.explode(F.when(F.col("slices").isNull(), F.array(F.lit(None).cast("bigint"))).otherwise(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1))))
    return out.withColumn("a", F.coalesce(F.least("mine", "other"), F.lit(0))).withColumn("b", F.coalesce(F.greatest("mine", "other"), F.lit(0)))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = CANDIDATE_RADIUS) -> DataFrame:
    """``(id, text_hash, n, kept)`` per distinct id and text: in how many rows it
    occurs, and whether it stands for its class of copies and near copies (the
    smallest id does, null ids last).  Classes are chains of pairs whose sets of
    shingles have a Jaccard similarity of 0.8 or more.

    Shards of the bands give candidate links of at most ``radius`` bits.  What
    they connect is one shard of the second pass, which has the sets, so that a
    text's set travels once and only if the text has a candidate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [wide_fingerprint(t) for t in bytes_of(batch)]
            yield pa.RecordBatch.from_arrays([column(batch, "id"), column(batch, "text_hash"), pa.array([f for f, _ in found], pa.binary()), pa.array([k for _, k in found], pa.list_(pa.int64()))], ["id", "text_hash", "wide", "keys"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                found = [shingle_set(t) for t in bytes_of(part)]
                yield pa.RecordBatch.from_arrays([column(part, "key"), column(part, "node"), column(part, "wide"), pa.array([len(h) for h in found], pa.int64()), pa.array([h.tobytes() for h in found], pa.binary())], ["key", "node", "wide", "size", "shingles"])

    def linked(cols: list[list]) -> pa.RecordBatch:
        u: list[int] = []
        v: list[int] = []
        keys, nodes, wides, *rest = cols
        s = 0
        for e in [*(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]:
            if e - s > 1:
                holds = None
                if rest:
                    own = [np.frombuffer(x, np.uint64) for x in rest[0][s:e]]
                    holds = lambda i, j, own=own: similar(own[i], own[j])
                for i, j in forest([int.from_bytes(w, "big") for w in wides[s:e]], radius, holds):
                    u.append(nodes[s + i])
                    v.append(nodes[s + j])
            s = e
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    scanned = stored(rows.mapInArrow(run, f"id {kind}, text_hash bigint, wide binary, keys array<bigint>"), "near-scan")
    texts = scanned.select("text_hash", "wide", "keys").dropDuplicates(["text_hash"])
    spread = stored(texts.select(F.explode("keys").alias("key"), F.col("text_hash").alias("node"), "wide"), "near-spread")
    candidates = connected_components(in_shards(cells(spread, F.ceil(F.count("*") / SHARD)), linked, ("node", "wide")), "near-candidates")
    # the smallest member of what candidates connect is no node of theirs
    named = stored(candidates.select("node", F.col("root").alias("key")).union(candidates.select("root", "root")).distinct(), "near-named")
    wanted = named.join(texts.select(F.col("text_hash").alias("h2"), "wide"), F.col("node") == F.col("h2")).select("key", "node", "wide")
    held = rows.dropDuplicates(["text_hash"]).join(wanted, F.col("text_hash") == F.col("node")).select("key", "node", "wide", "text")
    found = held.mapInArrow(sets, "key bigint, node bigint, wide binary, size bigint, shingles binary")
    sized = stored(found, "near-sets")
    edges = in_shards(cells(sized, F.ceil(F.greatest(F.count("*") / SHARD, F.sum("size") / SHARD_SHINGLES))), linked, ("node", "wide", "shingles"))
    roots = connected_components(edges, "near-cc")
    members = scanned.groupBy("id", "text_hash").agg(F.count("*").alias("n"))
    classes = members.join(roots, F.col("text_hash") == F.col("node"), "left").withColumn("root", F.coalesce("root", "text_hash")).select("id", "text_hash", "n", "root")
    best = classes.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("best")).select(F.col("root").alias("r2"), "best")
    return classes.join(best, F.col("root") == F.col("r2")).select("id", "text_hash", "n", (F.col("best.id").eqNullSafe(F.col("id")) & (F.col("best.text_hash") == F.col("text_hash"))).alias("kept"))


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each class of copies and near copies, all columns kept."""
    found = stored(near_copies(docs, id_col, text_col), "near-classes")
    gone = found.where(~F.col("kept")).select(F.col("id").alias("gone_id"), F.col("text_hash").alias("gone_hash"))
    names = docs.columns
    rows = docs.select(F.struct(*(docs[c] for c in names)).alias("row")).withColumn("text_hash", F.xxhash64(F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))))
    left = rows.join(gone, F.col(f"row.`{id_col}`").eqNullSafe(F.col("gone_id")) & (F.col("text_hash") == F.col("gone_hash")), "left_anti")
    if found.where("kept and n > 1").limit(1).count():  # rows that are repeated as they are
        left = left.withColumn("id", F.col(f"row.`{id_col}`")).dropDuplicates(["id", "text_hash"])
    return left.select(*(F.col(f"row.`{c}`").alias(c) for c in names))
