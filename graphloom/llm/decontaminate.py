"""Benchmark decontamination by latent semantic retrieval.

Word weights are inverse document frequencies over all documents.  Benchmark
passages are decomposed by a randomised SVD of their TF-IDF matrix, in blocks
that are spread over the cluster.  Every passage of every document is projected
into these latent spaces; where the cosine to a benchmark passage is high
enough, the longest common subsequence of words and the words of the item's
answer decide, so that paraphrases are found and chance likeness is not.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, stored, texts_of

#: Hash buckets of document frequencies.
BUCKETS = 1 << 16
#: Words of a document passage, and how far the next one begins after it.
WINDOW, STRIDE = 32, 16
#: Words of a benchmark passage, and how far the next one begins after it: an item
#: is its passages (itself, if it has no more words), and leaks if one of them does.
PART, STEP = 64, 32
#: Benchmark passages that share a latent space, its dimensions, and spaces that one scan of the documents serves.
BLOCK, RANK, SPACES = 256, 160, 8
#: Least cosine of a candidate, to the part of the window or the passage that is
#: the smaller; shares of a passage's words that a leak must have in order, without
#: and with the answer check; share of the answer's words.
COSINE, COPIED, REWORDED, ANSWERED = 0.4, 0.7, 0.6, 0.8
#: Share of a passage's words that a leak must have in any order within as many
#: words and a quarter more, if at least half of them are in order.
SHUFFLED, HALF = 0.85, 0.5
#: Passages of fewer words have to stand as they are: parts of them are chance.
EXACT = 5

_POWERS = np.cumprod(np.full(256, 0x9E3779B97F4A7C15 | 1, np.uint64), dtype=np.uint64)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def word_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit codes of the lower-cased words of all texts, one after another,
    and n+1 offsets into them.  Words are runs of ASCII letters, digits and
    characters beyond ASCII."""
    data = [t.lower().encode() for t in texts]
    raw = np.frombuffer(b"\n".join([*data, b""]), np.uint8)
    word = _WORD[raw]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    starts, ends = edge[0::2], edge[1::2]
    bounds = np.cumsum([0, *(len(d) + 1 for d in data)])
    offsets = np.searchsorted(starts, bounds)
    if not len(starts):
        return np.zeros(0, np.uint64), offsets
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    place = np.arange(sizes.sum()) - np.repeat(first, sizes)
    codes = np.add.reduceat((raw[word].astype(np.uint64) + np.uint64(1)) * _POWERS[place & 255], first)
    codes ^= codes >> np.uint64(29)
    codes *= np.uint64(0xBF58476D1CE4E5B9)
    return codes ^ (codes >> np.uint64(32)), offsets


def pieces(texts: Iterator[str], size: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``size`` characters, with the number of the first."""
    at, held, chars = 0, [], 0
    for t in texts:
        held.append(t)
        chars += len(t)
        if chars >= size:
            yield at, held
            at, held, chars = at + len(held), [], 0
    if held:
        yield at, held


def frequencies(docs: DataFrame, text_col: str = "text") -> tuple[int, np.ndarray]:
    """Number of documents, and in how many each bucket's words occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = 0, np.zeros(BUCKETS, np.int64)
        for batch in batches:
            total += batch.num_rows
            for _, texts in pieces(texts_of(batch, "text")):
                codes, offsets = word_codes(texts)
                owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
                both = np.unique(owner * BUCKETS + (codes % np.uint64(BUCKETS)).astype(np.int64))
                seen += np.bincount(both % BUCKETS, minlength=BUCKETS)
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(seen[used], total))], ["bucket", "n"])

    rows = docs.select(docs[text_col].alias("text")).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # a row per bucket
    counts = {r.bucket: r.n for r in rows}
    out = np.zeros(BUCKETS, np.int64)
    for b, n in counts.items():
        if b >= 0:
            out[b] = n
    return counts.get(-1, 0), out


def weights(total: int, df: np.ndarray) -> np.ndarray:
    """Inverse document frequencies; no word weighs nothing."""
    return np.maximum(np.log((total + 1) / (df + 1)), 0.05).astype(np.float32)


def randomised_svd(a: np.ndarray, rank: int, rounds: int = 2, spare: int = 12) -> np.ndarray:
    """Right singular vectors (columns) of the largest singular values of ``a``."""
    rng = np.random.default_rng(7)
    q = rng.standard_normal((a.shape[1], min(rank + spare, min(a.shape))))
    for _ in range(rounds):
        q, _ = np.linalg.qr(a.T @ (a @ q))
    small = a @ q
    values, vectors = np.linalg.eigh(small.T @ small)
    return (q @ vectors[:, np.argsort(-values)[:rank]]).astype(np.float32)


def latent_spaces(benchmark: DataFrame, idf: np.ndarray, rank: int = RANK, text_col: str = "text") -> DataFrame:
    """``(block, space binary)``: for each block of passages its terms, their
    latent coordinates, the passages' directions, words and items, named by the
    hashes of their texts.  Passages are dealt to blocks by their words; a block
    is one task's, and small."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for item, text in zip(column(batch, "item").to_pylist(), texts_of(batch, "text")):
                codes, _ = word_codes([text])
                if not len(codes):
                    continue
                last = text.rstrip().rstrip(".!?")
                mark = max(last.rfind(x) for x in (". ", "? ", "! ", "\n"))
                answer = len(word_codes([text[mark + 1 :]])[0]) if mark >= 0 else 0
                n = len(codes)
                for s in range(0, max(1, n - STEP), STEP):
                    e = min(s + PART, n)
                    rows.append((item, codes[s:e].view(np.int64), min(answer, e - s) if e == n else 0))
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.list_(pa.int64())), pa.array(cols[2], pa.int32())], ["item", "words", "answer"])

    def decompose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        words = [np.array(w, np.int64).view(np.uint64) for w in pdf["words"]]
        terms, index = np.unique(np.concatenate(words), return_inverse=True)
        rows = np.repeat(np.arange(len(words)), [len(w) for w in words])
        a = np.zeros((len(words), len(terms)), np.float32)
        np.add.at(a, (rows, index), idf[(terms % np.uint64(BUCKETS)).astype(np.int64)][index])
        norms = np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-9)
        a /= norms
        basis = randomised_svd(a, rank)
        directions = a @ basis
        directions /= np.maximum(np.linalg.norm(directions, axis=1, keepdims=True), 1e-9)
        space = {"norms": norms.ravel(), "terms": terms, "coordinates": basis, "directions": directions, "words": words, "answers": pdf["answer"].tolist(), "items": pdf["item"].tolist()}
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "space": [pickle.dumps(space)]})

    rows = benchmark.select(F.sha2(benchmark[text_col], 256).alias("item"), benchmark[text_col].alias("text")).where("text is not null").dropDuplicates(["item"])
    passages = stored(rows.mapInArrow(cut, "item string, words array<bigint>, answer int"), "passages")
    # an even deal without a global sort: by hash into as many blocks as are needed
    blocks = max(1, -(-passages.count() // (BLOCK * 3 // 4)))
    dealt = passages.withColumn("place", F.xxhash64("words")).withColumn("block", F.pmod("place", F.lit(blocks)).cast("int"))
    return dealt.groupBy("block").applyInPandas(decompose, "block int, space binary")


def common_words(a: np.ndarray, masks: dict[int, int], size: int) -> int:
    """Length of the longest common subsequence, bit-parallel; ``masks`` has the
    places of each word in the other sequence of ``size`` words."""
    full = (1 << size) - 1
    row = full
    for w in a.tolist():
        m = masks.get(w)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return size - row.bit_count()


def masks_of(words: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words.tolist()):
        out[w] = out.get(w, 0) | 1 << i
    return out


def shuffled(there: np.ndarray, words: np.ndarray) -> float:
    """The largest share of ``words``, repeats counted, that any stretch of as many
    words and a quarter more has, in whatever order."""
    names, number = np.unique(words, return_inverse=True)
    room = np.bincount(number)
    at = np.searchsorted(names, there)
    at[at == len(names)] = 0
    spans = np.where(names[at] == there, at, -1).tolist()
    width, have, seen, best = len(words) + len(words) // 4, 0, [0] * len(names), 0
    for i, k in enumerate(spans):
        if k >= 0:
            seen[k] += 1
            have += seen[k] <= room[k]
        if i >= width and (k := spans[i - width]) >= 0:
            have -= seen[k] <= room[k]
            seen[k] -= 1
        best = max(best, have)
    return best / len(words)


def sequence_codes(codes: np.ndarray, n: int) -> np.ndarray:
    """A code for every run of ``n`` words."""
    out = np.zeros(max(0, len(codes) - n + 1), np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + len(out)]
    return out


class Finder:
    """Finds leaks of some latent spaces' items in texts."""

    def __init__(self, spaces: list[dict], idf: np.ndarray, cosine: float = COSINE):
        self.spaces, self.idf, self.cosine = spaces, idf, cosine
        for s in spaces:
            s["counts"] = [[*Counter(w.tolist()).items()] for w in s["words"]]
            s["least"] = float(s["norms"].min()) ** 2
            # passages that have to stand as they are: number of words, hash, passage
            short = [(len(w), int(sequence_codes(w, len(w))[0]), j) for j, w in enumerate(s["words"]) if len(w) < EXACT]
            s["exact"] = {}
            for n, h, j in short:
                s["exact"].setdefault(n, {}).setdefault(h, []).append(j)
            s["masks"] = [(masks_of(w), masks_of(w[len(w) - a :]) if a else {}) for w, a in zip(s["words"], s["answers"])]

    def find(self, texts: list[str]) -> list[tuple[int, object, float, float, float]]:
        """(text number, item, cosine, share of words in order, share of the answer)."""
        codes, offsets = word_codes(texts)
        counts = np.diff(offsets)
        windows = np.where(counts > 0, np.maximum(1, -(-(counts - STRIDE) // STRIDE)), 0)
        owner = np.repeat(np.arange(len(texts)), windows)
        start = offsets[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)) * STRIDE
        stop = np.minimum(start + WINDOW, offsets[owner + 1])
        weight = self.idf[(codes % np.uint64(BUCKETS)).astype(np.int64)]
        energy = np.concatenate(([0.0], np.cumsum(weight.astype(np.float64) ** 2)))
        whole = energy[stop] - energy[start]
        found: dict[tuple, tuple] = {}
        runs: dict[int, np.ndarray] = {}
        for space in self.spaces:
            for n, hashes in space["exact"].items():
                if n not in runs:
                    runs[n] = sequence_codes(codes, n)
                for i in np.flatnonzero(np.isin(runs[n], np.array(list(hashes), np.uint64))).tolist():
                    doc = int(np.searchsorted(offsets, i, "right")) - 1
                    if i + n <= offsets[doc + 1]:
                        found.update({(doc, space["items"][j]): (1.0, 1.0, 1.0) for j in hashes[int(runs[n][i])] if (codes[i : i + n] == space["words"][j]).all()})
            at = np.searchsorted(space["terms"], codes)
            at[at == len(space["terms"])] = 0
            known = space["terms"][at] == codes
            inside = np.concatenate(([0.0], np.cumsum(np.where(known, weight, 0).astype(np.float64) ** 2)))
            known &= weight > 0
            # the likeness is at most the share of a window, or of the smallest passage, that the space knows, repeats aside
            likely = np.flatnonzero((inside[stop] - inside[start] >= 0.25 * self.cosine**2 * np.minimum(whole, space["least"])) & (whole > 0))
            for low in range(0, len(likely), 4096):
                pick = likely[low : low + 4096]
                # a window is two blocks of STRIDE words; neighbouring windows share one
                blocks, place = np.unique(np.concatenate((start[pick], np.minimum(start[pick] + STRIDE, stop[pick]))), return_inverse=True)
                limit = np.zeros(len(blocks), np.int64)
                limit[place] = np.minimum(np.concatenate((start[pick], start[pick] + STRIDE)) + STRIDE, np.tile(stop[pick], 2))
                spread = blocks[:, None] + np.arange(STRIDE)
                good = spread < limit[:, None]
                spread = np.minimum(spread, len(codes) - 1)
                good &= known[spread]
                w, p = np.nonzero(good)
                token = spread[w, p]
                sums = np.zeros((len(blocks), space["coordinates"].shape[1]), np.float32)
                if len(w):
                    cuts = np.flatnonzero(np.diff(w, prepend=-1))
                    sums[w[cuts]] = np.add.reduceat(space["coordinates"][at[token]] * weight[token, None], cuts, axis=0)
                vectors = sums[place[: len(pick)]] + sums[place[len(pick) :]]
                likeness = vectors @ space["directions"].T / np.minimum(np.sqrt(np.maximum(whole[pick], 1e-9))[:, None], space["norms"][None, :])
                for i, j in np.argwhere(likeness >= self.cosine).tolist():
                    words, answer, (masks, answer_masks) = space["words"][j], space["answers"][j], space["masks"][j]
                    doc = int(owner[pick[i]])
                    lo = max(int(offsets[doc]), int(start[pick[i]]) - len(words))
                    hi = min(int(offsets[doc + 1]), int(stop[pick[i]]) + len(words))
                    if len(words) < EXACT:
                        continue
                    there = set(codes[lo:hi].tolist())
                    if sum(n for word, n in space["counts"][j] if word in there) < REWORDED * len(words):
                        continue  # not even out of order
                    share = common_words(codes[lo:hi], masks, len(words)) / len(words)
                    if share < HALF:
                        continue
                    replied = common_words(codes[lo:hi], answer_masks, answer) / answer if answer else 1.0
                    if share >= COPIED or share >= REWORDED and replied >= ANSWERED or shuffled(codes[lo:hi], words) >= SHUFFLED:
                        key, new = (doc, space["items"][j]), (share, replied, min(float(likeness[i, j]), 1.0))
                        found[key] = max(found.get(key, new), new)
        return [(d, item, c, s, r) for (d, item), (s, r, c) in sorted(found.items(), key=lambda x: (x[0][0], str(x[0][1])))]


def finders(docs: DataFrame, benchmark: DataFrame, rank: int = RANK) -> Iterator:
    """One broadcast value (spaces, weights) per scan of the documents that is needed."""
    total, df = frequencies(docs)
    idf = weights(total, df)
    spaces = stored(latent_spaces(benchmark, idf, rank), "latent")
    held: list[bytes] = []
    for row in spaces.orderBy("block").toLocalIterator():
        held.append(bytes(row.space))
        if len(held) == SPACES:
            yield docs.sparkSession.sparkContext.broadcast((held, idf))  # SPACES spaces of BLOCK passages: some ten MB
            held = []
    if held:
        yield docs.sparkSession.sparkContext.broadcast((held, idf))


def _finder(value: tuple[list[bytes], np.ndarray]) -> Finder:
    return Finder([pickle.loads(s) for s in value[0]], value[1])


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, item_id, cosine, in_order, answered)``: every benchmark item
    that a document holds, copied or reworded.

    Null texts are empty and hold nothing; rows that share an id are reported
    together; a null id is reported as null; items of equal texts are judged once
    and all reported; an item without words is held by none.  An empty benchmark
    has no leaks.  Other columns are ignored."""
    kind, item = docs.schema[id_col].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    named = benchmark.select(F.sha2(benchmark["text"], 256).alias("text_sha"), benchmark["item_id"].alias("item_id")).where("text_sha is not null").distinct()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    out = None
    for shared in finders(rows, benchmark):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            finder = _finder(shared.value)
            for batch in batches:
                ids, hits = column(batch, "id"), []
                for first, texts in pieces(texts_of(batch, "text")):
                    hits += [(first + d, *rest) for d, *rest in finder.find(texts)]
                cols = list(zip(*hits)) or [()] * 5
                arrays = [ids.take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.string()), *(pa.array(c, pa.float64()) for c in cols[2:])]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "sha", "cosine", "in_order", "answered"])

        one = rows.mapInArrow(run, f"id {kind}, sha string, cosine double, in_order double, answered double")
        out = one if out is None else out.union(one)
    if out is None:
        return docs.sparkSession.createDataFrame([], f"`{id_col}` {kind}, item_id {item}, cosine double, in_order double, answered double")
    best = out.groupBy("id", "sha").agg(F.max("cosine").alias("cosine"), F.max("in_order").alias("in_order"), F.max("answered").alias("answered"))
    return best.join(named, F.col("sha") == F.col("text_sha")).select(F.col("id").alias(id_col), "item_id", "cosine", "in_order", "answered")


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns kept."""
    out = docs
    for shared in finders(docs.select(docs[text_col].alias("text")), benchmark):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            finder = _finder(shared.value)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for first, texts in pieces(texts_of(batch, text_col)):
                    clean[[first + d for d, *_ in finder.find(texts)]] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(run, docs.schema)
    return out
