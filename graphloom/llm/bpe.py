"""Byte-level BPE with a pair occurrence index.

Texts are cut at spaces into chunks, chunks into words by the vocabulary's
split pattern.  Chunks that a partition brings anew are merged
together: every pair of adjacent symbols is mapped to all its positions among
their words, the active ranks are applied in ascending order, each to all of
its positions at once, and only the lists of the pairs that a merge creates are
extended.  Finished chunks are kept in a bounded table, so a text costs one
lookup per chunk.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column, texts_of

#: Fixed value: the split pattern of byte-level BPE vocabularies, of letters L, numbers N and white space S.
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d| ?[L]+| ?[N]+| ?[^SLN]+|[S]+(?![^S])|[S]+"
#: Letters and numbers that Unicode 16.0, by which the vocabularies' library
#: splits, has beyond the 15.1 of Python 3.13 (first and last of each range).
LETTERS_16 = "1c89-1c8a a7cb-a7cd a7da-a7dc 105c0-105f3 10d4a-10d65 10d6f-10d85 10ec2-10ec4 11380-11389 1138b-1138b 1138e-1138e 11390-113b5 113b7-113b7 113d1-113d1 113d3-113d3 11bc0-11be0 13460-143fa 16100-1611d 16d40-16d6c 18cff-18cff 1e5d0-1e5ed 1e5f0-1e5f0"
NUMBERS_16 = "10d40-10d49 116d0-116e3 11bf0-11bf9 16130-16139 16d70-16d79 1ccf0-1ccf9 1e5f1-1e5fa"
#: A space inside a run of white space is no start of a word; texts with one are cut into words at once.
INNER_SPACE = re.compile(r"\s \s|\s $")
#: Marks keys of chunks that no space precedes; no valid text holds it.
BARE = "\ud800"
#: Characters and new chunks that wait to be merged, words that are merged at a time,
#: bytes of finished chunks that a worker keeps before it starts its table anew, and
#: ids of an output batch.  Only memory and speed depend on them.
WAITING, FRESH, MERGED, KEPT_BYTES, EMITTED = 8 << 20, 1 << 17, 1 << 17, 48 << 20, 1 << 20
#: New pairs of a merge that are listed one by one; more are sorted.  Only speed depends on it.
LISTED = 64


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where it is
    printable in Latin-1, else the next free one from U+0100 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


@cache
def split_pattern(limit: int = 0x110000) -> str:
    """``SPLIT`` for texts of code points below ``limit``, its classes as ranges
    of code points by the general categories of Unicode 16.0."""

    def ranges(member: np.ndarray, more: str) -> str:
        for r in more.split():
            low, high = r.split("-")
            member[int(low, 16) : int(high, 16) + 1] = True
        member = member[:limit]
        edge = np.flatnonzero(np.diff(member, prepend=False, append=False))
        return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist()))

    kinds = np.array([unicodedata.category(chr(c))[0] for c in range(0x110000)])
    spaces = kinds == "Z"
    spaces[[*b"\t\n\v\f\r", 0x85]] = True
    classes = {"L": ranges(kinds == "L", LETTERS_16), "N": ranges(kinds == "N", NUMBERS_16), "S": ranges(spaces, "")}
    return re.sub("[LNS]", lambda m: classes[m[0]], SPLIT)


def grown(kept: np.ndarray, used: int, new: np.ndarray) -> np.ndarray:
    """``kept`` with ``new`` behind its first ``used`` values; room is doubled."""
    need = used + len(new)
    if need > len(kept):
        wider = np.empty(max(need, 2 * len(kept)), kept.dtype)
        wider[:used] = kept[:used]
        kept = wider
    kept[used:need] = new
    return kept


class PairIndexBpe:
    """Encoder and decoder for one vocabulary (the JSON text of its file)."""

    def __init__(self, spec: str):
        model = json.loads(spec)
        vocab: dict[str, int] = model["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        alphabet = byte_alphabet()
        self.byte_id = np.array([vocab[c] for c in alphabet], np.int64)
        byte_of = {c: b for b, c in enumerate(alphabet)}
        self.base = max([*vocab.values(), *self.special.values()]) + 1
        self.piece = [b""] * self.base
        for token, i in vocab.items():
            self.piece[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        for token, i in self.special.items():
            self.piece[i] = token.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = self.left * self.base + self.right
        self.rank_of_key = np.argsort(keys, kind="stable")
        self.keys = keys[self.rank_of_key]
        self.plain, self.wide = (re.compile(split_pattern(limit)) for limit in (0x80, 0x110000))
        self.stops = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.forget()

    def forget(self) -> None:
        """Empty the table of finished chunks."""
        self.number: dict[str, int] = {}
        self.known, self.n_ids, self.held = 0, 0, 0  # chunks and ids in the table, and about how many bytes it takes
        self.ids = np.zeros(0, np.uint32)
        self.start = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)

    def words(self, text: str) -> list[str]:
        return (self.plain if text.isascii() else self.wide).findall(text)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 if it never merges."""
        want = a.astype(np.int64) * self.base + b
        at = np.searchsorted(self.keys, want)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == want, self.rank_of_key[at], -1)

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and how many each has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.byte_id[np.frombuffer(b"".join(words), np.uint8)].astype(np.int32)
        n = len(sym)
        after = np.arange(1, n + 1, dtype=np.int32)
        ends = np.cumsum(sizes)
        after[ends[sizes > 0] - 1] = -1
        before = np.arange(-1, n - 1, dtype=np.int32)
        before[(ends - sizes)[sizes > 0]] = -1
        alive = np.ones(n, bool)

        # the positions of a pair: those known from the start and from large
        # merges as arrays, those that small merges add one by one
        blocks: dict[int, list[np.ndarray]] = {}
        singles: dict[int, list[int]] = {}
        heap: list[int] = []

        def listed(rank: np.ndarray, place: np.ndarray) -> None:
            order = np.argsort(rank, kind="stable")
            rank, place = rank[order], place[order]
            cuts = np.flatnonzero(np.diff(rank, prepend=-1))
            for r, s, e in zip(rank[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(rank)]):
                if r not in blocks and r not in singles:
                    heapq.heappush(heap, r)
                blocks.setdefault(r, []).append(place[s:e])

        first = np.flatnonzero(after >= 0).astype(np.int32)
        rank = self.ranks(sym[first], sym[first + 1])
        listed(rank[rank >= 0], first[rank >= 0])
        while heap:
            r = heapq.heappop(heap)
            a, b = self.left[r], self.right[r]
            pos = np.concatenate([*blocks.pop(r, ()), np.array(singles.pop(r, ()), np.int32)])
            pos.sort()
            nxt = after[pos]
            ok = alive[pos] & (sym[pos] == a) & (nxt >= 0)
            pos, nxt = pos[ok], nxt[ok]
            ok = sym[nxt] == b
            pos, nxt = pos[ok], nxt[ok]
            if len(pos) > 1:  # two neighbours may both have listed a pair
                once = np.append(True, pos[1:] != pos[:-1])
                pos, nxt = pos[once], nxt[once]
            if a == b and len(pos) > 1:  # in a run of equal symbols, every other pair from the left
                joined = np.concatenate(([False], pos[1:] == nxt[:-1]))
                index = np.arange(len(pos))
                run = np.maximum.accumulate(np.where(joined, 0, index))
                ok = (index - run) % 2 == 0
                pos, nxt = pos[ok], nxt[ok]
            if not len(pos):
                continue
            beyond = after[nxt]
            sym[pos] = self.made[r]
            alive[nxt] = False
            after[pos] = beyond
            has = beyond >= 0
            before[beyond[has]] = pos[has]
            prev = before[pos]
            left = prev[prev >= 0]
            start = np.concatenate((left, pos[has]))
            new = self.ranks(sym[start], sym[after[start]])
            good = new >= 0
            new, start = new[good], start[good]
            if len(new) > LISTED:
                listed(new, start)
                continue
            for k, p in zip(new.tolist(), start.tolist()):
                if k in singles:
                    singles[k].append(p)
                else:
                    if k not in blocks:
                        heapq.heappush(heap, k)
                    singles[k] = [p]
        counts = np.add.reduceat(np.append(alive, False), np.minimum(ends - sizes, n), dtype=np.int64) if len(words) else np.zeros(0, np.int64)
        counts[sizes == 0] = 0
        return sym[alive].astype(np.uint32), counts

    def learn(self, chunks: list[str]) -> None:
        """Merge the chunks numbered last and add them to the table."""
        cut, parts, waiting = self.words, [], 0
        for i, c in enumerate(chunks, 1):
            parts.append(cut(c[1:] if c.startswith(BARE) else " " + c))
            waiting += len(parts[-1])
            if waiting >= MERGED or i == len(chunks):
                ids, per_word = self.merge_words([w.encode() for p in parts for w in p])
                upto = np.concatenate(([0], np.cumsum(per_word)))[np.cumsum([len(p) for p in parts])]
                counts = np.diff(upto, prepend=0)
                self.start = grown(self.start, self.known, self.n_ids + upto - counts)
                self.count = grown(self.count, self.known, counts)
                self.ids = grown(self.ids, self.n_ids, ids)
                self.known += len(parts)
                self.n_ids += len(ids)
                parts, waiting = [], 0
        # a key's string and its place in the dictionary
        self.held += sum(map(len, chunks)) + 160 * len(chunks)

    def encode_all(self, texts: Iterable[str], budget: int = WAITING) -> Iterator[np.ndarray]:
        """The ids of each text, in order; texts of ``budget`` characters, or of
        ``FRESH`` new chunks, wait together."""
        waiting: list[list[np.ndarray | int]] = []
        held = 0
        for text in texts:
            waiting.append(self._numbered(text))
            held += len(text)
            if held >= budget or len(self.number) - self.known >= FRESH:
                yield from self._flush(waiting)
                waiting, held = [], 0
        yield from self._flush(waiting)

    def _numbered(self, text: str) -> list[np.ndarray | int]:
        """Chunk numbers of the stretches between special tokens, and those tokens' ids."""
        number, out, at = self.number, [], 0
        cuts = [(m.start(), m.end()) for m in self.stops.finditer(text)] if self.stops else []
        for s, e in [*cuts, (len(text), len(text))]:
            part = text[at:s] if cuts else text
            if INNER_SPACE.search(part):
                keys = [BARE + w for w in self.words(part)]
            else:  # every space starts a word
                keys = part.split(" ")
                keys[0] = BARE + keys[0]
            try:  # most texts bring nothing new
                out.append(np.fromiter(map(number.__getitem__, keys), np.int32, len(keys)))
            except KeyError:
                out.append(np.array([number.setdefault(k, len(number)) for k in keys], np.int32))
            if e > s:
                out.append(self.special[text[s:e]])
            at = e
        return out

    def _flush(self, waiting: list[list[np.ndarray | int]]) -> Iterator[np.ndarray]:
        if len(self.number) > self.known:
            # dicts keep insertion order, so the new chunks are the last ones
            fresh = [w for _, w in zip(range(len(self.number) - self.known), reversed(self.number))][::-1]
            self.learn(fresh)
        for parts in waiting:
            out = [np.array([p], np.uint32) if isinstance(p, int) else self._gather(p) for p in parts]
            yield out[0] if len(out) == 1 else np.concatenate(out)
        waiting.clear()
        if self.held > KEPT_BYTES:
            self.forget()

    def _gather(self, chunks: np.ndarray) -> np.ndarray:
        counts = self.count[chunks]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(self.start[chunks] - ends + counts, counts) + np.arange(total)]

    def decode(self, ids: np.ndarray) -> str:
        """Special tokens are kept; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.piece.__getitem__, ids.tolist())).decode("utf-8", "replace")


_loaded: dict[str, PairIndexBpe] = {}


def loaded(spec: str) -> PairIndexBpe:
    """One encoder per worker and vocabulary."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = PairIndexBpe(spec)
    return _loaded[key]


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, with_text: bool = False) -> DataFrame:
    """Encode ``text_col`` and decode it again, one row per input row.

    Returns ``id_col, n_tokens, ids_sha256, decoded_sha256`` and, with
    ``with_ids``, ``ids array<int>``, with ``with_text``, ``decoded string``.
    Null and empty texts have no tokens; a null id stays null; repeated rows
    give repeated rows; other columns of ``docs`` are ignored, whatever they are
    called.  Rows leave a worker as soon as they have ``EMITTED`` ids."""
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())  # one vocabulary file, some MB whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(spec.value)
        for batch in batches:
            keys, first = column(batch, "id"), 0
            sizes: list[int] = []
            hashes: tuple[list[str], list[str]] = ([], [])
            kept: list[np.ndarray] = []
            decoded: list[str] = []
            held = 0

            def full() -> pa.RecordBatch:
                arrays = [keys.slice(first, len(sizes)), pa.array(sizes, pa.int64()), *(pa.array(h, pa.string()) for h in hashes)]
                if with_ids:
                    flat = np.concatenate([*kept, np.zeros(0, np.uint32)]).view(np.int32)
                    arrays.append(pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), pa.array(flat)))
                if with_text:
                    arrays.append(pa.array(decoded, pa.string()))
                return pa.RecordBatch.from_arrays(arrays, names)

            for ids in bpe.encode_all(texts_of(batch, "text")):
                text = bpe.decode(ids)
                sizes.append(len(ids))
                hashes[0].append(hashlib.sha256(ids.astype("<u4", copy=False).tobytes()).hexdigest())
                hashes[1].append(hashlib.sha256(text.encode()).hexdigest())
                if with_ids:
                    kept.append(ids)
                if with_text:
                    decoded.append(text)
                held += len(ids)
                if held >= EMITTED:
                    yield full()
                    first += len(sizes)
                    sizes, hashes, kept, decoded, held = [], ([], []), [], [], 0
            if sizes:
                yield full()

    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids + ["decoded"] * with_text
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, schema)
