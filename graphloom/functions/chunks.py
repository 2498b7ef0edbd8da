"""Overlapping chunks of long texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Boundaries that a chunk may end at, and the share of its size that it must reach for that.
BOUNDARIES, SHARE = ("\n\n", "\n", ". "), 0.6


def spans(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Where the chunks of a text begin and end.  All but the last are ``size``
    long, or end one character into their last boundary where that lies beyond
    the share; each begins ``overlap`` (at most a third of the size) before the
    end of the one before it, but after its beginning."""
    step_back = sorted((0, overlap, size // 3))[1]
    least = int(size * SHARE) + 1
    begin = end = 0
    while end < len(text):
        begin = max(end - step_back, begin + 1) if end else 0
        end = begin + size
        if end < len(text):
            # the first place of the latest boundary that lies far enough
            cut = max(text.rfind(mark, begin + least, end) for mark in BOUNDARIES)
            end = end if cut < 0 else cut + 1
        yield begin, min(end, len(text))


def chunks_of(text: str, size: int, overlap: int) -> list[str]:
    """The chunks of a text, stripped, without empty ones; a text that fits
    comes back as it is."""
    if not 0 < size < len(text):
        return [text]
    return [piece for s, e in spans(text, size, overlap) if (piece := text[s:e].strip())]


def chunk(df: DataFrame, text_col: str, size: int, overlap: int) -> DataFrame:
    """``df`` without its text, a row per chunk, with ``chunk_index`` (from 1)
    and ``chunk``.  A null text has no chunks."""
    keep = [c for c in df.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, index, out = [], [], []
            for i, value in enumerate(batch.column(len(keep))):
                if value.is_valid:
                    for n, piece in enumerate(chunks_of(value.as_py(), size, overlap), 1):
                        rows.append(i)
                        index.append(n)
                        out.append(piece)
            kept = batch.select(list(range(len(keep)))).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(index, pa.int32()), pa.array(out, pa.string())], [*keep, "chunk_index", "chunk"])

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, text_col).mapInArrow(run, f"{fields}, chunk_index int, chunk string")
