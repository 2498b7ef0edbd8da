"""Media columns: Netpbm and BMP files in binary columns.

Files are decoded to numpy arrays, area-resized through integral images, and
written as NPY tiles with difference hashes.  A text can also be stored as an
image: its UTF-8 bytes become the samples of a binary pixmap.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bytes_of, column

#: Payload bytes per image row: 64 pixels of 3 samples.
ROW_BYTES = 192
#: Width and height of the tile that a feature is read from.
TILE = 32


def _netpbm_header(data: bytes, fields: int) -> tuple[list[int], int]:
    """The numbers after the magic and the offset just past the last one."""
    out, at = [], 2
    token = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)")
    for _ in range(fields):
        m = token.match(data, at)
        if not m:
            raise ValueError("broken Netpbm header")
        out.append(int(m[1]))
        at = m.end()
    return out, at


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as (height, width, channels); bitmaps as 0 and 255."""
    kind = data[1:2]
    if data[:1] != b"P" or kind not in b"123456":
        raise ValueError("no Netpbm file")
    bitmap, channels = kind in b"14", 3 if kind in b"36" else 1
    head, at = _netpbm_header(data, 2 if bitmap else 3)
    width, height, top = head[0], head[1], 1 if bitmap else head[2]
    if not 0 < top < 65536:
        raise ValueError("sample maximum out of range")
    if kind in b"123":
        body = re.sub(rb"#[^\n]*", b"", data[at:])
        values = np.array(list(re.sub(rb"\s", b"", body)), np.int64) - 48 if bitmap else np.array(body.split(), np.int64)
    elif bitmap:
        rows = np.frombuffer(data, np.uint8, height * ((width + 7) // 8), at + 1).reshape(height, -1)
        values = np.unpackbits(rows, axis=1)[:, :width].ravel()
    else:
        values = np.frombuffer(data, np.uint8 if top < 256 else ">u2", height * width * channels, at + 1)
    if len(values) < height * width * channels:
        raise ValueError("Netpbm file cut short")
    image = values[: height * width * channels].reshape(height, width, channels)
    if bitmap:
        return ((1 - image) * 255).astype(np.uint8)
    return image.astype(np.uint8) if top < 256 else image.astype(np.uint16)


def encode_ppm(image: np.ndarray) -> bytes:
    """(height, width, 3) bytes as a binary pixmap."""
    height, width, _ = image.shape
    return b"P6\n%d %d\n255\n" % (width, height) + image.tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits as (height, width, 3)."""
    if data[:2] != b"BM":
        raise ValueError("no BMP file")
    start, head = struct.unpack_from("<II", data, 10)
    width, height, _, bits, packing, _, _, _, colours = struct.unpack_from("<iiHHIIiiI", data, 18)
    if packing not in (0, 3) or bits not in (1, 4, 8, 24, 32):
        raise ValueError("unsupported BMP")
    rows, stride = abs(height), (width * bits + 31) // 32 * 4
    raw = np.frombuffer(data, np.uint8, rows * stride, start).reshape(rows, stride)
    if bits <= 8:
        table = np.frombuffer(data, np.uint8, 4 * (colours or 1 << bits), 14 + head).reshape(-1, 4)[:, 2::-1]
        if bits < 8:
            parts = np.unpackbits(raw, axis=1).reshape(rows, -1, bits)
            raw = parts @ (1 << np.arange(bits)[::-1])
        image = table[raw[:, :width]]
    else:
        image = raw[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1]
    return np.ascontiguousarray(image if height < 0 else image[::-1])


def encode_bmp(image: np.ndarray) -> bytes:
    """(height, width, 3) bytes as a 24-bit BMP."""
    height, width, _ = image.shape
    stride = (width * 3 + 3) // 4 * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : width * 3] = image[::-1, :, ::-1].reshape(height, -1)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + rows.size, 0, 0, 54, 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target pixel's area, by an integral image: sums up to a
    fractional edge are read between its entries, exact for constant pixels."""
    h, w = image.shape[:2]
    total = np.zeros((h + 1, w + 1, image.shape[2]))
    np.cumsum(image, axis=0, out=total[1:, 1:])
    np.cumsum(total[1:, 1:], axis=1, out=total[1:, 1:])
    for axis, (size, target) in enumerate(((h, height), (w, width))):
        edge = np.arange(target + 1) * size / target
        low = np.minimum(edge.astype(np.int64), size - 1)
        part = (edge - low).reshape((-1, 1, 1) if axis == 0 else (1, -1, 1))
        total = np.take(total, low, axis) * (1 - part) + np.take(total, low + 1, axis) * part
    sums = np.diff(np.diff(total, axis=0), axis=1)
    return sums / ((h / height) * (w / width))


def difference_hash(image: np.ndarray) -> str:
    """64 bits: whether each of 8 x 8 cells is darker than its right neighbour."""
    small = area_resize(image, 8, 9).mean(axis=2)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(array), version=(1, 0))
    return out.getvalue()


def tiles(df: DataFrame, id_col: str, media_col: str, tile: int = TILE, scale: tuple[int, int] | None = None) -> DataFrame:
    """Decode each file, resize it to ``scale`` (height, width) if given, and
    cut it into NPY tiles: ``(id, tile_row, tile_col, height, width, npy, dhash,
    error)``.  A null or broken file gives one row that has only an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, data = column(batch, "id"), column(batch, "media")
            for i in range(batch.num_rows):
                rows: list[tuple] = []
                try:
                    if not data[i].is_valid:
                        raise ValueError("no file")
                    image = decode(data[i].as_py())
                    if scale:
                        image = np.rint(area_resize(image, *scale)).astype(image.dtype)
                    for y in range(0, image.shape[0], tile):
                        for x in range(0, image.shape[1], tile):
                            part = image[y : y + tile, x : x + tile]
                            rows.append((y // tile, x // tile, part.shape[0], part.shape[1], npy(part), difference_hash(part), None))
                except (ValueError, struct.error, IndexError) as e:
                    rows = [(None, None, None, None, None, None, str(e))]
                cols = list(zip(*rows)) or [[]] * 7
                kinds = [pa.int32()] * 4 + [pa.binary(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array([i] * len(rows), pa.int32())), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["id", "tile_row", "tile_col", "height", "width", "npy", "dhash", "error"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col].alias("id"), df[media_col].alias("media")).mapInArrow(run, f"id {kind}, tile_row int, tile_col int, height int, width int, npy binary, dhash string, error string")


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = True) -> DataFrame:
    """Store each text as a binary pixmap, read it back and describe it.

    The payload is the UTF-8 text (null: empty) padded with spaces to a
    positive multiple of 192 bytes, one image row each.  The feature is the
    difference hash of a 32 x 32 NPY tile of the decoded image.  Columns: id,
    n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature and, with ``with_media``, media and tile.  One row
    per input row, repeats and null ids included; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(9)]
            for text in bytes_of(batch, "text"):
                payload = text + b" " * (max(1, -(-len(text) // ROW_BYTES)) * ROW_BYTES - len(text))
                media = encode_ppm(np.frombuffer(payload, np.uint8).reshape(-1, ROW_BYTES // 3, 3))
                image = decode(media)
                back = image.tobytes()
                tile = npy(np.rint(area_resize(image, TILE, TILE)).astype(np.uint8))
                feature = difference_hash(np.load(io.BytesIO(tile)))
                row = (len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, media, tile)
                for c, v in zip(out, row if with_media else (*row[:7], None, None)):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary()]
            arrays = [column(batch, "id"), *(pa.array(c, k) for c, k in zip(out, kinds))]
            yield pa.RecordBatch.from_arrays(arrays if with_media else arrays[:8], names if with_media else names[:8])

    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media", "tile"]
    kinds = [kind, "bigint", "bigint", "string", "bigint", "bigint", "string", "string", "binary", "binary"]
    schema = ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds[: 10 if with_media else 8]))
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, schema)
