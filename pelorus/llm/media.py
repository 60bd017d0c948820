"""Media columns: Netpbm and BMP bytes to numpy arrays, area resizing by
integral images, NPY tiles and difference hashes."""

from __future__ import annotations

import io
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pelorus.llm.common import chunks, lean, pick, text_bytes

_HEADER = re.compile(rb"\s*(?:#[^\n]*\n\s*)*(\d+)")


def read_netpbm(raw: bytes) -> np.ndarray:
    """P1 to P6 as an array (height, width) or (height, width, 3); bitmaps give 0 for black and 1 for white; samples wider than a byte give 16-bit arrays."""
    kind, at, head = raw[:2], 2, []
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not Netpbm")
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        if not (m := _HEADER.match(raw, at)):
            raise ValueError("broken Netpbm header")
        head.append(int(m[1]))
        at = m.end()
    w, h = head[:2]
    most = head[2] if len(head) > 2 else 1
    shape = (h, w, 3) if kind in (b"P3", b"P6") else (h, w)
    n = w * h * (3 if kind in (b"P3", b"P6") else 1)
    if n > 8 * len(raw) or not 0 < most < 65536:  # a bit a sample at least
        raise ValueError("more samples than the file can hold")
    if kind == b"P1":
        digits = re.sub(rb"#[^\n]*|[^01#]", b"", raw[at:])
        return (1 - (np.frombuffer(digits[:n], np.uint8) - 48)).reshape(shape)
    if kind in (b"P2", b"P3"):
        return np.array(re.sub(rb"#[^\n]*", b"", raw[at:]).split()[:n], np.uint16 if most > 255 else np.uint8).reshape(shape)
    at += 1
    if kind == b"P4":
        bits = np.unpackbits(np.frombuffer(raw, np.uint8, h * ((w + 7) // 8), at).reshape(h, -1), axis=1)[:, :w]
        return 1 - bits
    if most > 255:
        return np.frombuffer(raw, ">u2", n, at).astype(np.uint16).reshape(shape)
    return np.frombuffer(raw, np.uint8, n, at).reshape(shape)


def write_pgm(samples: np.ndarray) -> bytes:
    h, w = samples.shape
    return b"P5\n%d %d\n255\n" % (w, h) + samples.tobytes()


def read_bmp(raw: bytes) -> np.ndarray:
    """Uncompressed BMP of 8, 24 or 32 bits: (height, width, 3) RGB, or (height, width) where an 8-bit palette is grey."""
    if raw[:2] != b"BM":
        raise ValueError("not BMP")
    start, head, w, h, _, bits, packed = struct.unpack_from("<I I i i H H I", raw, 10)
    if packed not in (0, 3) or bits not in (8, 24, 32):
        raise ValueError("this kind of BMP is not read")
    rows, row = abs(h), (w * bits // 8 + 3) // 4 * 4
    grid = np.frombuffer(raw, np.uint8, rows * row, start).reshape(rows, row)[:, : w * bits // 8]
    if h > 0:
        grid = grid[::-1]
    if bits > 8:
        return np.ascontiguousarray(grid.reshape(rows, w, bits // 8)[:, :, 2::-1])
    n = struct.unpack_from("<I", raw, 46)[0] or 256
    palette = np.zeros((256, 3), np.uint8)
    palette[:n] = np.frombuffer(raw, np.uint8, n * 4, 14 + head).reshape(n, 4)[:, 2::-1]
    if (palette == palette[:, :1]).all():
        return palette[:, 0][grid]
    return palette[grid]


def decode_media(raw: bytes) -> np.ndarray:
    return read_bmp(raw) if raw[:2] == b"BM" else read_netpbm(raw)


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the exact source area of each target pixel, fractions of pixels
    included: the integral image is interpolated at the area's corners."""
    h, w = image.shape
    total = np.zeros((h + 1, w + 1))
    np.cumsum(image, axis=0, out=total[1:, 1:], dtype=np.float64)
    np.cumsum(total[1:, 1:], axis=1, out=total[1:, 1:])
    y, x = np.arange(height + 1) * (h / height), np.arange(width + 1) * (w / width)
    y0, x0 = np.minimum(y.astype(int), h - 1), np.minimum(x.astype(int), w - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    rows = total[y0] * (1 - fy) + total[y0 + 1] * fy
    at = rows[:, x0] * (1 - fx) + rows[:, x0 + 1] * fx
    return (at[1:, 1:] - at[:-1, 1:] - at[1:, :-1] + at[:-1, :-1]) / (h / height * (w / width))


def difference_hash(image: np.ndarray, side: int = 8) -> str:
    """side * side bits, as hex: whether each cell is darker than its right neighbour."""
    small = area_resize(grey(image), side, side + 1)
    return np.packbits(small[:, 1:] > small[:, :-1] + 1e-9).tobytes().hex()


def npy_tile(image: np.ndarray, side: int) -> bytes:
    out = io.BytesIO()
    np.save(out, np.rint(area_resize(grey(image), side, side)).astype(np.uint8))
    return out.getvalue()


def text_images(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 64) -> DataFrame:
    """Stores texts losslessly as PGM images, one byte a sample.

    ``id_col``, ``n_bytes`` (of the UTF-8 text) and ``media``: the bytes of the
    text, padded with 0 to a positive multiple of ``width``, as rows of ``width``
    samples.  Null texts count as empty and give one row of zeros.  All in the
    JVM, row by row.
    """
    rows = pick(df, id=id_col, text=text_col).select("id", text_bytes().alias("text"))
    size = F.length("text")
    tall = F.greatest(F.lit(1), F.ceil(size / width)).cast("int")
    pad = F.substring(F.unhex(F.lit("00" * width)), F.lit(1), (tall * width - size).cast("int"))
    head = F.concat(F.lit(f"P5\n{width} "), tall.cast("string"), F.lit("\n255\n")).cast("binary")
    return rows.select(F.col("id").alias(id_col), size.cast("long").alias("n_bytes"), F.concat(head, F.col("text"), pad).alias("media"))


def image_features(df: DataFrame, id_col: str = "doc_id", media_col: str = "media", tile: int = 32) -> DataFrame:
    """Decodes media bytes and computes features.

    ``id_col``, ``width``, ``height``, ``samples`` (binary: decoded samples row
    by row), ``tile`` (NPY bytes of a ``tile`` x ``tile`` grey image) and
    ``feature`` (difference hash as hex).  Null or unreadable media give a row
    with nulls; repeated rows are kept; an empty table gives an empty table.
    """
    rows = pick(df, id=id_col, media=media_col)
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("samples", T.BinaryType()), T.StructField("tile", T.BinaryType()), T.StructField("feature", T.StringType())])

    def one(raw: bytes | None) -> tuple:
        try:
            image = decode_media(raw or b"")
            if not image.size:
                raise ValueError("no samples")
        except (ValueError, OverflowError, struct.error):
            return None, None, None, None, None
        return image.shape[1], image.shape[0], image.tobytes(), npy_tile(image, tile), difference_hash(image)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches):
            made = list(zip(*(one(m) for _, m in rows)))
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), *(pa.array(c, k) for c, k in zip(made, kinds))], names=["id", "width", "height", "samples", "tile", "feature"])

    return rows.mapInArrow(lean(run), schema).withColumnRenamed("id", id_col)


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 64, tile: int = 32) -> DataFrame:
    """:func:`text_images` and :func:`image_features` in one pass: ``id_col``, ``n_bytes``, ``media``, ``samples``, ``tile``, ``feature``."""
    stored = text_images(df, id_col, text_col, width).withColumnRenamed(id_col, "id")
    schema = T.StructType([*stored.schema.fields, *[T.StructField(n, t) for n, t in (("samples", T.BinaryType()), ("tile", T.BinaryType()), ("feature", T.StringType()))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches):
            made = []
            for _, _, raw in rows:
                image = decode_media(raw)
                made.append((image.tobytes(), npy_tile(image, tile), difference_hash(image)))
            ids, sizes, media = zip(*rows)
            samples, tiles, marks = zip(*made)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sizes, pa.int64()), pa.array(media, pa.binary()), pa.array(samples, pa.binary()), pa.array(tiles, pa.binary()), pa.array(marks, pa.string())], names=["id", "n_bytes", "media", "samples", "tile", "feature"])

    return stored.mapInArrow(lean(run), schema).withColumnRenamed("id", id_col)


def digests(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Sizes and digests of what was stored and of what reads back."""
    return media.select(
        id_col,
        "n_bytes",
        F.length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(samples, greatest(length(samples) - 63, 1), 64)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        F.sha2("tile", 256).alias("tile_sha256"),
    )
