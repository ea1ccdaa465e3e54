"""Image files to frames (path, image, error); a file that can't be read has an error, and no image."""

from __future__ import annotations

import io
import re
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rasters
from .pools import expand


def pgm(data: bytes) -> np.ndarray:
    """A binary graymap of 8 or 16 bits, the latter scaled to 8."""
    head = re.match(rb"P5\s+(?:#[^\n]*\n\s*)*(\d+)\s+(?:#[^\n]*\n\s*)*(\d+)\s+(?:#[^\n]*\n\s*)*(\d+)\s", data)
    if not head:
        raise ValueError("no binary PGM")
    w, h, top = (int(x) for x in head.groups())
    px = np.frombuffer(data, ">u2" if top > 255 else "u1", w * h, head.end()).reshape(h, w)
    return px.astype(np.uint8) if top == 255 else (px.astype(np.float64) * 255 / top).astype(np.uint8)


def unfiltered(rule: np.ndarray, left_over: np.ndarray) -> np.ndarray:
    """The bytes of an image (height, width, bytes a pixel) from each line's filter and what the filters left over.

    A byte is guessed from those to the left, above, and above that; so all pixels of a diagonal are
    worked out at once, whatever their lines' filters.
    """
    h, w, step = left_over.shape
    if not rule.any():
        return left_over
    out = np.zeros((h + 1, w + 1, step), np.int16)  # a line and a column of zeros around
    for d in range(h + w - 1):
        y = np.arange(max(0, d - w + 1), min(h, d + 1))
        x = d - y
        a, b, c = out[y + 1, x], out[y, x + 1], out[y, x]
        da, db, dc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
        paeth = np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))
        out[y + 1, x + 1] = (left_over[y, x] + np.choose(rule[y, None], (np.zeros_like(a), a, b, (a + b) >> 1, paeth))) & 255
    return out[1:, 1:].astype(np.uint8)


def png(data: bytes) -> np.ndarray:
    """A non-interlaced PNG of gray, gray+alpha, RGB or RGBA; 16 bits are cut to the upper 8, alpha is dropped."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, packed, head, palette = 8, b"", None, None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed += body
        at += 12 + n
    if head is None:
        raise ValueError("no PNG header")
    w, h, depth, colour, _, _, interlaced = head
    if interlaced or depth not in (8, 16) or colour not in (0, 2, 3, 4, 6):
        raise ValueError(f"PNG of depth {depth}, colour type {colour}, interlace {interlaced}")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    step = channels * depth // 8
    rows = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(h, 1 + w * step)
    px = unfiltered(rows[:, 0], rows[:, 1:].reshape(h, w, step)).reshape(h, w, channels, depth // 8)[..., 0]
    if colour == 3:
        return palette[px[..., 0]]
    px = px[..., : {2: 1, 4: 3}.get(channels, channels)]
    return px[..., 0] if px.shape[2] == 1 else px


def encode_png(px: np.ndarray) -> bytes:
    """uint8 gray or RGB."""
    h, w = px.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), px.reshape(h, -1)], axis=1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", w, h, 8, 0 if px.ndim == 2 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def decode(data: bytes, gray: bool = True) -> np.ndarray:
    if data[:2] == b"P5":
        px = pgm(data)
    elif data[:4] == b"\x89PNG":
        px = png(data)
    else:
        try:
            from PIL import Image  # other formats, where it is installed
        except ImportError:
            raise ValueError("only PNG and binary PGM can be decoded here") from None
        with Image.open(io.BytesIO(data)) as im:
            return np.asarray(im.convert("L" if gray else "RGB"))
    if gray:
        return rasters.luma(px) if px.ndim == 3 else px
    return px if px.ndim == 3 else np.repeat(px[..., None], 3, axis=2)


def frames(spark: SparkSession, spec, gray: bool = True, on_error: str = "warn") -> DataFrame:
    """(path, image, error) of a pool, pattern, directory or file. Whoever reads only paths decodes nothing.

    With on_error='raise' a file that can't be read is an error.
    """
    if on_error not in ("warn", "raise"):
        raise ValueError("on_error must be 'warn' or 'raise'")

    @F.pandas_udf("height int, width int, nChannels int, data binary, error string")
    def read(content: pd.Series) -> pd.DataFrame:
        out = []
        for data in content:
            try:
                px = decode(data, gray)
                out.append((*px.shape[:2], 1 if px.ndim == 2 else px.shape[2], np.ascontiguousarray(px).tobytes(), None))
            except Exception as e:  # a broken file must not end the scan, unless that is asked for
                if on_error == "raise":
                    raise
                out.append((None, None, None, None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["height", "width", "nChannels", "data", "error"]).astype({"height": "Int32", "width": "Int32", "nChannels": "Int32"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(expand(spec))
    got = files.select("path", read("content").alias("r"))
    image = F.when(F.col("r.error").isNull(), F.struct("r.height", "r.width", "r.nChannels", "r.data"))
    return got.select("path", image.alias("image"), F.col("r.error").alias("error"))


def spark_frames(spark: SparkSession, spec) -> DataFrame:
    """(path, image) by Spark's own image source: no Python, colour in BGR order, unreadable files dropped."""
    got = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(expand(spec))
    return got.select(F.col("image.origin").alias("path"), "image")


def split_errors(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readable, failed)"""
    return scanned.where("error is null").drop("error"), scanned.where("error is not null").select("path", "error")
