"""Image files without an image library: listings, header sizes, 16-bit depth maps, run lengths."""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = ("bmp", "dng", "jpeg", "jpg", "mpo", "png", "tif", "tiff", "webp", "pfm", "heic", "avif")


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """Image files below a folder, with content only where it is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.where(F.lower(F.substring_index("path", ".", -1)).isin(*SUFFIXES))


def first_by_path(files: DataFrame, fraction: float | int) -> DataFrame:
    """The first part of the sorted listing: an integer above 1 counts files, a share is rounded, at least one."""
    from tessera.operators.scans import global_rank

    n = fraction if isinstance(fraction, int) and fraction > 1 else max(1, round(files.count() * fraction))
    common = files.agg(F.min("path"), F.max("path")).first()
    skip = len(os.path.commonprefix([x.encode() for x in common])) if common[0] is not None else 0
    # the bytes after what all paths begin with, as a number, are in the paths' own order
    start = F.conv(F.rpad(F.substring(F.hex("path"), 2 * skip + 1, 12), 12, "0"), 16, 10).cast("double")
    return global_rank(files.withColumn("start_", start), "start_", "path", name="rank_").where(F.col("rank_") <= n).drop("start_", "rank_")


def class_folders(files: DataFrame) -> DataFrame:
    """(path, name, cls): the class is the parent folder, numbered in order of name."""
    from pyspark.sql import Window

    rows = files.select("path", F.element_at(F.split("path", "/"), -2).alias("name"))
    ids = rows.select("name").distinct().select("name", (F.row_number().over(Window.orderBy("name")) - 1).alias("cls"))  # a row a class
    return rows.join(F.broadcast(ids), "name").select("path", "name", "cls")


def header(data: bytes) -> tuple[str | None, int | None, int | None]:
    """(format, width, height) from the first bytes; turned by the orientation tag of a JPEG."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return ("png", *struct.unpack(">II", data[16:24]))
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return ("gif", *struct.unpack("<HH", data[6:10]))
    if data[:2] == b"BM" and len(data) >= 26:
        w, h = struct.unpack("<ii", data[18:26])
        return "bmp", w, abs(h)
    if data[:2] == b"\xff\xd8":
        at, turned = 2, False
        while at + 9 < len(data) and data[at] == 0xFF:
            kind, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            if kind == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                turned = orientation(data[at + 10 : at + 2 + size]) in (5, 6, 7, 8)
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return ("jpeg", h, w) if turned else ("jpeg", w, h)
            at += 2 + size
    return None, None, None


def orientation(tiff: bytes) -> int:
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if not order or len(tiff) < 8:
        return 1
    at = struct.unpack(order + "I", tiff[4:8])[0]
    if at + 2 > len(tiff):
        return 1
    for i in range(struct.unpack(order + "H", tiff[at : at + 2])[0]):
        entry = tiff[at + 2 + 12 * i : at + 14 + 12 * i]
        if len(entry) == 12 and struct.unpack(order + "H", entry[:2])[0] == 0x0112:
            return struct.unpack(order + "H", entry[8:10])[0]
    return 1


def sizes(files: DataFrame, least: int = 10) -> DataFrame:
    """(path, format, w, h, ok): ok if the header reads and both sides have ``least`` pixels or more."""

    @F.pandas_udf("format string, w int, h int")
    def read(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([header(bytes(c) if c is not None else b"") for c in content], columns=["format", "w", "h"]).astype({"w": "Int32", "h": "Int32"})

    rows = files.select("path", read("content").alias("i")).select("path", "i.*")
    return rows.withColumn("ok", F.coalesce((F.col("w") >= least) & (F.col("h") >= least), F.lit(False)))


def encode_depth(metres: np.ndarray, scale: float = 1000.0) -> bytes:
    """A 16-bit grey PNG of ``metres * scale``; 0 is invalid."""
    v = np.clip(np.nan_to_num(np.asarray(metres, np.float64) * scale).round(), 0, 65535).astype(">u2")
    h, w = v.shape
    raw = b"".join(b"\0" + row.tobytes() for row in v)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 16, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def decode_depth(data: bytes, scale: float = 1000.0) -> np.ndarray:
    """Metres of a 16-bit grey PNG, rows filtered in any of the five ways."""
    at, body, w, h = 8, b"", 0, 0
    while at < len(data):
        size, kind = struct.unpack(">I", data[at : at + 4])[0], data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            w, h, bits, colour = struct.unpack(">IIBB", part[:10])
            if (bits, colour) != (16, 0):
                raise ValueError("not a 16-bit grey image")
        body += part if kind == b"IDAT" else b""
        at += 12 + size
    raw, stride = zlib.decompress(body), 2 * w
    above, out = np.zeros(stride, np.uint8), np.empty((h, stride), np.uint8)
    for y in range(h):
        kind, row = raw[y * (stride + 1)], np.frombuffer(raw, np.uint8, stride, y * (stride + 1) + 1).copy()
        if kind == 1:
            row = np.cumsum(row.reshape(-1, 2), axis=0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            row += above
        elif kind in (3, 4):
            for i in range(stride):
                a, b, c = int(row[i - 2]) if i > 1 else 0, int(above[i]), int(above[i - 2]) if i > 1 else 0
                p = a + b - c
                pick = (a + b) // 2 if kind == 3 else min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                row[i] = (int(row[i]) + pick) & 255
        out[y] = above = row
    return out.view(">u2").astype(np.float64) / scale


def run_lengths(mask: np.ndarray) -> list[int]:
    """Column-major run lengths of a mask, starting with zeros."""
    flat = np.asarray(mask, bool).reshape(-1, order="F")
    cuts = np.flatnonzero(np.diff(np.concatenate([[False], flat]))) if flat.size else np.zeros(0, int)
    return np.diff(np.concatenate([[0], cuts, [flat.size]])).tolist()


def from_run_lengths(runs: list[int], h: int, w: int) -> np.ndarray:
    return np.repeat(np.arange(len(runs)) % 2 == 1, runs).reshape(h, w, order="F")


def packed_runs(runs: list[int]) -> str:
    """Run lengths as text: from the third on the difference to the one two before, in groups of five bits, lowest first, each a character from 48 on with bit 6 for more."""
    out = []
    for i, n in enumerate(runs):
        x = n - runs[i - 2] if i > 2 else n
        while True:
            low, x = x & 31, x >> 5
            done = x == (-1 if low & 16 else 0)
            out.append(chr(48 + (low | (0 if done else 32))))
            if done:
                break
    return "".join(out)


def unpacked_runs(text: str) -> list[int]:
    runs: list[int] = []
    x = shift = 0
    for c in text.encode():
        part = c - 48
        x |= (part & 31) << shift
        shift += 5
        if not part & 32:
            if part & 16:
                x -= 1 << shift
            runs.append(x + runs[-2] if len(runs) > 2 else x)
            x = shift = 0
    return runs
