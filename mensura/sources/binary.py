"""Binary rasters and clouds as data sources in plain Python: 8 and 16-bit PNG, binary PLY. Files are read by Spark, so any store will do."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def png(data: bytes) -> np.ndarray:
    """Rows of a grey PNG without interlace, as unsigned integers."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, parts, head = 8, [], None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + size
    width, height, depth, colour, _, _, interlace = head
    if colour or interlace or depth not in (8, 16):
        raise ValueError("only grey PNG of 8 or 16 bits")
    step = depth // 8
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, 1 + width * step)
    out = np.zeros((height, width * step), np.uint8)
    above = np.zeros(width * step, np.int64)
    for y in range(height):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int64)
        if kind == 1:
            line = line.reshape(-1, step).cumsum(0).ravel()
        elif kind == 2:
            line = line + above
        elif kind in (3, 4):
            for x in range(len(line)):
                a, b = (line[x - step] & 255 if x >= step else 0), above[x]
                c = above[x - step] if x >= step else 0
                if kind == 3:
                    line[x] += (a + b) // 2
                else:
                    p = a + b - c
                    line[x] += min(((abs(p - v), k, v) for k, v in enumerate((a, b, c))))[2]
        above = line & 255
        out[y] = above
    return out.view(">u2").astype(np.uint16) if depth == 16 else out


def write_png(rows: np.ndarray) -> bytes:
    """The inverse of png, without filters."""
    step = rows.dtype.itemsize
    body = np.ascontiguousarray(rows.astype(">u2") if step == 2 else rows).view(np.uint8).reshape(len(rows), -1)
    raw = np.hstack([np.zeros((len(rows), 1), np.uint8), body]).tobytes()
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", rows.shape[1], len(rows), 8 * step, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


_PLY = {"float": "f4", "float32": "f4", "double": "f8", "float64": "f8", "uchar": "u1", "uint8": "u1", "char": "i1", "int8": "i1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4"}


def ply(data: bytes) -> np.ndarray:
    """Vertices of a binary PLY, with the columns that its header names."""
    end = data.index(b"end_header")
    end = data.index(b"\n", end) + 1
    fields, n, order, inside = [], 0, "<", False
    for line in data[:end].decode("ascii").splitlines():
        w = line.split()
        if w[:1] == ["format"]:
            order = ">" if w[1] == "binary_big_endian" else "<"
            if w[1] == "ascii":
                raise ValueError("only binary PLY")
        elif w[:1] == ["element"]:
            inside = w[1] == "vertex"
            n = int(w[2]) if inside else n
        elif w[:1] == ["property"] and inside:
            fields.append((w[-1], order + _PLY[w[1]]))
    return np.frombuffer(data, np.dtype(fields), n, end)


def depth_frames(spark: SparkSession, path: str, stride: int = 1) -> DataFrame:
    """(capture, frame, r, c, depth) in metres of all 16-bit depth rasters below a path, whose folder lies in their capture's; zero, for missing, becomes null."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                grid = png(bytes(content))[::stride, ::stride]
                r, c = np.indices(grid.shape)
                metres = np.where(grid > 0, grid * 1e-3, np.nan).ravel()
                folder = name.split("/")
                yield pd.DataFrame({"capture": folder[-3] if len(folder) > 2 else None, "frame": int(folder[-1].split(".")[0]), "r": r.ravel() * stride, "c": c.ravel() * stride, "depth": pd.array(metres).astype("Float64")})

    return files.mapInPandas(run, "capture string, frame int, r int, c int, depth double")


def ply_points(spark: SparkSession, path: str) -> DataFrame:
    """(x, y, z) of the vertices of all PLY files below a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ply").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                v = ply(bytes(content))
                yield pd.DataFrame({"file": name, **{c: v[c].astype(float) for c in "xyz"}})

    return files.mapInPandas(run, "file string, x double, y double, z double")
