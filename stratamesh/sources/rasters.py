"""Raster files: grids of cells as uncompressed GeoTIFF tiles of 32-bit numbers, written and read by executors."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamesh.functions.geometry import Bounds

NODATA = -9999.0
#: Cells to a side of a file, at most: a task holds one file's cells.
SIDE = 2048
#: TIFF tags and their types (3: 16 bit, 4: 32 bit, 12: double, 2: text).
_KIND = {256: 4, 257: 4, 258: 3, 259: 3, 262: 3, 273: 4, 277: 3, 278: 4, 279: 4, 339: 3, 33550: 12, 33922: 12, 34735: 3, 42113: 2}
_FORMAT = {2: "s", 3: "H", 4: "I", 12: "d"}


def encode_tiff(values: np.ndarray, left: float, top: float, cell: float, epsg: int | None = None, nodata: float = NODATA) -> bytes:
    """A GeoTIFF of values (rows from the top, NaN for no data); left and top: the raster's corner."""
    height, width = values.shape
    body = np.where(np.isnan(values), nodata, values).astype("<f4").tobytes()
    tags: dict[int, tuple] = {
        256: (width,), 257: (height,), 258: (32,), 259: (1,), 262: (1,), 273: (8,), 277: (1,), 278: (height,), 279: (len(body),), 339: (3,),
        33550: (cell, cell, 0.0), 33922: (0.0, 0.0, 0.0, left, top, 0.0), 42113: (f"{nodata:g}\0".encode(),),
    }
    if epsg:
        plane = epsg != 4326
        tags[34735] = (1, 1, 0, 3, 1024, 0, 1, 1 if plane else 2, 1025, 0, 1, 1, 3072 if plane else 2048, 0, 1, epsg)
    start = 8 + len(body) + len(body) % 2
    after, entries, tail = start + 2 + 12 * len(tags) + 4, b"", b""
    for tag, v in sorted(tags.items()):
        kind = _KIND[tag]
        raw = v[0] if kind == 2 else struct.pack(f"<{len(v)}{_FORMAT[kind]}", *v)
        place = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", after + len(tail))
        tail += b"" if len(raw) <= 4 else raw + b"\0" * (len(raw) % 2)
        entries += struct.pack("<HHI", tag, kind, len(raw) if kind == 2 else len(v)) + place
    return struct.pack("<2sHI", b"II", 42, start) + body + b"\0" * (len(body) % 2) + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0) + tail


def decode_tiff(content: bytes) -> tuple[np.ndarray, float, float, float]:
    """(values with NaN for no data, left, top, cell) of what encode_tiff() writes; ValueError for other files."""
    if content[:4] != b"II*\0":
        raise ValueError("not a little-endian TIFF")
    at = struct.unpack_from("<I", content, 4)[0]
    tags = {}
    for i in range(struct.unpack_from("<H", content, at)[0]):
        tag, kind, n = struct.unpack_from("<HHI", content, at + 2 + 12 * i)
        if tag in _KIND:
            size = struct.calcsize(f"<{n}{_FORMAT[kind]}")
            place = at + 2 + 12 * i + 8 if size <= 4 else struct.unpack_from("<I", content, at + 2 + 12 * i + 8)[0]
            tags[tag] = struct.unpack_from(f"<{n}{_FORMAT[kind]}", content, place)
    if tags.get(259) != (1,) or tags.get(258) != (32,) or tags.get(339) != (3,) or len(tags.get(273, ())) != 1:
        raise ValueError("only uncompressed rasters of 32-bit numbers in one strip are read")
    values = np.frombuffer(content, "<f4", tags[256][0] * tags[257][0], tags[273][0]).reshape(tags[257][0], tags[256][0]).astype(float)
    nodata = float(tags[42113][0].rstrip(b"\0")) if 42113 in tags else None
    return np.where(values == nodata, np.nan, values), tags[33922][3], tags[33922][4], tags[33550][0]


def write_rasters(cells: DataFrame, value: str, b: Bounds, cell: float, folder: str, epsg: int | None = None, side: int = SIDE) -> DataFrame:
    """(file, n_cells) of GeoTIFF files of a grid's cells (cell_x, cell_y, value), `side` cells square, in a folder that executors share.

    Cells without a row or with a null are no data; of cells that stand twice one is taken; squares without any cell have no
    file. Names tell a square's place, so a retried task writes the same file. Nothing is written before the result is read.
    """
    os.makedirs(folder, exist_ok=True)
    rows = cells.select(F.floor(F.col("cell_x") / side).cast("int").alias("i"), F.floor(F.col("cell_y") / side).cast("int").alias("j"), "cell_x", "cell_y", F.col(value).cast("double").alias("v"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        i, j = int(part.i.iloc[0]), int(part.j.iloc[0])
        x, y = part.cell_x.to_numpy() - i * side, part.cell_y.to_numpy() - j * side
        values = np.full((int(y.max()) + 1, int(x.max()) + 1), np.nan)
        values[values.shape[0] - 1 - y, x] = part.v.to_numpy()
        name = os.path.join(folder, f"raster-{i:05d}-{j:05d}.tif")
        with open(name + ".tmp", "wb") as f:
            f.write(encode_tiff(values, b.min_x + i * side * cell, b.min_y + (j * side + values.shape[0]) * cell, cell, epsg))
        os.replace(name + ".tmp", name)
        return pd.DataFrame({"file": [name], "n_cells": [len(part)]})

    return rows.groupBy("i", "j").applyInPandas(run, "file string, n_cells long")


def read_rasters(spark: SparkSession, path: str, b: Bounds, cell: float) -> DataFrame:
    """(cell_x, cell_y, value) of the cells with data of GeoTIFF files, by Spark's own reader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                values, left, top, _ = decode_tiff(content)
                row, col = np.nonzero(~np.isnan(values))
                x = np.rint((left - b.min_x) / cell).astype(int) + col
                y = np.rint((top - b.min_y) / cell).astype(int) - 1 - row
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()), pa.array(y, pa.int32()), pa.array(values[row, col])], ["cell_x", "cell_y", "value"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.tif").load(path).select("content").mapInArrow(run, "cell_x int, cell_y int, value double")
