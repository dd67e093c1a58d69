"""LAS files (uncompressed, point formats 0 to 3 and 6 to 8) as a Spark data source named `las`, and a writer.

A reader task takes one range of one file's points, so large files are read by many tasks. Conditions on classification
and coordinates go to the reader (with spark.sql.python.filterPushdown.enabled): files whose header box can't hold a hit aren't
opened again, other points are left out before rows are made. Files lie on a folder that driver and executors mount;
read_anywhere() takes them from any store that Spark reads. No codec for compressed LAZ is at hand; such files raise ValueError.
"""

from __future__ import annotations

import glob
import os
import struct
from collections.abc import Iterable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

INTS = ("intensity", "return_number", "number_of_returns", "classification", "scan_direction_flag", "edge_of_flight_line", "synthetic", "key_point", "withheld", "user_data", "point_source_id", "red", "green", "blue")
SCHEMA = "file string, point_id long, x double, y double, z double, " + ", ".join(f"{c} int" for c in INTS) + ", scan_angle double, gps_time double, distance double"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
#: Record lengths of the point formats, where GPS time and colours stand, degrees of one step of the scan angle from format 6 on.
_LENGTH = {0: 20, 1: 28, 2: 26, 3: 34, 6: 30, 7: 36, 8: 38}
_GPS = {1: 20, 3: 20, 6: 22, 7: 22, 8: 22}
_COLOURS = {2: 20, 3: 28, 7: 30, 8: 30}
_STEP = 0.006
CHUNK = 1_000_000
#: Points that the writer puts into a file at most: some 30 MB, as read_anywhere() holds whole files.
PER_FILE = 1_000_000


def parse_header(h: bytes, path: str) -> dict:
    """Version, date, format, counts, scale, offset, box of a file's first 375 bytes. ValueError for other content."""
    if h[:4] != b"LASF":
        raise ValueError(f"not a LAS file: {path}")
    minor = h[25]
    day, year = struct.unpack_from("<HH", h, 90)
    data, _, fmt, length, count = struct.unpack_from("<IIBHI", h, 96)
    scale, offset = struct.unpack_from("<3d", h, 131), struct.unpack_from("<3d", h, 155)
    box = struct.unpack_from("<6d", h, 179)
    if minor >= 4 and len(h) >= 255:
        count = struct.unpack_from("<Q", h, 247)[0] or count
    if fmt & 0x80 or fmt not in _LENGTH:
        raise ValueError(f"point format {fmt & 0x3F} isn't supported, or the file is compressed: {path}")
    return {"path": path, "version": f"{h[24]}.{minor}", "creation_day": day, "creation_year": year, "point_format": fmt, "record": length, "data": data, "n_points": count, "scales": list(scale), "offsets": list(offset), "max_x": box[0], "min_x": box[1], "max_y": box[2], "min_y": box[3], "max_z": box[4], "min_z": box[5]}


def read_header(path: str) -> dict:
    """parse_header() of a file. ValueError for another suffix, FileNotFoundError for no file."""
    if not path.lower().endswith(".las"):
        raise ValueError(f"not a LAS file: {path}")
    with open(path, "rb") as f:
        return parse_header(f.read(375), path)


def dimensions(fmt: int) -> list[str]:
    """The columns that points of a format fill."""
    return ["x", "y", "z", *(c for c in INTS if c not in ("red", "green", "blue") or fmt in _COLOURS), "scan_angle", *(["gps_time"] if fmt in _GPS else [])]


def decode(head: dict, raw: np.ndarray) -> dict[str, np.ndarray]:
    """Columns of records (rows of bytes); those that the format lacks are missing."""
    get = lambda at, kind: raw[:, at : at + np.dtype(kind).itemsize].copy().view(kind)[:, 0]
    fmt, out = head["point_format"], {}
    for i, c in enumerate("xyz"):
        out[c] = get(4 * i, "<i4") * head["scales"][i] + head["offsets"][i]
    first, second = raw[:, 14].astype(np.int32), raw[:, 15].astype(np.int32)
    bit = lambda v, i: v >> i & 1
    if fmt >= 6:
        out |= {"return_number": first & 15, "number_of_returns": first >> 4, "classification": raw[:, 16], "point_source_id": get(20, "<u2"), "scan_angle": get(18, "<i2") * _STEP}
        out |= {"synthetic": bit(second, 0), "key_point": bit(second, 1), "withheld": bit(second, 2), "scan_direction_flag": bit(second, 6), "edge_of_flight_line": bit(second, 7)}
    else:
        out |= {"return_number": first & 7, "number_of_returns": first >> 3 & 7, "classification": second & 31, "point_source_id": get(18, "<u2"), "scan_angle": get(16, "<i1").astype(float)}
        out |= {"synthetic": bit(second, 5), "key_point": bit(second, 6), "withheld": bit(second, 7), "scan_direction_flag": bit(first, 6), "edge_of_flight_line": bit(first, 7)}
    out |= {"intensity": get(12, "<u2"), "user_data": raw[:, 17]}
    if fmt in _GPS:
        out["gps_time"] = get(_GPS[fmt], "<f8")
    if fmt in _COLOURS:
        out |= {c: get(_COLOURS[fmt] + 2 * i, "<u2") for i, c in enumerate(("red", "green", "blue"))}
    if head["record"] >= _LENGTH[fmt] + 8:
        out["distance"] = get(_LENGTH[fmt], "<f8")
    return out


def batch_of(head: dict, raw: np.ndarray, start: int, conditions: Iterable[tuple[str, str, object]] = ()) -> pa.RecordBatch:
    """Rows of NAMES of the records from number `start` on that meet every (column, operation, value)."""
    cols = decode(head, raw) | {"point_id": np.arange(start, start + len(raw))}
    keep = np.ones(len(raw), bool)
    for c, op, value in conditions:
        keep &= _TESTS[op](cols[c], value)
    own = {c: v[keep] for c, v in cols.items()}
    n = int(keep.sum())
    kind = {c: pa.int32() for c in INTS} | {"point_id": pa.int64(), "file": pa.string()}
    arrays = [pa.array([os.path.basename(head["path"])] * n) if c == "file" else pa.array(own[c], kind.get(c, pa.float64())) if c in own else pa.nulls(n, kind.get(c, pa.float64())) for c in NAMES]
    return pa.RecordBatch.from_arrays(arrays, NAMES)


_TESTS = {
    "EqualTo": lambda c, v: c == v, "In": lambda c, v: np.isin(c, list(v)), "GreaterThan": lambda c, v: c > v, "GreaterThanOrEqual": lambda c, v: c >= v,
    "LessThan": lambda c, v: c < v, "LessThanOrEqual": lambda c, v: c <= v,
}


class _Range(InputPartition):
    def __init__(self, path: str, start: int, n: int):
        self.path, self.start, self.n = path, start, n


class LasReader(DataSourceReader):
    def __init__(self, options: dict):
        path = options["path"]
        self.files = sorted(glob.glob(os.path.join(path, "*.las")) if os.path.isdir(path) else glob.glob(path))
        if not self.files:
            raise FileNotFoundError(path)
        self.chunk = int(options.get("chunk", CHUNK))
        self.conditions: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        """Comparisons of coordinates and classes with constants are met here; the rest is Spark's."""
        for f in filters:
            name = type(f).__name__
            column = ".".join(getattr(f, "attribute", ()))
            value = getattr(f, "value", None)
            if name in _TESTS and column in ("x", "y", "z", "classification") and value is not None:
                self.conditions.append((column, name, value))
            else:
                yield f

    def _may_hold(self, head: dict) -> bool:
        for c, op, v in self.conditions:
            if c in "xyz" and op != "In":
                # a header's box may be rounded to its scale
                low, high = head[f"min_{c}"] - head["scales"]["xyz".index(c)], head[f"max_{c}"] + head["scales"]["xyz".index(c)]
                if (op.startswith("Greater") and high < v) or (op.startswith("Less") and low > v) or (op == "EqualTo" and not low <= v <= high):
                    return False
        return True

    def partitions(self) -> list[InputPartition]:
        heads = [h for h in map(read_header, self.files) if self._may_hold(h)]
        return [_Range(h["path"], i, min(self.chunk, h["n_points"] - i)) for h in heads for i in range(0, h["n_points"], self.chunk)] or [_Range(self.files[0], 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if partition.n:
            head = read_header(partition.path)
            with open(partition.path, "rb") as f:
                f.seek(head["data"] + partition.start * head["record"])
                for at in range(0, partition.n, 100_000):
                    n = min(100_000, partition.n - at)
                    raw = np.frombuffer(f.read(n * head["record"]), np.uint8).reshape(-1, head["record"])
                    yield batch_of(head, raw, partition.start + at, self.conditions)


class LasSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LasReader:
        return LasReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LasSource)
    with suppress(Exception):  # a session that doesn't let it be set filters after reading
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_anywhere(spark: SparkSession, path: str) -> DataFrame:
    """The same columns from files in any store that Spark reads. A file comes to its task whole (2 GB at most), so it's for stores that can't be mounted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                content = memoryview(content.as_buffer())
                head = parse_header(bytes(content[:375]), name)
                raw = np.frombuffer(content, np.uint8, head["n_points"] * head["record"], head["data"]).reshape(-1, head["record"])
                for at in range(0, len(raw), 100_000):
                    yield batch_of(head, raw[at : at + 100_000], at)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.las").load(path).select("path", "content").mapInArrow(run, SCHEMA)


def headers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A row for each file: version, date, format, scales, offsets, dimensions, box and number of points, from headers alone."""
    kinds = "path string, version string, creation_day int, creation_year int, point_format int, record int, data long, n_points long, scales array<double>, offsets array<double>, max_x double, min_x double, max_y double, min_y double, max_z double, min_z double, dimensions array<string>"
    rows = []
    for p in paths:
        h = read_header(p)
        rows.append(tuple(h.values()) + (dimensions(h["point_format"]),))
    return spark.createDataFrame(rows, kinds)


def _records(extra: list[str], wkt: str | None) -> bytes:
    """Variable length records: extra 64-bit fields, and the text of the coordinate system."""
    out = b""
    if extra:
        fields = b""
        for name in extra:
            field = bytearray(192)
            field[2], field[4 : 4 + min(32, len(name))] = 10, name.encode("ascii")[:32]
            fields += bytes(field)
        out += struct.pack("<H16sHH32s", 0, b"LASF_Spec", 4, len(fields), b"extra fields") + fields
    if wkt:
        text = wkt.encode() + b"\0"
        out += struct.pack("<H16sHH32s", 0, b"LASF_Projection", 2112, len(text), b"coordinate system") + text
    return out


def wkt_in(path: str) -> str | None:
    """The text of a file's coordinate system, if it has one."""
    with open(path, "rb") as f:
        h = f.read(375)
        size, count = struct.unpack_from("<H", h, 94)[0], struct.unpack_from("<I", h, 100)[0]
        f.seek(size)
        for _ in range(count):
            _, user, kind, length, _ = struct.unpack("<H16sHH32s", f.read(54))
            body = f.read(length)
            if user.rstrip(b"\0") == b"LASF_Projection" and kind == 2112:
                return body.rstrip(b"\0").decode()
    return None


class _File:
    """A LAS 1.4 file of point format 6 that grows batch by batch; its header is written last."""

    def __init__(self, path: str, extra: list[str], wkt: str | None, scale: float):
        self.path, self.extra, self.scale, self.vlrs = path, extra, scale, _records(extra, wkt)
        self.count = len(extra[:1]) + bool(wkt)
        self.wkt, self.n, self.offset = bool(wkt), 0, None
        self.low, self.high = np.full(3, np.inf), np.full(3, -np.inf)
        self.out = open(path + ".tmp", "wb")  # noqa: SIM115
        self.out.write(bytes(375) + self.vlrs)

    def add(self, cols: dict[str, np.ndarray]) -> None:
        xyz = np.stack([cols[c] for c in "xyz"])
        if self.offset is None:
            self.offset = np.floor(xyz.min(1))
        self.low, self.high = np.minimum(self.low, xyz.min(1)), np.maximum(self.high, xyz.max(1))
        n = xyz.shape[1]
        rec = np.zeros((n, 30 + 8 * len(self.extra)), np.uint8)
        for i in range(3):
            rec[:, 4 * i : 4 * i + 4] = np.rint((xyz[i] - self.offset[i]) / self.scale).astype("<i4").view(np.uint8).reshape(n, 4)
        rec[:, 14], rec[:, 16] = 0x11, cols["classification"].astype(np.uint8)
        for i, name in enumerate(self.extra):
            rec[:, 30 + 8 * i : 38 + 8 * i] = cols[name].astype("<f8").view(np.uint8).reshape(n, 8)
        self.out.write(rec.tobytes())
        self.n += n

    def close(self) -> None:
        h = bytearray(375)
        h[:4], h[24], h[25] = b"LASF", 1, 4
        struct.pack_into("<H", h, 6, 16 if self.wkt else 0)
        h[26 : 26 + 10] = b"stratamesh"
        struct.pack_into("<HHH", h, 90, 1, 2020, 375)
        struct.pack_into("<IIBHI", h, 96, 375 + len(self.vlrs), self.count, 6, 30 + 8 * len(self.extra), min(self.n, 2**32 - 1))
        struct.pack_into("<3d3d", h, 131, *[self.scale] * 3, *self.offset)
        struct.pack_into("<6d", h, 179, *(v for pair in zip(self.high, self.low, strict=True) for v in pair))
        struct.pack_into("<Q", h, 247, self.n)
        self.out.seek(0)
        self.out.write(h)
        self.out.close()
        os.replace(self.path + ".tmp", self.path)  # a retried task writes the same file


def write(points: DataFrame, folder: str, extra: Iterable[str] = (), wkt: str | None = None, scale: float = 0.001, per_file: int = PER_FILE) -> int:
    """LAS files of points (x, y, z, classification, distance if there, and number or boolean columns `extra`) in a folder that executors share. Returns the number of files.

    Each partition writes its points batch by batch, `per_file` to a file at most, so memory doesn't grow with a partition. Coordinates are rounded to `scale`
    and must lie within two billion of it from a file's first batch (ValueError); nulls in extra columns are NaN, booleans 0 and 1.
    wkt: the text of the coordinate system, put into every file.
    """
    names = [*(["distance"] if "distance" in points.columns and "distance" not in extra else []), *extra]
    os.makedirs(folder, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, done, own = TaskContext.get().partitionId(), [], None
        for b in batches:
            for lo in range(0, len(b), per_file):
                part = b.slice(lo, per_file)
                cols = {c: part.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(part.schema.names)}
                if own is not None and own.n + len(part) > per_file:
                    own.close()
                    own = None
                if own is None:
                    done.append(os.path.join(folder, f"part-{task:05d}-{len(done):03d}.las"))
                    own = _File(done[-1], names, wkt, scale)
                if any(np.abs((cols[c] - (own.offset[i] if own.offset is not None else np.floor(cols[c].min()))) / scale).max() > 2e9 for i, c in enumerate("xyz")):
                    raise ValueError("coordinates too far apart for this scale")
                own.add(cols)
        if own is not None:
            own.close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["file"])

    numbers = [F.col(c).cast("double").alias(c) for c in names]
    return points.select(*(F.col(c).cast("double").alias(c) for c in "xyz"), F.col("classification").cast("int").alias("classification"), *numbers).mapInArrow(run, "file string").count()
