"""PLY point files as a Spark data source: ``spark.read.format("ply")`` and ``df.write.format("ply")``.

Paths may name any file system that Arrow opens (local, hdfs, object stores); tasks and driver use
the same one.  Binary little-endian vertices have a fixed width, so a file splits into byte ranges
that tasks read independently.  A task writes complete files of bounded size, one value of the
``by`` column at a time if that option is set; a commit only moves them.
"""

from __future__ import annotations

import io
import uuid
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

# --- fixed values: PLY scalar names -------------------------------------------------------
TYPES = {
    "char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8",
    "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8",
}
SQL = {"i1": "tinyint", "u1": "int", "i2": "smallint", "u2": "int", "i4": "int", "u4": "bigint", "f4": "float", "f8": "double"}
WRITE = {"tinyint": "char", "smallint": "short", "int": "int", "float": "float", "double": "double"}
GAUSSIAN_FIELDS = {"f_dc_0", "f_rest_0", "opacity", "scale_0", "rot_0"}
CHUNK_ROWS = 250_000
FILE_ROWS = 1_000_000  # a larger scan is written as several files


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    uri = urlparse(path)
    if uri.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(uri.path) if uri.scheme else path
    return fs.FileSystem.from_uri(path)


@dataclass
class Header:
    binary: bool
    count: int
    fields: list  # (name, numpy type)
    offset: int


    @property
    def is_gaussian(self) -> bool:
        return bool(GAUSSIAN_FIELDS & {n for n, _ in self.fields})


def read_header(path: str) -> Header:
    store, where = opened(path)
    head = b""
    with store.open_input_file(where) as f:
        while b"end_header\n" not in head:
            more = f.read(1 << 16)
            if not more or not (head + more).startswith(b"ply"):
                raise ValueError(f"not a PLY file: {path}")
            head += more
    offset = head.index(b"end_header\n") + len(b"end_header\n")
    fields, count, fmt, inside = [], 0, None, False
    for word in (line.split() for line in head[:offset].decode("ascii").splitlines()):
        if word[:1] == ["format"]:
            fmt = word[1]
        elif word[:1] == ["element"]:
            inside = word[1] == "vertex"
            if inside:
                count = int(word[2])
            elif not fields:
                raise ValueError("vertex must be the first element")
        elif word[:1] == ["property"] and inside:
            fields.append((word[2], TYPES[word[1]]))
    if fmt not in ("binary_little_endian", "ascii"):
        raise ValueError(f"unsupported PLY format {fmt}")
    if not {"x", "y", "z"} <= {n for n, _ in fields}:
        raise ValueError(f"PLY misses x/y/z: {path}")
    return Header(fmt != "ascii", count, fields, offset)


@dataclass
class Range(InputPartition):
    path: str
    first: int
    rows: int


class PlyReader(DataSourceReader):
    def __init__(self, options, schema):
        self.files = list_files(options["path"])
        self.names = schema.names

    def partitions(self):
        parts = []
        for path in self.files:
            h = read_header(path)
            step = CHUNK_ROWS if h.binary else max(1, h.count)
            parts += [Range(path, s, min(step, h.count - s)) for s in range(0, h.count, step)]
        return parts

    def read(self, part):
        h = read_header(part.path)
        dtype = np.dtype([(n, "<" + t) for n, t in h.fields])
        store, where = opened(part.path)
        with store.open_input_file(where) as f:
            if h.binary:
                f.seek(h.offset + part.first * dtype.itemsize)
                rows = np.frombuffer(f.read(part.rows * dtype.itemsize), dtype=dtype)
            else:
                f.seek(h.offset)
                rows = np.loadtxt(io.BytesIO(f.read()), dtype=dtype, max_rows=part.rows, ndmin=1)
        cols = []
        for n in self.names:
            if n == "point_id":
                cols.append(pa.array(np.arange(part.first, part.first + part.rows, dtype=np.int64)))
            elif n == "file":
                cols.append(pa.array([part.path.rsplit("/", 1)[-1]] * part.rows))
            else:
                kind = dict(h.fields)[n]
                cols.append(pa.array(rows[n].astype({"u1": "i4", "u2": "i4", "u4": "i8"}.get(kind, kind))))
        yield pa.RecordBatch.from_arrays(cols, names=self.names)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class PlyWriter(DataSourceArrowWriter):
    def __init__(self, options, schema):
        self.path, self.by, self.order = options["path"], options.get("by"), options.get("order")
        self.fields = [(f.name, f.dataType.simpleString()) for f in schema.fields if f.name not in (self.by, self.order)]
        for n, t in self.fields:
            if t not in WRITE:
                raise ValueError(f"PLY cannot hold column {n} of type {t}")

    def write(self, iterator):
        """Rows come sorted by the ``by`` column; Arrow batches are cut where its value changes."""
        dtype = np.dtype([(n, "<" + TYPES[WRITE[t]]) for n, t in self.fields])
        store, folder = opened(self.path)
        store.create_dir(folder, recursive=True)
        done, blocks, held, value = [], [], 0, None

        def flush():
            nonlocal blocks, held
            if held:
                name = f"{'part' if self.by is None else value}-{len(done):05d}-{uuid.uuid4().hex}.ply"
                head = "".join(["ply\nformat binary_little_endian 1.0\n", f"element vertex {held}\n", *[f"property {WRITE[t]} {n}\n" for n, t in self.fields], "end_header\n"])
                with store.open_output_stream(f"{folder}/.{name}.tmp") as f:
                    f.write(head.encode())
                    for block in blocks:
                        f.write(block.tobytes())
                done.append(name)
            blocks, held = [], 0

        for batch in iterator:
            keys = batch.column(self.by).to_pylist() if self.by else [None] * batch.num_rows
            edges = [0, *[k for k in range(1, len(keys)) if keys[k] != keys[k - 1]], len(keys)]
            rows = np.empty(batch.num_rows, dtype)
            for n, _ in self.fields:
                rows[n] = batch.column(n).to_numpy(zero_copy_only=False)
            for begin, end in zip(edges, edges[1:]):
                if held and (keys[begin] != value or held >= FILE_ROWS):
                    flush()
                if end > begin:
                    value = keys[begin]
                    blocks.append(rows[begin:end])
                    held += end - begin
        flush()
        return Written(done)

    def commit(self, messages):
        store, folder = opened(self.path)
        for name in (n for m in messages if m is not None for n in m.names):
            store.move(f"{folder}/.{name}.tmp", f"{folder}/{name}")

    def abort(self, messages):
        store, folder = opened(self.path)
        for name in (n for m in messages if m is not None for n in m.names):
            store.delete_file(f"{folder}/.{name}.tmp")


def list_files(path: str) -> list[str]:
    """PLY files at a path: one file, or the visible ones of a folder."""
    store, where = opened(path)
    info = store.get_file_info(where)
    if info.type == fs.FileType.File:
        return [path]
    found = store.get_file_info(fs.FileSelector(where)) if info.type == fs.FileType.Directory else []
    names = sorted(i.base_name for i in found if i.base_name.endswith(".ply") and not i.base_name.startswith("."))
    if not names:
        raise FileNotFoundError(f"no PLY file at {path}")
    return [f"{path.rstrip('/')}/{n}" for n in names]


class PlySource(DataSource):
    """Reads vertices with ``point_id`` (vertex index) and ``file``; writes numeric columns."""

    @classmethod
    def name(cls):
        return "ply"

    def schema(self):
        h = read_header(list_files(self.options["path"])[0])
        return ", ".join(["file string", "point_id bigint", *[f"`{n}` {SQL[t]}" for n, t in h.fields]])

    def reader(self, schema):
        return PlyReader(self.options, schema)

    def writer(self, schema, overwrite):
        return PlyWriter(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PlySource)


def write_rows(rows: DataFrame, path: str) -> None:
    """One file per scan in ``point_id`` order with every column but these two."""
    register(rows.sparkSession)
    spread = rows.repartition("scan_id").sortWithinPartitions("scan_id", "point_id")
    spread.write.format("ply").option("by", "scan_id").option("order", "point_id").mode("append").save(path)


def write_points(points: DataFrame, path: str) -> None:
    """x, y, z and colour vertices, one file per scan."""
    write_rows(points.selectExpr("scan_id", "point_id", "float(x) AS x", "float(y) AS y", "float(z) AS z", "int(r) AS red", "int(g) AS green", "int(b) AS blue"), path)


def labeled(gaussians: DataFrame, labels: DataFrame) -> DataFrame:
    """All source properties plus label id, confidence and support views; scans whose counts differ are skipped."""
    n = labels.select("scan_id", "point_id", "semantic_label_id", "semantic_confidence", "semantic_support_views")
    out = gaussians.join(n.withColumn("_has", F.lit(True)), ["scan_id", "point_id"], "left")
    short = out.where("_has IS NULL").select("scan_id").distinct()
    return out.join(short, "scan_id", "left_anti").drop("_has")


def subset(gaussians: DataFrame, keys: DataFrame) -> DataFrame:
    """Kept points with every property."""
    return gaussians.join(keys.select("scan_id", "point_id"), ["scan_id", "point_id"], "left_semi")
