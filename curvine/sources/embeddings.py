"""Embedding tables and fixed-width binary matrices."""

from __future__ import annotations

import ast
import struct
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from curvine.functions import kernels


def load_embeddings(spark: SparkSession, path: str, *, id_col="vec_id", vec_col="embedding", dim: int | None = None) -> DataFrame:
    """Parquet embeddings; with ``dim`` a row of another length fails the query.

    The check travels with the vector column, so a plan that does not read the
    vectors does not pay for it.
    """
    df = spark.read.parquet(path)
    for name in (id_col, vec_col):
        if name not in df.columns:
            raise ValueError(f"{path} has no column {name!r}")
    if dim is None:
        return df
    wrong = F.raise_error(F.concat(F.lit(f"expected {dim} dimensions, got "), F.size(vec_col).cast("string")))
    checked = F.when(F.col(vec_col).isNull() | (F.size(vec_col) == dim), F.col(vec_col)).otherwise(wrong.cast(df.schema[vec_col].dataType))
    return df.withColumn(vec_col, checked)


# --- fixed-width matrices -----------------------------------------------------


class _Rows(InputPartition):
    def __init__(self, path: str, first: int, count: int, start: int, dim: int, dtype: str):
        self.path, self.first, self.count, self.start, self.dim, self.dtype = path, first, count, start, dim, dtype


# Schemes of Hadoop that Arrow knows by another name.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasbs": "abfs", "wasb": "abfs"}


def open_uri(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, Hadoop's schemes included, and the path inside it."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}:{rest}")


def _files(path: str) -> list[tuple[str, int]]:
    """Files of a folder in name order, or the one file, with their sizes."""
    system, name = open_uri(path)
    info = system.get_file_info(name)
    if info.type == fs.FileType.Directory:
        found = system.get_file_info(fs.FileSelector(name))
        return sorted((f.path, f.size) for f in found if f.is_file and not f.base_name.startswith(("_", ".")))
    return [(name, info.size)]


def _header(system, name: str) -> tuple[int, str, int, int]:
    """Offset of the data, element type, rows and columns of an .npy file."""
    with system.open_input_file(name) as f:
        magic = f.read(8)
        if magic[:6] != b"\x93NUMPY":
            raise ValueError(f"{name} is not an .npy file; give dim for a raw matrix")
        wide = magic[6] > 1
        size = struct.unpack("<I" if wide else "<H", f.read(4 if wide else 2))[0]
        about = ast.literal_eval(f.read(size).decode("latin1"))
    if about["fortran_order"] or len(about["shape"]) != 2:
        raise ValueError(f"{name} is not a row-major matrix")
    return 8 + (4 if wide else 2) + size, about["descr"], about["shape"][0], about["shape"][1]


class MatrixReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        opts = self.options
        rows_per_task = int(opts.get("rowspertask", 65536))
        system, _ = open_uri(opts["path"])
        out, first = [], 0
        files = _files(opts["path"])
        raw = "dim" in opts
        with ThreadPoolExecutor(16) as pool:  # a header is one short read of a remote file
            headers = [None] * len(files) if raw else list(pool.map(lambda f: _header(system, f[0]), files))
        for (name, size), header in zip(files, headers):
            if raw:
                dtype, dim, start = opts.get("dtype", "<f4"), int(opts["dim"]), 0
                n, tail = divmod(size, dim * np.dtype(dtype).itemsize)
                if tail:
                    raise ValueError(f"{name} ends inside a row: {size} bytes are no multiple of {dim} x {dtype}")
            else:
                start, dtype, n, dim = header
            width = dim * np.dtype(dtype).itemsize
            for row in range(0, n, rows_per_task):
                out.append(_Rows(name, first + row, min(rows_per_task, n - row), start + row * width, dim, dtype))
            first += n
        return out

    def read(self, part: _Rows):
        system, _ = open_uri(self.options["path"])
        width = part.dim * np.dtype(part.dtype).itemsize
        step = 8192
        with system.open_input_file(part.path) as f:
            for row in range(0, part.count, step):
                n = min(step, part.count - row)
                f.seek(part.start + row * width)
                x = np.frombuffer(f.read(n * width), dtype=part.dtype).reshape(n, part.dim)
                ids = np.arange(part.first + row, part.first + row + n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), kernels.list_column(x.astype(np.float32), pa.float32())], names=["vec_id", "embedding"]
                )


class MatrixSource(DataSource):
    """``spark.read.format("matrix")``: rows of .npy files, or of raw files when ``dim`` is given.

    The id is the position over all files in name order. A task reads its own byte
    range only.
    """

    @classmethod
    def name(cls):
        return "matrix"

    def schema(self):
        return "vec_id bigint, embedding array<float>"

    def reader(self, schema):
        return MatrixReader(dict(self.options))


def read_matrix(spark: SparkSession, path: str, **options) -> DataFrame:
    """A matrix file or folder; ``dim`` and ``dtype`` describe raw files."""
    spark.dataSource.register(MatrixSource)
    reader = spark.read.format("matrix")
    for key, value in options.items():
        reader = reader.option(key, str(value))
    return reader.load(path)


def write_matrix(df: DataFrame, path: str, *, id_col="vec_id", vec_col="embedding", rows_per_file: int = 65536) -> int:
    """Write vectors in id order as .npy files of a bounded size; returns the number of rows.

    A task writes a temporary name and moves it over, so a repeated task leaves one file.
    """
    system, name = open_uri(path)
    system.create_dir(name, recursive=True)

    def run(batches):
        context = TaskContext.get()
        held, rows, number = [], 0, 0

        def flush():
            x = np.concatenate(held)
            file = f"part-{context.partitionId():06d}-{number:06d}.npy"
            attempt = f"{name}/_{file}-{context.taskAttemptId()}"
            with system.open_output_stream(attempt) as out:
                np.lib.format.write_array_header_1_0(out, {"descr": "<f4", "fortran_order": False, "shape": x.shape})
                out.write(x.tobytes())
            system.move(attempt, f"{name}/{file}")
            return pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int64())], names=["n"])

        for batch in batches:
            if batch.num_rows == 0:
                continue
            held.append(kernels.matrix(batch.column(1)).astype("<f4"))
            rows += batch.num_rows
            if rows >= rows_per_file:
                yield flush()
                held, rows, number = [], 0, number + 1
        if held:
            yield flush()

    ranged = df.select(id_col, vec_col).repartitionByRange(id_col).sortWithinPartitions(id_col)
    return ranged.mapInArrow(run, "n bigint").agg(F.sum("n")).collect()[0][0] or 0
