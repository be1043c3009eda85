"""Gridded npz files as a Python data source, and versions of tables that readers change over to at once.

``spark.read.format("npzgrid").option("path", ...)`` gives it, iy, ix and the fields of three dimensions, one partition for
each time step: the driver reads the entries' headers only, and a task its own step of each field that is asked for.  Option
``fields`` prunes fields, filters on ``it`` prune steps.  NaN stays NaN.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual)
from pyspark.sql.types import DoubleType, IntegerType, StructType

#: Bytes that are read at once to get over the steps before one's own in a compressed entry.
_SKIP = 1 << 22


def _open(path: str) -> zipfile.ZipFile:
    fs, name = pyarrow.fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else "file://" + path)
    return zipfile.ZipFile(fs.open_input_file(name))


def _header(entry: zipfile.ZipExtFile) -> tuple[tuple[int, ...], np.dtype]:
    """Shape and type of an npy entry; the entry then stands at its first value."""
    major, _ = np.lib.format.read_magic(entry)
    read = np.lib.format.read_array_header_1_0 if major == 1 else np.lib.format.read_array_header_2_0
    shape, fortran, kind = read(entry)
    if fortran and len(shape) > 1:
        raise ValueError("arrays in column order are not read")
    return shape, kind


def grid_shapes(path: str) -> dict[str, tuple[int, ...]]:
    """The shapes of a file's entries, from their headers."""
    with _open(path) as z:
        shapes = {}
        for name in z.namelist():
            with z.open(name) as entry:
                shapes[name.removesuffix(".npy")] = _header(entry)[0]
    return shapes


def grid_entries(path: str, dimensions: int = 2) -> dict[str, object]:
    """The entries of at most so many dimensions: axes, hours, where the grid comes from."""
    small = [k for k, shape in grid_shapes(path).items() if len(shape) <= dimensions]
    out = {}
    with _open(path) as z:
        for k in small:
            with z.open(f"{k}.npy") as entry:
                value = np.lib.format.read_array(entry, allow_pickle=False)
            out[k] = value.item() if value.ndim == 0 else value.tolist()
    return out


def read_slices(path: str, field: str, first: int, count: int) -> np.ndarray:
    """``count`` slices of an entry's leading axis from ``first`` on; nothing after them is read."""
    with _open(path) as z, z.open(f"{field}.npy") as entry:
        shape, kind = _header(entry)
        size = int(np.prod(shape[1:])) * kind.itemsize
        count, left = max(0, min(count, shape[0] - first)), first * size
        while left:
            left -= len(entry.read(min(left, _SKIP)))
        return np.frombuffer(entry.read(count * size), kind).reshape(count, *shape[1:])


def read_step(path: str, field: str, step: int) -> np.ndarray:
    """One time step of a field, as doubles."""
    return read_slices(path, field, step, 1)[0].astype(float)


@dataclass
class Step(InputPartition):
    it: int


class GridReader(DataSourceReader):
    def __init__(self, path: str, fields: list[str], steps: int) -> None:
        self.path, self.fields, self.wanted = path, fields, list(range(steps))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        tests = {EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b,
                 LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}
        for f in filters:
            if type(f) in tests and f.attribute == ("it",):
                self.wanted = [i for i in self.wanted if tests[type(f)](i, f.value)]
            else:
                yield f

    def partitions(self) -> list[Step]:
        return [Step(i) for i in self.wanted] or [Step(-1)]

    def read(self, part: Step) -> Iterator[pa.RecordBatch]:
        if part.it < 0:
            return
        values = [read_step(self.path, f, part.it) for f in self.fields]
        ny, nx = values[0].shape
        lines = max(1, 100_000 // nx)
        for a in range(0, ny, lines):
            iy, ix = np.mgrid[a : min(a + lines, ny), 0:nx].astype(np.int32)
            columns = [np.full(iy.size, part.it, np.int32), iy.ravel(), ix.ravel(), *(v[a : a + lines].ravel() for v in values)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["it", "iy", "ix", *self.fields])


class GridSource(DataSource):
    """Options: path; fields, with commas between (all of three dimensions)."""

    @classmethod
    def name(cls) -> str:
        return "npzgrid"

    def _fields(self) -> tuple[list[str], int]:
        shapes = {k: s for k, s in grid_shapes(self.options["path"]).items() if len(s) == 3}
        fields = [f for f in self.options.get("fields", ",".join(shapes)).split(",") if f]
        if not fields or any(shapes.get(f) != shapes.get(fields[0]) or f not in shapes for f in fields):
            raise ValueError(f"fields {fields} are not grids of one shape in {self.options['path']}: {shapes}")
        return fields, shapes[fields[0]][0]

    def schema(self) -> StructType:
        out = StructType()
        for name in ("it", "iy", "ix"):
            out = out.add(name, IntegerType(), False)
        for name in self._fields()[0]:
            out = out.add(name, DoubleType(), False)
        return out

    def reader(self, schema: StructType) -> GridReader:
        fields, steps = self._fields()
        return GridReader(self.options["path"], fields, steps)


def read_grid(spark: SparkSession, path: str, fields: list[str] = ()) -> tuple[DataFrame, dict[str, object]]:
    """A gridded file as rows (it, iy, ix, fields), read by tasks, and its small entries."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GridSource)
    source = spark.read.format("npzgrid").option("path", path)
    return (source.option("fields", ",".join(fields)) if fields else source).load(), grid_entries(path)


def _versions(spark: SparkSession, folder: str) -> list[tuple[int, str, bool]]:
    """Number, path and whether it is complete of every version in a folder, in order."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("version=")]
    done = lambda p: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    return sorted((int(p.getName().removeprefix("version=")), p.toString(), done(p)) for p in found)


def publish(table: DataFrame, folder: str, keep: int = 2, by: list[str] = ()) -> str:
    """Write ``table`` as the next version in ``folder`` and return its path; readers see it once its job has committed.

    The ``keep`` newest complete versions stay, for readers that have begun on them.
    """
    spark = table.sparkSession
    before = _versions(spark, folder)
    path = f"{folder}/version={(before[-1][0] if before else 0) + 1:08d}"
    writer = table.write.mode("errorifexists")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    for _, old, _ in [v for v in before if v[2]][: max(0, sum(v[2] for v in before) + 1 - keep)]:
        p = spark._jvm.org.apache.hadoop.fs.Path(old)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return path


def newest(spark: SparkSession, folder: str) -> DataFrame:
    """The newest complete version in ``folder``; one whose job still runs or has failed is not seen."""
    done = [path for _, path, complete in _versions(spark, folder) if complete]
    if not done:
        raise FileNotFoundError(f"no complete version in {folder}")
    return spark.read.parquet(done[-1])
