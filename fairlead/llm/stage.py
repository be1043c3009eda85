"""Tables in the cluster's shared folder, and joins that check a side's size before broadcasting it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, NumericType, StringType

#: Most rows and most bytes of values that are sent to every executor; beyond either the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 16 << 20
#: Most characters of a plan's text that the driver keeps of each written table.
PLAN_CHARS = 4096
#: Where the keys of rows without a doc_id begin, above the numbers that stand for doc_ids in tables with such rows.
KEYLESS = 1 << 62


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one only for a local master without that setting."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = getattr(spark.sparkContext, "_fairlead_dir", None)
        if base is None:
            base = spark.sparkContext._fairlead_dir = "file://" + tempfile.mkdtemp(prefix="fairlead-")
    return f"{base.rstrip('/')}/fairlead-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI and the path within it, for tasks that read or write files of their own format."""
    return pyarrow.fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else "file://" + path)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark, schema = df.sparkSession, df.schema
    path = new_path(spark, name)
    with brief_plans(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


@contextmanager
def brief_plans(spark: SparkSession) -> Iterator[None]:
    """Short texts of plans for a while: the driver keeps those of its last thousand jobs, which an iterative operator fills."""
    key = "spark.sql.maxPlanStringLength"
    before = spark.conf.get(key)
    spark.conf.set(key, PLAN_CHARS)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def once(df: DataFrame, key: str) -> DataFrame:
    """A staged table with one row for each ``key``; it is written anew only if some key has more."""
    n = df.agg(F.count("*").alias("n"), F.count_distinct(key).alias("d")).first()
    return df if n["n"] == n["d"] else stage(df.dropDuplicates([key]), "once")


def drop(df: DataFrame) -> None:
    """Delete the files of a staged table that no later step reads."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if path.startswith(shared_dir(spark).replace("file:///", "file:/")) or path.startswith(shared_dir(spark)):
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def semi(big: DataFrame, ids: DataFrame, on: list[str] | str) -> DataFrame:
    """Rows of ``big`` whose key is in ``ids``; ``ids`` is broadcast up to BROADCAST_ROWS rows, else both sides shuffle."""
    return big.join(_checked(ids), on, "left_semi")


def anti(big: DataFrame, ids: DataFrame, on: list[str] | str) -> DataFrame:
    """Rows of ``big`` whose key is not in ``ids``, under the same size check as ``semi``."""
    return big.join(_checked(ids), on, "left_anti")


def attach(big: DataFrame, small: DataFrame, on: list[str] | str, how: str = "left") -> DataFrame:
    """``big`` with the columns of ``small``, under the same size check as ``semi``."""
    return big.join(_checked(small), on, how)


def _checked(df: DataFrame) -> DataFrame:
    size = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(0))
    n, total = df.limit(BROADCAST_ROWS + 1).agg(F.count("*"), F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and total <= BROADCAST_BYTES else df


def _bytes(c: Column, kind: DataType) -> Column:
    """About how many bytes a value takes, that of an array by its elements."""
    if isinstance(kind, ArrayType):
        return F.coalesce(F.size(c), F.lit(0)) * (8 if isinstance(kind.elementType, NumericType) else 64)
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0))
    return F.lit(8)
