"""Numbers for the rows of a table in its order, without a task that sees them all; keys for rows that may lack an id."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fairlead.llm.stage import KEYLESS, attach, stage

#: Rows of a range of the sort.
RANGE_ROWS = 100_000


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``number``, from 0, in ascending order of the columns ``order`` (null first); rows that tie there may stand either way.

    The table is range-sorted, rows are counted within each range, and the counts of the ranges, one row each, are added up.
    ``df`` is read twice or more; it should be a staged table.
    """
    schema = df.schema.simpleString()[len("struct<") : -1]
    ranges = -(-df.count() // RANGE_ROWS) or 1
    placed = df.withColumn("_row", F.monotonically_increasing_id())
    placed = placed.repartitionByRange(ranges, *order, "_row").sortWithinPartitions(*order, "_row").drop("_row")

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            cols = [*batch.columns, pa.array([part] * n, pa.int32()), pa.array(range(at, at + n), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, "_part", "_at"])
            at += n

    placed = stage(placed.mapInArrow(place, f"{schema}, _part int, _at long"), "numbered")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("n"))
    above = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", above.alias("_above"))
    return attach(placed, starts, "_part", "inner").withColumn("number", F.col("_above") + F.col("_at")).drop("_part", "_at", "_above")


def with_keys(docs: DataFrame) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``docs(doc_id, text)`` whose doc_id is a key that every row has, and a function that makes ids of key columns again.

    Without null ids the keys are the ids.  Otherwise ids are numbered in their order, and a row without one has a key from its
    text, above all numbers; equal texts have equal keys.  ``restore(df, *columns)`` makes such keys null.
    """
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    if not docs.where("doc_id is null").select("doc_id").head(1):
        return docs, lambda df, *columns: df
    ids = stage(docs.select("doc_id").where("doc_id is not null").distinct(), "ids")
    ids = stage(numbered(ids, ["doc_id"]), "ids")
    key = F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit(KEYLESS - 1)).bitwiseOR(F.lit(KEYLESS))
    keyed = attach(docs, ids, "doc_id").withColumn("doc_id", F.coalesce("number", key)).drop("number")

    def restore(df: DataFrame, *columns: str) -> DataFrame:
        order = df.columns
        for c in columns:
            df = attach(df, ids.select(F.col("number").alias(c), F.col("doc_id").alias("_id")), c).drop(c).withColumnRenamed("_id", c)
        return df.select(order)

    return keyed, restore
