"""Cutting lineage of iterative plans in the cluster's checkpoint folder, and long expressions where they are shared."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if base:
        return base
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="fairlead-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read back, worked out once; on a local master without one a temporary folder serves."""
    spark, schema = df.sparkSession, df.schema
    path = f"{_folder(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with ``columns``, each worked out once a row: later expressions read the value, not a copy of the expression."""
    made = F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias("_made")
    return df.select("*", made).select(*[f"`{k}`" for k in df.columns], "_made.*")
