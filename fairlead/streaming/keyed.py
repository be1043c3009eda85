"""A keyed table that a stream keeps up to date, and streams joined with tables that change (S25, section 2.13).

Rows live in buckets by the hash of their key.  A micro-batch rewrites the buckets that it touches and then names, in one
small file, where each bucket stands now; readers follow the newest such file, so they see whole batches only and read
every bucket once.  A batch that runs again finds its own file and does nothing, or finds none and writes its buckets over.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from fairlead.operators.cut import cut
from fairlead.sources.gridfile import newest
from fairlead.sources.telemetry import keep_last

KEYS = ["timestamp", "source_pgn"]


class KeyedTable:
    """The newest row of each key under ``path``; ``order`` says which of two rows of one key and batch is newer.

    Of rows from different batches that of the later batch stays.  Null keys are keys.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, keys: list[str] = KEYS, buckets: int = 64, order: Column | None = None) -> None:
        self.spark, self.path, self.keys, self.buckets = spark, path, list(keys), buckets
        self.schema = spark.createDataFrame([], schema).schema
        self.order = order

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def commits(self) -> list[int]:
        """The batches that are in the table, in order."""
        fs, folder = self._fs(), self._path("commits")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def state(self, batch: int | None = None) -> dict[int, int]:
        """bucket: the batch that wrote it last, as of a batch (the newest)."""
        done = self.commits()
        if not done:
            return {}
        text = self.spark.read.text(f"{self.path}/commits/{done[-1] if batch is None else batch:012d}.json", wholetext=True).first()[0]
        return {int(b): n for b, n in json.loads(text).items()}

    def _commit(self, batch: int, state: dict[int, int]) -> None:
        """Write under another name and rename, which a file system does at once."""
        fs, text = self._fs(), json.dumps({str(b): n for b, n in sorted(state.items())})
        draft, final = self._path(f"commits/.{batch:012d}.draft"), self._path(f"commits/{batch:012d}.json")
        out = fs.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not fs.rename(draft, final):
            raise OSError(f"commit of batch {batch} could not be named")

    def _read(self, state: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/data/batch={n}/bucket={b}" for b, n in sorted(state.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """The table as of the newest batch: one scan of each bucket, nothing to rank."""
        return self._read(self.state())

    def merge(self, batch: DataFrame, number: int) -> bool:
        """Put a micro-batch in; False if it is in already."""
        if number in self.commits():
            return False
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        order = F.monotonically_increasing_id() if self.order is None else self.order
        new = batch.select(*self.schema.names, order.alias("_order"))
        new = cut(keep_last(new, self.keys, F.col("_order")).drop("_order").withColumn("bucket", bucket))
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most as many as there are buckets
        state = self.state()
        old = self._read({b: state[b] for b in touched if b in state}).withColumn("bucket", bucket)
        rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
        rows = keep_last(rows, [*self.keys, "bucket"], F.col("_new")).drop("_new")
        if touched:
            rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/batch={number}")
        self._commit(number, state | dict.fromkeys(touched, number))
        return True

    def vacuum(self, keep: int = 2) -> int:
        """Delete what none of the ``keep`` newest batches needs, and their older commits; how many folders went."""
        fs, done = self._fs(), self.commits()
        needed = {(b, n) for c in done[-keep:] for b, n in self.state(c).items()}
        gone, data = 0, self._path("data")
        for s in fs.listStatus(data) if fs.exists(data) else []:
            number = int(s.getPath().getName().removeprefix("batch="))
            if number > done[-1]:
                continue  # a batch that is being written
            for t in fs.listStatus(s.getPath()):
                name = t.getPath().getName()
                if name.startswith("bucket=") and (int(name.removeprefix("bucket=")), number) not in needed:
                    gone += bool(fs.delete(t.getPath(), True))
        for c in done[:-keep]:
            fs.delete(self._path(f"commits/{c:012d}.json"), False)
        return gone

    def follow(self, rows: DataFrame, checkpoint: str, vacuum_every: int = 50) -> StreamingQuery:
        """Keep the table up to date with a stream until it has no more rows."""

        def put(batch: DataFrame, number: int) -> None:
            if self.merge(batch, number) and number % vacuum_every == vacuum_every - 1:
                self.vacuum()

        return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow_with(rows: DataFrame, folder: str, join: Callable[[DataFrame, DataFrame], DataFrame], put: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """A stream whose micro-batches each go, joined with the newest complete version in ``folder`` (``gridfile.publish``), to ``put``.

    The version is looked up when the micro-batch begins, so a new one takes effect with the next and none changes within one.
    """

    def one(batch: DataFrame, number: int) -> None:
        put(join(batch, newest(batch.sparkSession, folder)), number)

    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
