"""Frames from a vessel's network as a stream: parse, decode, keep the last of each key (S22-S24, section 2.13)."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fairlead.functions import n2k
from fairlead.sources.telemetry import keep_last

COLUMNS = ["lat_deg", "lon_deg", "sog_kn", "cog_deg", "engine_fuel_rate_l_per_h", "engine_rpm"]


def parse_lines(lines: DataFrame, text: str = "value") -> DataFrame:
    """Lines "time R|T id byte byte ..." in hexadecimal -> pgn, priority, addresses, data; malformed lines go."""
    p = F.split(F.trim(text), r"\s+")
    rows = lines.withColumn("_p", p).where(
        (F.size("_p") >= 3) & F.get("_p", F.lit(1)).isin("R", "T") & F.get("_p", F.lit(2)).rlike("^[0-9A-Fa-f]{1,8}$")
        & F.forall(F.slice("_p", 4, F.size("_p")), lambda x: x.rlike("^[0-9A-Fa-f]{1,2}$")))
    padded = F.transform(F.slice("_p", 4, F.size("_p")), lambda x: F.lpad(x, 2, "0"))
    can = F.conv(F.get("_p", F.lit(2)), 16, 10).cast("long")
    parts = n2k.split_id(can)
    return rows.withColumns({**parts, "data": F.unhex(F.array_join(padded, ""))}).drop("_p")


def samples(frames: DataFrame, tier: str) -> DataFrame:
    """Frames of the four mapped messages as telemetry rows keyed by (timestamp, source_pgn); others go."""
    found = n2k.decode(F.col("pgn"), F.col("data"))
    return frames.where(n2k.mapped(F.col("pgn"))).select(
        "timestamp", F.col("pgn").alias("source_pgn"), F.lit(tier).alias("sensor_tier"), *[found[c].alias(c) for c in COLUMNS])


#: A message of the byte-stuffed serial stream, up to the mark after its body: 10 02, bytes with every 10 doubled, 10 and a byte.
_MESSAGE = re.compile(rb"\x10\x02((?:[^\x10]|\x10\x10)*+)\x10(.)", re.DOTALL)
#: What a received frame begins with: kind, length, priority, group (3 bytes), destination, source, time (4 bytes), length of the data.
_HEAD = struct.Struct("<BBB3sBB4sB")
_RECEIVED, _END, _EVERYONE = 0x93, b"\x03", 0xFF


def serial_frames(data: bytes, tail: bytes = b"") -> tuple[list[tuple], bytes]:
    """Frames in a piece of the serial stream that follows ``tail``, and the tail that the next piece follows.

    A message ends with 10 03, and its bytes sum to 0 modulo 256.  Messages that break a rule go.
    """
    wire, end, bodies = tail + data, 0, []
    for m in _MESSAGE.finditer(wire):
        end = m.end()
        if m[2] == _END:
            bodies.append(m[1].replace(b"\x10\x10", b"\x10"))
    begun = wire.find(b"\x10\x02", end)
    rest = wire[begun:] if begun >= 0 else b"\x10" if wire[end:].endswith(b"\x10") else b""
    return [f for f in map(_frame, bodies) if f], rest


def _frame(body: bytes) -> tuple | None:
    """pgn, priority, source, destination (None for everyone) and data of a received frame's body with its check byte."""
    if sum(body) % 256 or len(body) <= _HEAD.size:
        return None
    kind, _, priority, group, to, source, _, size = _HEAD.unpack_from(body)
    if kind != _RECEIVED:
        return None
    return int.from_bytes(group, "little"), priority, source, None if to == _EVERYONE else to, body[_HEAD.size : -1][:size]


def read_serial(pieces: DataFrame) -> DataFrame:
    """A stream of ``pieces(device string, seq long, data binary, timestamp double)`` -> frames; an unfinished message of a device is its state."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tail = bytes(state.get[0]) if state.exists else b""
        out = []
        for pdf in batches:
            pdf = pdf.sort_values("seq")
            for piece, at in zip(pdf["data"], pdf["timestamp"], strict=True):
                found, tail = serial_frames(bytes(piece), tail)
                out += [(key[0], *f, at) for f in found]
        state.update((tail,))
        yield pd.DataFrame(out, columns=["device", "pgn", "priority", "source_address", "destination_address", "data", "timestamp"])

    return pieces.groupBy("device").applyInPandasWithState(
        run, "device string, pgn int, priority int, source_address int, destination_address int, data binary, timestamp double",
        "tail binary", "append", GroupStateTimeout.NoTimeout)


def write_latest(rows: DataFrame, path: str, checkpoint: str, keys: list[str] = ("timestamp", "source_pgn")) -> StreamingQuery:
    """Append each micro-batch to ``path`` with its number; ``read_latest`` keeps the last row of each key.

    A batch is written under its own number, so one that runs again after a failure replaces itself.
    """

    def put(batch: DataFrame, number: int) -> None:
        one = keep_last(batch.withColumn("_order", F.monotonically_increasing_id()), list(keys), F.col("_order")).drop("_order")
        one.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark, path: str, keys: list[str] = ("timestamp", "source_pgn")) -> DataFrame:
    return keep_last(spark.read.option("basePath", path).parquet(path), list(keys), F.col("batch")).drop("batch")


def gap_sessions(rows: DataFrame, gap: str = "2 minutes", late: str = "10 minutes") -> DataFrame:
    """An extension: sessions of a vessel's samples by gaps, for streams with a watermark."""
    return rows.withWatermark("ts", late).groupBy("vessel_id", F.session_window("ts", gap)).agg(
        F.count("*").alias("n"), F.avg("stw_ms").alias("mean_stw_ms"))

