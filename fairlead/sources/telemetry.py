"""Keyed telemetry tables, track files and synthetic telemetry."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TRACK = "t_epoch_s double, lat_deg double, lon_deg double, hs_m double, period_peak_s double, period_mean_s double, wave_from_deg double, wind_u_ms double, wind_v_ms double"
SAMPLES = "t_h double, stw_ms double, heading_deg double, active_engines int, fuel_kg_per_h double, hs_m double, period_peak_s double, wave_from_deg double"
MOTION = ["motion_heave_m", "motion_roll_deg", "motion_pitch_deg", "motion_accel_vertical_ms2"]


def read_track(spark: SparkSession, path: str) -> DataFrame:
    """A track file with a header; blank fields are null."""
    return spark.read.csv(path, schema=TRACK, header=True, enforceSchema=False)


def write_track(track: DataFrame, path: str) -> None:
    track.select(*[c.split()[0] for c in TRACK.split(", ")]).write.csv(path, header=True, nullValue="", emptyValue="")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=SAMPLES, header=True, enforceSchema=False)


def keep_last(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row for each key, that with the largest ``order``; a grouped maximum, so a hot key is combined before it moves."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_b"))
    return best.select(*keys, "_b.*")


def upsert(table: DataFrame, new: DataFrame, arrival: str = "arrival") -> DataFrame:
    """``table`` with ``new`` rows replacing those of equal (timestamp, source_pgn); a null pgn is 0."""
    fill = lambda df: df.withColumn("source_pgn", F.coalesce("source_pgn", F.lit(0)))
    both = fill(table).withColumn("_new", F.lit(0)).unionByName(fill(new).withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, ["timestamp", "source_pgn"], F.struct("_new", arrival)).drop("_new")


def status(table: DataFrame, now_s: Column, by: list[str] = ()) -> DataFrame:
    """Number of samples, the last one's time and tier, and seconds since; an empty table has a null last sample."""
    found = table.groupBy(*by).agg(
        F.count("*").alias("sample_count"), F.max("timestamp").alias("last_sample_at"), F.max_by("sensor_tier", "timestamp").alias("sensor_tier"))
    return found.withColumn("gap_s", now_s - F.col("last_sample_at"))


def with_motion(table: DataFrame) -> DataFrame:
    """Stored rows in time order, their motion columns as one struct that is null if all four are."""
    whole = F.when(F.coalesce(*MOTION).isNotNull(), F.struct(*MOTION))
    return table.withColumn("motion", whole).drop(*MOTION).orderBy("timestamp")


#: Kinds of spoilt blocks: speed and heading wander with every sample, or one sample's fuel jumps.
JUNK = ["manoeuvre", "tank_transfer"]
WANDER_MS, WANDER_DEG, JUMPS = 3.0, 60.0, (0.4, 1.8)


def synthetic_samples(spark: SparkSession, speeds_kn: list[float], engines: list[int], waves_m: list[float], fuel: Column, per: int = 15,
                      every_s: float = 60.0, gap_s: float = 240.0, noise: float = 0.03, seed: int = 3, speed_noise_ms: float = 0.0, wave_noise_m: float = 0.0,
                      junk: float = 0.0) -> DataFrame:
    """Steady blocks of ``per`` samples for every speed, engine count and wave height, ``gap_s`` apart, in a seeded order.

    ``fuel`` is a column over the true stw_ms, hs_m and active_engines; what is recorded has noise, seeded by row: of fuel as a share,
    of speed and wave height in their units (waves not below 0).  A share ``junk`` of the blocks is spoilt, and column junk says how: in
    a manoeuvre every sample's speed and heading wander, in a tank transfer the middle sample's fuel jumps.
    """
    blocks = [(i, s, n, h) for i, (s, n, h) in enumerate((s, n, h) for s in speeds_kn for n in engines for h in waves_m)]
    rows = spark.createDataFrame(blocks, "block int, speed_kn double, active_engines int, hs_m double")
    u = lambda k, *of: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), *of), F.lit(1_000_003)) + 0.5) / 1_000_003.0
    place = F.row_number().over(Window.orderBy(F.xxhash64(F.lit(seed), F.lit(0), "block"), "block")) - 1  # one row a block
    rows = rows.withColumns({"place": place, "junk": F.when(u(9, "block") < junk, F.when(u(10, "block") < 0.5, JUNK[0]).otherwise(JUNK[1]))})
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(per - 1))))
    own = lambda n: u(n, "block", "k")
    normal = lambda n: F.sqrt(-2.0 * F.log(own(n))) * F.cos(2.0 * np.pi * own(n + 1))
    t = F.col("place") * (per * every_s + gap_s) + F.col("k") * every_s
    rows = rows.withColumns({"t_s": t, "stw_ms": F.col("speed_kn") * 0.514444, "period_peak_s": F.lit(7.0), "wave_from_deg": F.lit(0.0)})
    astray, jump = F.col("junk") == JUNK[0], (F.col("junk") == JUNK[1]) & (F.col("k") == per // 2)
    wander = lambda n, most: F.when(astray, (2.0 * own(n) - 1.0) * most).otherwise(0.0)
    spoilt = F.when(jump, F.when(own(13) < 0.5, JUMPS[0]).otherwise(JUMPS[1])).otherwise(1.0)
    rows = rows.withColumn("fuel_kg_per_h", fuel * (1.0 + noise * normal(1)) * spoilt)  # of the true values
    return rows.withColumns({
        "stw_ms": F.col("stw_ms") + speed_noise_ms * normal(3) + wander(11, WANDER_MS), "hs_m": F.greatest(F.lit(0.0), F.col("hs_m") + wave_noise_m * normal(5)),
        "heading_deg": F.pmod(180.0 + wander(12, WANDER_DEG), F.lit(360.0))}).drop("speed_kn", "k", "place")
