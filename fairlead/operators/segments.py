"""Steady-state segments of telemetry: gaps and islands by pairwise compatibility."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fairlead.functions.units import SEGMENT_MS_TO_KN, angle_between, cosine, sine, wrap_bearing


@dataclass(frozen=True)
class Limits:
    min_duration_s: float = 300.0
    speed_kn: float = 0.5
    heading_deg: float = 5.0
    fuel_jump: float = 0.25
    max_gap_s: float = 120.0


def circular_mean(x: Column) -> Column:
    """Direction of the mean of unit vectors; of opposite ones nearly nothing but their rounding is left, so that must be right."""
    return wrap_bearing(F.degrees(F.atan2(F.avg(sine(x)), F.avg(cosine(x)))))


def breaks(order: Window, limits: Limits) -> Column:
    """Whether a sample does not go on from the one before it; the first does not."""
    was = lambda c: F.lag(c).over(order)
    mean = F.greatest(F.lit(1e-6), (F.col("fuel_kg_per_h") + was("fuel_kg_per_h")) / 2.0)
    return (
        was("t_s").isNull() | (F.col("t_s") - was("t_s") > limits.max_gap_s) | (F.col("active_engines") != was("active_engines"))
        | (F.abs(F.col("stw_ms") - was("stw_ms")) * SEGMENT_MS_TO_KN > limits.speed_kn)
        | (angle_between(F.col("heading_deg"), was("heading_deg")) > limits.heading_deg)
        | (F.abs(F.col("fuel_kg_per_h") - was("fuel_kg_per_h")) / mean > limits.fuel_jump))


def steady_segments(samples: DataFrame, by: list[str], tie: str, limits: Limits = Limits()) -> DataFrame:
    """``samples(*by, t_s, <tie>, stw_ms, heading_deg, active_engines, fuel_kg_per_h, hs_m, period_peak_s, wave_from_deg)``
    -> one row for each maximal run of compatible samples that lasts ``min_duration_s``.

    Samples are put in order of (t_s, tie) first.  One shuffle by ``by`` serves the window and the grouping.
    """
    order = Window.partitionBy(*by).orderBy("t_s", tie)
    marked = samples.withColumn("_new", breaks(order, limits).cast("int"))
    runs = marked.withColumn("run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    mean = lambda c, name: F.avg(c).alias(name)
    found = runs.groupBy(*by, "run").agg(
        F.min("t_s").alias("t_start_s"), F.max("t_s").alias("t_end_s"), mean("stw_ms", "mean_stw_ms"),
        circular_mean(F.col("heading_deg")).alias("mean_heading_deg"), F.first("active_engines").alias("active_engines"),
        mean("fuel_kg_per_h", "mean_fuel_kg_per_h"), mean("hs_m", "mean_hs_m"), mean("period_peak_s", "mean_period_peak_s"),
        circular_mean(F.col("wave_from_deg")).alias("mean_wave_from_deg"), F.count("*").alias("n_samples"))
    return found.withColumn("duration_h", (F.col("t_end_s") - F.col("t_start_s")) / 3600.0).where(
        F.col("t_end_s") - F.col("t_start_s") >= limits.min_duration_s)


def relative_hours(samples: DataFrame, by: list[str], t: str = "t_s") -> DataFrame:
    """``samples`` with t_h, the hours since the first sample of their group."""
    first = F.min(t).over(Window.partitionBy(*by))
    return samples.withColumn("t_h", (F.col(t) - first) / 3600.0)
