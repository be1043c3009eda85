"""Import of logs from four kinds of source into one canonical table, and on into segments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.functions.clock import local_to_epoch, utc_to_epoch
from fairlead.functions.mission import DAILY, noise_multiplier
from fairlead.functions.units import IMPORT_KN_TO_MS
from fairlead.operators.segments import Limits, steady_segments

OPTIONAL = ["stw_kn", "sog_kn", "heading_deg", "fuel_kg_per_h", "hs_m", "period_peak_s", "period_mean_s", "wave_from_deg", "wind_u_ms", "wind_v_ms"]
NEEDED = ["speed_kn", "heading_deg", "active_engines", "fuel_kg_per_h", "hs_m", "period_peak_s", "wave_from_deg"]
LITRE_KG = 0.85


def value(c: str) -> Column:
    """A number from text; blank text is null."""
    return F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).cast("double")


def _canonical(raw: DataFrame, source: str, t: Column, known: dict[str, Column], low: bool) -> DataFrame:
    engines = value("active_engines").cast("int") if "active_engines" in raw.columns else F.lit(None).cast("int")
    rest = [known.get(c, F.lit(None).cast("double")).alias(c) for c in OPTIONAL]
    return raw.select(
        "vessel_id", "passage_id", F.lit(source).alias("source"), t.alias("t_epoch_s"), value("lat_deg").alias("lat_deg"),
        value("lon_deg").alias("lon_deg"), engines.alias("active_engines"), *rest, F.lit(low).alias("is_low_frequency"))


def _present(raw: DataFrame, *names: str) -> dict[str, Column]:
    return {c: value(c) for c in names if c in raw.columns}


def monitoring(raw: DataFrame) -> DataFrame:
    """Rows of text columns with UTC times and speed through water in knots."""
    return _canonical(raw, "monitoring_csv", utc_to_epoch(F.col("timestamp_utc")), _present(
        raw, "stw_kn", "heading_deg", "fuel_kg_per_h", "hs_m", "period_peak_s", "wave_from_deg"), False)


def e_logbook(raw: DataFrame) -> DataFrame:
    """Local times with a zone, speed over ground, fuel in litres an hour."""
    known = _present(raw, "sog_kn", "heading_deg", "hs_m", "period_peak_s", "wave_from_deg") | {"fuel_kg_per_h": value("fuel_l_per_h") * LITRE_KG}
    return _canonical(raw, "e_logbook", local_to_epoch(F.col("local_datetime"), F.col("timezone")), known, False)


def noon_report(raw: DataFrame) -> DataFrame:
    """One row a day: distance, hours and tonnes of fuel; these have no heading."""
    hours = value("hours_run")
    known = {"sog_kn": value("distance_run_nm") / hours, "fuel_kg_per_h": value("fuel_consumed_mt") * 1000.0 / hours}
    return _canonical(raw, "noon_report", local_to_epoch(F.concat_ws(" ", "report_date", "local_time"), F.col("timezone")), known, True)


def annotated_track(raw: DataFrame) -> DataFrame:
    """Positions and surroundings only."""
    return _canonical(raw, "annotated_track", value("t_epoch_s"), _present(
        raw, "hs_m", "period_peak_s", "period_mean_s", "wave_from_deg", "wind_u_ms", "wind_v_ms"), False)


def with_speed(rows: DataFrame) -> DataFrame:
    """Speed through water, or over ground where that is all there is; ``missing`` names what a fit would lack."""
    out = rows.withColumn("speed_kn", F.coalesce("stw_kn", "sog_kn"))
    return out.withColumn("missing", F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in NEEDED])))


def require_complete(rows: DataFrame) -> DataFrame:
    """The same rows; reading one that lacks a needed value fails and says which."""
    text = F.concat(F.lit("row at t_epoch_s="), F.col("t_epoch_s").cast("string"), F.lit(" is missing "), F.concat_ws(", ", "missing"))
    return rows.withColumn("speed_kn", F.when(F.size("missing") > 0, F.raise_error(text).cast("double")).otherwise(F.col("speed_kn")))


def rows_to_segments(rows: DataFrame, limits: Limits = Limits(), strict: bool = True) -> DataFrame:
    """Canonical rows -> segments of both frequencies, with the multiplier of their fuel noise.

    A daily row is a segment of 24 hours and noisier; other rows are grouped by vessel, passage and source.  A group
    any of whose rows lacks speed through water is noisier too.  Incomplete rows fail, or go if not ``strict``.
    """
    full = with_speed(rows)
    full = require_complete(full) if strict else full.where(F.size("missing") == 0)
    by = ["vessel_id", "passage_id", "source"]
    over_ground = F.col("stw_kn").isNull()
    daily = full.where("is_low_frequency").select(
        *by, F.col("t_epoch_s").alias("t_start_s"), (F.col("t_epoch_s") + 86400.0).alias("t_end_s"),
        (F.col("speed_kn") * IMPORT_KN_TO_MS).alias("mean_stw_ms"), F.col("heading_deg").alias("mean_heading_deg"), "active_engines",
        F.col("fuel_kg_per_h").alias("mean_fuel_kg_per_h"), F.col("hs_m").alias("mean_hs_m"), F.col("period_peak_s").alias("mean_period_peak_s"),
        F.col("wave_from_deg").alias("mean_wave_from_deg"), F.lit(1).cast("long").alias("n_samples"), F.lit(24.0).alias("duration_h"),
        (noise_multiplier(F.col("source"), over_ground) * DAILY).alias("fuel_noise_multiplier"))
    high = full.where("not is_low_frequency").withColumn("stw_ms", F.col("speed_kn") * IMPORT_KN_TO_MS).withColumn("t_s", F.col("t_epoch_s"))
    segments = steady_segments(high, by, "t_epoch_s", limits).drop("run")
    fallback = high.groupBy(*by).agg(F.bool_or(over_ground).alias("_ground"))
    stamped = segments.join(fallback, by).withColumn("fuel_noise_multiplier", noise_multiplier(F.col("source"), F.col("_ground")))
    return daily.unionByName(stamped.drop("_ground"))


def union_sources(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
