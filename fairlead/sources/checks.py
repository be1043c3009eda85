"""What can be told of packs before any plan is asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from fairlead.operators.cut import cut
from fairlead.operators.interp import Axes, sample

#: Fields without which no plan can be made.
NEEDED = ["hs_m", "wind_u_ms", "wind_v_ms"]


def endpoint_weather(packs: DataFrame, weather: dict[str, tuple[DataFrame, Axes]], t_h: float = 0.0) -> DataFrame:
    """pack_id, end, lat_deg, lon_deg, missing: which of NEEDED each default end of each pack lacks in its pack's weather.

    ``weather`` has each pack's table (from ``interp.cells``) and axes.  A pack without a weather table lacks all; ends
    that a pack does not name are left out, as requests to it must name their own.
    """
    ends = packs.select("pack_id", F.explode(F.create_map(
        F.lit("origin"), F.col("default_origin"), F.lit("destination"), F.col("default_destination"))).alias("end", "at")).where("at is not null")
    ends = ends.select("pack_id", "end", F.col("at.lat_deg").alias("lat_deg"), F.col("at.lon_deg").alias("lon_deg"), F.lit(float(t_h)).alias("t_h"))
    out = ends.where(~F.col("pack_id").isin(list(weather))).withColumns({f: F.lit(float("nan")) for f in NEEDED})
    for pack, (table, axes) in weather.items():  # packs are a few files
        own = sample(ends.where(F.col("pack_id") == pack), table, axes, masked=["hs_m"], plain=["wind_u_ms", "wind_v_ms"])
        out = out.unionByName(own)
    lacks = F.array_compact(F.array(*[F.when(F.isnan(f) | F.col(f).isNull(), F.lit(f)) for f in NEEDED]))
    return out.select("pack_id", "end", "lat_deg", "lon_deg", lacks.alias("missing"))


def check_weather(packs: DataFrame, weather: dict[str, tuple[DataFrame, Axes]], strict: bool = False) -> list[str]:
    """One line for each default end that lacks weather, by pack; with ``strict`` the first such pack raises ValueError.

    How many ends were looked at is observed in the same pass, so that a check of no ends does not look like a good one.
    """
    seen = Observation("ends")
    report = cut(endpoint_weather(packs, weather).observe(seen, F.count("*").alias("n"), F.count_if(F.size("missing") > 0).alias("bad")))
    n, bad = seen.get["n"], seen.get["bad"]
    rows = report.where(F.size("missing") > 0).orderBy("pack_id", F.desc("end")).collect() if bad else []  # two rows a pack at most
    found = [f"pack {r.pack_id!r}: no {', '.join(r.missing)} at its default {r.end} ({r.lat_deg}, {r.lon_deg})" for r in rows]
    if strict and (found or not n):
        raise ValueError(found[0] if found else "no pack has a default end")
    return found
