"""Vessel specifications and region packs from YAML (S1-S3, S13), as literals or as struct columns."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The default 50 m displacement yacht.
DEFAULT: dict[str, Any] = {
    "name": "default 50 m displacement yacht",
    "provisional": True,
    "hull": {"length_wl_m": 45.0, "beam_wl_m": 9.0, "block_coefficient": 0.52, "draft_m": 2.5},
    "calm_resistance": {
        "linear_coefficient": 5.0, "cubic_coefficient": 1.0, "steepening_coefficient": 1.5, "steepening_exponent": 4.0,
        "hull_speed_froude": 0.40},
    "added_resistance": {"scale": 0.4, "period_reference_s": 7.5, "head_factor": 1.0, "following_factor": 0.25},
    "engines": [
        {"name": n, "mcr_kw": 1350.0, "sfoc_base_g_per_kwh": 195.0, "sfoc_min_load_fraction": 0.75, "sfoc_curvature": 2.0}
        for n in ("port", "starboard")],
    "hotel_load_fuel_kg_per_h": 36.0,
    "fuel_density_kg_per_l": 0.85,
    "co2_per_kg_fuel": 3.15,
    "min_under_keel_clearance_m": 2.0,
    "comfort": {
        "scale": 1.0, "hs_exponent": 1.7, "beam_base": 0.35, "beam_amplitude": 0.91, "head_bonus": 0.25,
        "head_bonus_threshold_deg": 150.0, "period_reference_s": 6.5, "speed_base": 0.5, "speed_scale_kn": 22.0},
    "wear_policy": {
        "weight_eur_equivalent": 9.0, "max_continuous_load_fraction": 0.85, "slamming_hs_threshold_m": 1.8,
        "slamming_min_speed_ms": 6.69, "slamming_encounter_angle_deg": 140.0, "load_wear_scale": 1.2, "slam_wear_scale": 3.0,
        "single_engine_wear_bonus": 0.15, "load_cycling_limit": None},
}
#: Names of the numbers of each section, of an engine and of the vessel itself, in the order of DEFAULT.
SECTIONS = {s: [k for k, v in d.items() if isinstance(v, float)] for s, d in DEFAULT.items() if isinstance(d, dict)}
ENGINE = [k for k, v in DEFAULT["engines"][0].items() if isinstance(v, float)]
SCALARS = [k for k, v in DEFAULT.items() if isinstance(v, float)]



class Vessel:
    """Numbers of one vessel as columns: ``ship["hull.draft_m"]``; from literals or from a struct column of a table."""

    def __init__(self, get: Callable[[str], Column], data: dict[str, Any] | None = None) -> None:
        self._get, self.data = get, data

    def __getitem__(self, path: str) -> Column:
        return self._get(path)

    @classmethod
    def of(cls, data: dict[str, Any] = DEFAULT) -> Vessel:
        """A missing section, number or engine list raises KeyError."""
        checked = {s: {k: float(data[s][k]) for k in keys} for s, keys in SECTIONS.items()}
        engines = [{k: float(e[k]) for k in ENGINE} for e in data["engines"]]
        flat = {f"{s}.{k}": v for s, ks in checked.items() for k, v in ks.items()} | {k: float(data[k]) for k in SCALARS}

        def get(path: str) -> Column:
            if path == "engines":
                return F.array(*[F.struct(*[F.lit(e[k]).alias(k) for k in ENGINE]) for e in engines])
            return F.lit(flat[path])

        return cls(get, {**data, "provisional": data.get("provisional", True)})

    @classmethod
    def column(cls, name: str) -> Vessel:
        """A vessel for each row, in a struct column as ``vessels`` makes it."""
        return cls(lambda path: F.col(f"{name}.{path}"))

    @classmethod
    def from_yaml(cls, path: str) -> Vessel:
        with open(path) as f:
            return cls.of(yaml.safe_load(f))

    def to_yaml(self, path: str) -> None:
        with open(path, "w") as f:
            yaml.safe_dump(self.data, f, sort_keys=False)


def schema() -> str:
    parts = [f"{s} struct<{', '.join(f'{k}: double' for k in keys)}>" for s, keys in SECTIONS.items()]
    return "name string, " + ", ".join(
        [*parts, f"engines array<struct<{', '.join(f'{k}: double' for k in ENGINE)}>>", *[f"{k} double" for k in SCALARS]])


def vessels(spark: SparkSession, specs: list[dict[str, Any]]) -> DataFrame:
    """One row for each specification, name and struct column ``ship``."""
    rows = [
        (d["name"], *[tuple(float(d[s][k]) for k in keys) for s, keys in SECTIONS.items()],
         [tuple(float(e[k]) for k in ENGINE) for e in d["engines"]], *[float(d[k]) for k in SCALARS]) for d in specs]
    flat = spark.createDataFrame(rows, schema())
    return flat.select("name", F.struct(*[c for c in flat.columns if c != "name"]).alias("ship"))


PLACE = "struct<lat_deg: double, lon_deg: double>"
PACK = (
    "pack_id string, name string, bbox struct<lon_min: double, lat_min: double, lon_max: double, lat_max: double>, ref_lat_deg double, "
    "coastline_path string, bathymetry_path string, nogo_path string, tss_path string, weather_npz_path string, "
    f"ports map<string, {PLACE}>, default_origin {PLACE}, default_destination {PLACE}, lane_turn_rate_nm double, "
    "min_navigable_edge_fraction double, min_refinement_step_nm double, "
    f"corridors array<struct<origin: {PLACE}, destination: {PLACE}, corridor: string>>, currents_dataset_id string")
# Fixed values of a pack's file: those that stand in for what it leaves out, and the corridors that it may name.
PACK_DEFAULTS = {"min_navigable_edge_fraction": 0.75, "min_refinement_step_nm": 0.5}
CORRIDORS = ("corridor_east", "corridor_west")


def region_packs(spark: SparkSession, paths: list[str], corridors: tuple[str, ...] = CORRIDORS) -> DataFrame:
    """Packs from YAML files, one row each; an unknown corridor raises ValueError, a missing key KeyError."""
    place = lambda v: None if v is None else tuple(map(float, v))
    number = lambda v: None if v is None else float(v)
    rows = []
    for path in paths:
        with open(path) as f:
            d = PACK_DEFAULTS | yaml.safe_load(f)
        ways = [(place(c["origin"]), place(c["destination"]), c["corridor"]) for c in d.get("legacy_corridors") or []]
        if unknown := sorted({w[2] for w in ways} - set(corridors)):
            raise ValueError(f"{path}: unknown corridors {unknown}; known are {sorted(corridors)}")
        rows.append((
            d["pack_id"], d["name"], place(d["bbox"]), float(d["ref_lat_deg"]), *[d[f"{k}_path"] for k in ("coastline", "bathymetry", "nogo", "tss", "weather_npz")],
            {k: place(v) for k, v in (d.get("ports") or {}).items()}, place(d.get("default_origin")), place(d.get("default_destination")),
            number(d.get("lane_turn_rate_nm")), number(d["min_navigable_edge_fraction"]), number(d["min_refinement_step_nm"]), ways, d.get("currents_dataset_id")))
    return spark.createDataFrame(rows, PACK)


def with_endpoints(requests: DataFrame, packs: DataFrame) -> DataFrame:
    """``requests(pack_id, origin, destination, ...)``: ends left out are the pack's defaults; an unknown pack or a missing default fails."""
    own = packs.select("pack_id", "default_origin", "default_destination", F.lit(True).alias("_known"))
    rows = requests.join(F.broadcast(own), "pack_id", "left")  # packs are a few files

    def end(which: str) -> Column:
        lost = F.when(F.col("_known").isNull(), F.concat(F.lit("unknown region pack "), "pack_id")).otherwise(
            F.concat(F.lit("region pack "), "pack_id", F.lit(f" has no default {which}")))
        return F.coalesce(which, f"default_{which}", F.raise_error(lost).cast(PLACE))

    return rows.withColumns({w: end(w) for w in ("origin", "destination")}).drop("default_origin", "default_destination", "_known")


def manifest_packs(spark: SparkSession, manifest: str | None) -> DataFrame:
    """Packs that a manifest file lists; without one, the built-in pack alone."""
    if manifest is None:
        none = [None] * 5
        box, ends = (6.7, 40.75, 10.15, 44.0), ((43.55, 7.17), (41.13, 9.55))
        ways = [(*ends, name) for name in ("corridor_west", "corridor_east")]
        return spark.createDataFrame([(
            "med", "Western Mediterranean", box, 42.3, *none, {"antibes": ends[0], "portocervo": ends[1]}, *ends, None, *PACK_DEFAULTS.values(), ways, None)], PACK)
    with open(manifest) as f:
        listed = yaml.safe_load(f)
    return region_packs(spark, listed["packs"] if isinstance(listed, dict) else listed)
