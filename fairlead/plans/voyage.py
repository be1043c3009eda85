"""Whole plans: a passage from request to candidates, and a vessel's twin from segments to a validated fit."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.functions import mission, twin
from fairlead.operators import fitting, lattice, legs, ranking, search
from fairlead.functions.units import KN_TO_MS, distance_nm, kn_to_ms
from fairlead.operators.cut import cut
from fairlead.operators.distill import alterations, distill, track_totals
from fairlead.operators.spatial import Waters
from fairlead.operators.tracks import BAND, BAND_LON
from fairlead.sources.specs import DEFAULT, Vessel

BASELINE_KN, BASELINE_ENGINES, ANCHORAGE_M = 14.0, 2, (3.0, 50.0)


@dataclass
class Request:
    origin: lattice.Point
    destination: lattice.Point
    pace: float
    comfort: float
    latest_arrival_h: float | None = None
    t0_h: float = 0.0
    speeds_kn: list[float] | None = None
    horizon_h: float = 72.0
    origin_is_anchorage: bool = False
    destination_is_anchorage: bool = False


def check_endpoints(spark: SparkSession, request: Request, waters: Waters) -> None:
    """ValueError for an end that is not navigable, or an anchorage whose depth is out of range."""
    rows = [("origin", *map(float, request.origin), request.origin_is_anchorage), ("destination", *map(float, request.destination), request.destination_is_anchorage)]
    ends = spark.createDataFrame(rows, "label string, lat double, lon double, anchorage boolean")
    for r in sorted(waters.described(ends, "lat", "lon").collect(), key=lambda r: r.label, reverse=True):  # two rows
        if not r.is_navigable:
            raise ValueError(f"{r.label} is not navigable")
        if r.anchorage and not ANCHORAGE_M[0] <= r.depth_m <= ANCHORAGE_M[1]:
            raise ValueError(f"{r.label} is {r.depth_m:.1f} m deep, not within {ANCHORAGE_M} m")


def weights_of(pace: float, comfort: float, ship: Vessel) -> dict[str, Column]:
    return mission.weights(F.lit(float(pace)), F.lit(float(comfort))) | {"wear_eur_per_point": ship["wear_policy.weight_eur_equivalent"]}


def side_of(path: str = "path") -> Column:
    """W or E by the mean longitude of a route's points in the band; null without any."""
    inside = F.filter(path, lambda p: p["lat"].between(*BAND))
    mean = F.aggregate(inside, F.lit(0.0), lambda s, p: s + p["lon"]) / F.nullif(F.size(inside), F.lit(0))
    return F.when(mean < BAND_LON, "W").when(mean.isNotNull(), "E")


def main_engine(path: str = "path") -> Column:
    """The engine count that runs longest on a route; ties go to the smaller count."""
    spent = F.transform(F.sequence(F.lit(1), F.size(path) - 1), lambda i: F.struct(
        F.get(path, i)["engines"].alias("n"), (F.get(path, i)["t_h"] - F.get(path, i - 1)["t_h"]).alias("h")))
    counts = F.array_distinct(F.transform(spent, lambda x: x["n"]))
    total = lambda n: F.aggregate(F.filter(spent, lambda x: x["n"] == n), F.lit(0.0), lambda s, x: s + x["h"])
    return -F.array_max(F.transform(counts, lambda n: F.struct(total(n).alias("h"), (-n).alias("n"))))["n"]


def route_nm(path: str, ref_lat: float) -> Column:
    legs_ = F.transform(F.sequence(F.lit(1), F.size(path) - 1), lambda i: distance_nm(
        F.get(path, i - 1)["lat"], F.get(path, i - 1)["lon"], F.get(path, i)["lat"], F.get(path, i)["lon"], ref_lat))
    return F.aggregate(legs_, F.lit(0.0), lambda s, x: s + x)


def _candidate(found: DataFrame, name: str, ref_lat: float) -> DataFrame:
    nm = route_nm("path", ref_lat)
    return found.select(
        F.lit(name).alias("route"), side_of().alias("side"), (nm / F.nullif(F.col("duration_h"), F.lit(0.0))).alias("speed_kn"), main_engine().alias("engines"),
        nm.alias("distance_nm"), "duration_h", "fuel_kg", "comfort", "wear", "max_hs", F.col("cost").alias("score_eur"), "path")


def speeds_for(spark: SparkSession, ship: Vessel) -> tuple[list[float], DataFrame]:
    """Candidate speeds up to the best ceiling, and the ceiling of every engine count."""
    n = spark.range(1).select(F.size(ship["engines"]).alias("n")).first()["n"]
    ceilings = spark.range(1, n + 1).select(F.col("id").cast("int").alias("engines")).withColumn("ceiling_kn", twin.fastest_continuous(F.col("engines"), ship))
    grid = ceilings.agg(F.max("ceiling_kn").alias("c")).select(twin.speed_grid(F.col("c")).alias("s")).first()["s"]
    return grid, ceilings


def plan_voyage(spark: SparkSession, request: Request, weather: legs.Weather, waters: Waters, ship: Vessel | None = None,
                corridors: dict[str, tuple[lattice.Lattice, str]] | None = None, grid: lattice.Lattice | None = None, distilled: bool = False) -> dict[str, DataFrame]:
    """candidates (all), picks (up to three, in order), legs and alterations of the picks, baseline, prune counts and diagnostics of one request.

    The cheapest route, the cheapest on the other side, and the cheapest along each corridor at each speed compete.
    With ``distilled`` candidates lose the points that they do better without.  The baseline runs at a fixed speed on two
    engines under neutral weights.
    """
    ship = ship or Vessel.of()
    check_endpoints(spark, request, waters)
    speeds, ceilings = speeds_for(spark, ship)
    speeds = request.speeds_kn or speeds
    engines = [r.engines for r in ceilings.select("engines").collect()]
    plan = search.Plan(weather, waters, ship, weights_of(request.pace, request.comfort, ship), speeds, engines, request.t0_h)
    grid = grid or lattice.build(spark, request.origin, request.destination, waters)
    graph = search.limited_edges(spark, grid, plan)
    reach = search.within(search.arrivals(spark, grid, plan, request.horizon_h, graph), request.t0_h, request.horizon_h)
    pruned: list[dict[str, int]] = []
    first = cut(_candidate(search.cheapest(spark, grid, plan, graph, reach, pruned=pruned), "open water", waters.ref_lat))
    parts, notes = [first], []
    side = next((r.side for r in first.select("side").collect()), None)
    if side:
        other = "W" if side == "E" else "E"
        band = [i for i, p in enumerate(grid.centres) if BAND[0] <= p[0] <= BAND[1]]
        limited = lattice.side_only(graph, (band[0], band[-1]) if band else None, other)
        second = cut(_candidate(search.cheapest(spark, grid, plan, limited, reach), "open water", waters.ref_lat).where(F.col("side") == other))
        parts.append(second)
        if not second.head(1):
            notes.append((0, f"route_side_unreachable:{other}", None))
    if corridors:
        runs = search.corridor_routes(spark, corridors, plan).withColumnRenamed("engines", "n_engines")
        best = ranking.best_per_key(runs, ["route", "speed_kn"], "cost", "n_engines")
        parts.append(best.select(
            "route", "side", "speed_kn", F.col("n_engines").alias("engines"), route_nm("path", waters.ref_lat).alias("distance_nm"), "duration_h", "fuel_kg", "comfort",
            "wear", "max_hs", F.col("cost").alias("score_eur"), "path"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    ends = [grid.centres[0], grid.centres[-1]]
    if distilled:
        every = _distilled(every, plan, ends)
    limit = F.lit(request.latest_arrival_h).cast("double")
    every = cut(every.withColumns({"request_id": F.lit(0), "latest_arrival_h": limit, "candidate_id": F.monotonically_increasing_id()}))
    pool = ranking.eta_pool(every)
    neutral = replace(plan, weights=weights_of(50, 50, ship), speeds_kn=[BASELINE_KN], engines=[BASELINE_ENGINES])
    baseline = _candidate(search.cheapest(spark, grid, neutral, graph), "baseline", waters.ref_lat)
    counts = search.prune_counts(pruned)
    gaps = counts.select(F.lit(0).alias("request_id"), F.col("missing_weather").alias("n"))
    found = ranking.diagnostics(every, gaps)
    floors = ranking.below_floor(ceilings, min(speeds)).select(F.lit(0).alias("request_id"), F.concat_ws(":", "code", F.col("engines").cast("string")).alias("code"), F.col("ceiling_kn").alias("detail"))
    found = found.unionByName(floors).unionByName(spark.createDataFrame(notes, "request_id int, code string, detail double"))
    picks = cut(ranking.diverse_picks(pool))
    routes = _routes(every.join(F.broadcast(picks.select("candidate_id")), "candidate_id"), "candidate_id")  # three picks at most
    totals = track_totals(routes, plan, ends).withColumnRenamed("route_id", "candidate_id")
    turns = alterations(totals.withColumnRenamed("candidate_id", "route_id")).withColumnRenamed("route_id", "candidate_id")
    return {"candidates": every, "picks": picks, "legs": totals, "alterations": turns, "baseline": baseline, "pruned": counts, "diagnostics": found}


def _routes(candidates: DataFrame, key: str) -> DataFrame:
    """route_id, track, stw, engine of candidates with a ``path``."""
    steps = F.slice("path", 2, F.size("path"))
    return candidates.select(
        F.col(key).alias("route_id"), F.transform("path", lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))).alias("track"),
        F.transform(steps, lambda p: kn_to_ms(p["speed_kn"])).alias("stw"), F.transform(steps, lambda p: p["engines"]).alias("engine"))


def _distilled(candidates: DataFrame, plan: search.Plan, exempt: list[lattice.Point]) -> DataFrame:
    """Candidates along their distilled tracks; side, speed and engines stay as they were."""
    kept = cut(candidates.withColumn("_id", F.monotonically_increasing_id()))
    done = distill(_routes(kept, "_id"), plan, exempt)
    point = lambda p, i: F.struct(
        i.alias("stage"), F.lit(0).alias("lane"), p["lat"].alias("lat"), p["lon"].alias("lon"), F.get("eta_h", i).alias("t_h"),
        (F.get("stw", i - 1) / KN_TO_MS).alias("speed_kn"), F.get("engine", i - 1).alias("engines"))
    done = done.withColumn("path", F.transform("track", point)).withColumn("distance_nm", route_nm("path", plan.waters.ref_lat))
    fresh = ["distance_nm", "duration_h", "fuel_kg", "comfort", "wear", "max_hs", "path"]
    done = done.select(F.col("route_id").alias("_id"), F.col("cost").alias("score_eur"), *fresh)
    return kept.drop("score_eur", *fresh).join(done, "_id").select(candidates.columns)


def fit_twin(segments: DataFrame, ship: dict = DEFAULT, by: str = "passage_id", fraction: float = 0.2, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(parameters, validation) of one fit for each vessel, from whole groups of segments held out of it."""
    held = cut(fitting.holdout_groups(segments, by, fraction, seed))
    params = cut(fitting.fit_vessels(held.where("not is_holdout"), ship))
    reports = fitting.validation_by_vessel(held, params, ship)
    return params, reports
