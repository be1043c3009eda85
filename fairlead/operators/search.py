"""Cheapest and earliest routes through layered graphs, one layer a step.

Edges lead from a stage to the next only, so a layer is final before the next is made: each step joins the layer's
labels with its edges, speeds and engine counts, evaluates the legs and keeps the best label of every state.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from fairlead.functions.mission import leg_cost
from fairlead.functions.units import kn_to_ms
from fairlead.operators.cut import cut
from fairlead.operators.lattice import Lattice, edges
from fairlead.operators.legs import Weather, edge_limits, evaluate, feasible
from fairlead.operators.spatial import Waters
from fairlead.sources.specs import Vessel

BUCKET_H = 1.0
#: Layers between two checkpoints.
CUT_EVERY = 1


@dataclass
class Plan:
    """What a search is given besides its graph."""

    weather: Weather
    waters: Waters
    ship: Vessel
    weights: dict[str, Column]
    speeds_kn: list[float]
    engines: list[int]
    t0_h: float = 0.0


def limited_edges(spark, lattice: Lattice, plan: Plan) -> DataFrame:
    """The lattice's edges that are navigable and deep enough, tested once for all speeds and times."""
    found = edges(spark, lattice)
    depth = spark.range(1).select((plan.ship["hull.draft_m"] + plan.ship["min_under_keel_clearance_m"]).alias("d")).first()["d"]
    known = edge_limits(found, plan.waters, depth, [lattice.centres[0], lattice.centres[-1]])
    return cut(found.join(known, ["p_lat", "p_lon", "q_lat", "q_lon"]).where("navigable and depth_ok"))


def _options(rows: DataFrame, plan: Plan) -> DataFrame:
    speeds = F.array(*[F.lit(float(s)) for s in plan.speeds_kn])
    return rows.withColumn("speed_kn", F.explode(speeds)).withColumn("engines", F.explode(F.array(*[F.lit(n) for n in plan.engines]))).withColumn(
        "stw_ms", kn_to_ms(F.col("speed_kn")))


#: Limits that may take a leg, in the order in which they are charged with it.
LIMITS = ["missing_weather", "not_navigable", "too_shallow", "slam", "overload", "current"]


def lost_to() -> Column:
    """The first limit that a leg breaks, null for a leg that keeps all."""
    broken = ["non_finite", "not navigable", "not depth_ok", "slam", "overload", "current_exceeds"]
    return F.coalesce(*[F.when(F.expr(b), name) for b, name in zip(broken, LIMITS, strict=True)])


def prune_counts(pruned: list[dict[str, int]]) -> DataFrame:
    """One row of LIMITS: the legs that each took in all layers of a search."""
    return SparkSession.active().createDataFrame([tuple(sum(p[x] for p in pruned) for x in LIMITS)], ", ".join(f"{x} long" for x in LIMITS))


def cheapest(spark, lattice: Lattice, plan: Plan, graph: DataFrame | None = None, reachable: DataFrame | None = None,
             bucket_h: float = BUCKET_H, any_end: bool = False, apart: bool = False, pruned: list[dict[str, int]] | None = None) -> DataFrame:
    """The cheapest route to lane 0 of the last stage: one row, or none: cost, duration_h, fuel_kg, comfort, wear, max_hs, path.

    A label is kept for each (lane, hour of arrival): a dearer one that arrives earlier in the same hour is lost, as
    the definition of the result has it.  ``path`` lists stage, lane, place, time, speed and engines.  Ties go to the
    smaller previous lane, then speed, then engines.  ``any_end`` takes the cheapest lane where lane 0 has no label.
    ``pruned`` gets, for each layer, how many legs each limit took (A14), observed as the layer is written.  With ``apart`` a route keeps one speed and one engine count, and there is a row for each: run_speed_kn, run_engines.
    """
    c, run = F.col, ["run_speed_kn", "run_engines"] if apart else []
    graph = limited_edges(spark, lattice, plan) if graph is None else graph
    if reachable is not None:
        graph = graph.join(reachable.select((c("stage") - 1).alias("stage"), c("lane").alias("next_lane")), ["stage", "next_lane"], "left_semi")
    zero = F.lit(0.0)
    place = F.struct(
        F.lit(0).alias("stage"), F.lit(0).alias("lane"), F.lit(lattice.centres[0][0]).alias("lat"), F.lit(lattice.centres[0][1]).alias("lon"),
        F.lit(plan.t0_h).cast("double").alias("t_h"), F.lit(None).cast("double").alias("speed_kn"), F.lit(None).cast("int").alias("engines"))
    layer = spark.range(1).select(
        F.lit(0).alias("lane"), F.lit(0).cast("long").alias("bucket"), zero.alias("cost"), F.lit(plan.t0_h).cast("double").alias("t_h"), zero.alias("fuel"),
        zero.alias("discomfort"), zero.alias("worn"), zero.alias("worst_hs"), F.array(place).alias("path"))
    layer = _options(layer, plan).select(*layer.columns, c("speed_kn").alias("run_speed_kn"), c("engines").alias("run_engines")) if apart else layer
    for i in range(len(lattice.centres) - 1):
        step = graph.where(c("stage") == i).drop("stage")
        onward = layer.join(step, "lane")
        onward = onward.withColumns({"speed_kn": c("run_speed_kn"), "engines": c("run_engines"), "stw_ms": kn_to_ms(c("run_speed_kn"))}) if apart else _options(onward, plan)
        legs = evaluate(onward, plan.weather, plan.ship, lattice.ref_lat).withColumn("lost", lost_to())
        if pruned is not None:
            seen = Observation()
            legs = legs.observe(seen, *[F.count_if(c("lost") == x).alias(x) for x in LIMITS])
        legs = legs.where("lost is null")
        t = c("t_h") + c("duration_h")
        here = F.struct(
            F.lit(i + 1).alias("stage"), c("next_lane").alias("lane"), c("q_lat").alias("lat"), c("q_lon").alias("lon"), t.alias("t_h"),
            c("speed_kn"), c("engines"))
        grown = legs.select(
            *run, c("next_lane"), F.floor((t - plan.t0_h) / bucket_h).alias("next_bucket"),
            F.struct(
                (c("cost") + leg_cost(plan.weights, c("fuel_kg"), c("duration_h"), c("comfort"), c("wear"))).alias("cost"),
                c("lane").alias("from_lane"), c("bucket"), c("speed_kn"), c("engines")).alias("rank"),
            F.struct(
                t.alias("t_h"), (c("fuel") + c("fuel_kg")).alias("fuel"), (c("discomfort") + c("comfort")).alias("discomfort"),
                (c("worn") + c("wear")).alias("worn"), F.greatest("worst_hs", "max_hs").alias("worst_hs"), F.concat("path", F.array(here)).alias("path")).alias("rest"))
        best = grown.groupBy(*run, "next_lane", "next_bucket").agg(F.min_by(F.struct("rank", "rest"), "rank").alias("b"))
        layer = best.select(*run, c("next_lane").alias("lane"), c("next_bucket").alias("bucket"), c("b.rank.cost").alias("cost"), "b.rest.*")
        if pruned is not None or (i + 1) % CUT_EVERY == 0:
            layer = cut(layer)
        if pruned is not None:
            pruned.append(seen.get)
    goal = F.struct(c("lane") != 0, "cost", "bucket") if any_end else F.struct("cost", "bucket")
    last = layer if any_end else layer.where("lane = 0")
    return last.groupBy(*run).agg(F.min_by(F.struct(*last.columns), goal).alias("b")).where("b is not null").select(
        *run,
        c("b.cost").alias("cost"), (c("b.t_h") - plan.t0_h).alias("duration_h"), c("b.fuel").alias("fuel_kg"), c("b.discomfort").alias("comfort"),
        c("b.worn").alias("wear"), c("b.worst_hs").alias("max_hs"), c("b.path").alias("path"))


def arrivals(spark, lattice: Lattice, plan: Plan, max_hours: float, graph: DataFrame | None = None, with_path: bool = False) -> DataFrame:
    """stage, lane, arrival_h: the earliest arrival at every node within ``max_hours``, over all speeds and engines."""
    c = F.col
    graph = limited_edges(spark, lattice, plan) if graph is None else graph
    layer = spark.range(1).select(
        F.lit(0).alias("lane"), F.lit(plan.t0_h).cast("double").alias("t_h"), F.array(F.lit(0)).alias("path"))
    found = layer.select(F.lit(0).alias("stage"), "lane", c("t_h").alias("arrival_h"), "path")
    for i in range(len(lattice.centres) - 1):
        legs = feasible(evaluate(_options(layer.join(graph.where(c("stage") == i).drop("stage"), "lane"), plan), plan.weather, plan.ship, lattice.ref_lat))
        reached = legs.withColumn("arrival", c("t_h") + c("duration_h")).where(c("arrival") <= plan.t0_h + max_hours)
        layer = reached.groupBy("next_lane").agg(F.min(F.struct("arrival", "lane", "path")).alias("b")).select(
            c("next_lane").alias("lane"), c("b.arrival").alias("t_h"), F.concat("b.path", F.array("next_lane")).alias("path"))
        layer = cut(layer)
        found = found.unionByName(layer.select(F.lit(i + 1).alias("stage"), "lane", c("t_h").alias("arrival_h"), "path"))
    return found if with_path else found.drop("path")


def within(found: DataFrame, t0_h: float, max_hours: float) -> DataFrame:
    """Nodes of ``arrivals`` that a shorter horizon reaches, from the same sweep."""
    return found.where(F.col("arrival_h") <= t0_h + max_hours).select("stage", "lane")


def time_optimal(spark, lattice: Lattice, plan: Plan, max_hours: float = 1e9) -> DataFrame:
    last = len(lattice.centres) - 1
    return arrivals(spark, lattice, plan, max_hours, with_path=True).where((F.col("stage") == last) & (F.col("lane") == 0)).select(
        (F.col("arrival_h") - plan.t0_h).alias("duration_h"), F.col("path").alias("lanes"))


def corridor_routes(spark, corridors: dict[str, tuple[Lattice, str]], plan: Plan) -> DataFrame:
    """The cheapest run along each named corridor at each fixed speed and engine count."""
    parts = []
    for name, (lattice, side) in corridors.items():
        found = cheapest(spark, lattice, plan, bucket_h=1e9, any_end=True, apart=True)
        found = found.withColumnsRenamed({"run_speed_kn": "speed_kn", "run_engines": "engines"})
        parts.append(found.select(F.lit(name).alias("route"), F.lit(side).alias("side"), *found.columns))
    return reduce(DataFrame.unionByName, parts)


def main_engines(path: DataFrame, by: list[str]) -> DataFrame:
    """``path(*by, engines, duration_h)`` -> the engine count that runs longest; ties go to the smaller count."""
    spent = path.groupBy(*by, "engines").agg(F.sum("duration_h").alias("h"))
    return spent.groupBy(*by).agg(F.max(F.struct("h", (-F.col("engines")).alias("e"))).alias("b")).select(*by, (-F.col("b.e")).alias("engines"))

