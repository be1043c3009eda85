"""Layered graphs and cheapest routes for a table of requests at once, with bounds.

All requests go from layer to layer together: a layer is one join and one grouping for all of them.  A bound on what is left
(the shortest way through the graph to the end, at the least cost a mile of any speed and engine count in still weather) and
the cost of one known route a request tell which legs cannot lead to a cheaper one; these are not evaluated.  The bound
depends on the place alone, so where a label goes, dearer ones of its place go too, and what is kept is what the unbounded
search keeps: routes are the same.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from fairlead.functions import twin
from fairlead.functions.mission import leg_cost
from fairlead.functions.units import distance_nm, kn_to_ms, ms_to_kn
from fairlead.operators.cut import computed, cut
from fairlead.operators.lattice import offset
from fairlead.operators.legs import edge_limits, evaluate, feasible
from fairlead.operators.search import BUCKET_H, Plan

#: Speeds that are tried for a first route.
TRIES = 3
REQUEST = ["request_id", "o_lat", "o_lon", "d_lat", "d_lon"]


def graph(requests: DataFrame, along_nm: float, across_nm: float, lanes: int, turn_nm: float, ref_lat: float) -> DataFrame:
    """``requests(request_id, o_lat, o_lon, d_lat, d_lon)`` -> request_id, last, stage, lane, next_lane, p_lat, p_lon, q_lat, q_lon, nm.

    Stages stand about ``along_nm`` apart on the line to the destination, with ``lanes`` lanes to either side but for the
    ends; lanes of neighbouring stages are joined up to ``turn_nm`` apart.  Requests from a place to itself have no edges.
    """
    c = F.col
    total = distance_nm(c("o_lat"), c("o_lon"), c("d_lat"), c("d_lon"), ref_lat)
    rows = requests.select(*REQUEST, total.alias("total")).where("total > 0")
    rows = rows.withColumn("last", F.greatest(F.lit(1), F.round(c("total") / along_nm)).cast("int"))
    rows = rows.withColumn("stage", F.explode(F.sequence(F.lit(0), c("last") - 1)))
    side = lambda stage: F.when((stage == 0) | (stage == c("last")), 0).otherwise(lanes)
    rows = rows.withColumn("_side", side(c("stage"))).withColumn("lane", F.explode(F.sequence(-c("_side"), c("_side"))))
    wide, after = int(turn_nm / across_nm + 1e-9), side(c("stage") + 1)
    rows = rows.withColumns({"_lo": F.greatest(-after, c("lane") - wide), "_hi": F.least(after, c("lane") + wide)}).where("_lo <= _hi")
    rows = rows.withColumn("next_lane", F.explode(F.sequence(c("_lo"), c("_hi"))))

    def place(stage: Column, lane: Column) -> tuple[Column, Column]:
        lat, lon = (c(f"o_{x}") + (c(f"d_{x}") - c(f"o_{x}")) * stage / c("last") for x in ("lat", "lon"))
        return offset(lat, lon, c("o_lat"), c("o_lon"), c("d_lat"), c("d_lon"), lane * across_nm, ref_lat)

    (p_lat, p_lon), (q_lat, q_lon) = place(c("stage"), c("lane")), place(c("stage") + 1, c("next_lane"))
    rows = rows.select("request_id", "last", "stage", "lane", "next_lane", p_lat.alias("p_lat"), p_lon.alias("p_lon"), q_lat.alias("q_lat"), q_lon.alias("q_lon"))
    return rows.withColumn("nm", distance_nm(c("p_lat"), c("p_lon"), c("q_lat"), c("q_lon"), ref_lat))


def open_edges(edges: DataFrame, plan: Plan) -> DataFrame:
    """The edges of ``graph`` that are navigable and deep enough for the ship, tested once for all speeds and times, and written."""
    ends = ["p_lat", "p_lon", "q_lat", "q_lon"]
    depth = edges.sparkSession.range(1).select((plan.ship["hull.draft_m"] + plan.ship["min_under_keel_clearance_m"]).alias("d")).first()["d"]
    known = edge_limits(edges, plan.waters, depth)
    return cut(edges.join(known.where("navigable and depth_ok").select(*ends), ends))


def to_go(edges: DataFrame) -> DataFrame:
    """request_id, stage, lane, to_go_nm: the shortest way through the graph to the end from every node that reaches it."""
    stages = edges.agg(F.max("last")).first()[0] or 0
    ends = edges.select("request_id", F.col("last").alias("stage"), F.lit(0).alias("lane"), F.lit(0.0).alias("to_go_nm")).distinct()
    every = layer = cut(ends)
    for i in range(stages - 1, -1, -1):
        on = layer.where(F.col("stage") == i + 1).select("request_id", F.col("lane").alias("next_lane"), "to_go_nm")
        step = edges.where(F.col("stage") == i).join(on, ["request_id", "next_lane"])
        best = step.groupBy("request_id", "stage", "lane").agg(F.min(F.col("nm") + F.col("to_go_nm")).alias("to_go_nm"))
        layer = cut(best.unionByName(ends.where(F.col("stage") == i)))  # shorter requests end here
        every = every.unionByName(layer.where(F.col("stage") < 1 if i == 0 else F.col("stage") == i).join(ends.select("request_id", "stage", "lane"), ["request_id", "stage", "lane"], "left_anti"))
    return cut(every)


def least_cost_per_nm(stw_ms: Column, engines: Column, plan: Plan, most_current_kn: float = 0.0) -> Column:
    """What a mile costs at least at a speed: time at the fastest over ground, and fuel of still water at the engines' best rate.

    Discomfort and wear cost nothing at least; weights are taken to be no less than 0.
    """
    ship = plan.ship
    best = F.array_min(F.transform(ship["engines"], lambda e: F.when(e["sfoc_curvature"] >= 0, e["sfoc_base_g_per_kwh"]).otherwise(0.0)))
    fuel = ship["hotel_load_fuel_kg_per_h"] + twin.calm_power(stw_ms, ship) * best / 1000.0
    hourly = plan.weights["time_eur_per_min"] * 60.0 + plan.weights["fuel_eur_per_kg"] * fuel
    return hourly / (ms_to_kn(stw_ms) + most_current_kn)


def _sustained(options: DataFrame, plan: Plan) -> DataFrame:
    """The options that still water does not overload; waves only add to the load, so no leg keeps the others."""
    return options.where(F.col("speed_kn") <= twin.fastest_continuous(F.col("engines"), plan.ship) + 1e-6)


def _options(rows: DataFrame, plan: Plan, most_current_kn: float) -> DataFrame:
    spark = rows.sparkSession
    every = spark.createDataFrame([(float(s), int(n)) for s in plan.speeds_kn for n in plan.engines], "speed_kn double, engines int")
    every = every.withColumn("stw_ms", kn_to_ms(F.col("speed_kn")))
    every = every.withColumn("per_nm", least_cost_per_nm(F.col("stw_ms"), F.col("engines"), plan, most_current_kn))
    listed = every.agg(F.collect_list(F.struct("speed_kn", "engines", "stw_ms", "per_nm")).alias("o"))  # speeds x engine counts
    return rows.crossJoin(F.broadcast(listed)).select(*rows.columns, F.explode("o").alias("o")).select(*rows.columns, "o.*")  # one row


def cheapest_routes(edges: DataFrame, plan: Plan, bucket_h: float = BUCKET_H, bounds: DataFrame | None = None, known: DataFrame | None = None,
                    most_current_kn: float = 0.0, evaluated: list[int] | None = None) -> DataFrame:
    """The cheapest route of every request in ``edges`` (from ``open_edges``): request_id, cost, duration_h, fuel_kg, comfort, wear, max_hs, path.

    A label is kept for each (request, lane, hour of arrival) as ``search.cheapest`` keeps it.  With ``bounds`` (``to_go``) and
    ``known(request_id, at_most)`` legs that cannot come to ``at_most`` or less are not evaluated; requests whose cheapest
    route costs more are then missing.  ``most_current_kn`` is the fastest current in the weather; ``evaluated`` gets the number of legs
    of each layer.
    """
    c, zero, spark = F.col, F.lit(0.0), edges.sparkSession
    stages = edges.agg(F.max("last")).first()[0] or 0
    least = _sustained(_options(spark.range(1), plan, most_current_kn), plan).agg(F.min("per_nm")).first()[0] or 0.0
    start = edges.where("stage = 0").select("request_id", "p_lat", "p_lon").distinct()
    place = F.struct(c("p_lat").alias("lat"), c("p_lon").alias("lon"), F.lit(0).alias("lane"), F.lit(float(plan.t0_h)).alias("t_h"), F.lit(None).cast("double").alias("speed_kn"), F.lit(None).cast("int").alias("engines"))
    layer = start.select(
        "request_id", F.lit(0).alias("lane"), F.lit(0).cast("long").alias("bucket"), zero.alias("cost"), F.lit(float(plan.t0_h)).alias("t_h"), zero.alias("fuel"),
        zero.alias("discomfort"), zero.alias("worn"), zero.alias("worst_hs"), F.array(place).alias("path"))
    steps = edges
    if bounds is not None:
        on = bounds.select("request_id", (c("stage") - 1).alias("stage"), c("lane").alias("next_lane"), "to_go_nm")
        steps = steps.join(on, ["request_id", "stage", "next_lane"]).join(known, "request_id")
    done = None
    for i in range(stages):
        onward = _options(layer.join(steps.where(c("stage") == i), ["request_id", "lane"]), plan, most_current_kn)
        if bounds is not None:
            onward = onward.where(c("cost") + c("per_nm") * c("nm") + least * c("to_go_nm") <= c("at_most") + 1e-6)
        if evaluated is not None:
            seen = Observation()
            onward = onward.observe(seen, F.count("*").alias("n"))
        legs = feasible(evaluate(onward.withColumns({"navigable": F.lit(True), "depth_ok": F.lit(True)}), plan.weather, plan.ship, plan.waters.ref_lat))
        legs = computed(legs, {"_t": c("t_h") + c("duration_h"), "_cost": c("cost") + leg_cost(plan.weights, c("fuel_kg"), c("duration_h"), c("comfort"), c("wear"))})
        if bounds is not None:
            legs = legs.where(c("_cost") + least * c("to_go_nm") <= c("at_most") + 1e-6)
        here = F.struct(c("q_lat").alias("lat"), c("q_lon").alias("lon"), c("next_lane").alias("lane"), c("_t").alias("t_h"), "speed_kn", "engines")
        rank = F.struct(c("_cost").alias("cost"), c("lane").alias("from_lane"), c("bucket").alias("from_bucket"), "speed_kn", "engines")
        rest = F.struct(
            c("_t").alias("t_h"), (c("fuel") + c("fuel_kg")).alias("fuel"), (c("discomfort") + c("comfort")).alias("discomfort"), (c("worn") + c("wear")).alias("worn"),
            F.greatest("worst_hs", "max_hs").alias("worst_hs"), F.concat("path", F.array(here)).alias("path"), "last")
        grown = legs.select("request_id", "next_lane", F.floor((c("_t") - plan.t0_h) / bucket_h).alias("next_bucket"), rank.alias("rank"), rest.alias("rest"))
        best = grown.groupBy("request_id", "next_lane", "next_bucket").agg(F.min_by(F.struct("rank", "rest"), "rank").alias("b"))
        layer = cut(best.select("request_id", c("next_lane").alias("lane"), c("next_bucket").alias("bucket"), "b.rank.cost", "b.rest.*"))
        if evaluated is not None:
            evaluated.append(seen.get["n"])
        ended = layer.where((c("last") == i + 1) & (c("lane") == 0)).drop("last")
        done = ended if done is None else done.unionByName(ended)
        layer = layer.where(c("last") > i + 1).drop("last")
    if done is None:
        done = layer.limit(0)
    one = done.groupBy("request_id").agg(F.min_by(F.struct(*done.columns), F.struct("cost", "bucket")).alias("b"))
    return cut(one.select(
        "request_id", "b.cost", (c("b.t_h") - plan.t0_h).alias("duration_h"), c("b.fuel").alias("fuel_kg"), c("b.discomfort").alias("comfort"), c("b.worn").alias("wear"),
        c("b.worst_hs").alias("max_hs"), "b.path"))


def bounded_routes(edges: DataFrame, plan: Plan, bucket_h: float = BUCKET_H, most_current_kn: float = 0.0, evaluated: list[int] | None = None) -> DataFrame:
    """``cheapest_routes`` with bounds: the same routes from fewer legs.

    The known route of a request is the cheapest at one speed on most engines: the speed which a mile costs least at in
    still water, or one of the next TRIES - 1 where limits leave no route at it.  A request without one, or whose cheapest
    kept label costs more, is searched without bounds.
    """
    spark, c = edges.sparkSession, F.col
    bounds, known, rest = to_go(edges), None, edges
    options = _sustained(_options(spark.range(1), replace(plan, engines=[max(plan.engines)]), most_current_kn), plan)
    for best in options.orderBy("per_nm").limit(TRIES).collect():
        single = replace(plan, speeds_kn=[best.speed_kn], engines=[best.engines])
        found = cheapest_routes(rest, single, bucket_h=1e9).select("request_id", c("cost").alias("at_most"))
        known = found if known is None else known.unionByName(found)
        rest = cut(edges.join(known, "request_id", "left_anti"))
        if not rest.head(1):
            break
    if known is None:
        return cheapest_routes(edges, plan, bucket_h, evaluated=evaluated)
    found = cheapest_routes(edges, plan, bucket_h, bounds, known, most_current_kn, evaluated)
    rest = cut(edges.join(found.select("request_id"), "request_id", "left_anti"))
    return found.unionByName(cheapest_routes(rest, plan, bucket_h, evaluated=evaluated)) if rest.head(1) else found
