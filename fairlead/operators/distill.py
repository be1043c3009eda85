"""Removal of waypoints that a route does better without (G13), for many routes at once.

A point goes if the legs on both sides have one speed and engine count, the straight leg past it keeps every limit, and
it costs no more than the two.  Whether it does depends on the points before it, so a sweep goes from left to right;
each step is one evaluation of legs for all routes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.functions.mission import leg_cost
from fairlead.functions.units import angle_between
from fairlead.operators.cut import cut
from fairlead.operators.legs import edge_limits, evaluate
from fairlead.operators.search import Plan

SWEEPS = 50


def _legs(rows: DataFrame, name: str, p: Column, q: Column, t: Column, plan: Plan, depth: float, exempt: list[tuple[float, float]]) -> DataFrame:
    """``rows`` with <name>_cost, <name>_h and <name>_ok of the leg from p to q at the pending speed."""
    ends = ["p_lat", "p_lon", "q_lat", "q_lon"]
    given = rows.withColumns({
        "p_lat": p["lat"], "p_lon": p["lon"], "q_lat": q["lat"], "q_lon": q["lon"], "stw_ms": F.col("_stw"), "engines": F.col("_engines"), "t_h": t})
    done = evaluate(given, plan.weather, plan.ship, plan.waters.ref_lat)
    known = done.join(edge_limits(done, plan.waters, depth, exempt), ends)
    ok = F.expr("navigable and depth_ok and not slam and not overload and not current_exceeds")
    cost = leg_cost(plan.weights, F.col("fuel_kg"), F.col("duration_h"), F.col("comfort"), F.col("wear"))
    return known.select(*rows.columns, cost.alias(f"{name}_cost"), F.col("duration_h").alias(f"{name}_h"), ok.alias(f"{name}_ok"))


def sweep(routes: DataFrame, plan: Plan, depth: float, exempt: list[tuple[float, float]]) -> DataFrame:
    """One pass over ``routes(route_id, track array<struct<lat, lon>>, stw array, engine array)``, as such rows again."""
    c = F.col
    longest = routes.agg(F.max(F.size("track")).alias("n")).first()["n"] or 0
    rows = routes.select(
        "route_id", "track", "stw", "engine", F.array(F.lit(0)).alias("kept"), F.slice("stw", 1, 0).alias("kept_stw"),
        F.slice("engine", 1, 0).alias("kept_engine"), F.lit(plan.t0_h).cast("double").alias("_t"), c("stw")[0].alias("_stw"), c("engine")[0].alias("_engines"))
    for i in range(1, longest - 1):
        more = rows.where(F.size("track") > i + 1)
        last = F.get("track", F.element_at("kept", -1))
        here, after = F.get("track", F.lit(i)), F.get("track", F.lit(i + 1))
        one = _legs(more, "to", last, here, c("_t"), plan, depth, exempt)
        two = _legs(one, "on", here, after, c("_t") + c("to_h"), plan, depth, exempt)
        three = _legs(two, "past", last, after, c("_t"), plan, depth, exempt)
        same = (F.get("stw", F.lit(i)) == c("_stw")) & (F.get("engine", F.lit(i)) == c("_engines"))
        gone = same & c("past_ok") & (c("past_cost") <= c("to_cost") + c("on_cost"))
        keep = three.withColumn("_gone", F.coalesce(gone, F.lit(False))).select(
            "route_id", "track", "stw", "engine",
            F.when(c("_gone"), c("kept")).otherwise(F.concat("kept", F.array(F.lit(i)))).alias("kept"),
            F.when(c("_gone"), c("kept_stw")).otherwise(F.concat("kept_stw", F.array("_stw"))).alias("kept_stw"),
            F.when(c("_gone"), c("kept_engine")).otherwise(F.concat("kept_engine", F.array("_engines"))).alias("kept_engine"),
            F.when(c("_gone"), c("_t")).otherwise(c("_t") + c("to_h")).alias("_t"),
            F.when(c("_gone"), c("_stw")).otherwise(F.get("stw", F.lit(i))).alias("_stw"),
            F.when(c("_gone"), c("_engines")).otherwise(F.get("engine", F.lit(i))).alias("_engines"))
        rows = cut(keep.unionByName(rows.where(F.size("track") <= i + 1)))
    places = F.concat("kept", F.array(F.size("track") - 1))
    return rows.select(
        "route_id", F.transform(places, lambda k: F.get("track", k)).alias("track"), F.concat("kept_stw", F.array("_stw")).alias("stw"),
        F.concat("kept_engine", F.array("_engines")).alias("engine"))


def track_totals(routes: DataFrame, plan: Plan, exempt: list[tuple[float, float]] = ()) -> DataFrame:
    """What each whole route costs (A7), leg after leg with its own arrival times.

    ``routes(route_id, track, stw, engine)`` -> the same with cost, duration_h, fuel_kg, comfort, wear, max_hs, ``eta_h``
    (the time at every point, the first included) and ``legs`` (course, course to steer, speed, engines and hours of each).
    One evaluation of legs serves all routes at a step.
    """
    c, zero = F.col, F.lit(0.0)
    longest = routes.agg(F.max(F.size("track")).alias("n")).first()["n"] or 0
    leg = "array<struct<course_deg: double, course_to_steer_deg: double, stw_ms: double, engines: int, duration_h: double>>"
    rows = routes.select("route_id", "track", "stw", "engine").withColumns({
        "cost": zero, "duration_h": zero, "fuel_kg": zero, "comfort": zero, "wear": zero, "max_hs": zero,
        "eta_h": F.array(F.lit(plan.t0_h).cast("double")), "legs": F.array().cast(leg)})
    sums = ["fuel_kg", "comfort", "wear"]
    for i in range(1, longest):
        p, q = F.get("track", F.lit(i - 1)), F.get("track", F.lit(i))
        before = {k: c(k).alias(f"_{k}") for k in ("cost", "duration_h", "max_hs", *sums)}
        more = rows.where(F.size("track") > i).select(
            "route_id", "track", "stw", "engine", "eta_h", "legs", *before.values(), p["lat"].alias("p_lat"), p["lon"].alias("p_lon"), q["lat"].alias("q_lat"),
            q["lon"].alias("q_lon"), F.get("stw", F.lit(i - 1)).alias("stw_ms"), F.get("engine", F.lit(i - 1)).alias("engines"), F.element_at("eta_h", -1).alias("t_h"))
        done = evaluate(more, plan.weather, plan.ship, plan.waters.ref_lat)
        leg_now = F.struct("course_deg", "course_to_steer_deg", "stw_ms", c("engines").cast("int").alias("engines"), "duration_h")
        done = done.select(
            "route_id", "track", "stw", "engine", (c("_cost") + leg_cost(plan.weights, c("fuel_kg"), c("duration_h"), c("comfort"), c("wear"))).alias("cost"),
            (c("_duration_h") + c("duration_h")).alias("duration_h"), *[(c(f"_{k}") + c(k)).alias(k) for k in sums], F.greatest("_max_hs", "max_hs").alias("max_hs"),
            F.concat("eta_h", F.array(c("t_h") + c("duration_h"))).alias("eta_h"), F.concat("legs", F.array(leg_now)).alias("legs"))
        rows = cut(done.select(rows.columns).unionByName(rows.where(F.size("track") <= i)))
    return rows


def distill(routes: DataFrame, plan: Plan, exempt: list[tuple[float, float]]) -> DataFrame:
    """Sweeps until no route loses a point, SWEEPS at most; a sweep that makes a whole route dearer is undone and ends it.

    -> the columns of ``track_totals``.
    """
    c = F.col
    spark = routes.sparkSession
    depth = spark.range(1).select((plan.ship["hull.draft_m"] + plan.ship["min_under_keel_clearance_m"]).alias("d")).first()["d"]
    active, ended = track_totals(routes, plan, exempt), None
    for _ in range(SWEEPS):
        swept = track_totals(sweep(active, plan, depth, exempt), plan, exempt)
        both = active.select("route_id", F.struct(*active.columns).alias("old")).join(swept.select("route_id", F.struct(*swept.columns).alias("new")), "route_id")
        better = (F.size("new.track") < F.size("old.track")) & (c("new.cost") <= c("old.cost") + 1e-9)
        both = cut(both.select(better.alias("better"), F.when(better, c("new")).otherwise(c("old")).alias("r")))
        still = both.where(~c("better")).select("r.*")
        ended = still if ended is None else ended.unionByName(still)
        active = both.where("better").select("r.*")
        if not active.head(1):
            return ended
    return active if ended is None else ended.unionByName(active)


def alterations(totals: DataFrame, least_deg: float = 1.0) -> DataFrame:
    """route_id, point, lat, lon, eta_h, before_deg, after_deg of the points where a route of ``track_totals`` changes course."""
    at = totals.select("route_id", "track", "eta_h", "legs", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("legs") - 1))).alias("point")).where(F.size("legs") > F.col("point"))
    before, after = F.get("legs", F.col("point") - 1)["course_deg"], F.get("legs", F.col("point"))["course_deg"]
    here = F.get("track", F.col("point"))
    return at.where(angle_between(before, after) >= least_deg).select(
        "route_id", "point", here["lat"].alias("lat"), here["lon"].alias("lon"), F.get("eta_h", F.col("point")).alias("eta_h"), before.alias("before_deg"), after.alias("after_deg"))
