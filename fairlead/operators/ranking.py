"""Choice among candidate routes: windows, diversity and diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PICKS, FASTEST, APART_KN = 3, 4, 2.0


def best_per_key(rows: DataFrame, keys: list[str], cost: str, tie: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(cost, tie))).where("_n = 1").drop("_n")


def eta_pool(candidates: DataFrame) -> DataFrame:
    """``candidates(request_id, candidate_id, duration_h, score_eur, latest_arrival_h, ...)``: those of each request that
    arrive in time; where none does, its FASTEST fastest, marked missed_window.  No latest arrival keeps all.
    """
    mine = Window.partitionBy("request_id")
    timely = F.col("latest_arrival_h").isNull() | (F.col("duration_h") <= F.col("latest_arrival_h"))
    marked = candidates.withColumn("_in", timely).withColumn("missed_window", ~F.bool_or("_in").over(mine))
    marked = marked.withColumn("_n", F.row_number().over(mine.orderBy("duration_h", "candidate_id")))
    return marked.where(F.when(F.col("missed_window"), F.col("_n") <= FASTEST).otherwise(F.col("_in"))).drop("_in", "_n")


def order_of(pool: DataFrame) -> Column:
    return F.when(F.col("missed_window"), F.col("duration_h")).otherwise(F.col("score_eur"))


def diverse_picks(pool: DataFrame) -> DataFrame:
    """Up to PICKS of each request's ``pool(request_id, candidate_id, side, speed_kn, missed_window, duration_h, score_eur)``.

    The best; then the best of every side not yet picked, in order; then in order those that differ from every pick in
    side or by APART_KN.  Rows come with place 1, 2, 3 in order.  Both passes are folds over the ordered pool, a
    request's few candidates; a null side is a side.
    """
    item = F.struct(order_of(pool).alias("o"), "candidate_id", "side", "speed_kn")
    grouped = pool.groupBy("request_id").agg(F.sort_array(F.collect_list(item)).alias("pool"))
    none = F.slice("pool", 1, 0)
    same = lambda p, x: p["side"].eqNullSafe(x["side"])
    by_side = F.aggregate("pool", none, lambda acc, x: F.when(
        (F.size(acc) < PICKS) & ~F.exists(acc, lambda p: same(p, x)), F.concat(acc, F.array(x))).otherwise(acc))
    rest = F.aggregate("pool", F.col("picks"), lambda acc, x: F.when(
        (F.size(acc) < PICKS) & ~F.exists(acc, lambda p: same(p, x) & (F.abs(p["speed_kn"] - x["speed_kn"]) < APART_KN)),
        F.concat(acc, F.array(x))).otherwise(acc))
    picked = grouped.withColumn("picks", by_side).withColumn("picks", F.sort_array(rest))
    return picked.select("request_id", F.posexplode("picks").alias("place", "p")).select(
        "request_id", (F.col("place") + 1).alias("place"), F.col("p.candidate_id").alias("candidate_id"), F.col("p.side").alias("side"),
        F.col("p.speed_kn").alias("speed_kn"))


def diagnostics(candidates: DataFrame, gaps: DataFrame) -> DataFrame:
    """request_id, code, detail: windows that no candidate meets, and missing weather where no route or none in time was found.

    ``candidates(request_id, duration_h, latest_arrival_h)``; ``gaps(request_id, n)`` counts legs without weather.
    """
    seen = candidates.groupBy("request_id").agg(
        F.min("duration_h").alias("fastest_h"), F.first("latest_arrival_h").alias("latest_h"))
    missed = seen.where(F.col("fastest_h") > F.col("latest_h"))
    late = missed.select("request_id", F.lit("eta_window_infeasible").alias("code"), F.col("fastest_h").alias("detail"))
    short = gaps.where("n > 0").join(seen, "request_id", "left").where("fastest_h is null or fastest_h > latest_h")
    return late.unionByName(short.select("request_id", F.lit("weather_data_gap").alias("code"), F.col("n").cast("double").alias("detail")))


def below_floor(ceilings: DataFrame, floor_kn: float) -> DataFrame:
    """``ceilings(engines, ceiling_kn)`` -> engine counts that cannot reach the slowest candidate speed."""
    return ceilings.where(F.col("ceiling_kn") < floor_kn).select(
        F.lit("engine_config_below_speed_floor").alias("code"), "engines", "ceiling_kn")
