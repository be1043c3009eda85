"""Fits of resistance and fuel curves with priors, and their validation on holdouts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fairlead.functions import twin
from fairlead.sources.specs import DEFAULT, ENGINE, Vessel

# Priors (mean, standard deviation) and bounds of each parameter.
CALM = {
    "linear_coefficient": (5.0, 1.5, 0.0, 100.0), "cubic_coefficient": (1.0, 0.4, 0.0, 20.0), "steepening_coefficient": (1.5, 0.6, 0.0, 20.0),
    "steepening_exponent": (4.0, 1.0, 1.0, 10.0), "sfoc_base_g_per_kwh": (195.0, 15.0, 50.0, 400.0),
    "sfoc_min_load_fraction": (0.75, 0.1, 0.05, 0.99), "sfoc_curvature": (2.0, 0.75, 0.0, 20.0)}
ADDED = {
    "scale": (0.4, 0.15, 0.0, 5.0), "period_reference_s": (7.5, 2.0, 2.0, 20.0), "head_factor": (1.0, 0.3, 0.0, 5.0),
    "following_factor": (0.25, 0.15, 0.0, 5.0)}
NEAR_CALM_M, NOISE, NOISE_FLOOR, Z90 = 0.3, 0.03, 1.0, 1.645


def predicted_fuel(ship: Vessel) -> Column:
    """Fuel rate of a segment from its means."""
    power = twin.total_power(F.col("mean_stw_ms"), F.col("mean_hs_m"), F.col("mean_period_peak_s"), F.col("mean_wave_from_deg"), F.col("mean_heading_deg"), ship)
    return twin.fuel_rate(power, F.col("active_engines"), ship)


def validation(segments: DataFrame, ship: Vessel, by: list[str] = ()) -> DataFrame:
    """n, rmse, bias and 90 % band of predicted less measured fuel; an empty table gives no groups."""
    r = predicted_fuel(ship) - F.col("mean_fuel_kg_per_h")
    return segments.groupBy(*by).agg(
        F.count("*").alias("n_holdout"), F.sqrt(F.avg(r * r)).alias("rmse_kg_per_h"), F.avg(r).alias("mean_bias_kg_per_h"),
        (F.lit(Z90) * F.stddev_pop(r)).alias("error_band_kg_per_h"))


def validation_by_vessel(held: DataFrame, params: DataFrame, ship: dict = DEFAULT) -> DataFrame:
    """``validation`` of every vessel's own fit on its held-out segments, or on all of them where none is held out.

    ``held(vessel_id, is_holdout, ...)``; ``params`` as ``fit_vessels`` has it joins the segments as a map of a dozen numbers.
    """
    fit = params.groupBy("vessel_id").agg(F.map_from_entries(F.collect_list(F.struct("param", "value"))).alias("_fit"))
    some = held.groupBy("vessel_id").agg(F.bool_or("is_holdout").alias("_some"))
    base, own = Vessel.of(ship), lambda name, x: F.coalesce(F.try_element_at(F.col("_fit"), F.lit(name)), x)

    def get(path: str) -> Column:
        if path == "engines":
            return F.transform(base[path], lambda e: F.struct(*[own(k, e[k]).alias(k) for k in ENGINE]))
        section, _, name = path.rpartition(".")
        return own(name, base[path]) if section in ("calm_resistance", "added_resistance") else base[path]

    rows = held.join(fit, "vessel_id").join(some, "vessel_id").where(F.col("is_holdout") | ~F.col("_some"))
    return validation(rows, Vessel(get), ["vessel_id"])


def _smallest(rows: DataFrame, bucket: Column, key: Column, n: int) -> Column:
    """Whether a row is among the ``n`` smallest by ``key``, of which ``bucket`` is the beginning.

    Rows are counted by bucket; those below the bucket that the n-th is in are in, those above out, and only that
    bucket's are put in order.  A table with the result reads its rows once more and moves none.
    """
    counts = rows.groupBy(bucket.alias("b")).agg(F.count("*").alias("k"))
    upto = F.sum("k").over(Window.orderBy("b"))  # one row a bucket
    edge = counts.withColumn("upto", upto).where(F.col("upto") >= n).orderBy("b").first()
    if edge is None:
        return F.lit(bool(n))
    left = n - (edge["upto"] - edge["k"])
    last = rows.where(bucket == edge["b"]).select(key.alias("k")).orderBy("k").limit(left).agg(F.max("k").alias("k")).first()["k"]
    end = F.struct(*[F.lit(v).alias(f) for f, v in last.asDict().items()]).cast(rows.select(key.alias("k")).schema["k"].dataType)
    return (bucket < edge["b"]) | ((bucket == edge["b"]) & (key <= end))


def holdout_rows(segments: DataFrame, order: list[str], fraction: float = 0.2, seed: int = 7) -> DataFrame:
    """``segments`` with is_holdout for that share of the rows (L7), at least one, chosen by a seeded hash of ``order``; ties go by ``order``."""
    wanted = segments.count() * fraction
    if not wanted:
        return segments.withColumn("is_holdout", F.lit(False))
    h = F.xxhash64(F.lit(seed), *order)
    return segments.withColumn("is_holdout", _smallest(segments, F.shiftright(h, 48), F.struct(h.alias("h"), *order), max(1, int(wanted + 0.5))))


def holdout_groups(segments: DataFrame, by: str, fraction: float = 0.2, seed: int = 7) -> DataFrame:
    """``segments`` with is_holdout, whole groups of ``by`` at a time, chosen by a seeded hash.

    Fails before the work begins if some rows have a group and others none, if there are fewer than two groups, or if
    the fraction rounds down to none.
    """
    seen = segments.agg(F.count_if(F.col(by).isNull()).alias("none"), F.count("*").alias("n")).first()
    if 0 < seen["none"] < seen["n"]:
        raise ValueError(f"{seen['none']} of {seen['n']} segments have no {by}")
    groups = segments.select(by).distinct()
    n = groups.count()
    if n < 2:
        raise ValueError(f"a holdout needs two groups of {by} at least, not {n}")
    if int(n * fraction) == 0:
        raise ValueError(f"{fraction} of {n} groups of {by} is no group")
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(by).cast("string")))
    return segments.withColumn("is_holdout", _smallest(groups, F.substring(h, 1, 4), F.struct(h.alias("h"), F.col(by).alias("g")), int(n * fraction)))


def engine_configurations(segments: DataFrame, by: list[str] = ()) -> DataFrame:
    """active_engines and n_segments of every engine count that the segments hold."""
    return segments.groupBy(*by, "active_engines").agg(F.count("*").alias("n_segments"))


def _powers(pdf: dict[str, np.ndarray], calm: dict[str, np.ndarray], added: dict[str, np.ndarray], ship: dict) -> np.ndarray:
    """Power of each segment, a row for each value of the parameters where these are columns of values."""
    hull, v = ship["hull"], pdf["mean_stw_ms"]
    froude = v / np.sqrt(twin.GRAVITY * hull["length_wl_m"]) / ship["calm_resistance"]["hull_speed_froude"]
    base = (calm["linear_coefficient"] * v**2 + calm["cubic_coefficient"] * v**3) * (1 + calm["steepening_coefficient"] * froude ** calm["steepening_exponent"])
    enc = np.abs(((pdf["mean_heading_deg"] - pdf["mean_wave_from_deg"]) % 360 + 540) % 360 - 180) / 180.0
    r = (pdf["mean_period_peak_s"] / added["period_reference_s"]) ** 2
    turn = added["following_factor"] + (added["head_factor"] - added["following_factor"]) * enc**1.6
    force = added["scale"] * twin.SEAWATER * twin.GRAVITY * pdf["mean_hs_m"] ** 2 * hull["beam_wl_m"] ** 2 / hull["length_wl_m"] * r / (1 + (r - 1) ** 2) * turn
    return np.where(v > 0, base, 0.0) + force * v / 1000.0


def _fuel(pdf: dict[str, np.ndarray], calm: dict[str, np.ndarray], added: dict[str, np.ndarray], ship: dict) -> np.ndarray:
    n = pdf["active_engines"]
    share = _powers(pdf, calm, added, ship) / n
    load = share / ship["engines"][0]["mcr_kw"]
    rate = calm["sfoc_base_g_per_kwh"] * (1 + calm["sfoc_curvature"] * (load - calm["sfoc_min_load_fraction"]) ** 2)
    return ship["hotel_load_fuel_kg_per_h"] + n * share * rate / 1000.0


def least_squares(residuals, x: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Levenberg-Marquardt steps kept within bounds; derivatives by differences.

    ``residuals`` takes a table with a row of parameters for each of several trials and returns a row for each: all derivatives are
    one call, and while no step is taken they stay as they are.
    """
    damp, r, normal = 1e-3, residuals(x[None])[0], None
    for _ in range(rounds):
        if normal is None:
            step = np.maximum(np.abs(x), 1e-3) * 1e-6
            jac = ((residuals(x + np.diag(step)) - r) / step[:, None]).T
            normal, slope = jac.T @ jac, jac.T @ r
        moved = np.clip(x - np.linalg.solve(normal + damp * np.diag(np.diag(normal)), slope), low, high)
        new = residuals(moved[None])[0]
        if new @ new < r @ r:
            small = r @ r - new @ new < 1e-12 * (r @ r)
            x, r, damp, normal = moved, new, damp / 3, None
            if small:
                break
        else:
            damp *= 4
            if damp > 1e12:
                break
    return x


_MEANS = ["mean_stw_ms", "mean_heading_deg", "mean_wave_from_deg", "mean_period_peak_s", "mean_hs_m", "active_engines", "mean_fuel_kg_per_h"]


def fit_vessels(segments: DataFrame, ship: dict = DEFAULT, near_calm_m: float = NEAR_CALM_M) -> DataFrame:
    """vessel_id, param, value, shift (in standard deviations of its prior), n_calm, n_waves: one fit for each vessel.

    Segments are few for each vessel whatever the telemetry's size.  Calm and fuel parameters are fitted on near-calm
    segments, then wave parameters on all, each with its priors as residuals.  A vessel without near-calm segments fails.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = {c: pdf[c].to_numpy() for c in _MEANS}
        noise = pdf["fuel_noise_multiplier"].to_numpy() if "fuel_noise_multiplier" in pdf else 1.0
        rows["_sd"] = np.maximum(NOISE_FLOOR, NOISE * rows["mean_fuel_kg_per_h"] * noise)
        calm_rows = rows["mean_hs_m"] <= near_calm_m
        quiet = {c: v[calm_rows] for c, v in rows.items()}
        vessel, n_calm = pdf["vessel_id"].iloc[0], int(calm_rows.sum())
        if not n_calm:
            raise ValueError(f"vessel {vessel} has no segment with waves up to {near_calm_m} m")
        known = {"calm": {k: p[0] for k, p in CALM.items()}, "added": {k: p[0] for k, p in ADDED.items()}}
        out = []
        for part, table, own in (("calm", CALM, quiet), ("added", ADDED, rows)):
            names, (mean, sd, low, high) = list(table), (np.array(x) for x in zip(*table.values(), strict=True))

            def residuals(x: np.ndarray, part=part, names=names, own=own, mean=mean, sd=sd) -> np.ndarray:
                tried = known | {part: dict(zip(names, x.T[:, :, None], strict=True))}
                miss = (_fuel(own, tried["calm"], tried["added"], ship) - own["mean_fuel_kg_per_h"]) / own["_sd"]
                return np.concatenate([miss, (x - mean) / sd], axis=1)

            x = least_squares(residuals, mean.copy(), low, high)
            known[part] = dict(zip(names, x.tolist(), strict=True))
            out += [(vessel, k, float(v), float((v - m) / s), n_calm, len(pdf)) for k, v, m, s in zip(names, x, mean, sd, strict=True)]
        return pd.DataFrame(out, columns=["vessel_id", "param", "value", "shift", "n_calm", "n_waves"])

    kind = segments.schema["vessel_id"].dataType.simpleString()
    needed = segments.select("vessel_id", *[c for c in (*_MEANS, "fuel_noise_multiplier") if c in segments.columns])
    return needed.groupBy("vessel_id").applyInPandas(fit, f"vessel_id {kind}, param string, value double, shift double, n_calm long, n_waves long")


def fitted_spec(params: dict[str, float], ship: dict = DEFAULT) -> dict:
    """A specification with fitted parameters in their places."""
    put = lambda section: section | {k: params[k] for k in section if k in params}
    return ship | {
        "calm_resistance": put(ship["calm_resistance"]), "added_resistance": put(ship["added_resistance"]),
        "engines": [put(e) for e in ship["engines"]], "provisional": False}
