"""Vessel physics as column expressions: power, fuel, motion and wear."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from fairlead.functions.units import kn_to_ms, ms_to_kn
from fairlead.sources.specs import Vessel

GRAVITY, SEAWATER = 9.81, 1025.0


def encounter_angle(heading: Column, wave_from: Column) -> Column:
    """0 with the waves dead ahead, 180 with them dead astern."""
    return F.abs(F.pmod(F.pmod(heading - wave_from, F.lit(360.0)) + 540.0, F.lit(360.0)) - 180.0)


def period_response(peak: Column, reference: Column) -> Column:
    r = F.pow(peak / reference, 2)
    return r / (1.0 + F.pow(r - 1.0, 2))


def calm_power(v: Column, ship: Vessel) -> Column:
    c = lambda k: ship["calm_resistance." + k]
    froude = v / F.sqrt(GRAVITY * ship["hull.length_wl_m"])
    rise = 1.0 + c("steepening_coefficient") * F.pow(froude / c("hull_speed_froude"), c("steepening_exponent"))
    return F.when(v <= 0, 0.0).otherwise((c("linear_coefficient") * v * v + c("cubic_coefficient") * v * v * v) * rise)


def added_power(v: Column, hs: Column, peak: Column, encounter: Column, ship: Vessel) -> Column:
    a = lambda k: ship["added_resistance." + k]
    turn = a("following_factor") + (a("head_factor") - a("following_factor")) * F.pow(encounter / 180.0, 1.6)
    hull = ship["hull.beam_wl_m"] * ship["hull.beam_wl_m"] / ship["hull.length_wl_m"]
    force = a("scale") * SEAWATER * GRAVITY * hs * hs * hull * period_response(peak, a("period_reference_s")) * turn
    return force * v / 1000.0


def total_power(v: Column, hs: Column, peak: Column, wave_from: Column, heading: Column, ship: Vessel) -> Column:
    return calm_power(v, ship) + added_power(v, hs, peak, encounter_angle(heading, wave_from), ship)


def sfoc(load: Column, engine: Column) -> Column:
    return engine["sfoc_base_g_per_kwh"] * (1.0 + engine["sfoc_curvature"] * F.pow(load - engine["sfoc_min_load_fraction"], 2))


def engine_loads(power: Column, engines: Column, ship: Vessel) -> Column:
    """Load fractions of the first ``engines`` engines, which share the power equally; null for a count out of range."""
    used = F.slice(ship["engines"], F.lit(1), F.greatest(engines, F.lit(0)))
    return F.when(engines.between(1, F.size(ship["engines"])), F.transform(used, lambda e: power / engines / e["mcr_kw"]))


def fuel_rate(power: Column, engines: Column, ship: Vessel) -> Column:
    """kg an hour with the hotel load; null for an engine count out of range."""
    used = F.slice(ship["engines"], F.lit(1), F.greatest(engines, F.lit(0)))
    share = power / engines
    burned = F.aggregate(used, F.lit(0.0), lambda s, e: s + share * sfoc(share / e["mcr_kw"], e) / 1000.0)
    return F.when(engines.between(1, F.size(ship["engines"])), ship["hotel_load_fuel_kg_per_h"] + burned)


def motion_index(v: Column, hs: Column, peak: Column, wave_from: Column, heading: Column, ship: Vessel) -> Column:
    c = lambda k: ship["comfort." + k]
    enc = encounter_angle(heading, wave_from)
    beam = c("beam_base") + c("beam_amplitude") * F.pow(F.sin(F.radians(enc)), 2)
    beam = beam + F.when(enc > c("head_bonus_threshold_deg"), c("head_bonus")).otherwise(0.0)
    pace = c("speed_base") + ms_to_kn(v) / c("speed_scale_kn")
    return c("scale") * F.pow(hs, c("hs_exponent")) * beam * period_response(peak, c("period_reference_s")) * pace


def wear(v: Column, hs: Column, wave_from: Column, heading: Column, load: Column, engines: Column, ship: Vessel) -> dict[str, Column]:
    """rate an hour, slam and overload; all limits are exceeded strictly.  NaN exceeds nothing."""
    w = lambda k: ship["wear_policy." + k]
    over = lambda x, y: ~F.isnan(x) & (x > y)
    slam = (
        over(encounter_angle(heading, wave_from), w("slamming_encounter_angle_deg")) & over(hs, w("slamming_hs_threshold_m"))
        & over(v, w("slamming_min_speed_ms")))
    hit = w("slam_wear_scale") * (hs - w("slamming_hs_threshold_m")) * (v - w("slamming_min_speed_ms"))
    parts = [
        F.pow(F.greatest(load, F.lit(0.0)), 3) * w("load_wear_scale"), F.when(slam, hit).otherwise(0.0),
        F.when(engines == 1, w("single_engine_wear_bonus")).otherwise(0.0)]
    return {"rate": reduce(add, parts), "slam": slam, "overload": over(load, w("max_continuous_load_fraction"))}


def fastest_continuous(engines: Column, ship: Vessel, top: float = 40.0, steps: int = 30) -> Column:
    """Speed in knots at the continuous load limit in calm water, by bisection inside one expression."""
    mcr = F.array_min(F.transform(F.slice(ship["engines"], F.lit(1), engines), lambda e: e["mcr_kw"]))
    limit = ship["wear_policy.max_continuous_load_fraction"]

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2.0
        above = calm_power(kn_to_ms(mid), ship) / engines / mcr > limit
        return F.struct(F.when(above, s["lo"]).otherwise(mid).alias("lo"), F.when(above, mid).otherwise(s["hi"]).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0.0).alias("lo"), F.lit(top).alias("hi")), halve, lambda s: s["lo"])


def speed_grid(ceiling: Column, floor: float = 6.0, step: float = 1.0) -> Column:
    """Speeds from the floor up to the ceiling in equal steps; the ceiling alone if it is lower."""
    low = F.least(ceiling, F.lit(floor))
    return F.transform(F.sequence(F.lit(0), F.floor((ceiling - low) / step).cast("int")), lambda i: low + i * step)
