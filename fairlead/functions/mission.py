"""Mission sliders to weights, and the cost of a leg under them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Presets (pace, comfort), and fuel noise by source with the share that counts as one.
PRESETS = {"owner_aboard": (25.0, 90.0), "repositioning": (20.0, 10.0), "charter_turnaround": (85.0, 40.0), "delivery": (45.0, 15.0)}
NOISE = {"monitoring_csv": 0.03, "e_logbook": 0.08, "noon_report": 0.15, "bridge_sim": 0.03, "annotated_track": 0.03}
USUAL_NOISE, OVER_GROUND, DAILY = 0.03, 2.0, 5.0


def weights(pace: Column, comfort: Column) -> dict[str, Column]:
    """EUR for a kg of fuel, a minute and a point of discomfort; null for sliders outside 0..100."""
    valid = pace.between(0, 100) & comfort.between(0, 100)
    return {
        "fuel_eur_per_kg": F.when(valid, ((100.0 - pace) / 100.0 + 0.15) / 0.85),
        "time_eur_per_min": F.when(valid, pace / 100.0 * 25.0 + 0.5),
        "comfort_eur_per_point": F.when(valid, comfort / 100.0 * 36.0)}


def leg_cost(w: Column, fuel_kg: Column, duration_h: Column, comfort: Column, wear: Column) -> Column:
    return (
        w["fuel_eur_per_kg"] * fuel_kg + w["time_eur_per_min"] * duration_h * 60.0 + w["comfort_eur_per_point"] * comfort
        + w["wear_eur_per_point"] * wear)


def noise_multiplier(source: Column, over_ground: Column) -> Column:
    known = F.element_at(F.create_map(*[F.lit(x) for kv in NOISE.items() for x in kv]), source)
    return F.coalesce(known, F.lit(USUAL_NOISE)) / USUAL_NOISE * F.when(over_ground, OVER_GROUND).otherwise(1.0)
