"""Many requests at once: equal to each request searched alone, with bounds and without."""

import math

import pytest
from pyspark.sql import functions as F

from fairlead.operators import fleet, lattice, legs, search, spatial
from fairlead.sources.specs import Vessel

ISLAND = [[(42.76, 7.3), (42.76, 7.42), (42.6, 7.42), (42.6, 7.3)]]
WATERS = spatial.Waters(ISLAND)
ASKED = [(1, 42.9, 7.2, 42.5, 7.5), (2, 42.9, 7.2, 42.8, 7.3), (3, 42.3, 7.9, 42.55, 7.35), (4, 42.68, 7.36, 42.5, 7.0), (5, 42.0, 7.0, 42.0, 7.0)]


def plan_for(weather="mistral"):
    w = {"fuel_eur_per_kg": F.lit(0.8), "time_eur_per_min": F.lit(10.0), "comfort_eur_per_point": F.lit(15.0), "wear_eur_per_point": F.lit(9.0)}
    return search.Plan(legs.scenario(weather), WATERS, Vessel.of(), w, [8.0, 10.0, 12.0, 14.0], [1, 2])


@pytest.fixture(scope="module")
def edges(spark):
    asked = spark.createDataFrame(ASKED, "request_id long, o_lat double, o_lon double, d_lat double, d_lon double")
    return fleet.open_edges(fleet.graph(asked, 6.0, 3.0, 2, 6.0, 42.3), plan_for())


def shown(rows):
    return {r.request_id: (round(r.cost, 6), round(r.duration_h, 9), tuple((p.lane, p.speed_kn, p.engines) for p in r.path)) for r in rows.collect()}


@pytest.mark.parametrize("weather", ["calm", "mistral"])
def test_bounds_change_no_route_and_save_legs(spark, edges, weather):
    plan, many, few = plan_for(weather), [], []
    whole = shown(fleet.cheapest_routes(edges, plan, evaluated=many))
    assert shown(fleet.bounded_routes(edges, plan, evaluated=few)) == whole
    assert set(whole) == {1, 2, 3} | ({4} & set(whole)) and 5 not in whole
    assert sum(few) < sum(many) * (0.5 if weather == "calm" else 1.0)


def test_each_request_is_the_single_search(spark, edges):
    """A request of three stages against ``search.cheapest`` on the lattice with its centres and lanes."""
    found = shown(fleet.cheapest_routes(edges, plan_for("calm")))
    for request, *ends in (ASKED[0], ASKED[2]):
        o, d = tuple(ends[:2]), tuple(ends[2:])
        n = max(1, round(lattice.nm_between(o, d, 42.3) / 6.0))
        centres = [tuple(a + (b - a) * i / n for a, b in zip(o, d, strict=True)) for i in range(n + 1)]
        lat = lattice.Lattice(centres, [0, *[2] * (n - 1), 0], [3.0] * (n + 1), 6.0, 42.3)
        alone = search.cheapest(spark, lat, plan_for("calm")).first()
        assert math.isclose(found[request][0], alone.cost, rel_tol=1e-6) and [p.lane for p in alone.path] == [p[0] for p in found[request][2]]


def test_shortest_way_to_go(edges):
    rows = [r.asDict() for r in edges.collect()]
    last = {r["request_id"]: r["last"] for r in rows}
    left = {(k, n, 0): 0.0 for k, n in last.items()}
    for r in sorted(rows, key=lambda r: -r["stage"]):
        on = left.get((r["request_id"], r["stage"] + 1, r["next_lane"]))
        if on is not None:
            key = (r["request_id"], r["stage"], r["lane"])
            left[key] = min(left.get(key, 1e9), on + r["nm"])
    got = {(r.request_id, r.stage, r.lane): r.to_go_nm for r in fleet.to_go(edges).collect()}
    assert got.keys() == left.keys() and all(math.isclose(got[k], left[k], abs_tol=1e-9) for k in left)


def test_no_requests(spark, edges):
    none = edges.limit(0)
    assert fleet.bounded_routes(none, plan_for()).count() == 0 and fleet.to_go(none).count() == 0
