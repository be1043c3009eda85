"""The stream's segments are those of all samples at once, however it is cut into micro-batches."""

import random

import pytest

from fairlead.operators.segments import steady_segments
from fairlead.streaming.steady import steady_stream

SCHEMA = "vessel_id string, t_s double, event_id long, stw_ms double, heading_deg double, active_engines int, fuel_kg_per_h double, hs_m double, period_peak_s double, wave_from_deg double"
END = ("zz", 2e6, 10**9, 5.0, 0.0, 1, 1.0, 0.0, 5.0, 0.0)


def samples(seed):
    r, rows, n = random.Random(seed), [], 0
    for vessel in "abc":
        t, speed, heading, engines, fuel = 1e6, 6.0, 10.0, 2, 100.0
        for _ in range(260):
            t += r.choice([30.0, 60.0, 60.0, 90.0, 0.0]) if r.random() < 0.97 else 500.0
            if r.random() < 0.03:
                speed, heading, engines, fuel = r.uniform(5, 8), r.uniform(0, 360), r.choice([1, 2]), r.uniform(80, 120)
            n += 1
            rows.append((vessel, t, n, speed + r.uniform(-0.05, 0.05), (heading + r.uniform(-1, 1)) % 360, engines, fuel + r.uniform(-2, 2), r.uniform(0, 2), 6.0, r.uniform(0, 360)))
    return rows


def key(r):
    return (r.vessel_id, r.t_start_s, r.t_end_s, r.n_samples, r.active_engines, *[round(x, 6) for x in (
        r.mean_stw_ms, r.mean_heading_deg % 360, r.mean_fuel_kg_per_h, r.mean_hs_m, r.mean_period_peak_s, r.mean_wave_from_deg % 360, r.duration_h)])


@pytest.mark.parametrize("cuts", [1, 4, 9])
def test_segments_of_a_stream(spark, tmp_path, cuts):
    rows = samples(3)
    want = sorted(map(key, steady_segments(spark.createDataFrame(rows, SCHEMA), ["vessel_id"], "event_id").collect()))
    assert len(want) > 10
    r = random.Random(cuts)
    order = sorted(rows, key=lambda x: x[1] + r.uniform(0, 500))  # out of order, within the delay of 600 s
    size, got = -(-len(order) // cuts), []
    for part in [*(order[i : i + size] for i in range(0, len(order), size)), [END], [(*END[:1], 2e6 + 5000, *END[2:])]]:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = steady_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), "vessel_id", "event_id")
        stream.writeStream.foreachBatch(lambda df, n: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert sorted(key(x) for x in got if x.vessel_id != "zz") == want
