"""Grid files read by tasks, versions of tables, the keyed table and streams."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairlead.sources import gridfile
from fairlead.streaming.keyed import KeyedTable, follow_with

ROW = "timestamp double, source_pgn int, value string, n long"


@pytest.fixture(scope="module")
def grid(tmp_path_factory):
    rng = np.random.default_rng(3)
    a, b = rng.random((4, 5, 7)), rng.random((4, 5, 7)).astype(np.float32)
    a[1, 2, 3] = np.nan
    d = tmp_path_factory.mktemp("grids")
    entries = {"hs_m": a, "wind_u_ms": b, "hours": np.arange(4.0), "lat0": 41.0, "source_cycle": "20240101 06"}
    np.savez(d / "plain.npz", **entries)
    np.savez_compressed(d / "packed.npz", **entries)
    return d, a, b


@pytest.mark.parametrize("name", ["plain.npz", "packed.npz"])
def test_grid_source(spark, grid, name):
    folder, a, b = grid
    rows, rest = gridfile.read_grid(spark, str(folder / name))
    assert rest == {"hours": [0.0, 1.0, 2.0, 3.0], "lat0": 41.0, "source_cycle": "20240101 06"}
    got = {(r.it, r.iy, r.ix): (r.hs_m, r.wind_u_ms) for r in rows.collect()}
    assert len(got) == a.size and rows.rdd.getNumPartitions() == 4
    for k, (x, y) in got.items():
        assert (x == a[k] or np.isnan(x) and np.isnan(a[k])) and y == b[k]
    assert rows.where(F.isnan("hs_m")).count() == 1 and rows.where("hs_m is null").count() == 0


def test_grid_source_prunes(spark, grid):
    folder, a, b = grid
    rows, _ = gridfile.read_grid(spark, "file://" + str(folder / "packed.npz"), ["wind_u_ms"])
    assert rows.columns == ["it", "iy", "ix", "wind_u_ms"]
    some = rows.where("it >= 1 and it < 3")
    assert some.rdd.getNumPartitions() == 2 and some.count() == 70
    assert rows.where("it = 9").count() == 0 and rows.where("it in (0, 3)").agg(F.sum("wind_u_ms")).first()[0] == pytest.approx(float(b[[0, 3]].astype(float).sum()))
    with pytest.raises(Exception, match="are not grids of one shape"):
        gridfile.read_grid(spark, str(folder / "plain.npz"), ["hours"])[0].count()
    assert (gridfile.read_step(str(folder / "packed.npz"), "hs_m", 3) == a[3]).all()


def test_grid_source_with_long_steps(spark, tmp_path, monkeypatch):
    big = np.arange(2 * 400 * 600, dtype=np.float64).reshape(2, 400, 600)
    np.savez(tmp_path / "g.npz", x=big)
    rows, _ = gridfile.read_grid(spark, str(tmp_path / "g.npz"))
    assert rows.where("x <> it * 240000 + iy * 600 + ix").count() == 0 and rows.count() == big.size


def test_versions(spark, tmp_path):
    folder = "file://" + str(tmp_path / "v")
    with pytest.raises(FileNotFoundError):
        gridfile.newest(spark, folder)
    for i in range(4):
        gridfile.publish(spark.range(3).withColumn("v", F.lit(i)), folder, by=["v"] if i % 2 else [])
    assert gridfile.newest(spark, folder).select("v").distinct().first().v == 3
    (tmp_path / "v" / "version=00000009").mkdir()  # a job that has not committed
    assert gridfile.newest(spark, folder).first().v == 3 and len(list((tmp_path / "v").glob("version=0000000[1-4]"))) == 2
    assert gridfile.publish(spark.range(1).withColumn("v", F.lit(7)), folder).endswith("version=00000010")
    assert gridfile.newest(spark, folder).first().v == 7


def batches(seed, n=6):
    rng = random.Random(seed)
    key = lambda: (float(rng.randrange(30)), rng.choice([1, 2, None]))
    return [[(*key(), f"b{b}r{i}", i) for i in range(rng.randrange(0, 25))] for b in range(n)]


def latest(many):
    out = {}
    for rows in many:
        for r in rows:
            out[r[:2]] = r
    return sorted(out.values(), key=repr)


def test_keyed_table(spark, tmp_path):
    table = KeyedTable(spark, "file://" + str(tmp_path / "t"), ROW, buckets=5, order=F.col("n"))
    given = batches(1)
    assert table.read().count() == 0
    for b, rows in enumerate(given):
        assert table.merge(spark.createDataFrame(rows, ROW), b)
        assert sorted(map(tuple, table.read().collect()), key=repr) == latest(given[: b + 1])
    before = table.state()
    assert not table.merge(spark.createDataFrame(given[2], ROW), 2) and table.state() == before
    one = [(given[0][0][0], given[0][0][1], "last", 0)] if given[0] else [(1.0, 1, "last", 0)]
    table.merge(spark.createDataFrame(one, ROW), 6)
    assert len({b for b, n in table.state().items() if n == 6}) == 1  # the other buckets stand where they stood
    whole = sorted(map(tuple, table.read().collect()), key=repr)
    assert table.vacuum(keep=1) > 0 and sorted(map(tuple, table.read().collect()), key=repr) == whole and table.commits() == [6]


def test_keyed_table_after_a_lost_commit(spark, tmp_path, monkeypatch):
    """A batch whose buckets were written but not committed runs again and leaves nothing twice."""
    table = KeyedTable(spark, "file://" + str(tmp_path / "t"), ROW, buckets=3, order=F.col("n"))
    given = batches(2, 3)
    table.merge(spark.createDataFrame(given[0], ROW), 0)
    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            table.merge(spark.createDataFrame(given[1], ROW), 1)
    assert sorted(map(tuple, table.read().collect()), key=repr) == latest(given[:1])
    for b in (1, 2):
        table.merge(spark.createDataFrame(given[b], ROW), b)
    assert sorted(map(tuple, table.read().collect()), key=repr) == latest(given)


def test_keyed_table_follows_a_stream(spark, tmp_path):
    given = [b for b in batches(3) if b]
    table = KeyedTable(spark, "file://" + str(tmp_path / "t"), ROW, buckets=4, order=F.col("n"))
    for b, rows in enumerate(given):
        spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(ROW).parquet(str(tmp_path / "in"))
        table.follow(stream, str(tmp_path / "ck"), vacuum_every=2).awaitTermination()
        assert sorted(map(tuple, table.read().collect()), key=repr) == latest(given[: b + 1])


def test_stream_with_a_changing_table(spark, tmp_path):
    folder, out = "file://" + str(tmp_path / "dim"), []
    join = lambda rows, dim: rows.join(dim, "k", "left").select("k", "name")
    for i in range(3):
        gridfile.publish(spark.createDataFrame([(k, f"v{i}k{k}") for k in range(2 + i)], "k int, name string"), folder)
        if i == 2:
            (tmp_path / "dim" / "version=00000099").mkdir()
        spark.createDataFrame([(k,) for k in range(4)], "k int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("k int").parquet(str(tmp_path / "in"))
        follow_with(stream, folder, join, lambda df, n: out.append(sorted(map(tuple, df.collect()))), str(tmp_path / "ck")).awaitTermination()
    assert out == [[(k, f"v{i}k{k}" if k < 2 + i else None) for k in range(4)] for i in range(3)]
