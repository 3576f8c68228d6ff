from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsflow.operators import scanjoin, simjoin

T0 = datetime(2024, 3, 1)
POINT = "point_id long, embedding array<double>, at timestamp"


def clouds(rng, n, dim=6, tight=0.05):
    """Vectors around a few directions, with copies, opposite and zero vectors among them."""
    homes = rng.normal(size=(5, dim))
    rows = [homes[i % 5] + tight * rng.normal(size=dim) for i in range(n)]
    rows[3], rows[4] = rows[2], -rows[2]
    rows[7] = np.zeros(dim)
    return [list(map(float, r)) for r in rows]


def plain(queries, points, k, floor):
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1.0)
    out = set()
    for q, v, lo, hi in queries:
        seen = sorted((-round(float(unit(v) @ unit(w)), 12), p) for p, w, at in points if (lo is None or lo <= at < hi))
        out |= {(q, p, n + 1) for n, (c, p) in enumerate(seen[:k]) if -c >= floor}
    return out


@pytest.mark.parametrize("k,floor", [(1, -1.0), (4, 0.2), (7, 0.9)])
@pytest.mark.parametrize("how", ["scan", "grid"])
def test_scan_and_grid_equal_a_plain_product(spark, monkeypatch, how, k, floor):
    if how == "grid":
        monkeypatch.setattr(scanjoin, "TRAVEL_BYTES", -1)
    else:
        monkeypatch.setattr(scanjoin, "BLOCK_ROWS", 7)
        monkeypatch.setattr(scanjoin, "SLICE_BYTES", 20 * 48)
        monkeypatch.setattr(scanjoin, "TWIG_TASKS", 2)
    rng = np.random.default_rng(11)
    rows = [(n, v, T0 - timedelta(hours=int(rng.integers(0, 100)))) for n, v in enumerate(clouds(rng, 150))]
    points = spark.createDataFrame(rows, POINT).repartition(6)
    asked = [(n, v, T0 - timedelta(hours=int(rng.integers(0, 60)))) for n, v in enumerate(clouds(rng, 50, tight=0.4))]
    queries = spark.createDataFrame(asked, "article_id long, embedding array<double>, as_of timestamp")
    near = simjoin.nearest_points(queries, points, k, floor, "at", "as_of", 24, block_rows=16)
    assert {(r.query_id, r.point_id, r["rank"]) for r in near.collect()} == plain(
        [(q, v, at - timedelta(hours=24), at) for q, v, at in asked], rows, k, floor)
    constant = simjoin.nearest_points(queries, points, k, floor, "at", T0, 48, block_rows=16)
    assert {(r.query_id, r.point_id, r["rank"]) for r in constant.collect()} == plain(
        [(q, v, T0 - timedelta(hours=48), T0 + timedelta(days=1)) for q, v, _ in asked], rows, k, floor)


def test_points_are_not_shuffled(spark, tmp_path):
    rows = [(n, v, T0) for n, v in enumerate(clouds(np.random.default_rng(1), 40))]
    spark.createDataFrame(rows, POINT).write.parquet(f"{tmp_path}/points")
    points = spark.read.parquet(f"{tmp_path}/points")
    queries = points.limit(5).withColumnRenamed("point_id", "article_id")
    near = simjoin.best_recent(queries, points, 0.0, "at", T0, 24)
    plan = near._jdf.queryExecution().executedPlan().toString()
    scan, *above = plan[plan.index("MapInArrow"):].split("Exchange")
    assert "FileScan" in scan and not above and "Join" not in plan


def test_no_queries_no_points(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], T0)], POINT)
    none = rows.limit(0)
    assert simjoin.best_recent(none.withColumnRenamed("point_id", "article_id"), rows, 0.0, "at", T0, 24).count() == 0
    assert simjoin.best_recent(rows.withColumnRenamed("point_id", "article_id"), none, 0.0, "at", T0, 24).count() == 0


@pytest.mark.parametrize("tight", [0.05, 2.0])
def test_stored_cells_equal_a_plain_product_and_stay_unread(spark, tmp_path, monkeypatch, tight):
    rng = np.random.default_rng(2)
    rows = list(enumerate(clouds(rng, 300, tight=tight)))
    points = spark.createDataFrame(rows, "id long, vec array<double>")
    scanjoin.write_cells(points, str(tmp_path), cells=5)
    read: list[set[int]] = []
    scan = scanjoin._scan
    monkeypatch.setattr(scanjoin, "_scan", lambda p, b, k, timed: read.append({r[0] for r in p.select("cell").distinct().collect()}) or scan(p, b, k, timed))
    asked = [(1000 + n, v, None, None) for n, v in rows[10:300:25] if n % 5 == 0] + [(2000, rows[7][1], None, None)] * (tight > 1)
    queries = spark.createDataFrame([a[:2] for a in asked], "id long, vec array<double>")
    got = {(r.query_id, r.point_id, r["rank"]) for r in scanjoin.nearest_stored(spark, str(tmp_path), queries, 3, -1.0).collect()}
    assert got == plain(asked, [(p, v, None) for p, v in rows], 3, -1.0)
    cells = points.sparkSession.read.parquet(f"{tmp_path}/points").select("cell").distinct().count()
    if tight < 1:
        # All queries come from one cloud, so the cells of the others are never read.
        assert len(set().union(*read)) < cells


def test_ball_holds_its_rows():
    rng = np.random.default_rng(3)
    units = rng.normal(size=(60, 9))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    centre, radius = scanjoin.ball(units[:20])
    assert (scanjoin.reach(units, centre, radius) >= (units @ units[:20].T).max(axis=1)).all()
    assert scanjoin.ball(np.vstack([units, -units]))[1] == np.pi


def test_points_meet_queries_in_bounded_chunks():
    """A batch of many points becomes tables of a bounded number of rows, none lost."""
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(2500)), "vec": pa.array([[1.0, float(i)] for i in range(2500)])})
    tables = list(scanjoin._chunks(iter([batch, batch.slice(0, 0)])))
    assert max(t.num_rows for t in tables) <= scanjoin.POINT_ROWS
    assert [i for t in tables for i in t.column("id").to_pylist()] == list(range(2500))
    assert all(len(simjoin.unit_rows(t.column("vec"))) == t.num_rows for t in tables)
    assert scanjoin.unit_rows(tables[1].column("vec"))[0] == pytest.approx([1 / (1 + 1024**2) ** 0.5, 1024 / (1 + 1024**2) ** 0.5])
