"""Hand cases and properties of single operators."""

import datetime as dt
import gzip
import random
import re
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import datasource
from pyspark.sql import functions as F

from parcelflow import fixtures
from parcelflow.functions.geo import assign_cell, mean_longitude, output_grid
from parcelflow.operators import targets
from parcelflow.operators.schedule import gate, missing_inputs, release_schedule, step_schedule
from parcelflow.operators.targets import _descend, nearest_mask, nearest_mask_curvilinear
from parcelflow.operators.trajectory import segments, trajectories
from parcelflow.operators.uptake import linear_discount, linear_discount_fold
from parcelflow.params import HEAT, MOISTURE, Grid, Heat, Job, heat_method
from parcelflow.plans.attribute import grid_integrated, grid_sum, run_stats, runs_of, to_flux, track, track_all
from parcelflow.plans.job import whole_job, write_job
from parcelflow.sources.sink import manifest, read_results, write_results
from parcelflow.sources.snapshots import HEADER, RECORD, SnapshotReader, ingest_snapshots, load_mask_axes, read_observations, snapshot_catalogue, write_observations, write_snapshots
from parcelflow.sources.store import buckets_of, stored_trajectories, write_store

T0 = dt.datetime(2015, 7, 5)


@pytest.mark.parametrize("a, b, want", [(179.0, -179.0, -180.0), (-179.0, 179.0, -180.0), (10.0, 20.0, 15.0), (350.0, 10.0, 0.0), (-80.0, 80.0, 0.0), (None, 5.0, 5.0), (5.0, None, 5.0), (None, None, None), (100.0, -100.0, -180.0)])
def test_mean_longitude(spark, a, b, want):
    got = spark.range(1).select(mean_longitude(F.lit(a).cast("double"), F.lit(b).cast("double"))).first()[0]
    assert got == want


def test_cells_are_open_on_all_sides(spark):
    g = Grid(0.1, 3600, 1800)
    points = [(-179.95, -89.95), (-180.0, 0.05), (0.3, 0.05), (0.35, 0.1), (179.95, 89.95), (180.0, 1.05), (None, 1.0), (0.1 + 0.2, 0.05)]
    rows = assign_cell(spark.createDataFrame(points, "lon double, lat double"), g).collect()
    found = [(r.ix, r.iy) if r.ix is not None and r.iy is not None else None for r in rows]
    edge = -180.0 + 1803 * 0.1
    assert found[0] == (0, 0) and found[1] is None and found[4] == (3599, 1799) and found[5] is None and found[6] is None
    assert (found[2] is None) == (0.3 == edge) and found[3] is None or found[3][0] == 1803


def test_grid_covers_the_sphere(spark):
    area = output_grid(spark, Grid()).agg(F.sum("area")).first()[0]
    assert abs(area / (4 * np.pi * 6371000.0**2) - 1) < 1e-9


def fold(changes):
    kept = []
    for v in changes:
        v = v or 0.0
        if v > 0:
            kept.append(v)
        else:
            total = sum(kept)
            scale = max(0.0, 1 + v / total) if total > 0 else 0.0
            kept = [x * scale for x in kept] + [0.0]
    return kept


def test_linear_discount_equals_the_fold(spark):
    rng = random.Random(1)
    cases = [[rng.choice([None, 0.0, rng.gauss(0.2, 1), 1.0, -1.0]) for _ in range(40)] for _ in range(60)] + [[1.0, -2.0, 3.0, -1.0], [1.0] * 40, [None] * 3]
    rows = [(T0, p, i, v) for p, c in enumerate(cases) for i, v in enumerate(c)]
    df = spark.createDataFrame(rows, "release_ts timestamp, parcel_id int, segment int, value double")
    got = {(r.parcel_id, r.segment): r.kept for r in linear_discount(df).collect()}
    arrays = df.groupBy("parcel_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("segment", F.coalesce("value", F.lit(0.0)).alias("v")))), lambda s: s["v"]).alias("c"))
    twin = {r.parcel_id: r.k for r in arrays.select("parcel_id", linear_discount_fold(F.col("c")).alias("k")).collect()}
    for p, c in enumerate(cases):
        want = fold(c)
        assert np.allclose([got[p, i] for i in range(len(c))], want, atol=1e-12) and np.allclose(twin[p], want, atol=1e-12)
        assert all(0 <= got[p, i] <= max(v or 0, 0) + 1e-12 for i, v in enumerate(c))


def test_repeated_observations_count_once(spark):
    """A snapshot landed twice changes nothing; of two that differ, the one with more values counts, then the larger."""
    job = Job(tracking_time=1440)
    schema = "parcel_id int, obs_ts timestamp, lon double, lat double, q double, z double, hmix double, rho double, t_k double"
    obs = [(p, T0 - dt.timedelta(hours=6 * k), 10.0 + p, 10.0, 0.01 + 0.001 * k, 100.0, 500.0, 1.0, 280.0) for p in (1, 2) for k in range(6)]
    worse = [(*obs[1][:2], None, *obs[1][3:]), (*obs[2][:2], obs[2][2] - 1, *obs[2][3:])]
    targets = spark.createDataFrame([(T0, 1), (T0, 2)], "release_ts timestamp, parcel_id int")
    once = trajectories(spark.createDataFrame(obs, schema), targets, job)
    again = trajectories(spark.createDataFrame(obs[:4] + worse + obs, schema), targets, job)
    assert once.columns == again.columns and once.count() == again.count() == 12 and sorted(once.collect(), key=repr) == sorted(again.collect(), key=repr)


def test_a_gap_is_not_jumped_over(spark):
    job = Job(tracking_time=1440)
    obs = [(1, T0 - dt.timedelta(hours=6 * k), 10.0, 10.0, 0.01 + 0.001 * k, 100.0, 500.0, 1.0, 280.0) for k in range(6) if k != 3]
    df = spark.createDataFrame(obs, "parcel_id int, obs_ts timestamp, lon double, lat double, q double, z double, hmix double, rho double, t_k double")
    traj = trajectories(df, spark.createDataFrame([(T0, 1)], "release_ts timestamp, parcel_id int"), job)
    assert traj.count() == 6
    for kind, missing in (("heat", {0, 1}), ("moisture", {1, 2})):
        segs = segments(traj.withColumns({"heat_var": F.col("t_k"), "rh": F.col("t_k")}), job, kind).orderBy("segment").collect()
        assert [s.segment for s in segs] == [0, 1, 2, 3] and {s.segment for s in segs if s.dq is None} == missing


def test_schedules(spark):
    r = release_schedule(spark, [2016], [2], [27], [0, 12], n_days=3, calendar="365d")
    assert sorted(x[0].day for x in r.collect()) == [1, 1, 27, 27, 28, 28]
    with pytest.raises(Exception):
        release_schedule(spark, 2015, 2, 30, 0).collect()
    one = spark.createDataFrame([(dt.datetime(2016, 3, 2),)], "release_ts timestamp")
    steps = step_schedule(one, Job(calendar="365d")).orderBy("step").collect()
    assert len(steps) == 42 and [s.step for s in steps] == list(range(42)) and not any(s.obs_ts.month == 2 and s.obs_ts.day == 29 for s in steps)
    forward = step_schedule(one, Job(tracking_time=1440), "forward").orderBy("step").collect()
    assert len(forward) == 6 and forward[-1].obs_ts == dt.datetime(2016, 3, 3, 6)
    have = spark.createDataFrame([(s.obs_ts,) for s in forward[1:]], "obs_ts timestamp")
    assert [m.step for m in missing_inputs(step_schedule(one, Job(tracking_time=1440), "forward"), have).collect()] == [0]


def test_nearest_mask_has_no_largest_distance_and_breaks_ties_low(spark):
    mask = spark.createDataFrame([(la, lo, int(la * 10 + lo)) for la in (0.0, 1.0, 3.0) for lo in (0.0, 2.0)], "lat double, lon double, value int")
    points = spark.createDataFrame([(1, 2.0, 1.0), (2, 90.0, -170.0), (3, 0.4, 1.2), (4, None, 1.0)], "id int, lat double, lon double")
    got = {r.id: (r.mask_lat, r.mask_lon) for r in nearest_mask(points, mask).collect()}
    assert got == {1: (1.0, 0.0), 2: (3.0, 0.0), 3: (0.0, 2.0), 4: (None, 0.0)}


def test_parameters_are_checked():
    for bad in (lambda: Job(time_step=7), lambda: Heat("sde", 1.0, 1), lambda: Heat("dse", 1.0, 3), lambda: heat_method("nobody", Job()), lambda: heat_method("SCH20", Job(time_step=180))):
        with pytest.raises((ValueError, TypeError)):
            bad()
    assert heat_method("sch19", Job()) == HEAT["SCH19"]


def dense_run(spark, method, n=30):
    from parcelflow import fixtures  # noqa: F401

    rows = [(T0, c, k, T0 - dt.timedelta(hours=6 * k), (c * 137 + (41 - k) * 3) % 3600 / 10 - 180 + 0.03, (c * 61 % 1400 + (41 - k) * 2) / 10 - 70 + 0.03, (20 + (c * 31 + k * k * 17 + k * (c % 13) * 7) % 160) / 10000, float((c * 13 + k * 211) % 4000), float((c * 17 + k * 307) % 3000), (70 + (c + k * 7) % 50) / 100, float(255 + (c * 3 + k * 11) % 45)) for c in range(n) for k in range(42)]
    df = spark.createDataFrame(rows, "release_ts timestamp, parcel_id int, step int, obs_ts timestamp, lon double, lat double, q double, z double, hmix double, rho double, t_k double")
    return track(df, method, Job(), Grid())


def test_days_add_up_and_nothing_is_lost(spark):
    run = dense_run(spark, MOISTURE["SJ05"])
    daily = to_flux(grid_sum(run), run)
    assert np.isclose(daily.agg(F.sum("flux")).first()[0], grid_integrated(daily).agg(F.sum("flux")).first()[0])
    flagged = run.segments.where("flag = 1")
    total = flagged.agg(F.sum("kept")).first()[0]
    placed = grid_sum(run).agg(F.sum("total")).first()[0]
    dropped = flagged.where("ix is null or iy is null").agg(F.sum("kept")).first()[0] or 0.0
    assert np.isclose(placed + dropped, total)


def test_no_parcels_no_division(spark):
    run = dense_run(spark, Heat("dse", gain=1.0, pbl_mode=1, arrival_pbl=(1e9, 0.0)), n=3)
    row = run_stats(run).first()
    assert (row.n_target, row.n_filtered, row.n_no_uptake, row.pct_no_uptake) == (3, 0, 0, None)


def test_plan_has_no_cross_join_and_no_python(spark):
    plan = grid_sum(dense_run(spark, MOISTURE["SOD08"], 3))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Arrow"))


def test_snapshots_and_results(spark, tmp_path):
    rows = np.zeros(6, RECORD)
    rows["parcel_id"], rows["lon"], rows["lat"], rows["q"] = np.arange(6), np.arange(6) * 10.0, 5.0, [0.01, -999.9, 0.02, 0.03, 0.04, 0.05]
    end = np.zeros(1, RECORD).tobytes()
    (tmp_path / "in").mkdir()
    (tmp_path / "in/partposit_20150705000000").write_bytes(bytes(HEADER) + rows.tobytes() + end)
    (tmp_path / "in/partposit_20150705060000.gz").write_bytes(gzip.compress(bytes(HEADER) + rows.tobytes() + end))
    obs = ingest_snapshots(spark, str(tmp_path / "in"))
    assert obs.count() == 12 and obs.where("q is null").count() == 2 and {r[0].hour for r in obs.select("obs_ts").collect()} == {0, 6}
    assert ingest_snapshots(spark, str(tmp_path / "in"), box=(1.0, 20.0, 0.0, 10.0)).count() == 6
    assert ingest_snapshots(spark, str(tmp_path / "in"), compat=True).count() == 10
    (tmp_path / "wrf").mkdir()
    (tmp_path / "wrf/partposit_20150705000000").write_bytes(np.array([0, 0, 4], "<i4").tobytes() + rows.tobytes())
    assert ingest_snapshots(spark, str(tmp_path / "wrf"), layout="wrf").count() == 4
    write_observations(obs, str(tmp_path / "obs"))
    assert read_observations(spark, str(tmp_path / "obs"), obs.select("obs_ts")).count() == 12
    run = dense_run(spark, MOISTURE["APA22"], 5)
    for _ in range(2):  # written again, a release replaces itself
        where = write_results(run, str(tmp_path / "out"))
    out = spark.read.parquet(f"{where}/daily")
    assert out.count() == grid_sum(run).count() and spark.read.parquet(f"{where}/stats").count() == 1


def test_releases_of_one_day_and_both_methods_stay(spark, tmp_path):
    run = dense_run(spark, MOISTURE["APA22"], 5)
    later = lambda df: df.withColumn("release_ts", F.expr("release_ts + interval 6 hours"))
    write_results(run, str(tmp_path))
    where = write_results(replace(run, targets=later(run.targets), arrived=later(run.arrived), segments=later(run.segments)), str(tmp_path))
    heat = write_results(dense_run(spark, HEAT["SCH20"], 5), str(tmp_path))
    for table in ("daily", "integrated", "stats", "segments"):
        rows = spark.read.parquet(f"{where}/{table}").groupBy("release_ts").count().collect()
        assert {r.release_ts.hour for r in rows} == {0, 6} and len({r["count"] for r in rows}) == 1
    assert heat != where and spark.read.parquet(f"{heat}/stats").count() == 1


def test_curvilinear_mask_far_and_missing(spark):
    """Brute force on points near, far and without coordinates, and on cells that tie."""
    rng = random.Random(5)
    cells = [(i, rng.uniform(-20, 20), rng.uniform(-20, 20), i % 3) for i in range(40)] + [(90, 0.0, 1.0, 1), (91, 0.0, 1.0, 2), (92, None, 1.0, 1)]
    points = [(i, rng.uniform(-180, 180), rng.uniform(-90, 90)) for i in range(60)] + [(100, 1.0, 0.0), (101, None, 0.0), (102, 3.0, None)]
    mask = spark.createDataFrame(cells, "cell_id int, lat double, lon double, value int")
    got = {r.id: (r.mask_cell, r.mask_value) for r in nearest_mask_curvilinear(spark.createDataFrame(points, "id int, lon double, lat double"), mask, ["id"]).collect()}
    for i, lon, lat in points:
        near = min(((lon - x) ** 2 + (lat - y) ** 2, c, v) for c, y, x, v in cells if y is not None)[1:] if lon is not None and lat is not None else (None, None)
        assert got[i] == near
    assert nearest_mask_curvilinear(spark.createDataFrame(points, "id int, lon double, lat double"), mask.where("false"), ["id"]).where("mask_cell is not null").count() == 0


# sources, sinks and jobs


def _snapshots(tmp_path, spark, n=40, layout="global", compress=False):
    times = [T0 + dt.timedelta(hours=6 * k) for k in range(6)]
    obs = spark.createDataFrame([(t, p, float(p - 20), float(p % 9 * 10 - 40), None if p == 3 else 0.01) for t in times for p in range(n)], "obs_ts timestamp, parcel_id int, lon double, lat double, q double")
    assert write_snapshots(obs, str(tmp_path / "in"), layout, compress) == 6
    return str(tmp_path / "in"), obs


@pytest.mark.parametrize("layout, compress", [("global", False), ("global", True), ("wrf", False), ("wrf", True)])
def test_snapshots_come_back_from_ranges(spark, tmp_path, layout, compress):
    path, obs = _snapshots(tmp_path, spark, layout=layout, compress=compress)
    back = ingest_snapshots(spark, path, layout, split=7)
    same = lambda df: sorted(map(tuple, df.select("obs_ts", "parcel_id", "lon", "lat", F.round("q", 6)).collect()))
    assert [(*r[:4], r[4] is None) for r in same(back)] == [(*r[:4], r[4] is None) for r in same(obs)]
    assert ingest_snapshots(spark, path, layout, compat=True, split=7).groupBy("obs_ts").agg(F.max("parcel_id").alias("m")).where("m = 38").count() == 6
    reader = SnapshotReader({"path": path, "layout": layout, "split": "7", "tasks": "100"}, ["parcel_id"])
    ranges = [r for p in reader.partitions() for r in p.ranges]
    assert len(ranges) == (6 if compress else 36) and all(r.count <= 7 for r in ranges)


def test_filters_go_into_the_snapshot_source(spark, tmp_path):
    path, obs = _snapshots(tmp_path, spark)
    # Files of other times are never opened: these can't be read as snapshots of any layout.
    for k in (0, 5):
        (tmp_path / f"in/partposit_{T0 + dt.timedelta(hours=6 * k):%Y%m%d%H%M%S}").chmod(0)
    wanted = "obs_ts > timestamp'2015-07-05 00:00:00' and obs_ts < timestamp'2015-07-06 06:00:00' and parcel_id in (3, 5, 30) and lon <= 9"
    got = ingest_snapshots(spark, path, box=(-18.0, 50.0, -90.0, 90.0)).where(wanted)
    plan = got._sc._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "formatted")
    assert "PushedFilters" in plan and "In(parcel_id" in plan and "GreaterThan(obs_ts" in plan and "Filter (" not in plan
    assert {(r.parcel_id, r.lon) for r in got.collect()} == {(3, -17.0), (5, -15.0)} and got.count() == 8
    reader = SnapshotReader({"path": path, "tasks": "100"}, ["parcel_id"])
    left = list(reader.pushFilters([datasource.GreaterThan(("obs_ts",), T0), datasource.StringContains(("path",), "x"), datasource.EqualTo(("parcel_id",), 7)]))
    assert [type(f).__name__ for f in left] == ["StringContains"]
    assert len({r.path for p in reader.partitions() for r in p.ranges}) == 5


def test_catalogue_and_gate(spark, tmp_path):
    path, _ = _snapshots(tmp_path, spark, n=7)
    (tmp_path / "in/partposit_20150705120000").unlink()
    (tmp_path / "in/readme.txt").write_text("no snapshot")
    files = snapshot_catalogue(spark, path)
    assert files.count() == 5 and {r.records for r in files.collect()} == {7}
    job = Job(tracking_time=360)  # three inputs a release
    releases = spark.createDataFrame([(T0 + dt.timedelta(hours=6 * k),) for k in (2, 3, 5)] + [(None,)], "release_ts timestamp").where("release_ts is not null")
    ran, missing = gate(releases, step_schedule(releases, job), files)
    # Files of 0, 6, 18, 24 and 30 hours: only the last release has all of its three.
    assert [r.release_ts for r in ran.collect()] == [T0 + dt.timedelta(hours=30)]
    assert sorted((r.release_ts.hour, r.step, r.obs_ts.hour) for r in missing.collect()) == [(12, 0, 12), (18, 1, 12)]


def test_empty_rerun_empties_and_failed_run_changes_nothing(spark, tmp_path):
    run = dense_run(spark, MOISTURE["APA22"], 40)
    where = write_results(run, str(tmp_path))
    full = {t: read_results(spark, where, t).count() for t in ("daily", "integrated", "segments", "stats", "times", "grid", "runs")}
    assert full["daily"] and full["segments"] and full["stats"] == full["runs"] == 1 and full["times"] == 42 + 40 + 10
    broken = replace(run, segments=run.segments.withColumn("kept", F.raise_error(F.lit("lost")).cast("double")))
    with pytest.raises(Exception, match="lost"):
        write_results(broken, str(tmp_path))
    assert {t: read_results(spark, where, t).count() for t in full} == full
    none = dense_run(spark, replace(MOISTURE["APA22"], rain=-1.0), 40)
    write_results(none, str(tmp_path))
    assert [read_results(spark, where, t).count() for t in ("daily", "integrated", "segments", "stats", "runs")] == [0, 0, 0, 1, 1]
    stats = read_results(spark, where, "stats").first()
    assert (stats.n_target, stats.n_filtered, stats.n_no_uptake) == (40, 0, 0)
    assert '"rain": -1.0' in read_results(spark, where, "runs").first().parameters
    # A release without any target is empty too, and another release stays as it is.
    later = spark.createDataFrame([(T0 + dt.timedelta(days=1),)], "release_ts timestamp")
    write_results(replace(run, targets=run.targets.where("false"), segments=run.segments.where("false")), str(tmp_path), releases=later)
    assert sorted((r.release_ts.day, r.n_target) for r in read_results(spark, where, "stats").collect()) == [(5, 40), (6, 0)]
    assert manifest(spark, where).count() == 2 and manifest(spark, where, 1).first().version == 1


def test_curvilinear_mask_meets_few_cells(spark):
    points = spark.range(3000).selectExpr("id", "rand(1) * 360 - 180 as lon", "rand(2) * 180 - 90 as lat")
    dense = "cast(20 + (id % 360) * 0.05 + if(id > 60000, (id % 7) * 1e-7, 0) as decimal(18, 9)) as lon"
    mask = spark.range(64_800).selectExpr("id as cell_id", "cast(10 + (id div 360) * 0.05 as decimal(12, 4)) as lat", dense, "cast(id % 3 as int) as value")
    cells = mask.selectExpr("cast(lon as double) as lon", "cast(lat as double) as lat", "struct(cell_id, value) as cell")
    met = _descend(points, cells, ["id"], 64_800, 20.0, 10.0, 18.0).groupBy("id").count()
    assert met.count() == 3000 and met.agg(F.max("count")).first()[0] < 300
    got = {r.id: r.mask_cell for r in nearest_mask_curvilinear(points, mask, ["id"]).collect()}
    xy = np.array([(float(r.lon), float(r.lat)) for r in mask.orderBy("cell_id").collect()])
    for r in points.collect()[::10]:
        d = (xy[:, 0] - r.lon) ** 2 + (xy[:, 1] - r.lat) ** 2
        assert abs(d[got[r.id]] - d.min()) <= 1e-12 * d.min() + 1e-15


def test_crowded_axes_and_masks_of_axes(spark):
    lines = [(y, x, int(i)) for i, (y, x) in enumerate((y, x) for y in (-80.0, 80.0, 80.0001) for x in (0.0, 90.0))]
    points = [(1, 1.0, 79.9), (2, 50.0, 80.00005), (3, 45.0, 80.00006), (4, None, 3.0), (5, float("nan"), 3.0), (6, 500.0, -500.0), (7, 45.0, 0.0)]
    mask = spark.createDataFrame(lines + [(None, 1.0, 9)], "lat double, lon double, value int")
    df = spark.createDataFrame(points, "id int, lon double, lat double")
    want = {1: (80.0, 0.0), 2: (80.0, 90.0), 3: (80.0001, 0.0), 4: (None, None), 5: (None, None), 6: (-80.0, 90.0), 7: (-80.0, 0.0)}
    for lines_at_most in (50_000, 1):
        targets.AXIS_LINES = lines_at_most
        try:
            got = {r.id: (r.mask_lat, r.mask_lon, r.mask_value) for r in nearest_mask(df, mask).collect()}
        finally:
            targets.AXIS_LINES = 50_000
        for i, (lat, lon) in want.items():
            if lon is None:
                assert got[i][1] is None and got[i][2] is None
            else:
                assert got[i][:2] == (lat, lon), (i, got[i])
    assert nearest_mask(df, mask.where("false")).where("mask_value is not null").count() == 0
    axes = spark.createDataFrame([([10.0, 12.0], [0.0, 190.0], [[1, 0], [0, None]]), (None, None, None)], "lat array<double>, lon array<double>, value array<array<int>>")
    assert sorted(map(tuple, load_mask_axes(axes).collect()), key=repr) == sorted([(10.0, 0.0, 1), (10.0, -170.0, 0), (12.0, 0.0, 0), (12.0, -170.0, None)], key=repr)


def _gappy_obs(spark, n=30):
    rng = random.Random(4)
    return [(p, T0 - dt.timedelta(hours=6 * k), rng.uniform(-180, 180), rng.uniform(-60, 60), rng.uniform(0.002, 0.02), rng.uniform(0, 3000), rng.uniform(100, 3000), rng.uniform(0.7, 1.2), rng.uniform(255, 300)) for p in range(n) for k in range(48) if rng.random() < 0.8]


OBS = "parcel_id int, obs_ts timestamp, lon double, lat double, q double, z double, hmix double, rho double, t_k double"


@pytest.mark.parametrize("grid", [Grid(2.0, 180, 90), Grid(2.0, 200, 90, 0.0)])
@pytest.mark.parametrize("compat", [False, True])
def test_one_pass_gives_what_each_method_gives(spark, grid, compat):
    obs = spark.createDataFrame(_gappy_obs(spark), OBS)
    starts = spark.createDataFrame([(T0,), (T0 - dt.timedelta(hours=6),)], "release_ts timestamp")
    traj = trajectories(obs, obs.select("parcel_id").distinct().crossJoin(starts).select("release_ts", "parcel_id"), Job()).cache()
    methods = {"a": HEAT["SCH20"], "b": HEAT["JK22"], "c": MOISTURE["APA22"], "d": MOISTURE["SJ05"], "e": replace(MOISTURE["SOD08"], rain=0.001, min_rh=0.0)}
    job = Job(compat=compat)
    together = track_all(traj, methods, job, grid)
    columns = ["release_ts", "parcel_id", "segment", "mid_ts", "day", "iy", "ix", "flag", F.round("value", 9), F.round("kept", 9)]
    runs = runs_of(together, traj, methods, job, grid)
    for name, method in methods.items():
        alone = track(traj, method, job, grid)
        assert sorted(map(tuple, runs[name].segments.select(*columns).collect()), key=repr) == sorted(map(tuple, alone.segments.select(*columns).collect()), key=repr)
        assert runs[name].targets.count() == 60
    plan = together._jdf.queryExecution().executedPlan().toString()
    above = plan.split("InMemoryTableScan")[0]
    assert above.count("Sort [") == 2 and above.count("Exchange") == 1 and "Python" not in plan


def test_a_job_reads_its_observations_twice_at_most(spark, tmp_path):
    path = str(tmp_path / "obs")
    write_observations(spark.createDataFrame(_gappy_obs(spark), OBS), path)
    write_observations(spark.createDataFrame(_gappy_obs(spark), OBS), path)  # a day that is written again replaces itself
    obs = read_observations(spark, path)
    assert obs.count() == len(_gappy_obs(spark))
    releases = spark.createDataFrame([(T0,), (None,)], "release_ts timestamp")
    done = whole_job(obs, spark.createDataFrame([(0.0, 0.0, 1)], "lat double, lon double, value int"), releases, {"heat": HEAT["SCH20"], "moisture": MOISTURE["APA22"]}, Job())
    plan = done.segments._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= 3  # the targets in the spine, the observations
    where = write_job(done, str(tmp_path / "out"))
    assert read_results(spark, where["heat"], "stats").first().n_target == done.targets.count() > 10
    assert read_results(spark, where["moisture"], "segments").count() == done.segments.where("method = 'moisture'").count() > 0


def test_a_store_is_joined_without_shuffling_it(spark, tmp_path):
    obs = spark.createDataFrame(_gappy_obs(spark, 1200)[:], OBS)
    table = f"store_{tmp_path.name.replace('-', '_')}"
    write_store(obs, table, str(tmp_path / "store"), 4)
    targets_ = obs.where(F.col("obs_ts") == F.lit(T0)).select(F.col("obs_ts").alias("release_ts"), F.col("parcel_id").cast("bigint").alias("parcel_id"))
    traj = stored_trajectories(spark, table, targets_.where("parcel_id < 1100"), Job())
    few = stored_trajectories(spark, table, targets_.where("parcel_id < 50"), Job())
    want = trajectories(obs, targets_.where("parcel_id < 1100"), Job())
    same = lambda df: sorted(map(tuple, df.select("release_ts", F.col("parcel_id").cast("int"), "step", "obs_ts", "lon", "q", "t_k").collect()), key=repr)
    assert same(traj) == same(want)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = track(stored_trajectories(spark, table, targets_, Job()), MOISTURE["SJ05"], Job()).segments._jdf.queryExecution().executedPlan().toString()
        scans = plan.split("FileScan parquet")
        named = few._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "Bucketed: true" in plan and re.search(r"PartitionFilters: \[[^\]]*obs_date#\d+ INSET", plan)
    # From a scan of the store up to the root of its branch the plan's lines hold no exchange: only the spine is dealt.
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert exchanges and all("REPARTITION_BY_NUM" in line for line in exchanges), exchanges
    assert len(scans) >= 2 and re.search(r"DataFilters: \[[^\]]*parcel_id#\d+ INSET", named)
    write_store(obs.where("q > 1"), table, str(tmp_path / "store"))  # nothing: no day is replaced
    assert spark.table(table).count() == obs.count()
    day = obs.where(F.to_date("obs_ts") == F.lit(T0.date()))
    write_store(day.limit(5), table, str(tmp_path / "store"))  # replaces its day, and no other
    assert spark.table(table).count() == obs.count() - day.count() + 5


def test_trajectories_take_any_column_name(spark):
    rows = [(*r, 1.0, "x", 7) for r in _gappy_obs(spark, 3)]
    obs = spark.createDataFrame(rows + rows[:5], OBS + ", step double, _there string, `a.b` int")
    traj = trajectories(obs, obs.select(F.lit(T0).alias("release_ts"), "parcel_id").distinct(), Job())
    assert traj.count() == 3 * 42 and {"_there", "a.b"} <= set(traj.columns)
    assert traj.where("lon is not null").count() == obs.where(F.col("obs_ts") >= F.lit(T0 - dt.timedelta(hours=6 * 41))).select("parcel_id", "obs_ts").distinct().count()


def test_trajectories_broadcast_no_spine(spark):
    """The rows that explode makes of few targets are in no estimate: neither the spine nor its observations may be broadcast."""
    targets_ = spark.range(50).select(F.col("id").alias("parcel_id"), F.lit(T0).alias("release_ts"))
    obs = targets_.select("parcel_id", F.col("release_ts").alias("obs_ts"), F.lit(1.0).alias("q"))
    plan = trajectories(obs, targets_, Job())._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("most", ["-1", "20000", "10000000"])
def test_a_file_is_written_by_one_task(spark, tmp_path, most):
    """Whether or not the counts are broadcast on the way, also after observations that were shuffled before."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    obs = spark.range(20000).selectExpr("id as parcel_id", "id % 3 as b").groupBy("parcel_id", "b").agg(F.lit(1.5).alias("q")).selectExpr("parcel_id", "q", "timestamp_seconds(b * 21600) as obs_ts")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    try:
        assert write_snapshots(obs, str(tmp_path / "in"), compress=True) == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    back = ingest_snapshots(spark, str(tmp_path / "in"))
    assert back.select("parcel_id").distinct().count() == back.count() == 20000
    assert all(f.read_bytes()[8] != 2 for f in (tmp_path / "in").glob("*.gz"))  # not at the slowest level


def test_dense_trajectories_are_dealt_out_before_they_are_rows(spark, sf):
    plan = track(fixtures.dense(spark, sf, 4), MOISTURE["SOD08"], Job()).segments._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"Exchange (\w+)\((\w+)", plan) == [("hashpartitioning", "c")]


def test_buckets_of_a_store_grow_with_its_rows(spark, tmp_path, monkeypatch):
    obs = spark.createDataFrame(_gappy_obs(spark, 60), OBS)
    monkeypatch.setattr("parcelflow.sources.store.BUCKET_ROWS", 100)
    write_store(obs, "store_grown", str(tmp_path / "store"))
    assert buckets_of(spark, "store_grown") == -(-obs.count() // 100) > 8
    targets_ = obs.select(F.lit(T0).alias("release_ts"), "parcel_id").distinct()
    rows = lambda df: sorted(map(str, df.select("release_ts", "parcel_id", "step", "q").collect()))
    assert rows(stored_trajectories(spark, "store_grown", targets_, Job())) == rows(trajectories(obs, targets_, Job()))
    spark.sql("drop table store_grown")
