"""Registered queries of sources, sinks and whole jobs, and the same in plain SQL."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures
from .operators.schedule import gate, step_schedule
from .operators.targets import nearest_mask
from .params import HEAT, MOISTURE
from .plans.attribute import daily_of, grid_sum, to_flux, track
from .plans.job import whole_job, write_job
from .queries import _BASE, _OBS, _REL, _SOD, GRID, JOB, METHODS, _area, _daily_sql, _flux, _grid_sql, _r, _rel, _round, _run_sql, _stats_sql, _summary_sql
from .sources.files import fresh
from .sources.sink import read_results, times, write_results
from .sources.snapshots import ingest_snapshots, load_mask_axes, snapshot_catalogue, write_snapshots
from .sources.store import stored_trajectories, write_store

TOGETHER = {name: METHODS[name] for name in ("heat_sch20", "heat_jk22", "moisture_apa22", "moisture_sj05")}
RELEASES = (78936, 78937, 78938, 78939)
#: Parcels outside the lattice mask's tropics are the jobs' targets.
OUTSIDE = 0
#: Of the releases of results_rerun, those that are written again with a filter that keeps no parcel.
AGAIN = (78936, 78937)


def _releases(spark: SparkSession) -> DataFrame:
    return spark.range(RELEASES[0], RELEASES[-1] + 1).select(F.timestamp_seconds(F.col("id") * 21600).alias("release_ts"))


def _gappy_files(spark: SparkSession, sf_dir: str) -> str:
    path = fresh(spark, "snapshots")
    write_snapshots(fixtures.gappy(spark, sf_dir), path)
    return path


def whole_job_gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mask, targets, trajectories and four methods on one pass, summed together."""
    done = whole_job(fixtures.gappy(spark, sf_dir).drop("b"), fixtures.lattice_mask(spark), _releases(spark), TOGETHER, JOB, GRID, OUTSIDE)
    return _rel(daily_of(done.segments, TOGETHER, JOB, GRID)).select("method", "rel", "day", "iy", "ix", "n", _round("flux"))


def whole_job_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from binary files, gated by their catalogue, to written results, which are read back."""
    path = _gappy_files(spark, sf_dir)
    done = whole_job(ingest_snapshots(spark, path), fixtures.lattice_mask(spark), _releases(spark), TOGETHER, JOB, GRID, OUTSIDE, available=snapshot_catalogue(spark, path))
    out = None
    for name, where in write_job(done, fresh(spark, "results")).items():
        rows = _rel(read_results(spark, where, "daily")).select(F.lit(name).alias("method"), "rel", "day", "iy", "ix", "n", _round("flux"))
        out = rows if out is None else out.unionByName(rows)
    return out


def releases_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all times as releases, those whose inputs are all among the files, of which those of one time are left out."""
    path = fresh(spark, "snapshots")
    obs = fixtures.gappy(spark, sf_dir)
    write_snapshots(obs.where("b <> 78990"), path, compress=True)
    releases = obs.select(F.col("obs_ts").alias("release_ts")).distinct()
    ran, _ = gate(releases, step_schedule(releases, JOB), snapshot_catalogue(spark, path))
    return _rel(ran).select("rel")


def _results(spark: SparkSession, sf_dir: str) -> str:
    """Results of four releases, two of which are written again by a method whose filter keeps nothing."""
    from .operators.trajectory import trajectories

    obs = fixtures.gappy(spark, sf_dir)
    targets, path = fixtures.gappy_targets(obs), fresh(spark, "results")
    for method, some in ((MOISTURE["APA22"], RELEASES), (replace(MOISTURE["APA22"], rain=-1.0), AGAIN)):
        mine = targets.where(F.expr("unix_timestamp(release_ts) div 21600").isin(list(some)))
        where = write_results(track(trajectories(obs.drop("b"), mine, JOB), method, JOB, GRID), path)
    return where


def results_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of rewritten results, and what is left of their daily fields and segments."""
    where = _results(spark, sf_dir)
    rows = _rel(read_results(spark, where, "stats"))
    for table, name in (("daily", "n_cells"), ("integrated", "n_integrated"), ("segments", "n_segments")):
        rows = rows.join(read_results(spark, where, table).groupBy("release_ts").agg(F.count("*").alias(name)), "release_ts", "left").na.fill(0, [name])
    return rows.select("rel", "n_target", "n_filtered", "n_no_uptake", "pct_filtered", _round("residence_days"), "n_cells", "n_integrated", "n_segments")


def time_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time axes of a heat run over all order dates."""
    releases = fixtures.table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("timestamp").alias("release_ts")).distinct()
    axes = _rel(times(releases, JOB, "heat"))
    return axes.select("rel", "axis", "index", *(F.unix_timestamp(c).alias(c.removesuffix("_ts")) for c in ("start_ts", "mid_ts", "end_ts")))


def snapshot_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parcels at all steps through plain files, with missing humidities."""
    obs = fixtures.dense(spark, sf_dir).withColumn("q", F.when((F.col("parcel_id") + F.col("step")) % 7 != 0, F.col("q")))
    path = fresh(spark, "snapshots")
    write_snapshots(obs, path)
    back = ingest_snapshots(spark, path).withColumn("step", F.expr(f"cast({_REL} - unix_timestamp(obs_ts) div 21600 as int)"))
    return back.select("parcel_id", "step", *(_round(c) for c in ("lon", "lat", "q", "z", "hmix", "rho", "t_k")), F.col("mass").isNull().alias("no_mass"))


def snapshot_pushdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compressed files with the count in their header: one place, two days and some parcels, by filters that go into the source."""
    path = fresh(spark, "snapshots")
    write_snapshots(fixtures.dense(spark, sf_dir), path, layout="wrf", compress=True)
    near = ingest_snapshots(spark, path, layout="wrf", box=(-100.0, 100.0, -40.0, 60.0), columns=["obs_ts", "parcel_id", "z"])
    rows = near.where("obs_ts > timestamp'2015-07-01 00:00:00' and obs_ts <= timestamp'2015-07-03 00:00:00' and parcel_id >= 20 and z < 3000")
    return rows.groupBy("parcel_id").agg(F.count("*").alias("n"), F.sum("z").alias("z"))


def forward_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps after every order date without leap days: how many, the last and the sum of all times."""
    releases = fixtures.table(spark, sf_dir, "orders").where("not (month(o_orderdate) = 2 and day(o_orderdate) = 29)").select(F.col("o_orderdate").cast("timestamp").alias("release_ts")).distinct()
    steps = _rel(step_schedule(releases, replace(JOB, calendar="365d"), "forward"))
    return steps.groupBy("rel").agg(F.count("*").alias("n"), F.expr("max(unix_timestamp(obs_ts)) div 21600").alias("last"), F.expr("sum(unix_timestamp(obs_ts) div 21600)").alias("total"))


def mask_from_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mask cell of every parcel on arrival, from a mask of two axes with longitudes up to 360."""
    lats, lons = "transform(sequence(-44, 44), y -> y * 2e0)", "transform(sequence(0, 179), x -> x * 2e0)"
    mask = spark.range(1).selectExpr(f"{lats} as y", f"{lons} as x", "transform(sequence(-44, 44), y -> transform(sequence(0, 179), x -> (y * 7 + x * 3 + 700) % 5)) as inside")
    here = fixtures.dense(spark, sf_dir).where("step = 0").select("parcel_id", "lat", "lon")
    return nearest_mask(here, load_mask_axes(mask, "y", "x", "inside")).select("parcel_id", "mask_lat", "mask_lon", "mask_value")


def store_sod08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily moisture uptake over a store of observations by parcel."""
    table, dense = f"store_{uuid.uuid4().hex}", fixtures.dense(spark, sf_dir)
    write_store(dense.drop("release_ts", "step"), table, fresh(spark, "store"))
    traj = stored_trajectories(spark, table, dense.where("step = 0").select("release_ts", "parcel_id"), JOB)
    run = track(traj, _SOD, JOB, GRID)
    return _rel(to_flux(grid_sum(run), run)).select("rel", "day", "iy", "ix", "n", _round("flux"))


# ---- the same in SQL ----

_FLOAT = ("lon", "lat", "q", "z", "hmix", "rho", "t_k")
_OVER = "lat > -20 AND lat <= 20 AND lon > -60 AND lon <= 60"  # of the lattice mask's cells, those of value 1 are nearest there


def _masked(kind: str, rounded: bool) -> str:
    """The gappy base with targets over the mask, after rounding to the files' precision if asked for."""
    base = _BASE["gappy"].replace(" o AS (", " o0 AS (")
    columns = ", ".join(f"CAST(CAST({c} AS FLOAT) AS DOUBLE) AS {c}" for c in _FLOAT) if rounded else ", ".join(_FLOAT)
    head, tail = base.split(" d AS (")
    tail = tail.replace("(SELECT DISTINCT parcel_id FROM g), (SELECT unnest([78936, 78937, 78938, 78939]) AS rel)", "t")
    _BASE[kind] = f"{head} o AS (SELECT parcel_id, b, {columns} FROM o0), t AS (SELECT parcel_id, b AS rel FROM o WHERE b BETWEEN {RELEASES[0]} AND {RELEASES[-1]} AND NOT ({_OVER})), d AS ({tail}"
    return kind


def _together_sql(kind: str) -> str:
    one = "SELECT '{}' AS method, * FROM ({})"
    return " UNION ALL ".join(one.format(name, _daily_sql(m, kind)) for name, m in TOGETHER.items())


_APA = MOISTURE["APA22"]
_F32 = ", ".join(f"{_r(f'CAST(CAST({c} AS FLOAT) AS DOUBLE)')} AS {c}" for c in _FLOAT if c != "q")
_AGAIN = f"rel IN {AGAIN}"

QUERIES = {
    "whole_job_gappy": whole_job_gappy, "whole_job_files": whole_job_files, "releases_gated": releases_gated, "results_rerun": results_rerun, "time_axes": time_axes,
    "snapshot_read": snapshot_read, "snapshot_pushdown": snapshot_pushdown, "forward_steps": forward_steps, "mask_from_axes": mask_from_axes, "store_sod08": store_sod08,
}

ORACLE_SQL = {
    "whole_job_gappy": _together_sql(_masked("masked", False)),
    "whole_job_files": _together_sql(_masked("filed", True)),
    "releases_gated": """WITH b AS (SELECT DISTINCT CAST(floor(epoch(ts) / 21600) AS BIGINT) AS b FROM events), s AS (SELECT b AS rel, b - k AS slot FROM b, (SELECT unnest(range(42)) AS k))
SELECT rel FROM s GROUP BY rel HAVING count(*) FILTER (slot IN (SELECT b FROM b WHERE b <> 78990)) = 42""",
    "results_rerun": f"""WITH s AS ({_stats_sql(_APA, 'gappy')}), c AS (SELECT * FROM ({_run_sql(_APA, 'gappy')}, {_grid_sql()} SELECT rel, count(*) AS n_cells, count(DISTINCT iy * 1000 + ix) AS n_integrated FROM day_sum GROUP BY rel)),
g AS (SELECT * FROM ({_run_sql(_APA, 'gappy')} SELECT rel, count(*) AS n_segments FROM res GROUP BY rel))
SELECT s.rel, n_target, CASE WHEN {_AGAIN} THEN 0 ELSE n_filtered END AS n_filtered, CASE WHEN {_AGAIN} THEN 0 ELSE n_no_uptake END AS n_no_uptake, CASE WHEN {_AGAIN} THEN 0 ELSE pct_filtered END AS pct_filtered,
 CASE WHEN NOT {_AGAIN} THEN residence_days END AS residence_days, CASE WHEN {_AGAIN} THEN 0 ELSE coalesce(n_cells, 0) END AS n_cells, CASE WHEN {_AGAIN} THEN 0 ELSE coalesce(n_integrated, 0) END AS n_integrated,
 CASE WHEN {_AGAIN} THEN 0 ELSE coalesce(n_segments, 0) END AS n_segments FROM s LEFT JOIN c USING (rel) LEFT JOIN g USING (rel)""".replace("rel IN", "s.rel IN"),
    "time_axes": """WITH r AS (SELECT DISTINCT CAST(epoch(o_orderdate) AS BIGINT) // 21600 AS rel FROM orders)
SELECT rel, 'input' AS axis, CAST(k AS INT) AS index, (rel - k) * 21600 AS start, (rel - k) * 21600 AS mid, (rel - k) * 21600 AS end FROM r, (SELECT unnest(range(42)) AS k)
UNION ALL SELECT rel, 'segment', CAST(k AS INT), (rel - 40 + k) * 21600, (rel - 40 + k) * 21600 + 10800, (rel - 39 + k) * 21600 FROM r, (SELECT unnest(range(40)) AS k)
UNION ALL SELECT rel, 'day', CAST(k - 10 AS INT), (rel - 40 + 4 * k) * 21600, (rel - 38 + 4 * k) * 21600, (rel - 36 + 4 * k) * 21600 FROM r, (SELECT unnest(range(10)) AS k)""",
    "snapshot_read": f"WITH {_BASE['dense']} SELECT parcel_id, CAST(step AS INT) AS step, {_F32}, CASE WHEN (parcel_id + step) % 7 <> 0 THEN {_r('CAST(CAST(q AS FLOAT) AS DOUBLE)')} END AS q, true AS no_mass FROM d",
    "snapshot_pushdown": f"""WITH {_BASE['dense']}, f AS (SELECT parcel_id, step, CAST(CAST(lon AS FLOAT) AS DOUBLE) AS lon, CAST(CAST(lat AS FLOAT) AS DOUBLE) AS lat, CAST(CAST(z AS FLOAT) AS DOUBLE) AS z FROM d)
SELECT parcel_id, count(*) AS n, sum(z) AS z FROM f WHERE step >= 8 AND step < 16 AND parcel_id >= 20 AND z < 3000 AND lon BETWEEN -101 AND 101 AND lat BETWEEN -41 AND 61 GROUP BY parcel_id""",
    "forward_steps": """WITH r AS (SELECT DISTINCT CAST(epoch(o_orderdate) AS BIGINT) // 21600 AS rel FROM orders WHERE NOT (month(o_orderdate) = 2 AND day(o_orderdate) = 29)),
s AS (SELECT rel, rel + k AS slot FROM r, (SELECT unnest(range(60)) AS k) WHERE NOT (month(make_timestamp((rel + k) * 21600 * 1000000)) = 2 AND day(make_timestamp((rel + k) * 21600 * 1000000)) = 29)),
f AS (SELECT rel, slot FROM (SELECT *, row_number() OVER (PARTITION BY rel ORDER BY slot) AS rn FROM s) WHERE rn <= 42)
SELECT rel, count(*) AS n, max(slot) AS last, CAST(sum(slot) AS BIGINT) AS total FROM f GROUP BY rel""",
    "mask_from_axes": f"""WITH {_BASE['dense']}, lats AS (SELECT y, y * 2e0 AS v FROM (SELECT unnest(range(-44, 45)) AS y)), lons AS (SELECT x, CASE WHEN x * 2 > 180 THEN x * 2e0 - 360 ELSE x * 2e0 END AS v FROM (SELECT unnest(range(180)) AS x)),
a AS (SELECT parcel_id, min_by(y, abs(v - lat) * 1e6 + v * 1e-6) AS y FROM d, lats WHERE step = 0 GROUP BY ALL), b AS (SELECT parcel_id, min_by(x, abs(v - lon) * 1e6 + v * 1e-6) AS x FROM d, lons WHERE step = 0 GROUP BY ALL)
SELECT parcel_id, y * 2e0 AS mask_lat, (SELECT v FROM lons WHERE lons.x = b.x) AS mask_lon, CAST((y * 7 + b.x * 3 + 700) % 5 AS INT) AS mask_value FROM a JOIN b USING (parcel_id)""",
    "store_sod08": _daily_sql(_SOD),
}
