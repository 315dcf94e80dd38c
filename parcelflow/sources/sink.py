"""Results as Parquet tables under a manifest: a run's releases replace their predecessors all at once, or not at all.

    <path>/heat | moisture
        <table>/run=<run>/release=<yyyyMMddHHmmss>/   daily, integrated, stats, segments, trajectories, times
        grid/run=<run>/                               cells, edges, centres and areas
        runs/run=<run>/                               method, job, grid, units and the tables' schemas
        manifest/<version>.json                       the run that holds each release, from this version on

A run writes its tables under its own name, where no reader looks, and then one manifest file that names
its releases; readers take the latest version of each release.  So a failed run changes nothing, a release
of which nothing is left is empty, and what a release was made with stays beside it.  After that the
replaced tables are removed.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.geo import output_grid
from ..operators.schedule import day_before_arrival, step_schedule
from ..operators.trajectory import KEY
from ..params import Heat, Job
from ..plans.attribute import Tracked, grid_integrated, grid_sum, run_stats, to_flux

TABLES = ["daily", "integrated", "stats", "segments", "trajectories", "times"]
_RELEASE = "yyyyMMddHHmmss"


def _fs(spark: SparkSession, path: str):
    """Spark's own file system of a path, and the path on it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _write(df: DataFrame, path: str, table: str, run: str) -> None:
    named = df.withColumn("release", F.date_format("release_ts", _RELEASE))
    named.write.partitionBy("release").parquet(f"{path}/{table}/run={run}")


def _read(spark: SparkSession, path: str, table: str, schema: StructType, runs: list[str] | None = None) -> DataFrame:
    data = spark.read.schema(StructType(list(schema)).add("run", "string").add("release", "string")).parquet(f"{path}/{table}")
    return data if runs is None else data.where(F.col("run").isin(runs))


def times(releases: DataFrame, job: Job, kind: str) -> DataFrame:
    """Time axes of each release: (release_ts, axis, index, start_ts, mid_ts, end_ts).

    "input" has the steps (0 is arrival), "segment" the segments of ``kind`` (0 is the oldest) with their
    mid-times, "day" the days before arrival (-1 is the last).
    """
    oldest = job.segments if kind == "heat" else job.segments + 1
    steps = step_schedule(releases.select("release_ts").distinct(), job)
    w = Window.partitionBy("release_ts").orderBy(F.col("step").desc())
    used = steps.withColumn("start_ts", F.lag("obs_ts").over(w)).where((F.col("step") < oldest) & (F.col("step") >= oldest - job.segments))
    middle = lambda a, b: F.timestamp_seconds((F.unix_timestamp(a) + F.unix_timestamp(b)) / 2).alias("mid_ts")
    segments = used.select("release_ts", F.lit("segment").alias("axis"), (oldest - 1 - F.col("step")).cast("int").alias("index"), "start_ts", middle("start_ts", "obs_ts"), F.col("obs_ts").alias("end_ts"))
    days = segments.groupBy("release_ts", day_before_arrival(F.col("index"), job).alias("index")).agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"))
    days = days.select("release_ts", F.lit("day").alias("axis"), "index", "start_ts", middle("start_ts", "end_ts"), "end_ts")
    inputs = steps.select("release_ts", F.lit("input").alias("axis"), F.col("step").cast("int").alias("index"), F.col("obs_ts").alias("start_ts"), F.col("obs_ts").alias("mid_ts"), F.col("obs_ts").alias("end_ts"))
    return segments.unionByName(days).unionByName(inputs)


def _stats(run: Tracked, releases: DataFrame) -> DataFrame:
    """Statistics of all releases; one without parcels has zeros."""
    rows = releases.select("release_ts").distinct().join(run_stats(run), "release_ts", "left")
    return rows.na.fill(0, ["n_target", "n_filtered", "n_no_uptake"])


def write_results(run: Tracked, path: str, segments: bool = True, trajectories: DataFrame | None = None, releases: DataFrame | None = None, keep_replaced: bool = False) -> str:
    """Write a run and make it the current one of its releases; ``path``/heat or ``path``/moisture is returned.

    daily, integrated, stats, times, grid and the run's parameters are written, segments by default (the
    rest is then read off them), trajectories if given.  The run's releases are ``releases`` (release_ts), or
    those that have targets; each of them is replaced, also by nothing, and no other.  Equal rows stay apart;
    rows without a release_ts are left out.  ``keep_replaced`` leaves the replaced tables where they were, for
    readers that are still at work.
    """
    spark = run.segments.sparkSession
    kind = "heat" if isinstance(run.method, Heat) else "moisture"
    path, name = f"{path}/{kind}", f"r{uuid.uuid4().hex}"
    ours = (run.targets if releases is None else releases).select("release_ts").where("release_ts is not null").distinct()
    schemas = {}

    def put(df: DataFrame, table: str) -> DataFrame:
        df = df.where("release_ts is not null")
        schemas[table] = df.schema
        _write(df, path, table, name)
        return _read(spark, path, table, df.schema, [name]).drop("run", "release")

    if segments:
        run = replace(run, segments=put(run.segments, "segments"))
    daily = put(to_flux(grid_sum(run), run), "daily")
    put(grid_integrated(daily), "integrated")
    put(_stats(run, ours), "stats")
    put(times(ours, run.job, kind), "times")
    if trajectories is not None:
        put(trajectories.select(*KEY, *(c for c in trajectories.columns if c not in KEY)), "trajectories")
    output_grid(spark, run.grid).write.parquet(f"{path}/grid/run={name}")
    unit = "W/m2" if kind == "heat" else "mm"
    units = {"flux": unit, "lat": "degrees_north", "lon": "degrees_east", "area": "m2", "residence_days": "days", "pct_filtered": "%", "pct_no_uptake": "%"}
    told = {"parameters": {"method": asdict(run.method), "job": asdict(run.job), "grid": asdict(run.grid)}, "unit": unit, "units": units, "schemas": {k: v.json() for k, v in schemas.items()}}
    spark.range(1).select(*(F.lit(v if isinstance(v, str) else json.dumps(v)).alias(k) for k, v in told.items())).write.json(f"{path}/runs/run={name}")
    before = manifest(spark, path) if _exists(spark, f"{path}/manifest") else None
    version = _commit(ours, path, name)
    if before is not None and not keep_replaced:
        _remove_replaced(spark, path, before, ours, version)
    return path


def _exists(spark: SparkSession, path: str) -> bool:
    system, where = _fs(spark, path)
    return system.exists(where)


def _commit(releases: DataFrame, path: str, run: str) -> int:
    """Name the run's releases in the next manifest file; the number is claimed first, so two runs never share one."""
    spark = releases.sparkSession
    system, folder = _fs(spark, f"{path}/manifest")
    system.mkdirs(folder)
    have = [f.getPath().getName().split(".")[0] for f in system.listStatus(folder)]
    version = 1 + max((int(n) for n in have if n.isdigit()), default=0)
    # Spark's file system refuses to create a claim that is there.
    while not system.createNewFile(_fs(spark, f"{path}/manifest/{version:010d}.claim")[1]):
        version += 1
    staged = f"{path}/manifest/_staged-{run}"
    rows = releases.select(F.date_format("release_ts", _RELEASE).alias("release"), F.lit(run).alias("run"), F.lit(version).cast("bigint").alias("version"))
    rows.coalesce(1).write.json(staged)  # one short row a release
    part = next((f.getPath() for f in system.listStatus(_fs(spark, staged)[1]) if f.getPath().getName().startswith("part-")), None)
    if part is not None:
        system.rename(part, _fs(spark, f"{path}/manifest/{version:010d}.json")[1])
    system.delete(_fs(spark, staged)[1], True)
    return version


def manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(release, run, version): the run that holds each release now, or as of a version."""
    rows = spark.read.schema("release string, run string, version bigint").option("pathGlobFilter", "*.json").json(f"{path}/manifest")
    rows = rows if version is None else rows.where(F.col("version") <= version)
    return rows.groupBy("release").agg(F.max_by("run", "version").alias("run"), F.max("version").alias("version"))


def _remove_replaced(spark: SparkSession, path: str, before: DataFrame, ours: DataFrame, version: int) -> None:
    """Remove what earlier runs hold of this run's releases; runs that hold no release any more go whole."""
    names = ours.select(F.date_format("release_ts", _RELEASE).alias("release"))
    old = before.where(F.col("version") < version).join(names, "release", "left_semi").select("run", "release").toLocalIterator()
    runs = set()
    for row in old:
        runs.add(row.run)
        for table in TABLES:
            system, where = _fs(spark, f"{path}/{table}/run={row.run}/release={row.release}")
            system.delete(where, True)
    live = {r.run for r in manifest(spark, path).select("run").distinct().collect()}
    for run in runs - live:
        for table in [*TABLES, "grid", "runs"]:
            system, where = _fs(spark, f"{path}/{table}/run={run}")
            system.delete(where, True)


def read_results(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of the current runs (``path`` as write_results returned it), with run and, but for grid, release_ts.

    A release that no current run has rows of has none; an empty table has the columns of the latest run.
    """
    now = manifest(spark, path)
    live = [r.run for r in now.groupBy("run").agg(F.max("version").alias("v")).orderBy("v").collect()]
    if table == "grid":
        return spark.read.parquet(f"{path}/grid").where(F.col("run").isin(live))
    runs = spark.read.schema("parameters string, unit string, units string, schemas string, run string").json(f"{path}/runs").where(F.col("run").isin(live))
    if table == "runs":
        return runs.drop("schemas")
    known = {r.run: json.loads(r.schemas) for r in runs.collect()}  # a row a run
    latest = next((known[r][table] for r in reversed(live) if table in known[r]), None)
    if latest is None:
        raise ValueError(f"no current run has the table {table}")
    return _read(spark, path, table, StructType.fromJson(json.loads(latest)), live).join(now.select("run", "release"), ["run", "release"], "left_semi").drop("release")
