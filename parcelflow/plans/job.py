"""A whole job: from observations and a mask to the results of heat and moisture methods."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.schedule import gate, step_schedule
from ..operators.targets import select_targets
from ..operators.trajectory import KEY, trajectories
from ..params import Grid, Heat, Job, Moisture
from ..sources.files import fresh
from ..sources.sink import write_results
from .attribute import Tracked, runs_of, track_all


@dataclass(frozen=True)
class Outcome:
    """Releases that ran, inputs that others lack (release_ts, step, obs_ts), targets, and the segments of all methods."""

    releases: DataFrame
    missing: DataFrame
    targets: DataFrame
    segments: DataFrame
    methods: dict[str, Heat | Moisture]
    job: Job
    grid: Grid

    def runs(self) -> dict[str, Tracked]:
        return runs_of(self.segments, self.targets, self.methods, self.job, self.grid)


def whole_job(obs: DataFrame, mask: DataFrame, releases: DataFrame, methods: dict[str, Heat | Moisture], job: Job, grid: Grid = Grid(), value: int = 1, available: DataFrame | None = None) -> Outcome:
    """Gate the releases by their inputs, find the parcels over the mask, follow them once and run all methods on that.

    ``available`` (obs_ts) lists the times that are there, a catalogue of files as a rule: releases that lack
    one are left out, and what they lack is named.  Without it all releases run, and missing steps are gaps.
    The targets are written once, as the spine and the statistics need them; observations are read for the
    targets, at release times only, and for the trajectories.
    """
    releases = releases.select("release_ts").where("release_ts is not null").distinct()
    steps = step_schedule(releases, job)
    ran, missing = gate(releases, steps, available) if available is not None else (releases, steps.where("false"))
    here = obs.select("parcel_id", "obs_ts", "lon", "lat").join(ran.withColumn("obs_ts", F.col("release_ts")), "obs_ts")
    path = fresh(obs.sparkSession, "targets")
    targets = select_targets(here.select(*KEY, "lon", "lat"), mask, value)
    targets.write.parquet(path)
    targets = obs.sparkSession.read.schema(targets.schema).parquet(path)
    traj = trajectories(obs, targets, job, steps if job.calendar == "365d" else None)
    return Outcome(ran, missing, targets, track_all(traj, methods, job, grid), methods, job, grid)


def write_job(done: Outcome, path: str) -> dict[str, str]:
    """Write the results of every method below ``path``/<name>, from segments that are made once; where each of them lies is returned."""
    spark = done.segments.sparkSession
    made = fresh(spark, "segments")
    done.segments.write.partitionBy("method").parquet(made)
    segments = spark.read.schema(done.segments.schema).parquet(made)
    runs = runs_of(segments, done.targets, done.methods, done.job, done.grid)
    return {name: write_results(run, f"{path}/{name}", releases=done.releases) for name, run in runs.items()}
