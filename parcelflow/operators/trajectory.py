"""Trajectories, arrival filters and segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import mean_longitude
from ..params import Job

KEY = ["release_ts", "parcel_id"]
#: The same for windows: sorts compare parcels first, which differ more often than releases.
BY = ["parcel_id", "release_ts"]


def trajectories(obs: DataFrame, targets: DataFrame, job: Job, steps: DataFrame | None = None, buckets: int | None = None) -> DataFrame:
    """Every target at every step, with its observation or nulls: (release_ts, parcel_id, step, obs_ts, ...).

    The spine of targets and steps comes first, so that a missing step leaves a gap and later differences
    don't jump over it.  Steps are exploded from the release unless a schedule is given (no-leap runs).
    Of several observations of a parcel at one time, one counts: the one with the most values, of these
    the one with the largest in the order of columns.  Only wanted observations are grouped.  Columns of
    ``obs`` that are called like the spine's (release_ts, step) are left out; targets with nulls have no
    observations.  ``buckets`` lays the spine out as a store of so many buckets by parcel_id is, so that its
    observations stay where they are.
    """
    obs = obs.drop("release_ts", "step")
    if buckets:  # before targets become steps, of which there are many more
        targets = targets.withColumn("parcel_id", F.col("parcel_id").cast(obs.schema["parcel_id"].dataType)).repartition(buckets, "parcel_id")
    if steps is None:
        spine = targets.select(*KEY, F.explode(F.sequence(F.lit(0), F.lit(job.segments + 1))).alias("step"))
        spine = spine.withColumn("obs_ts", F.expr(f"release_ts - make_interval(0, 0, 0, 0, 0, step * {job.time_step})"))
    else:
        spine = targets.select(*KEY).join(steps.select("release_ts", "step", "obs_ts"), "release_ts")
        spine = spine.repartition(buckets, "parcel_id") if buckets else spine
    at = ["parcel_id", "obs_ts"]
    values = [c for c in obs.columns if c not in at]
    there = sum((F.col(f"`{c}`").isNotNull().cast("int") for c in values), F.lit(0))
    # Spark's estimates leave out what explode multiplies: without hints a spine of any size passes for small and is broadcast.
    wanted = obs.join(spine.select(*at).hint("merge"), at, "left_semi")
    # Values go by their place, so no name of theirs can clash.
    one = wanted.groupBy(*at).agg(F.max(F.struct(there, *(F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate(values)))).alias("one"))
    return spine.join(one.select(*at, *(F.col("one")[f"v{i}"].alias(c) for i, c in enumerate(values))).hint("merge"), at, "left")


def _at(step: int, name: str) -> F.Column:
    return F.max(F.when(F.col("step") == step, F.col(name)))


def arrivals(traj: DataFrame) -> DataFrame:
    """One row per parcel: what the arrival filters need, from its last four steps alone.

    Missing values are skipped; of rows repeated for a step the largest values count.
    """
    late = traj.where("step < 4")
    return late.groupBy(*KEY).agg(*(c.alias(name) for name, c in arrival_columns().items()))


def arrival_columns() -> dict[str, F.Column]:
    """The aggregates of ``arrivals``, which hold over all steps too: q0, q1, rh0, rh1, z0 and boundary-layer heights h_max, h_mean, h_actual."""
    late = F.when(F.col("step") < 4, F.col("hmix"))
    return {"q0": _at(0, "q"), "q1": _at(1, "q"), "rh0": _at(0, "rh"), "rh1": _at(1, "rh"), "z0": _at(0, "z"), "h_max": F.max(late), "h_mean": F.avg(late), "h_actual": _at(0, "hmix")}


def arrival_windows() -> dict[str, F.Column]:
    """``arrival_columns`` over all steps of a trajectory, in the order of its differences, so that both need one sort and one pass."""
    steps = Window.partitionBy(*BY).orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return {name: c.over(steps) for name, c in arrival_columns().items()}


def precipitates(loss: float, min_rh: float) -> F.Column:
    return (F.col("q0") - F.col("q1") < loss) & ((F.col("rh0") + F.col("rh1")) / 2 >= min_rh)


def arrives_in_pbl(lower: float = 0.0, upper: float = 0.0, method: str = "max") -> F.Column:
    if method not in ("max", "mean", "actual"):
        raise ValueError("method is max, mean or actual")
    return F.col("z0").between(F.lit(lower), F.greatest(f"h_{method}", F.lit(upper)))


def filter_precipitating(arrived: DataFrame, loss: float, min_rh: float) -> DataFrame:
    """Parcels that lose more than ``loss`` in the last step and arrive humid; those of which a value is missing don't pass, repeated rows stay."""
    return arrived.where(precipitates(loss, min_rh))


def filter_arrival_pbl(arrived: DataFrame, lower: float = 0.0, upper: float = 0.0, method: str = "max") -> DataFrame:
    """Parcels that arrive between ``lower`` and the boundary-layer height of the last four steps, or ``upper`` if higher.

    Without a height on arrival none passes; without any of the boundary layer ``upper`` counts.  Repeated rows stay.
    """
    return arrived.where(arrives_in_pbl(lower, upper, method))


def segments(traj: DataFrame, job: Job, kind: str) -> DataFrame:
    """Consecutive observations as segments: segment 0 is the oldest.

    Heat takes the steps up to arrival, moisture those up to the step before it.  Differences are later
    minus earlier and null where either is missing; ``pair_max`` takes the one height that is there.
    ``step`` is that of a segment's end.  All windows share one partitioning.
    """
    if kind not in ("heat", "moisture"):
        raise ValueError("kind is heat or moisture")
    return in_window(differences(traj, {"heat_var": "dheat"}), job, kind)


def in_window(rows: DataFrame, job: Job, kind: str) -> DataFrame:
    """The steps of ``differences`` that end a segment of a kind, numbered from the oldest."""
    oldest = job.segments if kind == "heat" else job.segments + 1
    return rows.where((F.col("step") < oldest) & (F.col("step") >= oldest - job.segments)).withColumn("segment", (oldest - 1 - F.col("step")).cast("int"))


def differences(traj: DataFrame, heat: dict[str, str], more: dict[str, F.Column] | None = None) -> DataFrame:
    """Each step with what has changed since the step before it; ``heat`` names the differences of heat variables.

    ``more`` has columns that are taken over whole trajectories on the way (see ``arrival_windows``).
    """
    w = Window.partitionBy(*BY).orderBy(F.col("step").desc())
    more = more or {}
    rows = traj.withColumns({f"{c}_a": F.lag(c).over(w) for c in ("lon", "lat", "q", "z", "hmix", "rh", "obs_ts", *heat)} | more)
    out = rows.select(
        *KEY, "step", *more,
        F.timestamp_seconds((F.unix_timestamp("obs_ts_a") + F.unix_timestamp("obs_ts")) / 2).alias("mid_ts"),
        mean_longitude(F.col("lon_a"), F.col("lon")).alias("lon"), ((F.col("lat_a") + F.col("lat")) / 2).alias("lat"),
        (F.col("q") - F.col("q_a")).alias("dq"), *((F.col(c) - F.col(f"{c}_a")).alias(d) for c, d in heat.items()), (F.col("rh") - F.col("rh_a")).alias("drh"),
        F.col("q_a").alias("q_start"), F.col("z_a").alias("z_start"), F.col("z").alias("z_end"), F.col("hmix_a").alias("h_start"), F.col("hmix").alias("h_end"),
    )
    return out.withColumns({"pair_max": F.greatest("h_start", "h_end"), "pair_mean": (F.col("h_start") + F.col("h_end")) / 2})
