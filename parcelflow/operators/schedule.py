"""Release times and the observation times each of them needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import Job


def _leap_day(ts) -> F.Column:
    return (F.month(ts) == 2) & (F.dayofmonth(ts) == 29)


def release_schedule(spark: SparkSession, years, months, days, hours, minutes=(0,), n_days: int = 1, calendar: str = "366d") -> DataFrame:
    """Distinct release_ts: every combination of the lists, each followed over ``n_days`` days.

    The lists are exploded one after the other, so nothing is joined.  An impossible date is an error.
    With calendar "365d" 29 February is left out and the window is longer by as many days.
    """
    lists = {"y": years, "mo": months, "d": days, "h": hours, "mi": minutes}
    rows = spark.range(1)
    for name, values in lists.items():
        values = [values] if isinstance(values, int) else list(values)
        rows = rows.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    extra = (n_days + 1) // 365 + 2 if calendar == "365d" else 0
    rows = rows.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(n_days - 1 + extra))))
    rows = rows.select("y", "mo", "d", "h", "mi", "n", F.expr("timestamp(date_add(make_date(y, mo, d), n)) + make_interval(0, 0, 0, 0, h, mi)").alias("release_ts"))
    if calendar == "365d":
        rows = rows.where(~_leap_day("release_ts"))
        from pyspark.sql import Window

        rank = F.row_number().over(Window.partitionBy("y", "mo", "d", "h", "mi").orderBy("n"))
        rows = rows.withColumn("rank", rank).where(F.col("rank") <= n_days)
    return rows.select("release_ts").distinct()


def step_schedule(releases: DataFrame, job: Job, direction: str = "backward") -> DataFrame:
    """(release_ts, step, obs_ts) with steps 0 .. K + 1 from the release on, K the number of segments.

    Without leap days ("365d") as many steps more are taken as fall on 29 February, and those left are
    numbered anew.
    """
    if direction not in ("backward", "forward"):
        raise ValueError("direction is backward or forward")
    sign, n = ("-" if direction == "backward" else "+"), job.segments + 2
    leap = job.calendar == "365d"
    more = job.per_day * (job.tracking_time // (1440 * 365) + 2) if leap else 0
    steps = releases.select("release_ts", F.explode(F.sequence(F.lit(0), F.lit(n - 1 + more))).alias("step"))
    steps = steps.withColumn("obs_ts", F.expr(f"release_ts {sign} make_interval(0, 0, 0, 0, 0, step * {job.time_step})"))
    if leap:
        from pyspark.sql import Window

        rank = F.row_number().over(Window.partitionBy("release_ts").orderBy("step")) - 1
        steps = steps.where(~_leap_day("obs_ts")).withColumn("step", rank).where(F.col("step") < n)
    return steps


def missing_inputs(steps: DataFrame, available: DataFrame) -> DataFrame:
    """Steps whose obs_ts isn't among the available times."""
    return steps.join(available.select("obs_ts").distinct(), "obs_ts", "left_anti").select("release_ts", "step", "obs_ts")


def gate(releases: DataFrame, steps: DataFrame, available: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(releases of which every step is available, steps that are missing): a release that lacks a time doesn't run.

    Both are by times alone; nulls among the available times count for nothing, repeated ones once.
    """
    missing = missing_inputs(steps, available)
    return releases.join(missing.select("release_ts").distinct(), "release_ts", "left_anti"), missing


def day_before_arrival(segment: F.Column, job: Job) -> F.Column:
    """-1 for the day that ends at arrival, -2 before it, ...; segment 0 is the oldest."""
    return (F.floor(segment / job.per_day) - job.days).cast("int")
