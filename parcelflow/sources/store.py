"""A store of observations laid out by parcel: trajectories are joined where the observations lie.

A bucketed table by parcel_id, sorted by parcel_id and obs_ts, partitioned by obs_date.  The spine of targets
and steps is dealt over the same buckets, so no observation is shuffled: not for the join, nor for the windows
over a parcel's steps after it.  Days that a run doesn't need are pruned by a list of days, and row groups by
a list of parcels where they are few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.schedule import step_schedule
from ..operators.trajectory import trajectories
from ..params import Job
from .snapshots import needed_days

#: Parcels that are named in a scan at most; of more, all row groups of the wanted days are read.
FEW_PARCELS = 1000
#: Rows of a bucket, about, where no number of buckets is given: what a task sorts at once.
BUCKET_ROWS = 1_000_000


def write_store(obs: DataFrame, table: str, path: str, buckets: int | None = None) -> None:
    """Write observations as the bucketed table ``table`` at ``path``; into an existing one, days of ``obs`` replace theirs.

    Buckets should hold what a task can sort: without ``buckets`` rows are counted and there are as many as hold
    BUCKET_ROWS each, but no fewer than the cluster has cores.  The number stays when days are added, so a store
    that is filled day by day should be given it.  Rows without a time or a parcel are left out; repeated rows
    stay, and count once in trajectories.
    """
    spark = obs.sparkSession
    rows = obs.where("obs_ts is not null and parcel_id is not null").withColumn("obs_date", F.to_date("obs_ts"))
    if spark.catalog.tableExists(table):
        have = spark.table(table)
        # An insert heeds the session alone: by days, not the whole table.
        before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:
            rows.select(*have.columns).repartition(buckets_of(spark, table), "parcel_id").write.insertInto(table, overwrite=True)
        finally:
            spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
        return
    if buckets is None:
        buckets = max(spark.sparkContext.defaultParallelism, -(-rows.count() // BUCKET_ROWS))
    # The columns' order is the table's: partition columns last.
    rows = rows.select(*(c for c in rows.columns if c != "obs_date"), "obs_date").repartition(buckets, "parcel_id")
    rows.write.option("path", path).partitionBy("obs_date").bucketBy(buckets, "parcel_id").sortBy("parcel_id", "obs_ts").saveAsTable(table)


def buckets_of(spark: SparkSession, table: str) -> int:
    return int(next(r.data_type for r in spark.sql(f"describe formatted {table}").collect() if r.col_name == "Num Buckets"))


def stored_trajectories(spark: SparkSession, table: str, targets: DataFrame, job: Job) -> DataFrame:
    """``trajectories`` of targets (release_ts, parcel_id) over a store, without shuffling its observations.

    Only the days of the targets' steps are opened; at most FEW_PARCELS targets' parcels are named in the scan too.
    The session is told that joins on (parcel_id, obs_ts) may meet where both sides lie by parcel_id alone.
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    releases = targets.select("release_ts").distinct()
    steps = step_schedule(releases, job)
    obs = spark.table(table).where(F.col("obs_date").isin(needed_days(steps))).drop("obs_date")
    ids = [r[0] for r in targets.select(F.col("parcel_id").cast(obs.schema["parcel_id"].dataType)).distinct().limit(FEW_PARCELS + 1).collect()]
    if len(ids) <= FEW_PARCELS:
        obs = obs.where(F.col("parcel_id").isin(ids))
    return trajectories(obs, targets, job, steps if job.calendar == "365d" else None, buckets_of(spark, table))
