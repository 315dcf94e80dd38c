"""Observations derived from the given tables: integer arithmetic up to one last division."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T0 = "2015-07-05 00:00:00"
#: Rows of whole trajectories that one task sorts, about.
TASK_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dense(spark: SparkSession, sf_dir: str, releases: int = 1) -> DataFrame:
    """Every parcel at every step: customers for one release; orders for more, six hours apart.

    Parcels are dealt out before they become rows, so windows over trajectories need no shuffle of observations.
    """
    source, key = ("customer", "c_custkey") if releases == 1 else ("orders", "o_orderkey")
    ids = table(spark, sf_dir, source).select(F.col(key).alias("c"))
    tasks = max(spark.sparkContext.defaultParallelism, -(-ids.count() * releases * 42 // TASK_ROWS))
    rows = ids.repartition(tasks, "c").withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(releases - 1)))).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(41))))
    return rows.selectExpr(
        "c as parcel_id", f"timestamp'{T0}' + make_interval(0, 0, 0, 0, 6 * r) as release_ts", "cast(k as int) as step", f"timestamp'{T0}' + make_interval(0, 0, 0, 0, 6 * (r - k)) as obs_ts",
        "((c * 137 + (41 - k) * 3) % 3600) / 10e0 - 180e0 + 0.03e0 as lon", "((c * 61) % 1400 + (41 - k) * 2) / 10e0 - 70e0 + 0.03e0 as lat",
        "(20 + (c * 31 + k * k * 17 + k * (c % 13) * 7) % 160) / 10000e0 as q", "((c * 13 + k * 211) % 4000) / 1e0 as z", "((c * 17 + k * 307) % 3000) / 1e0 as hmix",
        "(70 + (c + k * 7) % 50) / 100e0 as rho", "(255 + (c * 3 + k * 11) % 45) / 1e0 as t_k",
    )


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by user and six hours: more than half of the steps are missing."""
    e = table(spark, sf_dir, "events").selectExpr("user_id as parcel_id", "unix_timestamp(ts) div 21600 as b", "bigint(round(value * 100)) as v", "event_id")
    g = e.groupBy("parcel_id", "b").agg(F.sum("v").alias("c"), F.count("*").alias("n"), F.min("event_id").alias("m"))
    return g.selectExpr(
        "parcel_id", "b", "timestamp_seconds(b * 21600) as obs_ts", "((parcel_id * 37 + b * 3) % 3600) / 10e0 - 180e0 + 0.03e0 as lon", "((parcel_id * 61) % 1400 + (b % 100) * 2) / 10e0 - 70e0 + 0.03e0 as lat",
        "(20 + c % 160) / 10000e0 as q", "((c * 13 + n * 101) % 4000) / 1e0 as z", "((c * 17 + m * 29) % 3000) / 1e0 as hmix", "(70 + c % 50) / 100e0 as rho", "(255 + (m * 3 + c) % 45) / 1e0 as t_k",
    )


def gappy_targets(obs: DataFrame) -> DataFrame:
    """Every parcel as a target of four releases on 2024-01-12, six hours apart."""
    ids = obs.select("parcel_id").distinct()
    return ids.withColumn("b", F.explode(F.sequence(F.lit(78936), F.lit(78939)))).select(F.expr("timestamp_seconds(b * 21600L)").alias("release_ts"), "parcel_id")


def lattice_mask(spark: SparkSession) -> DataFrame:
    """A two-degree mask: 1 in the tropics from 60 W to 60 E."""
    ids = spark.range(90 * 180).selectExpr("(id div 180) * 2 - 89e0 as lat", "(id % 180) * 2 - 179e0 as lon")
    return ids.withColumn("value", (F.col("lat").between(-20, 20) & F.col("lon").between(-60, 60)).cast("int"))
