"""Heat and moisture attribution: from trajectories to gridded uptake and run statistics, for all releases in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import assign_cell, cell_area
from ..functions.thermo import with_thermo
from ..operators.schedule import day_before_arrival
from ..operators.trajectory import KEY, arrival_windows, arrivals, arrives_in_pbl, differences, in_window, precipitates
from ..operators.uptake import flag_uptake, linear_discount, linear_discounts, uptake
from ..params import CP, Grid, Heat, Job, Moisture


@dataclass(frozen=True)
class Tracked:
    """What a run gives: arrived parcels after the filters, and their segments with value, kept and flag."""

    method: Heat | Moisture
    job: Job
    grid: Grid
    targets: DataFrame
    arrived: DataFrame
    segments: DataFrame


def arrives(method: Heat | Moisture) -> F.Column:
    """Rain first, then the boundary layer; either may be off."""
    passes = F.lit(True)
    if isinstance(method, Moisture) and method.rain is not None:
        passes = passes & precipitates(method.rain, method.min_rh)
    return passes & arrives_in_pbl(*method.arrival_pbl) if method.arrival_pbl is not None else passes


def arrive_filters(arrived: DataFrame, method: Heat | Moisture) -> DataFrame:
    """The parcels that pass a method's filters; missing values don't pass."""
    return arrived.where(arrives(method))


def track(traj: DataFrame, method: Heat | Moisture, job: Job, grid: Grid = Grid()) -> Tracked:
    """Follow one method through trajectories (release_ts, parcel_id, step, obs_ts, lon, lat, q, z, hmix, rho, t_k)."""
    heat = isinstance(method, Heat)
    full = with_thermo(traj, method.var if heat else "dse")
    filtered = method.arrival_pbl is not None or (not heat and method.rain is not None)
    # What the filters need comes from windows that go with the differences: nothing is read or joined a second time.
    arrival = arrival_windows() if filtered else {}
    segs = in_window(differences(full, {"heat_var": "dheat"}, arrival), job, "heat" if heat else "moisture")
    segs = flag_uptake(segs.where(arrives(method)).drop(*arrival), method, job)
    segs = linear_discount(segs) if method.discount else segs.withColumn("kept", F.col("value"))
    segs = segs.withColumn("day", day_before_arrival(F.col("segment"), job))
    return Tracked(method, job, grid, full.select(*KEY).distinct(), arrive_filters(arrivals(full), method), assign_cell(segs, grid, wrap=not (heat and job.compat)))


def track_heat(traj: DataFrame, method: Heat, job: Job, grid: Grid = Grid()) -> Tracked:
    """``track`` for a heat method."""
    return track(traj, method, job, grid)


def track_moisture(traj: DataFrame, method: Moisture, job: Job, grid: Grid = Grid()) -> Tracked:
    """``track`` for a moisture method."""
    return track(traj, method, job, grid)


def track_all(traj: DataFrame, methods: dict[str, Heat | Moisture], job: Job, grid: Grid = Grid()) -> DataFrame:
    """Segments of several methods, each row with its ``method``'s name, from one pass through the trajectories.

    What the methods need of a parcel's arrival, the differences between its steps and all running totals
    come from windows over one partitioning and two sorts; each method's changes and flags are columns beside
    each other until rows are made of them at the end.  A method has rows of the parcels that pass its filters
    and of its own K segments (heat ends at arrival, moisture a step before): columns as ``track`` has them in
    ``segments``, value, kept, flag, day, ix and iy, and q0 and q1 of the parcel.  A change of 0 outside a method's
    segments leaves its totals as they are.
    """
    k = job.segments
    heat = {m.var: f"d_{m.var}" for m in methods.values() if isinstance(m, Heat)}
    rows = traj
    for var in heat or ["dse"]:
        rows = with_thermo(rows, var).withColumnRenamed("heat_var", var)
    names = list(enumerate(methods))
    rows = differences(rows, heat, arrival_windows()).where(F.col("step") <= k)
    rows = rows.withColumns({f"_passes_{i}": F.coalesce(arrives(methods[m]), F.lit(False)) for i, m in names})
    rows = rows.where(F.array_contains(F.array(*(f"_passes_{i}" for i, _ in names)), True))
    flags, own = {}, {}
    for i, name in names:
        method = methods[name]
        is_heat = isinstance(method, Heat)
        change, flag = uptake(method, job, heat.get(method.var, "") if is_heat else "")
        own[i] = F.col(f"_passes_{i}") & ((F.col("step") < k) if is_heat else (F.col("step") >= 1))
        flags[f"_value_{i}"], flags[f"_flag_{i}"] = F.when(own[i], F.coalesce(change, F.lit(0.0))).otherwise(0.0), flag
    rows = rows.withColumns(flags)
    discounted = {f"_value_{i}": f"_kept_{i}" for i, m in names if methods[m].discount}
    if discounted:
        rows = linear_discounts(rows, discounted)
    each = []
    for i, name in names:
        is_heat = isinstance(methods[name], Heat)
        segment = ((k - 1 if is_heat else k) - F.col("step")).cast("int")
        kept = F.col(f"_kept_{i}") if methods[name].discount else F.col(f"_value_{i}")
        each.append(F.when(own[i], F.struct(F.lit(name).alias("method"), segment.alias("segment"), F.col(f"_value_{i}").alias("value"), kept.alias("kept"), F.col(f"_flag_{i}").alias("flag"), F.lit(not (is_heat and job.compat)).alias("wrap"))))
    out = rows.select("*", F.inline(F.array_compact(F.array(*each))))
    out = out.withColumn("day", day_before_arrival(F.col("segment"), job)).select(
        "method", *KEY, "step", "segment", "mid_ts", "lon", "lat", "dq", *heat.values(), "drh", "q_start", "z_start", "z_end", "h_start", "h_end", "pair_max", "pair_mean", "q0", "q1", "value", "kept", "flag", "day", "wrap",
    )
    return assign_cell(out, grid, wrap=F.col("wrap")).drop("wrap")


def runs_of(segs: DataFrame, targets: DataFrame, methods: dict[str, Heat | Moisture], job: Job, grid: Grid = Grid()) -> dict[str, Tracked]:
    """A run for each method, to be written or read off, from the segments of ``track_all`` (best stored before) and the targets."""
    def one(name: str) -> Tracked:
        mine = segs.where(F.col("method") == name).drop("method")
        return Tracked(methods[name], job, grid, targets.select(*KEY).distinct(), mine.groupBy(*KEY).agg(F.max("q0").alias("q0"), F.max("q1").alias("q1")), mine)

    return {name: one(name) for name in methods}


def daily_of(segs: DataFrame, methods: dict[str, Heat | Moisture], job: Job, grid: Grid = Grid()) -> DataFrame:
    """(method, release_ts, day, iy, ix, total, n, flux) of all methods of ``track_all``, summed together."""
    sums = _summed(segs, "method")
    return sums.withColumn("flux", F.coalesce(*(F.when(F.col("method") == name, flux(F.col("total"), m, job, grid)) for name, m in methods.items())))


def _summed(segs: DataFrame, *more: str) -> DataFrame:
    here = (F.col("flag") == 1) & F.col("ix").isNotNull() & F.col("iy").isNotNull()
    return segs.where(here).groupBy(*more, "release_ts", "day", "iy", "ix").agg(F.sum("kept").alias("total"), F.count("*").alias("n"))


def flux(total: F.Column, method: Heat | Moisture, job: Job, grid: Grid) -> F.Column:
    """A cell's total as W/m2 for heat, mm for moisture; its area follows from its row iy."""
    area = cell_area(F.col("iy"), grid)
    if isinstance(method, Heat):
        return (1000.0 if method.var == "dse" else CP) * total * job.parcel_mass / (area * (job.time_step * 60))
    return total * job.parcel_mass / area


def grid_sum(run: Tracked) -> DataFrame:
    """(release_ts, day, iy, ix, total, n): what flagged segments keep, per cell and day before arrival.

    Segments without flag or cell go before the shuffle; partial sums do most of the work.
    """
    return _summed(run.segments)


def to_flux(sums: DataFrame, run: Tracked) -> DataFrame:
    """``total`` as ``flux``: W/m2 for heat, mm for moisture."""
    return sums.withColumn("flux", flux(F.col("total"), run.method, run.job, run.grid))


def grid_integrated(daily: DataFrame) -> DataFrame:
    """All days of a cell together."""
    return daily.groupBy("release_ts", "iy", "ix").agg(F.sum("flux").alias("flux"), F.sum("n").alias("n"))


def densify(daily: DataFrame, run: Tracked) -> DataFrame:
    """One row per release, day and cell, zeros included; days and cells are exploded, not joined, and centres follow from the cell."""
    half = run.grid.resolution / 2
    days = daily.select("release_ts").distinct().withColumn("day", F.explode(F.sequence(F.lit(-run.job.days), F.lit(-1))))
    cells = days.withColumn("iy", F.explode(F.sequence(F.lit(0), F.lit(run.grid.ny - 1)))).withColumn("ix", F.explode(F.sequence(F.lit(0), F.lit(run.grid.nx - 1))))
    filled = cells.select("release_ts", "day", F.col("iy").cast("bigint"), F.col("ix").cast("bigint")).join(daily.select("release_ts", "day", "iy", "ix", "flux"), ["release_ts", "day", "iy", "ix"], "left").na.fill(0.0, ["flux"])
    return filled.withColumns({"lat": run.grid.lat0 + F.col("iy") * run.grid.resolution + half, "lon": run.grid.lon0 + F.col("ix") * run.grid.resolution + half})


def parcel_summary(run: Tracked) -> DataFrame:
    """One row per arrived parcel: what it kept, whether it took up anything, and (discounted) its residence time.

    The residence time in minutes is the mean nominal age of its uptakes, weighted by what is left; where
    no more than rounding errors are left there is none (older results divided by such errors too).
    """
    job = run.job
    f = F.col("kept") * F.col("flag")
    lag = -(job.tracking_time + job.time_step - F.col("segment") * job.time_step - job.time_step / 2)
    none = F.lit(999.9) if job.compat else F.lit(None).cast("double")
    # Losses that just use up the gains may leave a rounding error, which is no weight to divide by.
    weight, least = F.sum(f), F.sum(F.abs("value")) * 1e-12
    out = run.segments.groupBy(*KEY).agg(
        F.sum("kept").alias("kept"), F.sum(F.abs("value")).alias("moved"), F.max("flag").alias("any_flag"),
        F.when(weight > least, F.abs(F.sum(lag * f) / weight)).otherwise(none).alias("residence_minutes"),
    )
    took = F.col("kept") > F.col("moved") * 1e-12 if run.method.discount else F.col("any_flag") == 1
    return out.withColumn("uptake", took).drop("moved", "any_flag")


def run_stats(run: Tracked) -> DataFrame:
    """One row per release: parcels in the target, after the filters, without uptake, and their percentages (null of none)."""
    targets = run.targets.groupBy("release_ts").agg(F.count("*").alias("n_target"))
    done = parcel_summary(run).groupBy("release_ts").agg(F.count("*").alias("n_filtered"), F.count_if(~F.col("uptake")).alias("n_no_uptake"), F.avg("residence_minutes").alias("minutes"))
    rows = targets.join(done, "release_ts", "left").na.fill(0, ["n_filtered", "n_no_uptake"])
    part = lambda a, b: F.round(100 * F.col(a) / F.nullif(F.col(b), F.lit(0)), 2)
    return rows.select("release_ts", "n_target", "n_filtered", "n_no_uptake", part("n_filtered", "n_target").alias("pct_filtered"), part("n_no_uptake", "n_filtered").alias("pct_no_uptake"), (F.col("minutes") / 1440).alias("residence_days"))


def contribution_pct(run: Tracked) -> DataFrame:
    """Per day and cell, uptake as a percentage of the humidity that parcels have a step before arrival."""
    total = run.arrived.groupBy("release_ts").agg(F.sum("q1").alias("q"))
    return grid_sum(run).join(F.broadcast(total), "release_ts").select("release_ts", "day", "iy", "ix", (100 * F.col("total") / F.col("q")).alias("pct"))


def attributed_fraction(run: Tracked) -> DataFrame:
    """Per release, what all segments keep as a share of the change on arrival; a change of 0 counts as 1."""
    change = run.arrived.groupBy("release_ts").agg(F.sum(F.abs(F.col("q0") - F.col("q1"))).alias("change"), F.sum("q0").alias("q_arrival"))
    kept = run.segments.groupBy("release_ts").agg(F.sum("kept").alias("kept"))
    return kept.join(change, "release_ts").select("release_ts", (F.col("kept") / F.when(F.col("change") == 0, 1.0).otherwise(F.col("change"))).alias("fraction"), "q_arrival")
