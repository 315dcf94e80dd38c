"""Which segments count as uptake, and what later losses leave of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import Heat, Job, Moisture
from .trajectory import BY


def pbl_flag(mode: int, height: str) -> Column:
    """Mode 0: always; 1: the start or the end lies in the boundary layer; 2: both."""
    if mode == 0:
        return F.lit(True)
    tops = {"max": ("pair_max", "pair_max"), "mean": ("pair_mean", "pair_mean"), "actual": ("h_start", "h_end")}[height]
    start, end = (F.coalesce(F.col(z) <= F.col(h), F.lit(False)) for z, h in zip(("z_start", "z_end"), tops))
    return start | end if mode == 1 else start & end


def _within(value: Column, most: float | None, missing: bool) -> Column:
    return F.lit(True) if most is None else F.coalesce(value <= most, F.lit(missing))


def uptake(method: Heat | Moisture, job: Job, dheat: str = "dheat") -> tuple[Column, Column]:
    """(the change that is summed, null where missing; 1 or 0 for an uptake) of a segment."""
    missing = job.compat
    heat = isinstance(method, Heat)
    change = F.col(dheat) if heat else F.col("dq")
    gain = change > method.gain if heat else change >= method.gain
    ok = pbl_flag(method.pbl_mode, method.pbl_height) & _within(F.abs("drh"), method.rh, missing) & F.coalesce(gain, F.lit(missing))
    if heat:
        ok = ok & _within(F.abs("dq") / F.col("q_start"), method.q, missing)
    return change, ok.cast("int")


def flag_uptake(segs: DataFrame, method: Heat | Moisture, job: Job) -> DataFrame:
    """Add ``value`` (the change that is summed, 0 where missing) and ``flag`` (1 where a segment is an uptake).

    A missing change, or a missing value that a check needs, is no uptake (with ``compat`` it passes); repeated rows stay.
    """
    change, flag = uptake(method, job)
    return segs.withColumns({"value": F.coalesce(change, F.lit(0.0)), "flag": flag})


def linear_discount(segs: DataFrame, value: str = "value", out: str = "kept") -> DataFrame:
    """Add what is left of each gain after later losses, each taken from all earlier gains in proportion.

    The total left after segment i is C_i - min(0, C_1 .. C_i), C the running sum of changes; each loss
    scales what is there by the ratio of two totals, so a gain ends as itself times the ratios after it.
    Windows alone: one partitioning, linear in the length of a trajectory.  Segments that still have their
    ``step`` come in its order from the differences, which saves a sort.  A null change counts as 0.
    """
    return linear_discounts(segs, {value: out})


def linear_discounts(segs: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``linear_discount`` of several columns of changes at once, in the same two sorts."""
    order = F.col("step").desc() if "step" in segs.columns else F.col("segment")
    back = F.col("step") if "step" in segs.columns else F.col("segment").desc()
    forward = Window.partitionBy(*BY).orderBy(order)
    so_far = forward.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = Window.partitionBy(*BY).orderBy(back).rowsBetween(Window.unboundedPreceding, -1)
    names = list(enumerate(columns))
    v = {i: F.coalesce(F.col(c), F.lit(0.0)) for i, c in names}
    before = forward.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    rows = segs.withColumns({f"_c{i}": F.sum(v[i]).over(so_far) for i, _ in names})
    # The totals after a segment and after the one before it, from one window.
    totals = {f"_s{i}": F.col(f"_c{i}") - F.least(zero, F.min(f"_c{i}").over(so_far)) for i, _ in names}
    rows = rows.withColumns(totals | {f"_p{i}": F.lag(f"_c{i}").over(forward) - F.least(zero, F.min(f"_c{i}").over(before)) for i, _ in names})
    rows = rows.withColumns({f"_f{i}": F.when(v[i] > 0, 1.0).when(F.col(f"_p{i}") > 0, F.col(f"_s{i}") / F.col(f"_p{i}")).otherwise(0.0) for i, _ in names})
    kept = {columns[c]: F.when(v[i] > 0, v[i] * F.coalesce(F.product(f"_f{i}").over(later), F.lit(1.0))).otherwise(0.0) for i, c in names}
    return rows.withColumns(kept).drop(*(f"_{x}{i}" for i, _ in names for x in "cspf"))


def linear_discount_fold(changes: Column) -> Column:
    """The same on an array of changes, oldest first, as a fold; for tests, slower than the windows."""
    def step(kept: Column, v: Column) -> Column:
        total = F.aggregate(kept, F.lit(0.0), lambda a, x: a + x)
        scale = F.when(total > 0, F.greatest(F.lit(0.0), 1 + v / total)).otherwise(0.0)
        return F.when(v > 0, F.concat(kept, F.array(v))).otherwise(F.concat(F.transform(kept, lambda x: x * scale), F.array(F.lit(0.0))))

    return F.aggregate(changes, F.array().cast("array<double>"), step)
