"""Masks and the parcels that arrive over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a mask's axes or of a curvilinear mask that are broadcast at most; larger ones are shuffled.
BROADCAST_ROWS = 1_000_000
#: Lines of an axis that go into the plan as a sorted list at most.
AXIS_LINES = 50_000
#: Cells of a closed box of the pyramid at most, and its levels; each cuts a box in 4 x 4.
LEAF, DEPTH = 16, 12


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _axis(mask: DataFrame, name: str) -> tuple[DataFrame, float]:
    """Values of an axis, each with the stretch it is nearest to, in buckets of the least spacing, but no more than eight a value."""
    values = mask.select(F.col(name).alias("value")).distinct()
    w = Window.orderBy("value")  # an axis: as many rows as a mask has lines
    near = values.select("value", F.lag("value").over(w).alias("before"), F.lead("value").over(w).alias("after"))
    near = near.select("value", ((F.col("before") + F.col("value")) / 2).alias("lo"), ((F.col("value") + F.col("after")) / 2).alias("hi"), (F.col("value") - F.col("before")).alias("gap"))
    n, gap, first, last = near.agg(F.count("*"), F.min("gap"), F.min("value"), F.max("value")).first()
    width = max(gap or 1.0, (last - first) / (8 * n))
    bounded = near.select("value", "lo", "hi", F.coalesce("lo", F.lit(first)).alias("from"), F.coalesce("hi", F.lit(last)).alias("to"))
    buckets = bounded.select("value", "lo", "hi", F.explode(F.sequence(F.floor(F.col("from") / width), F.floor(F.col("to") / width))).alias(f"{name}_bucket"))
    return buckets.select(F.col("value").alias(f"mask_{name}"), F.col("lo").alias(f"{name}_from"), F.col("hi").alias(f"{name}_to"), f"{name}_bucket"), (width, first, last)


def _line(x: F.Column, lines: list[float]) -> F.Column:
    """The line nearest to x, by halving: the number of midpoints below x is built up from its highest bit."""
    array = lambda values: F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")
    middles = [(a + b) / 2 for a, b in zip(lines, lines[1:])]
    steps = [1 << k for k in reversed(range(len(middles).bit_length()))]
    at = F.lit(0)
    if steps:
        held = array(middles)
        at = F.aggregate(F.array(*map(F.lit, steps)), at, lambda below, step: F.when(F.get(held, below + step - 1) < x, below + step).otherwise(below))
    return F.when(x.isNotNull() & ~F.isnan(x), F.get(array(lines), at))


def nearest_mask(points: DataFrame, mask: DataFrame) -> DataFrame:
    """Add mask_lat, mask_lon and mask_value of the mask cell nearest to (lon, lat) in plain degrees.

    For a rectilinear mask (lat, lon, value) the nearest line of each axis is independent of the other: it is
    found in the sorted lines (beyond AXIS_LINES of them by joins on buckets of the axis), then one equi-join
    finds the cell.  There is no largest distance; of two as near the smaller coordinate counts; of repeated
    cells the least value; points without coordinates, and all points of an empty mask, get nulls; mask rows
    without coordinates are no cells.  Not wrapped at the antimeridian.
    """
    mask = mask.select(F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), "value").where("lat is not null and lon is not null and not isnan(lat) and not isnan(lon)")
    out = points
    for name in ("lat", "lon"):
        lines = [r[0] for r in mask.select(name).distinct().orderBy(name).limit(AXIS_LINES + 1).collect()]
        if len(lines) > AXIS_LINES:
            out = _by_buckets(out, mask, name)
        else:
            out = out.withColumn(f"mask_{name}", _line(F.col(name).cast("double"), lines) if lines else F.lit(None).cast("double"))
    cells = mask.groupBy("lat", "lon").agg(F.min("value").alias("mask_value")).select(F.col("lat").alias("mask_lat"), F.col("lon").alias("mask_lon"), "mask_value")
    return out.join(_small(cells), ["mask_lat", "mask_lon"], "left")


def _by_buckets(points: DataFrame, mask: DataFrame, name: str) -> DataFrame:
    """Add the nearest of very many lines of an axis, by an equi-join on buckets."""
    axis, (width, first, last) = _axis(mask, name)
    inside = F.when(F.col(name).isNotNull() & ~F.isnan(F.col(name).cast("double")), F.least(F.greatest(F.col(name), F.lit(first)), F.lit(last)))
    here = points.withColumn("_x", inside).withColumn("_bucket", F.floor(inside / width))
    on = (F.col("_bucket") == F.col(f"{name}_bucket")) & (F.col(f"{name}_from").isNull() | (F.col("_x") > F.col(f"{name}_from"))) & (F.col(f"{name}_to").isNull() | (F.col("_x") <= F.col(f"{name}_to")))
    return here.join(_small(axis), on, "left").drop("_x", "_bucket", f"{name}_bucket", f"{name}_from", f"{name}_to")


def _box(level: F.Column) -> F.Column:
    """The number of the box of a level that a cell of codes (cx, cy) lies in; level 0 is one box."""
    shift = lambda c: F.floor(F.col(c) / F.pow(F.lit(4.0), DEPTH - level)).cast("bigint")
    return level.cast("bigint") * (1 << 4 * DEPTH) + shift("cx") * (1 << 2 * DEPTH) + shift("cy")


def _pyramid(cells: DataFrame, west: float, south: float, side: float) -> tuple[DataFrame, DataFrame]:
    """(below, leaves) of cells (lon, lat, ...): the boxes in each open box with their extents, and the cells with their closed box.

    A box is closed if it holds LEAF cells at most, or at DEPTH; an open one is cut in 4 x 4.  Only boxes that
    hold cells are there, with the extents of their cells.  A closed box is below itself.
    """
    code = lambda c, low: F.least(F.floor((F.col(c) - low) / side * 4.0**DEPTH), F.lit(4**DEPTH - 1)).cast("bigint")
    coded = cells.withColumns({"cx": code("lon", west), "cy": code("lat", south)})
    levels = coded.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(DEPTH))))
    levels = levels.withColumns({"box": _box(F.col("level")), "parent": F.when(F.col("level") > 0, _box(F.col("level") - 1))})
    boxes = levels.groupBy("box", "parent", "level").agg(F.count("*").alias("n"), *(f(c).alias(f"{c}_{n}") for c in ("lon", "lat") for n, f in (("lo", F.min), ("hi", F.max))))
    open_ = (F.col("n") > LEAF) & (F.col("level") < DEPTH)
    parents = boxes.where(open_).select(F.col("box").alias("parent"))
    tree = boxes.join(parents, "parent", "left_semi").unionByName(boxes.where("level = 0"))
    child = F.struct("box", "lon_lo", "lon_hi", "lat_lo", "lat_hi").alias("child")
    closed = tree.where(~open_)
    below = tree.where("level > 0").select("parent", child).unionByName(closed.select(F.col("box").alias("parent"), child))
    below = below.groupBy("parent").agg(F.collect_list("child").alias("children"))  # 16 at most
    return below, levels.drop("cx", "cy", "level", "parent").join(closed.select("box"), "box")


def nearest_mask_curvilinear(points: DataFrame, mask: DataFrame, key: list[str]) -> DataFrame:
    """As nearest_mask for a mask whose cells (cell_id, lat, lon, value) lie anywhere; ``key`` names a point.

    A pyramid of boxes is searched from its top for all points at once: each round opens the boxes that a
    point still has, and keeps those that may be nearer than some cell surely is (every side of a box touches
    a cell).  What is left are closed boxes of few cells, which are compared.  A point may be as far from all
    cells as it likes.  Ties go to the smaller cell_id; a point or cell with a missing coordinate is near
    nothing; without cells all are null.  Rounds keep a point's boxes in one task, without a shuffle.
    """
    here = lambda df: df.where("lon is not null and lat is not null and not isnan(lon) and not isnan(lat)")
    cells = here(mask.select("cell_id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), "value"))
    cells = cells.groupBy("lon", "lat").agg(F.min(F.struct("cell_id", "value")).alias("cell"))
    n, west, east, south, north = cells.agg(F.count("*"), F.min("lon"), F.max("lon"), F.min("lat"), F.max("lat")).first()
    if not n:
        kinds = dict(mask.dtypes)
        return points.withColumns({"mask_cell": F.lit(None).cast(kinds["cell_id"]), "mask_value": F.lit(None).cast(kinds["value"])})
    state = _descend(here(points.select(*key, F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"))), cells, key, n, west, south, max(east - west, north - south) or 1.0)
    d2 = F.pow(F.col("lon") - F.col("cell_lon"), 2) + F.pow(F.col("lat") - F.col("cell_lat"), 2)
    best = state.groupBy(*key, "lon", "lat").agg(F.min(F.struct(d2.alias("d2"), F.col("cell.cell_id").alias("cell_id"), F.col("cell.value").alias("value"))).alias("best"))
    return points.join(best.select(*key, F.col("best.cell_id").alias("mask_cell"), F.col("best.value").alias("mask_value")), key, "left")


def _descend(points: DataFrame, cells: DataFrame, key: list[str], n: int, west: float, south: float, side: float) -> DataFrame:
    """Each point with every cell of the closed boxes that are left for it."""
    below, leaves = _pyramid(cells, west, south, side)
    rounds = leaves.agg(F.max(F.floor(F.col("box") / (1 << 4 * DEPTH)))).first()[0]
    held = F.broadcast if n <= BROADCAST_ROWS else (lambda df: df)
    below, leaves = held(below.withColumnRenamed("parent", "box")), held(leaves.select("box", F.col("lon").alias("cell_lon"), F.col("lat").alias("cell_lat"), "cell"))
    state = points.repartition(*key).select(*key, "lon", "lat", F.lit(0).cast("bigint").alias("box"), F.lit(float("inf")).alias("bound"))
    square = lambda x: x * x
    for _ in range(rounds):
        each = state.join(below, "box").select(*key, "lon", "lat", "bound", F.explode("children").alias("c"))
        far, near, out = {}, {}, {}
        for x in ("lon", "lat"):
            lo, hi = F.col("c")[f"{x}_lo"], F.col("c")[f"{x}_hi"]
            out[x] = square(F.greatest(lo - F.col(x), F.col(x) - hi, F.lit(0.0)))  # to the box
            a, b = square(F.col(x) - lo), square(F.col(x) - hi)
            near[x], far[x] = F.least(a, b), F.greatest(a, b)  # to its nearer and its farther side
        sure = F.least(near["lon"] + far["lat"], far["lon"] + near["lat"])
        each = each.select(*key, "lon", "lat", F.least("bound", sure).alias("sure"), F.struct(F.col("c.box").alias("box"), (out["lon"] + out["lat"]).alias("least")).alias("b"))
        kept = each.groupBy(*key, "lon", "lat").agg(F.min("sure").alias("bound"), F.collect_list("b").alias("boxes"))
        # A hair's breadth for rounding.
        state = kept.select(*key, "lon", "lat", "bound", F.explode(F.expr("filter(boxes, b -> b.least <= bound * (1 + 1e-9D))")).alias("b")).select(*key, "lon", "lat", F.col("b.box").alias("box"), "bound")
    return state.join(leaves, "box")


def select_targets(arrivals: DataFrame, mask: DataFrame, value: int = 1) -> DataFrame:
    """Distinct (release_ts, parcel_id) of arrivals (release_ts, parcel_id, lon, lat) over cells of the wanted value.

    Values are cut to integers before they are compared.  Arrivals without coordinates, and cells without a value,
    are over nothing; of repeated arrivals of a parcel one that is over the region is enough.
    """
    return nearest_mask(arrivals, mask).where(F.col("mask_value").cast("int") == value).select("release_ts", "parcel_id").distinct()
