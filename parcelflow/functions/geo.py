"""Longitudes, the output grid and cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import EARTH_RADIUS, Grid


def mean_longitude(a: Column, b: Column) -> Column:
    """Mean of two longitudes, across the antimeridian where that is shorter; of one if the other is missing."""
    a, b = (x - 360.0 * (x >= 180).cast("double") for x in (a, b))
    size = F.abs(a) + F.abs(b)
    crosses = ((a * b < 0) & (size > 180) & (size < 540)).cast("double")
    mean = (a + b + 360.0 * crosses) / 2
    return F.coalesce(mean - 360.0 * (mean >= 180).cast("double"), a, b)


def wrap_longitude(lon: Column) -> Column:
    """Into 0..360."""
    return F.pmod(lon + 360, F.lit(360.0))


def in_domain(lon: Column, lat: Column, x_left: float, x_right: float, y_low: float, y_up: float) -> Column:
    """Inside a box with one degree to spare, bounds included; goes down to the Parquet scan."""
    return lon.between(x_left - 1, x_right + 1) & lat.between(y_low - 1, y_up + 1)


def output_grid(spark: SparkSession, grid: Grid) -> DataFrame:
    """One row per cell: iy, ix, edges, centre and area in m2."""
    ids = spark.range(grid.nx * grid.ny)
    cell = ids.select(F.expr(f"id div {grid.nx}").alias("iy"), (F.col("id") % grid.nx).alias("ix"))
    edges = cell.withColumns({
        "lat_lo": grid.lat0 + F.col("iy") * grid.resolution, "lat_hi": grid.lat0 + (F.col("iy") + 1) * grid.resolution,
        "lon_lo": grid.lon0 + F.col("ix") * grid.resolution, "lon_hi": grid.lon0 + (F.col("ix") + 1) * grid.resolution,
    })
    return edges.withColumns({"lat": (F.col("lat_lo") + F.col("lat_hi")) / 2, "lon": (F.col("lon_lo") + F.col("lon_hi")) / 2, "area": cell_area(F.col("iy"), grid)})


def cell_area(iy: Column, grid: Grid) -> Column:
    """Area of a cell of row iy on the sphere, in m2; no join needed."""
    lo, hi = grid.lat0 + iy * grid.resolution, grid.lat0 + (iy + 1) * grid.resolution
    return F.abs(F.radians(F.lit(1.0)) * EARTH_RADIUS**2 * (F.sin(F.radians(lo)) - F.sin(F.radians(hi)))) * grid.resolution


def assign_cell(points: DataFrame, grid: Grid, wrap: bool | Column = True) -> DataFrame:
    """Add ix and iy; a point on a cell's edge, outside the grid or nowhere has a null in either or both.

    Cells are found by division, so no join with the grid is needed: the nearest edge is that of the rounded
    quotient, and the side of it on which a point lies decides.  ``wrap`` (for some rows, if a column) puts
    longitudes into 0..360 on grids that run over 180 degrees.
    """
    x = F.col("lon")
    if grid.centred_180 and wrap is not False:
        x = wrap_longitude(x) if wrap is True else F.when(wrap, wrap_longitude(x)).otherwise(x)
    # Generated rows, of the coordinates and of the cells: filters on cells stay above them, so no long expression is written out twice.
    out = points.select("*", F.inline(F.array(F.struct(x.alias("_x"), F.col("lat").alias("_y")))))
    cells = []
    for name, value, low, n in (("ix", F.col("_x"), grid.lon0, grid.nx), ("iy", F.col("_y"), grid.lat0, grid.ny)):
        near = F.rint((value - low) / grid.resolution)
        edge = low + near * grid.resolution
        inside = (near >= 0) & (near <= n)  # else the index may not fit a bigint
        index = F.when(inside & (value > edge) & (near < n), near).when(inside & (value < edge) & (near > 0), near - 1)
        cells.append(index.cast("bigint").alias(name))
    return out.select("*", F.inline(F.array(F.struct(*cells)))).drop("_x", "_y")
