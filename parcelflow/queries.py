"""Registered queries over tables derived from the given ones, and the same in plain SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures
from .functions.geo import assign_cell, cell_area, in_domain
from .functions.thermo import with_thermo
from .operators.schedule import missing_inputs, release_schedule, step_schedule
from .operators.targets import nearest_mask_curvilinear, select_targets
from .operators.trajectory import arrivals, filter_arrival_pbl, filter_precipitating, segments, trajectories
from .params import HEAT, MOISTURE, Grid, Heat, Job, Moisture
from .plans.attribute import Tracked, attributed_fraction, contribution_pct, densify, grid_integrated, grid_sum, parcel_summary, run_stats, to_flux, track

JOB, GRID = Job(), Grid()
CUSTOM_HEAT = Heat("potTemp", gain=0.5, pbl_mode=1, pbl_height="mean", arrival_pbl=(0.0, 3500.0), rh=60.0, q=2.5, discount=False)
CUSTOM_MOISTURE = Moisture(rain=-0.0003, gain=0.0003, pbl_mode=2, pbl_height="actual", min_rh=20.0, arrival_pbl=(100.0, 2000.0), rh=40.0)
METHODS = {**{f"heat_{k.lower()}": v for k, v in HEAT.items()}, "heat_custom": CUSTOM_HEAT, **{f"moisture_{k.lower()}": v for k, v in MOISTURE.items()}, "moisture_custom": CUSTOM_MOISTURE}


def _round(name: str, digits: int = 6) -> F.Column:
    return (F.round(F.col(name), digits) + F.lit(0.0)).alias(name)


def _trajectories(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    if kind == "gappy":
        obs = fixtures.gappy(spark, sf_dir)
        return trajectories(obs.drop("b"), fixtures.gappy_targets(obs), JOB)
    return fixtures.dense(spark, sf_dir, 4 if kind == "multi" else 1)


def _run(spark: SparkSession, sf_dir: str, method, kind: str = "dense") -> Tracked:
    return track(_trajectories(spark, sf_dir, kind), method, JOB, GRID)


def _rel(df: DataFrame) -> DataFrame:
    """The release as six-hour number since 1970."""
    return df.withColumn("rel", F.expr("unix_timestamp(release_ts) div 21600"))


def daily(spark: SparkSession, sf_dir: str, method, kind: str = "dense") -> DataFrame:
    run = _run(spark, sf_dir, method, kind)
    return _rel(to_flux(grid_sum(run), run)).select("rel", "day", "iy", "ix", "n", _round("flux"))


def integrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _run(spark, sf_dir, MOISTURE["SOD08"])
    return _rel(grid_integrated(to_flux(grid_sum(run), run))).select("rel", "iy", "ix", "n", _round("flux"))


def dense_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _run(spark, sf_dir, MOISTURE["SOD08"])
    return densify(to_flux(grid_sum(run), run), run).select("day", "iy", "ix", "lat", "lon", _round("flux"))


def stats(spark: SparkSession, sf_dir: str, method, kind: str = "dense") -> DataFrame:
    return _rel(run_stats(_run(spark, sf_dir, method, kind))).select("rel", "n_target", "n_filtered", "n_no_uptake", "pct_filtered", "pct_no_uptake", _round("residence_days"))


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parcel_summary(_run(spark, sf_dir, MOISTURE["SOD08"])).select("parcel_id", _round("kept", 9), _round("residence_minutes", 4), "uptake")


def contribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contribution_pct(_run(spark, sf_dir, MOISTURE["SOD08"])).select("day", "iy", "ix", _round("pct", 8))


def fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rel(attributed_fraction(_run(spark, sf_dir, MOISTURE["SOD08"], "gappy"))).select("rel", _round("fraction"), _round("q_arrival"))


def discounted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, MOISTURE["APA22"]).segments.select("parcel_id", "segment", _round("value", 9), _round("kept", 9))


def thermo(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fixtures.dense(spark, sf_dir)
    both = with_thermo(d, "dse").withColumnRenamed("heat_var", "dse")
    return with_thermo(both, "potTemp").select("parcel_id", "step", _round("dse"), _round("heat_var"), _round("rh"))


def gappy_segments(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    segs = segments(with_thermo(_trajectories(spark, sf_dir, "gappy")), JOB, kind)
    return _rel(segs).select("rel", "parcel_id", "segment", F.unix_timestamp("mid_ts").alias("mid"), *(_round(c) for c in ("lon", "lat", "dq", "dheat", "drh", "pair_max", "pair_mean")))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = fixtures.dense(spark, sf_dir).withColumn("lat", F.round(F.col("lat") * 4 - 0.12) / 4)  # many on edges
    g = Grid(0.5, 480, 240, 0.0, -60.0)
    return assign_cell(points, g).where("ix is not null and iy is not null").select("parcel_id", "step", "iy", "ix", F.round(cell_area(F.col("iy"), g), 1).alias("area"))


def arrival_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrived = arrivals(with_thermo(fixtures.dense(spark, sf_dir)))
    parts = [filter_precipitating(arrived, -0.0002, 80.0).select("parcel_id", F.lit("rain").alias("passed"))]
    parts += [filter_arrival_pbl(arrived, 50.0, 500.0, m).select("parcel_id", F.lit(m).alias("passed")) for m in ("max", "mean", "actual")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def targets_by_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    here = fixtures.dense(spark, sf_dir).where("step = 0")
    return select_targets(here, fixtures.lattice_mask(spark)).select("parcel_id")


def curvilinear_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = fixtures.table(spark, sf_dir, "supplier").selectExpr("s_suppkey as cell_id", "(s_suppkey * 37 % 120) / 1e0 - 60e0 + 0.011e0 * s_suppkey as lat", "(s_suppkey * 53 % 360) / 1e0 - 180e0 as lon", "cast(s_suppkey % 7 as int) as value")
    here = fixtures.dense(spark, sf_dir).where("step = 0").select("parcel_id", "lat", "lon")
    return nearest_mask_curvilinear(here, mask, ["parcel_id"]).select("parcel_id", "mask_cell", "mask_value")


def needed_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = fixtures.gappy(spark, sf_dir)
    releases = obs.select(F.col("obs_ts").alias("release_ts")).distinct()
    return _rel(missing_inputs(step_schedule(releases, JOB), obs)).select("rel", "step")


def noleap_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of every order date without leap days: how many, the oldest and the sum of all times."""
    releases = fixtures.table(spark, sf_dir, "orders").where("not (month(o_orderdate) = 2 and day(o_orderdate) = 29)").select(F.col("o_orderdate").cast("timestamp").alias("release_ts")).distinct()
    steps = _rel(step_schedule(releases, Job(calendar="365d")))
    return steps.groupBy("rel").agg(F.count("*").alias("n"), F.expr("min(unix_timestamp(obs_ts)) div 21600").alias("oldest"), F.expr("sum(unix_timestamp(obs_ts) div 21600)").alias("total"))


def scheduled_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per release of a schedule: their days are the releases' days."""
    releases = release_schedule(spark, [1995, 1996], [2, 3], [1, 27], [0, 12], n_days=4)
    orders = fixtures.table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    return _rel(releases.join(orders, F.to_date("release_ts") == F.col("day"))).select("rel", "n")


def box_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations per parcel within a padded box."""
    d = fixtures.dense(spark, sf_dir).where(in_domain(F.col("lon"), F.col("lat"), -30.0, 45.0, 0.0, 60.0))
    return d.groupBy("parcel_id").agg(F.count("*").alias("n"), F.sum("step").alias("steps"))


# ---- the same in SQL ----

_OBS = """((c * 137 + (41 - k) * 3) % 3600) / 10e0 - 180e0 + 0.03e0 AS lon, ((c * 61) % 1400 + (41 - k) * 2) / 10e0 - 70e0 + 0.03e0 AS lat,
 (20 + (c * 31 + k * k * 17 + k * (c % 13) * 7) % 160) / 10000e0 AS q, ((c * 13 + k * 211) % 4000) / 1e0 AS z, ((c * 17 + k * 307) % 3000) / 1e0 AS hmix,
 (70 + (c + k * 7) % 50) / 100e0 AS rho, (255 + (c * 3 + k * 11) % 45) / 1e0 AS t_k"""
_REL = 66484  # 2015-07-05 00:00 in six-hour steps since 1970
_BASE = {
    "dense": f"d AS (SELECT c AS parcel_id, {_REL} AS rel, k AS step, {_OBS} FROM (SELECT c_custkey AS c FROM customer), (SELECT unnest(range(42)) AS k))",
    "multi": f"d AS (SELECT c AS parcel_id, {_REL} + r AS rel, k AS step, {_OBS} FROM (SELECT o_orderkey AS c FROM orders), (SELECT unnest(range(4)) AS r), (SELECT unnest(range(42)) AS k))",
    "gappy": """g AS (SELECT user_id AS parcel_id, CAST(floor(epoch(ts) / 21600) AS BIGINT) AS b, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS c, count(*) AS n, min(event_id) AS m FROM events GROUP BY ALL),
 o AS (SELECT parcel_id, b, ((parcel_id * 37 + b * 3) % 3600) / 10e0 - 180e0 + 0.03e0 AS lon, ((parcel_id * 61) % 1400 + (b % 100) * 2) / 10e0 - 70e0 + 0.03e0 AS lat, (20 + c % 160) / 10000e0 AS q,
 ((c * 13 + n * 101) % 4000) / 1e0 AS z, ((c * 17 + m * 29) % 3000) / 1e0 AS hmix, (70 + c % 50) / 100e0 AS rho, (255 + (m * 3 + c) % 45) / 1e0 AS t_k FROM g),
 d AS (SELECT s.parcel_id, s.rel, s.step, lon, lat, q, z, hmix, rho, t_k FROM (SELECT parcel_id, rel, step, rel - step AS b FROM (SELECT DISTINCT parcel_id FROM g), (SELECT unnest([78936, 78937, 78938, 78939]) AS rel), (SELECT unnest(range(42)) AS step)) s LEFT JOIN o USING (parcel_id, b))""",
}
_DSE = "(1005.7e0 * t_k + 9.780327e0 * (1 + 0.0053024e0 * pow(sin(radians(lat)), 2) - 0.0000058e0 * pow(sin(2 * radians(lat)), 2)) * z) / 1000"
_POT = "t_k * pow(1000 / (p / 100), 0.2854e0 * (1 - 0.00028e0 * (r * 1000)))"


def _r(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0e0"


def _thermo_sql(kind: str, heat: str) -> str:
    return f"""WITH {_BASE[kind]},
p AS (SELECT *, rho * 287.057e0 * (t_k * (1 + r / 0.6620e0) / (1 + r)) AS p FROM (SELECT *, -q / (q - 1) AS r FROM d)),
h AS (SELECT *, {heat} AS hv, 100 * (q * p / (0.622e0 + 0.378e0 * q)) / (611.2e0 * exp(17.67e0 * (t_k - 273.15e0) / (t_k - 273.15e0 + 243.5e0))) AS rv FROM p),
th AS (SELECT *, CASE WHEN hv >= 0 THEN hv END AS heat_var, CASE WHEN rv >= 0 THEN rv END AS rh FROM h)"""


_ARRIVED = """arr AS (SELECT rel, parcel_id, max(q) FILTER (step = 0) AS q0, max(q) FILTER (step = 1) AS q1, max(rh) FILTER (step = 0) AS rh0, max(rh) FILTER (step = 1) AS rh1, max(z) FILTER (step = 0) AS z0,
 max(hmix) FILTER (step < 4) AS h_max, avg(hmix) FILTER (step < 4) AS h_mean, max(hmix) FILTER (step = 0) AS h_actual FROM th GROUP BY ALL)"""


def _segments_sql(heat: bool, source: str = "th") -> str:
    used, oldest = ("step <= 40", 40) if heat else ("step >= 1", 41)
    lag = ", ".join(f"lag({c}) OVER w AS {c}_a" for c in ("lon", "lat", "q", "z", "hmix", "heat_var", "rh"))
    return f"""s0 AS (SELECT *, {lag} FROM {source} WHERE {used} WINDOW w AS (PARTITION BY rel, parcel_id ORDER BY step DESC)),
s1 AS (SELECT *, CAST({oldest} - 1 - step AS INT) AS segment, CASE WHEN lon_a >= 180 THEN lon_a - 360 ELSE lon_a END AS x, CASE WHEN lon >= 180 THEN lon - 360 ELSE lon END AS y FROM s0 WHERE step < {oldest}),
s2 AS (SELECT *, CASE WHEN x IS NULL THEN y WHEN y IS NULL THEN x WHEN x * y < 0 AND (abs(x) + abs(y)) / 2 > 90 AND (abs(x) + abs(y)) / 2 < 270 THEN (x + y + 360) / 2 ELSE (x + y) / 2 END AS mx FROM s1),
seg AS (SELECT rel, parcel_id, segment, CASE WHEN mx >= 180 THEN mx - 360 ELSE mx END AS lon, (lat_a + lat) / 2 AS lat, q - q_a AS dq, heat_var - heat_var_a AS dheat, rh - rh_a AS drh, q_a AS q_start,
 z_a AS z_start, z AS z_end, hmix_a AS h_start, hmix AS h_end, greatest(hmix_a, hmix) AS pair_max, (hmix_a + hmix) / 2 AS pair_mean FROM s2)"""


def _run_sql(method, kind: str) -> str:
    """CTEs up to ``res``: segments with value, kept, flag, day; ``keep``: arrived parcels."""
    heat = isinstance(method, Heat)
    where = []
    if not heat and method.rain is not None:
        where.append(f"q0 - q1 < {method.rain!r} AND (rh0 + rh1) / 2 >= {method.min_rh!r}")
    if method.arrival_pbl is not None:
        where.append(f"z0 BETWEEN {method.arrival_pbl[0]!r} AND greatest(h_max, {method.arrival_pbl[1]!r})")
    value = "dheat" if heat else "dq"
    flags = [f"coalesce({value} {'>' if heat else '>='} {method.gain!r}, false)"]
    if method.pbl_mode:
        a, b = {"max": ("pair_max", "pair_max"), "mean": ("pair_mean", "pair_mean"), "actual": ("h_start", "h_end")}[method.pbl_height]
        flags.append(f"(coalesce(z_start <= {a}, false) {'OR' if method.pbl_mode == 1 else 'AND'} coalesce(z_end <= {b}, false))")
    if method.rh is not None:
        flags.append(f"coalesce(abs(drh) <= {method.rh!r}, false)")
    if heat and method.q is not None:
        flags.append(f"coalesce(abs(dq) / q_start <= {method.q!r}, false)")
    discount = """c1 AS (SELECT *, sum(value) OVER (PARTITION BY rel, parcel_id ORDER BY segment ROWS UNBOUNDED PRECEDING) AS c FROM f0),
c2 AS (SELECT *, c - least(0, min(c) OVER (PARTITION BY rel, parcel_id ORDER BY segment ROWS UNBOUNDED PRECEDING)) AS s FROM c1),
c3 AS (SELECT *, lag(s) OVER (PARTITION BY rel, parcel_id ORDER BY segment) AS sp FROM c2),
c4 AS (SELECT *, CASE WHEN value > 0 THEN 1 WHEN sp > 0 THEN s / sp ELSE 0 END AS f FROM c3),
res AS (SELECT *, CASE WHEN value > 0 THEN value * coalesce(product(f) OVER (PARTITION BY rel, parcel_id ORDER BY segment DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) ELSE 0 END AS kept, CAST(segment // 4 - 10 AS INT) AS day FROM c4)"""
    plain = "res AS (SELECT *, value AS kept, CAST(segment // 4 - 10 AS INT) AS day FROM f0)"
    return f"""{_thermo_sql(kind, _POT if heat and method.var == "potTemp" else _DSE)},
{_ARRIVED}, keep AS (SELECT * FROM arr WHERE {" AND ".join(where) or "true"}),
used AS (SELECT th.* FROM th SEMI JOIN keep USING (rel, parcel_id)),
{_segments_sql(heat, "used")},
f0 AS (SELECT *, coalesce({value}, 0) AS value, CASE WHEN {" AND ".join(flags)} THEN 1 ELSE 0 END AS flag FROM seg),
{discount if method.discount else plain}"""


def _grid_sql(res: float = 1.0, nx: int = 360, ny: int = 180, lon0: float = -180.0, lat0: float = -90.0) -> str:
    x, y = f"((lon - {lon0!r}) / {res!r})", f"((lat - {lat0!r}) / {res!r})"
    return f"""cell AS (SELECT *, CAST(floor{y} AS BIGINT) AS iy, CAST(floor{x} AS BIGINT) AS ix FROM res WHERE flag = 1 AND lon > {lon0!r} AND lon < {lon0 + nx * res!r} AND lat > {lat0!r} AND lat < {lat0 + ny * res!r}
 AND floor{x} <> {x} AND floor{y} <> {y}),
day_sum AS (SELECT rel, day, iy, ix, sum(kept) AS total, count(*) AS n FROM cell GROUP BY ALL)"""


_MASS = "(5148000000000000000e0 / 1997651)"


def _area(res: float = 1.0, lat0: float = -90.0) -> str:
    return f"(abs(radians(1e0) * 6371000e0 * 6371000e0 * (sin(radians({lat0!r} + iy * {res!r})) - sin(radians({lat0!r} + (iy + 1) * {res!r})))) * {res!r})"


def _flux(method, area: str) -> str:
    if isinstance(method, Heat):
        return f"{1000.0 if method.var == 'dse' else 1005.7!r} * total * {_MASS} / ({area} * 21600)"
    return f"total * {_MASS} / {area}"


def _daily_sql(method, kind: str = "dense") -> str:
    return f"{_run_sql(method, kind)}, {_grid_sql()} SELECT CAST(rel AS BIGINT) AS rel, day, iy, ix, n, {_r(_flux(method, _area()))} AS flux FROM day_sum"


def _summary_sql(method, kind: str) -> str:
    took = "sum(kept) > sum(abs(value)) * 1e-12" if method.discount else "max(flag) = 1"
    return f"""{_run_sql(method, kind)}, per AS (SELECT rel, parcel_id, sum(kept) AS kept, {took} AS uptake,
 CASE WHEN sum(kept * flag) > sum(abs(value)) * 1e-12 THEN abs(sum(-(14400 + 360 - segment * 360 - 180) * kept * flag) / sum(kept * flag)) END AS residence_minutes FROM res GROUP BY ALL)"""


def _stats_sql(method, kind: str = "dense") -> str:
    return f"""{_summary_sql(method, kind)}, t AS (SELECT rel, count(DISTINCT parcel_id) AS n_target FROM d GROUP BY ALL),
a AS (SELECT rel, count(*) AS n_filtered, count(*) FILTER (NOT uptake) AS n_no_uptake, avg(residence_minutes) AS minutes FROM per GROUP BY ALL)
SELECT CAST(rel AS BIGINT) AS rel, n_target, coalesce(n_filtered, 0) AS n_filtered, coalesce(n_no_uptake, 0) AS n_no_uptake, round(100e0 * coalesce(n_filtered, 0) / nullif(n_target, 0), 2) AS pct_filtered,
 round(100e0 * n_no_uptake / nullif(n_filtered, 0), 2) AS pct_no_uptake, {_r("minutes / 1440")} AS residence_days FROM t LEFT JOIN a USING (rel)"""


_SOD, _APA = MOISTURE["SOD08"], MOISTURE["APA22"]
_GAPPY_SEGMENTS = ", ".join(f"{_r(c)} AS {c}" for c in ("lon", "lat", "dq", "dheat", "drh", "pair_max", "pair_mean"))

QUERIES = {
    **{name: partial(daily, method=m) for name, m in METHODS.items()},
    "moisture_sod08_releases": partial(daily, method=_SOD, kind="multi"),
    "moisture_sj05_gappy": partial(daily, method=MOISTURE["SJ05"], kind="gappy"),
    "heat_sch20_gappy": partial(daily, method=HEAT["SCH20"], kind="gappy"),
    "integrated_sod08": integrated, "dense_field_sod08": dense_field,
    "stats_sch20": partial(stats, method=HEAT["SCH20"]), "stats_sod08": partial(stats, method=_SOD), "stats_apa22_gappy": partial(stats, method=_APA, kind="gappy"),
    "parcel_summary_sod08": summary, "contribution_sod08": contribution, "attributed_fraction_gappy": fraction, "linear_discount": discounted, "thermo": thermo,
    "segments_heat_gappy": partial(gappy_segments, kind="heat"), "segments_moisture_gappy": partial(gappy_segments, kind="moisture"),
    "assign_cell": cells, "arrival_filters": arrival_filters, "targets_by_mask": targets_by_mask, "curvilinear_mask": curvilinear_mask,
    "missing_inputs": needed_inputs, "noleap_steps": noleap_steps, "release_schedule": scheduled_orders, "box_scan": box_scan,
}

ORACLE_SQL = {
    **{name: _daily_sql(m) for name, m in METHODS.items()},
    "moisture_sod08_releases": _daily_sql(_SOD, "multi"),
    "moisture_sj05_gappy": _daily_sql(MOISTURE["SJ05"], "gappy"),
    "heat_sch20_gappy": _daily_sql(HEAT["SCH20"], "gappy"),
    "integrated_sod08": f"{_run_sql(_SOD, 'dense')}, {_grid_sql()} SELECT CAST(rel AS BIGINT) AS rel, iy, ix, CAST(sum(n) AS BIGINT) AS n, {_r(f'sum({_flux(_SOD, _area())})')} AS flux FROM day_sum GROUP BY rel, iy, ix",
    "dense_field_sod08": f"""{_run_sql(_SOD, 'dense')}, {_grid_sql()}, every AS (SELECT CAST(dd AS INT) - 10 AS day, y AS iy, x AS ix FROM (SELECT unnest(range(10)) AS dd), (SELECT unnest(range(180)) AS y), (SELECT unnest(range(360)) AS x))
SELECT day, iy, ix, iy - 89.5e0 AS lat, ix - 179.5e0 AS lon, {_r(f"coalesce({_flux(_SOD, _area())}, 0e0)")} AS flux FROM every LEFT JOIN day_sum USING (day, iy, ix)""",
    "stats_sch20": _stats_sql(HEAT["SCH20"]), "stats_sod08": _stats_sql(_SOD), "stats_apa22_gappy": _stats_sql(_APA, "gappy"),
    "parcel_summary_sod08": f"{_summary_sql(_SOD, 'dense')} SELECT parcel_id, {_r('kept', 9)} AS kept, {_r('residence_minutes', 4)} AS residence_minutes, uptake FROM per",
    "contribution_sod08": f"{_run_sql(_SOD, 'dense')}, {_grid_sql()} SELECT day, iy, ix, {_r('100 * total / (SELECT sum(q1) FROM keep)', 8)} AS pct FROM day_sum",
    "attributed_fraction_gappy": f"""{_run_sql(_SOD, 'gappy')}, k AS (SELECT rel, sum(kept) AS kept FROM res GROUP BY ALL), a AS (SELECT rel, sum(abs(q0 - q1)) AS change, sum(q0) AS q FROM keep GROUP BY ALL)
SELECT CAST(rel AS BIGINT) AS rel, {_r('kept / CASE WHEN change = 0 THEN 1 ELSE change END')} AS fraction, {_r('q')} AS q_arrival FROM k JOIN a USING (rel)""",
    "linear_discount": f"{_run_sql(_APA, 'dense')} SELECT parcel_id, segment, {_r('value', 9)} AS value, {_r('kept', 9)} AS kept FROM res",
    "thermo": f"{_thermo_sql('dense', _DSE)} SELECT parcel_id, CAST(step AS INT) AS step, {_r('heat_var')} AS dse, {_r(_POT)} AS heat_var, {_r('rh')} AS rh FROM th",
    "segments_heat_gappy": f"{_thermo_sql('gappy', _DSE)}, {_segments_sql(True)} SELECT CAST(rel AS BIGINT) AS rel, parcel_id, segment, CAST((rel - 40 + segment) * 21600 + 10800 AS BIGINT) AS mid, {_GAPPY_SEGMENTS} FROM seg",
    "segments_moisture_gappy": f"{_thermo_sql('gappy', _DSE)}, {_segments_sql(False)} SELECT CAST(rel AS BIGINT) AS rel, parcel_id, segment, CAST((rel - 41 + segment) * 21600 + 10800 AS BIGINT) AS mid, {_GAPPY_SEGMENTS} FROM seg",
    "assign_cell": f"""WITH {_BASE['dense']}, p AS (SELECT parcel_id, step, lon, round(lat * 4 - 0.12e0) / 4 AS lat FROM d),
c AS (SELECT parcel_id, step, lat, (lon + 360) % 360 AS lon FROM p),
i AS (SELECT parcel_id, step, CAST(floor((lat + 60) * 2) AS BIGINT) AS iy, CAST(floor(lon * 2) AS BIGINT) AS ix FROM c WHERE lon > 0 AND lon < 240 AND lat > -60 AND lat < 60 AND floor(lon * 2) <> lon * 2 AND floor(lat * 2) <> lat * 2)
SELECT parcel_id, CAST(step AS INT) AS step, iy, ix, round({_area(0.5, -60.0)}, 1) AS area FROM i""",
    "arrival_filters": f"""{_thermo_sql('dense', _DSE)}, {_ARRIVED} SELECT parcel_id, 'rain' AS passed FROM arr WHERE q0 - q1 < -0.0002e0 AND (rh0 + rh1) / 2 >= 80
UNION ALL SELECT parcel_id, 'max' FROM arr WHERE z0 BETWEEN 50 AND greatest(h_max, 500) UNION ALL SELECT parcel_id, 'mean' FROM arr WHERE z0 BETWEEN 50 AND greatest(h_mean, 500) UNION ALL SELECT parcel_id, 'actual' FROM arr WHERE z0 BETWEEN 50 AND greatest(h_actual, 500)""",
    "targets_by_mask": f"""WITH {_BASE['dense']}, lats AS (SELECT unnest(range(90)) * 2 - 89e0 AS v), lons AS (SELECT unnest(range(180)) * 2 - 179e0 AS v),
a AS (SELECT parcel_id, min_by(v, abs(v - lat) * 1e6 + v * 1e-6) AS mlat FROM d, lats WHERE step = 0 GROUP BY ALL), b AS (SELECT parcel_id, min_by(v, abs(v - lon) * 1e6 + v * 1e-6) AS mlon FROM d, lons WHERE step = 0 GROUP BY ALL)
SELECT parcel_id FROM a JOIN b USING (parcel_id) WHERE mlat BETWEEN -20 AND 20 AND mlon BETWEEN -60 AND 60""",
    "curvilinear_mask": f"""WITH {_BASE['dense']}, m AS (SELECT s_suppkey AS cell_id, (s_suppkey * 37 % 120) / 1e0 - 60e0 + 0.011e0 * s_suppkey AS mlat, (s_suppkey * 53 % 360) / 1e0 - 180e0 AS mlon, CAST(s_suppkey % 7 AS INT) AS value FROM supplier)
SELECT parcel_id, cell_id AS mask_cell, value AS mask_value FROM (SELECT parcel_id, cell_id, value, row_number() OVER (PARTITION BY parcel_id ORDER BY pow(lon - mlon, 2) + pow(lat - mlat, 2), cell_id) AS rn FROM d, m WHERE step = 0) WHERE rn = 1""",
    "missing_inputs": """WITH b AS (SELECT DISTINCT CAST(floor(epoch(ts) / 21600) AS BIGINT) AS b FROM events), s AS (SELECT b AS rel, CAST(k AS INT) AS step, b - k AS slot FROM b, (SELECT unnest(range(42)) AS k))
SELECT rel, step FROM s WHERE slot NOT IN (SELECT b FROM b)""",
    "noleap_steps": """WITH r AS (SELECT DISTINCT CAST(epoch(o_orderdate) AS BIGINT) // 21600 AS rel FROM orders WHERE NOT (month(o_orderdate) = 2 AND day(o_orderdate) = 29)),
s AS (SELECT rel, rel - k AS slot FROM r, (SELECT unnest(range(60)) AS k) WHERE NOT (month(make_timestamp((rel - k) * 21600 * 1000000)) = 2 AND day(make_timestamp((rel - k) * 21600 * 1000000)) = 29)),
f AS (SELECT rel, slot FROM (SELECT *, row_number() OVER (PARTITION BY rel ORDER BY slot DESC) AS rn FROM s) WHERE rn <= 42)
SELECT rel, count(*) AS n, min(slot) AS oldest, CAST(sum(slot) AS BIGINT) AS total FROM f GROUP BY rel""",
    "release_schedule": """WITH r AS (SELECT DISTINCT make_date(y, m, d) + CAST(n AS INT) AS day, h FROM (SELECT unnest([1995, 1996]) AS y), (SELECT unnest([2, 3]) AS m), (SELECT unnest([1, 27]) AS d), (SELECT unnest([0, 12]) AS h), (SELECT unnest(range(4)) AS n)),
o AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY ALL)
SELECT CAST(epoch(CAST(day AS TIMESTAMP)) AS BIGINT) // 21600 + h // 6 AS rel, n FROM r JOIN o USING (day)""",
    "box_scan": f"WITH {_BASE['dense']} SELECT parcel_id, count(*) AS n, CAST(sum(step) AS BIGINT) AS steps FROM d WHERE lon BETWEEN -31 AND 46 AND lat BETWEEN -1 AND 61 GROUP BY parcel_id",
}
