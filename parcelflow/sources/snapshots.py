"""Binary snapshots of parcels, one file per time: a splittable Spark data source, their catalogue, and the landed tables.

A plain file is cut into ranges of records, each read by a task of its own; only .gz files are read as a
stream by one task.  Filters on time, place and parcel go down into the source: files of other times are
never opened, and of the rest only the records that pass become rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, datasource
from pyspark.sql import functions as F

from ..functions.geo import in_domain
from .files import file_system

# The layout of a record (little-endian) and the mark of a missing value.
RECORD = np.dtype([
    ("mark", "<i4"), ("parcel_id", "<i4"), ("lon", "<f4"), ("lat", "<f4"), ("z", "<f4"), ("released", "<i4"), ("topo", "<f4"), ("pv", "<f4"),
    ("q", "<f4"), ("rho", "<f4"), ("hmix", "<f4"), ("tropo", "<f4"), ("t_k", "<f4"), ("mass", "<f4"), ("end", "<i4"),
])
HEADER, MISSING, ABSENT = 12, -500.0, -999.9
COLUMNS = ["lon", "lat", "q", "z", "topo", "rho", "hmix", "tropo", "t_k", "mass"]
SCHEMA = "obs_ts timestamp, parcel_id int, " + ", ".join(f"{c} double" for c in COLUMNS)
#: Records of a range, and records that are decoded at once.
SPLIT, BATCH = 2_000_000, 200_000
#: Records that small files are packed to at least, before there are as many tasks as cores; also when they are written.
SMALL = 50_000
#: Most partitions that files are dealt over when they are written, and the level of their compression: gzip's own, as 9 takes eight times as long for 6 % less.
WRITERS, LEVEL = 10_000, 6
_NAME = re.compile(r"partposit_(\d{14})(\.gz)?$")
_TESTS = {datasource.EqualTo: np.equal, datasource.GreaterThan: np.greater, datasource.GreaterThanOrEqual: np.greater_equal, datasource.LessThan: np.less, datasource.LessThanOrEqual: np.less_equal, datasource.In: lambda x, v: np.isin(x, list(v))}


@dataclass
class Records:
    """``count`` records of a file from ``first`` on; a .gz file is one range that holds all of it (count -1)."""

    path: str
    first: int
    count: int


@dataclass
class Ranges(datasource.InputPartition):
    """What one task reads: a range of a large file, or several small ones."""

    ranges: list[Records]


class SnapshotReader(datasource.DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.path, self.layout = options["path"], options.get("layout", "global")
        self.split, self.compat = int(options.get("split", SPLIT)), options.get("compat", "false") == "true"
        self.tasks = int(options.get("tasks", 1))
        self.zone, self.columns = options.get("timezone", "UTC"), columns
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters):
        """Comparisons with values and tests for nulls are done here, in full; the rest is left to Spark."""
        for f in filters:
            kind, name = type(f), ".".join(f.attribute) if hasattr(f, "attribute") else ""
            if name in ("obs_ts", "parcel_id", *COLUMNS) and (kind in _TESTS and f.value is not None or kind is datasource.IsNotNull):
                self.tests.append((name, kind, getattr(f, "value", None)))
            else:
                yield f

    def _time(self, name: str) -> datetime:
        return datetime.strptime(_NAME.search(name)[1], "%Y%m%d%H%M%S").replace(tzinfo=ZoneInfo(self.zone))

    def _wanted(self, time: datetime) -> bool:
        def utc(v):
            return np.datetime64(v.astimezone(timezone.utc).replace(tzinfo=None) if v.tzinfo else v)

        own = utc(time)
        return all(kind is datasource.IsNotNull or bool(_TESTS[kind](own, [utc(v) for v in value] if kind is datasource.In else utc(value))) for name, kind, value in self.tests if name == "obs_ts")

    def partitions(self) -> list[Ranges]:
        """Ranges of all wanted files, small ones together; names and sizes are listed, nothing is opened."""
        from pyarrow import fs

        system, top = file_system(self.path)
        found = system.get_file_info(fs.FileSelector(top, recursive=True))
        ranges, sizes = [], []
        for info in sorted((i for i in found if i.type == fs.FileType.File and _NAME.search(i.base_name) and self._wanted(self._time(i.base_name))), key=lambda i: i.path):
            n = max(0, (info.size - HEADER) // RECORD.itemsize - (self.layout == "global"))
            if info.path.endswith(".gz"):
                ranges.append(Records(info.path, 0, -1))
                sizes.append(4 * n)  # about, as compressed
                continue
            for at in range(0, n, self.split):
                ranges.append(Records(info.path, at, min(self.split, n - at)))
                sizes.append(min(self.split, n - at))
        room = min(self.split, max(SMALL, -(-sum(sizes) // self.tasks)))
        out: list[Ranges] = [Ranges([])]
        held = 0
        for r, size in zip(ranges, sizes):
            if out[-1].ranges and held + size > room:
                out.append(Ranges([]))
                held = 0
            out[-1].ranges.append(r)
            held += size
        return out

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.path)
        for r in partition.ranges:
            time = self._time(r.path).astimezone(timezone.utc)
            for part in self._records(system, r):
                if not len(part := part[self._passes(part)]):
                    continue
                arrays = []
                for c in self.columns:
                    if c == "obs_ts":
                        arrays.append(pa.repeat(pa.scalar(time, pa.timestamp("us", tz="UTC")), len(part)))
                    elif c == "parcel_id":
                        arrays.append(pa.array(part[c]))
                    else:
                        x = part[c].astype(float)
                        arrays.append(pa.array(x, mask=~(x >= MISSING)))
                yield pa.record_batch(arrays, names=self.columns)

    def _passes(self, part: np.ndarray) -> np.ndarray:
        keep = np.ones(len(part), bool)
        for name, kind, value in self.tests:
            if name == "obs_ts":
                continue
            x = part[name]
            if name != "parcel_id":
                x = x.astype(float)
                keep &= x >= MISSING  # a null passes no test
            if kind is not datasource.IsNotNull:
                keep &= _TESTS[kind](x, value)
        return keep

    def _records(self, system, r: Records) -> Iterator[np.ndarray]:
        """The records of a range, some at a time, without the closing record and, with ``compat``, without the last parcel."""
        less = int(self.compat)
        if r.count >= 0:
            with system.open_input_file(r.path) as f:
                whole = (f.size() - HEADER) // RECORD.itemsize - 1 if self.layout == "global" else int(np.frombuffer(f.read(HEADER), "<i4")[2])
                end = min(r.first + r.count, whole - less)
                f.seek(HEADER + r.first * RECORD.itemsize)
                for at in range(r.first, end, BATCH):
                    yield np.frombuffer(f.read(min(BATCH, end - at) * RECORD.itemsize), RECORD)
            return
        with system.open_input_stream(r.path, compression="gzip") as f:
            head = f.read(HEADER)
            left = int(np.frombuffer(head, "<i4")[2]) - less if self.layout == "wrf" else None
            held = b""  # what may be the closing record, and the last parcel
            while left is None or left > 0:
                raw = f.read(BATCH * RECORD.itemsize)
                data = held + raw
                whole = len(data) // RECORD.itemsize
                n = max(0, whole - 1 - less) if left is None else min(whole, left)
                if n:
                    yield np.frombuffer(data[: n * RECORD.itemsize], RECORD)
                held = data[n * RECORD.itemsize :]
                left = left if left is None else left - n
                if not raw:
                    return


class SnapshotSource(datasource.DataSource):
    """spark.read.format("parcel_snapshots"): options path, layout, split, compat and timezone; a schema of fewer columns decodes fewer."""

    @classmethod
    def name(cls) -> str:
        return "parcel_snapshots"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SnapshotReader:
        return SnapshotReader(self.options, schema.fieldNames())


def ingest_snapshots(spark: SparkSession, path: str, layout: str = "global", box: tuple[float, float, float, float] | None = None, compat: bool = False, columns: list[str] | None = None, split: int = SPLIT) -> DataFrame:
    """Parcels of all snapshot files below ``path``: obs_ts, parcel_id, lon, lat, ... as doubles, missing values null.

    ``layout`` "global" takes the number of parcels from the file's length, less a closing record; "wrf"
    from its header.  The time comes from the 14 digits of the file name, in the session's time zone.
    ``box`` (x_left, x_right, y_low, y_up) keeps parcels within it and one degree around; with ``compat``
    the last parcel of a file is left out.  A plain file is read in ranges of ``split`` records, small
    files several at a time.  Filters on
    the result go down into the source; ``columns`` decodes only those.  Files without parcels, and folders
    without files, give no rows; a parcel that is twice in a file comes twice.
    """
    if layout not in ("global", "wrf"):
        raise ValueError("layout is global or wrf")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SnapshotSource)
    types = dict(c.split() for c in SCHEMA.split(", "))
    wanted = ["obs_ts", "parcel_id", *COLUMNS] if columns is None else columns
    # A box tests coordinates whether or not they are wanted; its columns are dropped again.
    read = wanted + [c for c in ("lon", "lat") if box and c not in wanted]
    rows = spark.read.format("parcel_snapshots").schema(", ".join(f"{c} {types[c]}" for c in read)).options(path=path, layout=layout, split=split, tasks=spark.sparkContext.defaultParallelism, compat=str(compat).lower(), timezone=spark.conf.get("spark.sql.session.timeZone")).load()
    return rows.where(in_domain(F.col("lon"), F.col("lat"), *box)).select(*wanted) if box else rows


def snapshot_catalogue(spark: SparkSession, path: str, layout: str = "global") -> DataFrame:
    """One row per snapshot file below ``path``: path, obs_ts, bytes and records (null where only the content tells); no content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "partposit_*").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("bytes"))
    digits = F.regexp_extract("path", r"partposit_(\d{14})(\.gz)?$", 1)
    told = F.lit(layout == "global") & ~F.endswith("path", F.lit(".gz"))
    count = F.when(told, F.greatest(F.lit(0), F.floor((F.col("bytes") - HEADER) / RECORD.itemsize) - 1).cast("bigint"))
    return files.where(digits != "").select("path", F.to_timestamp(digits, "yyyyMMddHHmmss").alias("obs_ts"), "bytes", count.alias("records"))


def write_snapshots(obs: DataFrame, path: str, layout: str = "global", compress: bool = False) -> int:
    """Write observations as snapshot files, one per obs_ts, parcels in ascending order; the number of files is returned.

    Columns that ``obs`` lacks, and nulls, are written as missing.  A file appears under its name when it
    is complete, so a repeated task replaces its files.  Rows without a time or a parcel are left out.
    """
    if layout not in ("global", "wrf"):
        raise ValueError("layout is global or wrf")
    have = [c for c in COLUMNS if c in obs.columns]
    name = F.date_format("obs_ts", "yyyyMMddHHmmss").alias("name")
    rows = obs.where("obs_ts is not null and parcel_id is not null").select(name, F.col("parcel_id").cast("int").alias("parcel_id"), *(F.col(c).cast("double").alias(c) for c in have))
    parcels = {r.name: r.n for r in rows.groupBy("name").agg(F.count("*").alias("n")).collect()}  # a row a file
    if not parcels:
        return 0
    # Ranges, not hashes: Spark drops a repartition by hash after a join on the same column, and reads such a join by mapper once its
    # other side is broadcast; a file would then be written by several tasks.  Four ranges a file leave each large file a task of its own.
    tasks = max(1, min(4 * len(parcels), sum(parcels.values()) // SMALL, WRITERS))
    rows = rows.repartitionByRange(tasks, "name").sortWithinPartitions("name", "parcel_id")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        system, top = file_system(path)
        system.create_dir(top, recursive=True)
        now = out = packed = None
        done = 0

        def put(data: np.ndarray) -> None:
            out.write(packed.compress(data.tobytes()) if compress else data.tobytes())

        def close() -> None:
            put(np.zeros(1, RECORD))
            if compress:
                out.write(packed.flush())
            out.close()
            system.move(f"{top}/.{now}.{os.getpid()}", f"{top}/partposit_{now}{'.gz' if compress else ''}")

        for batch in batches:
            names = batch.column(0).to_numpy(zero_copy_only=False)
            data = np.zeros(len(names), RECORD)
            data["mark"] = data["end"] = RECORD.itemsize - 8
            data["parcel_id"] = batch.column(1).to_numpy()
            for c in COLUMNS:
                data[c] = np.nan_to_num(batch.column(2 + have.index(c)).to_numpy(zero_copy_only=False).astype(float), nan=ABSENT) if c in have else ABSENT
            cuts = np.concatenate([[0], np.flatnonzero(names[1:] != names[:-1]) + 1, [len(names)]]) if len(names) else []
            for a, b in zip(cuts[:-1], cuts[1:]):
                if names[a] != now:
                    if now:
                        close()
                    now, done = names[a], done + 1
                    out = system.open_output_stream(f"{top}/.{now}.{os.getpid()}", compression=None)
                    packed = zlib.compressobj(LEVEL, zlib.DEFLATED, 31) if compress else None  # 31: with gzip's header
                    put(np.array([4, 0, parcels[now]], "<i4"))
                put(data[a:b])
        if now:
            close()
        yield pa.record_batch([pa.array([done], pa.int64())], names=["files"])

    return rows.mapInArrow(write, "files bigint").agg(F.sum("files")).first()[0] or 0


def write_observations(obs: DataFrame, path: str) -> None:
    """Parquet by obs_date, so that a run opens only the days it needs; days that ``obs`` holds replace those there, others stay.

    Rows without a time go to a partition of their own; repeated rows stay.
    """
    rows = obs.withColumn("obs_date", F.to_date("obs_ts")).repartition("obs_date").sortWithinPartitions("obs_ts", "parcel_id")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("obs_date").parquet(path)


def read_observations(spark: SparkSession, path: str, steps: DataFrame | None = None) -> DataFrame:
    """Landed observations; with ``steps`` only their days are opened: a list of calendar days goes into the scan."""
    obs = spark.read.parquet(path)
    return obs.where(F.col("obs_date").isin(needed_days(steps))) if steps is not None else obs


def needed_days(steps: DataFrame) -> list:
    """The distinct days of obs_ts, in order: at most one a calendar day."""
    return [r[0] for r in steps.where("obs_ts is not null").select(F.to_date("obs_ts").alias("d")).distinct().orderBy("d").collect()]


def load_mask(mask: DataFrame, lat: str = "lat", lon: str = "lon", value: str = "value") -> DataFrame:
    """(lat, lon, value) of a mask table by its column names, longitudes over 180 less 360; nulls stay, other columns go."""
    x = F.col(lon).cast("double")
    return mask.select(F.col(lat).cast("double").alias("lat"), F.when(x > 180, x - 360).otherwise(x).alias("lon"), F.col(value).cast("int").alias("value"))


def load_mask_axes(mask: DataFrame, lat: str = "lat", lon: str = "lon", value: str = "value") -> DataFrame:
    """(lat, lon, value) of a mask given as two axes and its lines: array columns ``lat``, ``lon`` and ``value`` (one array a latitude) of one row.

    The mesh follows from positions: each line of values is met with its latitude, each value with its
    longitude, within the row, so nothing is joined.  Lines or values without a coordinate get a null one;
    longitudes over 180 are put below 0 as in ``load_mask``.  Several rows are several masks, one after the other.
    """
    lines = mask.select(F.col(lat).alias("_lats"), F.col(lon).alias("_lons"), F.posexplode(F.col(value)).alias("_iy", "_line"))
    cells = lines.select(F.get("_lats", F.col("_iy")).alias("lat"), "_lons", F.posexplode("_line").alias("_ix", "value"))
    return load_mask(cells.select("lat", F.get("_lons", F.col("_ix")).alias("lon"), "value"))
