"""Job parameters, the output grid and the published attribution methods."""

from __future__ import annotations

from dataclasses import dataclass, replace

# Physical constants of the formulas, as the published methods use them.
G0 = 9.780327
VIRTUAL_EPSILON = 0.6620  # sic, in the virtual temperature; vapour pressure uses 0.622
R_SPECIFIC = 287.057
CP = 1005.7
EARTH_RADIUS = 6371000.0
T_REF = 273.15


@dataclass(frozen=True)
class Grid:
    """A regular output grid: nx x ny cells of ``resolution`` degrees from its lower left corner."""

    resolution: float = 1.0
    nx: int = 360
    ny: int = 180
    lon0: float = -180.0
    lat0: float = -90.0

    @property
    def centred_180(self) -> bool:
        """True if longitudes run over 180 degrees, so that points have to be put into 0..360."""
        return self.lon0 + self.nx * self.resolution > 180 + self.resolution


@dataclass(frozen=True)
class Job:
    """Time step and tracking time in minutes, mass, calendar and compatibility.

    ``compat`` brings back some oddities of older results: heat midpoints aren't wrapped on 180-centred
    grids, missing segments pass the predicates, and parcels without uptake count with 999.9 minutes in
    the mean residence time.
    """

    time_step: int = 360
    tracking_time: int = 14400
    total_mass: float = 5148000000000000000.0
    total_parcels: int = 1997651
    calendar: str = "366d"
    compat: bool = False

    def __post_init__(self):
        if self.time_step <= 0 or self.tracking_time <= 0 or self.tracking_time % self.time_step or 1440 % self.time_step:
            raise ValueError("tracking time and one day must be multiples of the time step")
        if self.calendar not in ("366d", "365d"):
            raise ValueError("calendar is 366d or 365d")

    @property
    def segments(self) -> int:
        return self.tracking_time // self.time_step

    @property
    def per_day(self) -> int:
        return 1440 // self.time_step

    @property
    def days(self) -> int:
        return -(-self.segments // self.per_day)

    @property
    def parcel_mass(self) -> float:
        return self.total_mass / self.total_parcels


@dataclass(frozen=True)
class Heat:
    """A heat method: ``var`` is "dse" or "potTemp"; None switches a check off."""

    var: str
    gain: float
    pbl_mode: int
    pbl_height: str = "max"
    arrival_pbl: tuple[float, float] | None = (0.0, 0.0)
    rh: float | None = None
    q: float | None = None
    discount: bool = True

    def __post_init__(self):
        _checked(self.pbl_mode, self.pbl_height)
        if self.var not in ("dse", "potTemp"):
            raise ValueError("var is dse or potTemp")


@dataclass(frozen=True)
class Moisture:
    """A moisture method: ``rain`` is the least loss on arrival (None: no rain filter)."""

    rain: float | None
    gain: float
    pbl_mode: int
    pbl_height: str = "max"
    min_rh: float = 0.0
    arrival_pbl: tuple[float, float] | None = None
    rh: float | None = None
    discount: bool = True

    def __post_init__(self):
        _checked(self.pbl_mode, self.pbl_height)


def _checked(mode: int, height: str) -> None:
    if mode not in (0, 1, 2) or height not in ("max", "mean", "actual"):
        raise ValueError("pbl_mode is 0, 1 or 2 and pbl_height max, mean or actual")


# Thresholds of the published methods; they hold for steps of 360 minutes.
HEAT = {
    "SCH19": Heat("dse", gain=1.0, pbl_mode=2, q=0.1),
    "SCH20": Heat("dse", gain=1.0, pbl_mode=1),
    "JK22": Heat("potTemp", gain=0.0, pbl_mode=1, rh=10.0),
}
MOISTURE = {
    "SOD08": Moisture(rain=-0.0002, gain=0.0002, pbl_mode=1, pbl_height="mean", min_rh=80.0),
    "FAS19": Moisture(rain=-0.0001, gain=0.0001, pbl_mode=0, pbl_height="mean", min_rh=80.0),
    "SJ05": Moisture(rain=None, gain=-1e7, pbl_mode=0, discount=False),
    "JK22": Moisture(rain=0.0, gain=0.0, pbl_mode=1, min_rh=80.0, rh=20.0),
    "APA22": Moisture(rain=-0.0001, gain=0.0, pbl_mode=0),
}


def heat_method(name: str, job: Job, **custom) -> Heat:
    """A preset by name (any case); CUSTOM, and any name at another time step, takes every parameter from ``custom``."""
    return _method(Heat, HEAT, name, job, custom)


def moisture_method(name: str, job: Job, **custom) -> Moisture:
    return _method(Moisture, MOISTURE, name, job, custom)


def _method(kind, presets: dict, name: str, job: Job, custom: dict):
    if name.upper() in presets and job.time_step == 360:
        return replace(presets[name.upper()], **custom)
    if name.upper() not in presets and name.upper() != "CUSTOM":
        raise ValueError(f"unknown method {name}")
    return kind(**custom)
