"""Thermodynamic columns.  Nulls stay nulls; nothing becomes NaN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import CP, G0, R_SPECIFIC, T_REF, VIRTUAL_EPSILON


def mixing_ratio(q: Column) -> Column:
    """Mass of vapour per mass of dry air, from specific humidity; a humidity of 1 or null gives null."""
    return F.when(q != 1, -q / (q - 1))


def pressure_pa(q: Column, t_k: Column, rho: Column) -> Column:
    """Pressure from density and virtual temperature."""
    r = mixing_ratio(q)
    return rho * R_SPECIFIC * (t_k * (1 + r / VIRTUAL_EPSILON) / (1 + r))


def potential_temperature(q: Column, t_k: Column, rho: Column) -> Column:
    """Temperature that a parcel has at 1000 hPa, in K, with the exponent of moist air; null where it isn't a number."""
    hpa = pressure_pa(q, t_k, rho) / 100
    return F.nanvl(t_k * F.pow(1000 / hpa, 0.2854 * (1 - 0.00028 * (mixing_ratio(q) * 1000))), F.lit(None).cast("double"))


def dry_static_energy(t_k: Column, z: Column, lat: Column) -> Column:
    """In kJ/kg; gravity follows the latitude."""
    phi = F.radians(lat)
    g = G0 * (1 + 0.0053024 * F.pow(F.sin(phi), 2) - 0.0000058 * F.pow(F.sin(2 * phi), 2))
    return (CP * t_k + g * z) / 1000


def relative_humidity(q: Column, t_k: Column, rho: Column) -> Column:
    """In per cent."""
    vapour = q * pressure_pa(q, t_k, rho) / (0.622 + 0.378 * q)
    celsius = t_k - T_REF
    return 100 * vapour / (611.2 * F.exp(17.67 * celsius / (celsius + 243.5)))


def with_thermo(obs: DataFrame, var: str = "dse") -> DataFrame:
    """Add heat_var and rh; negative results are missing."""
    q, t, rho = F.col("q"), F.col("t_k"), F.col("rho")
    heat = {"dse": lambda: dry_static_energy(t, F.col("z"), F.col("lat")), "potTemp": lambda: potential_temperature(q, t, rho)}
    value = heat[var]() if var in heat else F.lit(None).cast("double")
    rh = relative_humidity(q, t, rho)
    return obs.withColumns({"heat_var": F.when(value >= 0, value), "rh": F.when(rh >= 0, rh)})
