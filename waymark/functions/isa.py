"""The standard atmosphere and airspeeds as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FT, KT = 0.3048, 0.514444
P0, T0, RHO0, GAMMA, R, G = 101325.0, 288.15, 1.225, 1.4, 287.05287, 9.80665


def temperature_k(alt_ft: Column) -> Column:
    return F.greatest(T0 - 0.0065 * alt_ft * FT, F.lit(216.65))


def pressure_pa(alt_ft: Column) -> Column:
    h = alt_ft * FT
    return F.when(h < 11000, P0 * F.pow(1 - 0.0065 * h / T0, F.lit(G / (R * 0.0065)))).otherwise(22632.06 * F.exp(-G * (h - 11000) / (R * 216.65)))


def sound_kt(alt_ft: Column) -> Column:
    return F.sqrt(GAMMA * R * temperature_k(alt_ft)) / KT


def tas_kt(cas_kt: Column, alt_ft: Column) -> Column:
    """True airspeed from calibrated airspeed, with compressibility."""
    p, rho = pressure_pa(alt_ft), pressure_pa(alt_ft) / (R * temperature_k(alt_ft))
    impact = P0 * (F.pow(1 + RHO0 / (7 * P0) * F.pow(cas_kt * KT, F.lit(2.0)), F.lit(3.5)) - 1)
    return F.sqrt(2 * GAMMA / (GAMMA - 1) * p / rho * (F.pow(1 + impact / p, F.lit(2 / 7)) - 1)) / KT


def best_tas_kt(ias_kt: Column, gs_kt: Column, alt_ft: Column) -> Column:
    return F.when(ias_kt > 40, tas_kt(ias_kt, alt_ft)).otherwise(gs_kt)


def saturation_pa_ice(temp_k: Column) -> Column:
    """Saturation vapour pressure over ice. The formula's published coefficients."""
    return F.exp(9.550426 - 5723.265 / temp_k + 3.53068 * F.log(temp_k) - 0.00728332 * temp_k)


def relative_humidity_ice(specific: Column, temp_k: Column, pressure_pa: Column) -> Column:
    """Over ice, in percent, from the specific humidity (kg/kg)."""
    vapour = specific * pressure_pa / (0.622 + 0.378 * specific)
    return vapour / saturation_pa_ice(temp_k) * 100
