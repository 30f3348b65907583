"""Closed-form chain: moisture -> plant dielectric -> canopy mixture -> optical depth.

Dielectric values follow the convention ``eps' - j eps''``, so losses have an
imaginary part that is zero or negative. The numeric constants below are fixed
values of the published models.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import names
from . import complexnum as cx
from .values import clip, col


def gravimetric_moisture(lfmc_pct: Column | str) -> Column:
    value = col(lfmc_pct)
    return clip(F.try_divide(value, value + 100.0), 0.0, 0.999999)


def moisture_percent(mg: Column | str) -> Column:
    share = clip(col(mg), 0.0, 0.999999)
    return F.lit(100.0) * share / (F.lit(1.0) - share)


def conductivity(salinity_permil: Column | str) -> Column:
    s = col(salinity_permil)
    return clip(F.lit(0.16) * s - F.lit(0.0013) * s * s, 0.0)


def conductivity_at(sigma: Column | str, temp_c: Column | str, reference_c: float = 22.0, alpha: float = 0.02) -> Column:
    factor = F.lit(1.0) + F.lit(float(alpha)) * (col(temp_c) - F.lit(float(reference_c)))
    return col(sigma) * clip(factor, 0.0)


def static_permittivity(temp_c: Column | str) -> Column:
    t = col(temp_c)
    return F.lit(87.740) - F.lit(0.400081) * t + F.lit(9.398e-4) * t * t - F.lit(1.410e-6) * t * t * t


def relaxation_ghz(temp_c: Column | str) -> Column:
    tau = F.lit(1.382264e-13) * F.exp(F.lit(652.7648) / (col(temp_c) + F.lit(133.1383)))
    return F.lit(1.0) / (F.lit(2.0 * math.pi) * tau) / F.lit(1e9)


def free_water(
    f_ghz: Column | str,
    sigma: Column | float = 0.0,
    temp_c: Column | str | None = None,
    eps_inf: float = 4.9,
) -> Column:
    """Debye water with conductivity; without temperature 4.9 + 75 / (1 + j f / 18)."""
    f = F.greatest(col(f_ghz), F.lit(1e-6))
    sigma = sigma if isinstance(sigma, Column) else F.lit(float(sigma))
    eps_s = F.lit(eps_inf + 75.0) if temp_c is None else static_permittivity(temp_c)
    f0 = F.lit(18.0) if temp_c is None else F.greatest(relaxation_ghz(temp_c), F.lit(1e-6))
    a, b = cx.inverse(F.lit(1.0), f / f0)
    span = eps_s - F.lit(eps_inf)
    loss = sigma / (F.lit(2.0 * math.pi * names.VACUUM_PERMITTIVITY) * (f * F.lit(1e9)))
    return cx.make(F.lit(eps_inf) + span * a, span * b - loss)


def bound_water(f_ghz: Column | str) -> Column:
    """2.9 + 55 / (1 + sqrt(j f / 0.18)), with sqrt(j x) = sqrt(x / 2) (1 + j)."""
    half = F.sqrt(F.greatest(col(f_ghz), F.lit(1e-6)) / F.lit(0.18) / F.lit(2.0))
    a, b = cx.inverse(F.lit(1.0) + half, half)
    return cx.make(F.lit(2.9) + F.lit(55.0) * a, F.lit(55.0) * b)


def plant_dielectric(mg: Column | str, free: Column, bound: Column, clip_free: bool = True, clip_loss: bool = True) -> Column:
    """Bulk dielectric from moisture in [0, 1) and the two water phases.

    A missing moisture leaves the real part NULL, and with it everything after.
    """
    m = col(mg)
    rest = F.lit(1.7) - F.lit(0.74) * m + F.lit(6.16) * m * m
    v_free = m * (F.lit(0.55) * m - F.lit(0.076))
    if clip_free:
        v_free = F.greatest(v_free, F.lit(0.0))
    v_bound = F.lit(4.64) * m * m / (F.lit(1.0) + F.lit(7.36) * m * m)
    real = rest + v_free * cx.re(free) + v_bound * cx.re(bound)
    imag = v_free * cx.im(free) + v_bound * cx.im(bound)
    return cx.make(real, F.least(imag, F.lit(0.0)) if clip_loss else imag)


def rational_dielectric(
    lfmc_pct: Column | str, dry_re: float = 1.6, dry_loss: float = 0.05, k_re: float = 25.0, k_loss: float = 10.0
) -> Column:
    """Monotone fallback in the moisture share."""
    value = col(lfmc_pct)
    m = clip(value / (F.lit(100.0) + clip(value, 0.0)), 0.0, 0.999999)
    return cx.make(F.lit(dry_re) + F.lit(k_re) * m, -(F.lit(dry_loss) + F.lit(k_loss) * m))


def mix_with_air(eps_veg: Column, cover: Column | str, beta: float = 1.0 / 3.0) -> Column:
    """``(1 + v (eps^beta - 1))^(1/beta)``; NULL for a cover outside [0, 1]."""
    if beta == 0:
        raise ValueError("beta must not be 0")
    v = F.when(col(cover).between(0.0, 1.0), col(cover))
    powered = cx.power(eps_veg, beta)
    term = cx.make(F.lit(1.0) + v * (cx.re(powered) - F.lit(1.0)), v * cx.im(powered))
    return cx.power(term, 1.0 / beta)


def canopy_loss(eps_veg: Column, cover: Column | str, beta: float = 1.0 / 3.0) -> Column:
    """``-Im sqrt`` of ``mix_with_air`` in one step.

    With losses the angle of the mixed term lies in (-beta pi, 0], so power and
    root combine to one power with exponent 1 / (2 beta) on the principal branch.
    """
    v = F.when(col(cover).between(0.0, 1.0), col(cover))
    powered = cx.power(eps_veg, beta)
    term = cx.make(F.lit(1.0) + v * (cx.re(powered) - F.lit(1.0)), v * cx.im(powered))
    return -cx.im(cx.power(term, 0.5 / beta))


def wavelength_m(f_hz: Column | str) -> Column:
    return F.lit(names.LIGHT_SPEED) / col(f_hz)


def band_hz(band: Column | str) -> Column:
    chain = None
    for code, hertz in names.BAND_HZ.items():
        hit = col(band) == code
        chain = F.when(hit, F.lit(hertz)) if chain is None else chain.when(hit, F.lit(hertz))
    return chain


def optical_depth(
    eps_canopy: Column,
    wavelength: Column | str,
    height_m: Column | str,
    eta: Column | float = 1.0,
    alpha: Column | float | None = None,
    clamp_max: float | None = None,
) -> Column:
    """``eta 4 pi h / lambda (-Im sqrt eps)``, or ``alpha (-Im sqrt eps)`` when alpha is given."""
    return depth_of_loss(-cx.sqrt_imag(eps_canopy), wavelength, height_m, eta, alpha, clamp_max)


def depth_of_loss(
    loss: Column,
    wavelength: Column | str,
    height_m: Column | str,
    eta: Column | float = 1.0,
    alpha: Column | float | None = None,
    clamp_max: float | None = None,
) -> Column:
    if alpha is not None:
        depth = (alpha if isinstance(alpha, Column) else F.lit(float(alpha))) * loss
    else:
        eta = eta if isinstance(eta, Column) else F.lit(float(eta))
        depth = eta * (F.lit(4.0 * math.pi) * col(height_m) / col(wavelength)) * loss
    return clip(depth, 0.0, clamp_max) if clamp_max is not None else depth


def with_forward_depth(
    df: DataFrame,
    lfmc: str,
    cover: str,
    height: str,
    band: str,
    out: str = "vod_base",
    eta: Column | float = 1.0,
    salinity_permil: Column | float = 0.0,
    temp_c: str | None = None,
) -> DataFrame:
    """Whole chain, one row per (sample, band).

    Each stage is its own struct column: later stages reference the field
    instead of repeating the expression, which keeps the plan linear in size.
    """
    salinity = salinity_permil if isinstance(salinity_permil, Column) else F.lit(float(salinity_permil))
    sigma = conductivity(salinity)
    if temp_c is not None:
        sigma = conductivity_at(sigma, temp_c)
    staged = (
        df.withColumns({"_mg": gravimetric_moisture(lfmc), "_hz": band_hz(band)})
        .withColumn("_ghz", F.col("_hz") / F.lit(1e9))
        .withColumns({"_free": free_water("_ghz", sigma, temp_c), "_bound": bound_water("_ghz")})
        .withColumn("_veg", plant_dielectric("_mg", F.col("_free"), F.col("_bound")))
        .withColumn("_loss", canopy_loss(F.col("_veg"), cover))
        .withColumn(out, depth_of_loss(F.col("_loss"), wavelength_m("_hz"), height, eta))
    )
    return staged.drop("_mg", "_hz", "_ghz", "_free", "_bound", "_veg", "_loss")
