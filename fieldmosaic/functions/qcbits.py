"""Quality words of the microwave product."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import col

# Bit 0 frozen ground, bit 1 polarisation interference, bits 2-3
# spectral interference (1 medium, 2 severe), bit 4 snow or ice, 255 no data.
# Flags: 6 no data, 5 snow or ice, 4 severe, 3 medium, 2 polarisation, 1 frozen, 0 good.
FILL, FROZEN, POLARISATION, SPECTRAL, SNOW = 255, 1, 2, 12, 16


def low_byte(qc: Column | str) -> Column:
    return col(qc).bitwiseAND(255)


def decode(qc: Column | str) -> dict[str, Column]:
    """One boolean per meaning of the low eight bits."""
    byte = low_byte(qc)
    spectral = F.shiftright(byte.bitwiseAND(SPECTRAL), 2)
    return {
        "is_fill": byte == FILL,
        "is_frozen": byte.bitwiseAND(FROZEN) != 0,
        "is_polarisation_rfi": byte.bitwiseAND(POLARISATION) != 0,
        "is_spectral_medium": spectral == 1,
        "is_spectral_severe": spectral == 2,
        "is_snow_ice": byte.bitwiseAND(SNOW) != 0,
    }


def priority_flag(
    qc: Column | str,
    bands: Sequence[str] = (),
    any_band_missing_is_fill: bool = False,
    extra_missing: Column | None = None,
) -> Column:
    """Worst condition as a number 0..6; an absent quality word stays NULL.

    With ``any_band_missing_is_fill`` one missing band voids the cell; otherwise
    bands are independent and only the quality word decides.
    """
    bits = decode(qc)
    missing = bits["is_fill"]
    if any_band_missing_is_fill:
        for band in bands:
            missing = missing | col(band).isNull()
    if extra_missing is not None:
        missing = missing | F.coalesce(extra_missing, F.lit(False))
    ranked = (
        F.when(missing, 6)
        .when(bits["is_snow_ice"], 5)
        .when(bits["is_spectral_severe"], 4)
        .when(bits["is_spectral_medium"], 3)
        .when(bits["is_polarisation_rfi"], 2)
        .when(bits["is_frozen"], 1)
        .otherwise(0)
    )
    return F.when(col(qc).isNotNull(), ranked)


def mask_by_flag(bands: Iterable[str], flag: Column, keep: Sequence[int] = (0,)) -> list[Column]:
    """All bands of a cell are kept or dropped together."""
    return [F.when(flag.isin(list(keep)), col(band)).alias(band) for band in bands]


def mask_by_raw_zero(bands: Iterable[str], qc: Column | str) -> list[Column]:
    """Keep only cells whose whole low byte is 0; an absent word drops the cell."""
    return [F.when(low_byte(qc) == 0, col(band)).alias(band) for band in bands]


__all__ = ["decode", "low_byte", "mask_by_flag", "mask_by_raw_zero", "priority_flag"]
