"""Point to cell mappings of the 0.1 degree global grid, and 0.5 degree blocks.

Three mappings exist because sources differ: ``nearest_*`` for any point
(centre-registered, wrapped and clamped), ``aligned_cell`` for coordinates that
already are cell centres, ``floor_cell`` for any point by cell edges.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import names
from .values import clip, col

_LAT0, _LON0 = 89.95, -179.95


def wrap_longitude(lon: Column | str) -> Column:
    return F.pmod(col(lon) + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def nearest_row(lat: Column | str) -> Column:
    k = F.rint((F.lit(_LAT0) - col(lat)) / F.lit(names.CELL_DEG))
    return clip(k, 0, names.GRID_ROWS - 1).cast("int")


def nearest_col(lon: Column | str) -> Column:
    j = F.rint((wrap_longitude(lon) - F.lit(_LON0)) / F.lit(names.CELL_DEG))
    return clip(j, 0, names.GRID_COLS - 1).cast("int")


def center_lat(row: Column | str) -> Column:
    return F.round(F.lit(_LAT0) - col(row).cast("double") * F.lit(names.CELL_DEG), 2)


def center_lon(column: Column | str) -> Column:
    return F.round(F.lit(_LON0) + col(column).cast("double") * F.lit(names.CELL_DEG), 2)


def aligned_cell(lat: Column | str, lon: Column | str) -> tuple[Column, Column]:
    """Row and column of coordinates that are centres up to float noise; not clamped."""
    row = F.rint((F.lit(_LAT0) - F.round(col(lat), 2)) / F.lit(names.CELL_DEG)).cast("int")
    column = F.rint((F.round(col(lon), 2) - F.lit(_LON0)) / F.lit(names.CELL_DEG)).cast("int")
    return row, column


def in_grid(row: Column | str, column: Column | str) -> Column:
    inside = col(row).between(0, names.GRID_ROWS - 1) & col(column).between(0, names.GRID_COLS - 1)
    return F.coalesce(inside, F.lit(False))


def floor_cell(lat: Column | str, lon: Column | str) -> tuple[Column, Column]:
    """Row and column by cell edges; (-1, -1) outside the grid or without coordinates."""
    row = F.floor((F.lit(90.0) - col(lat)) / F.lit(names.CELL_DEG)).cast("int")
    column = F.floor((col(lon) + F.lit(180.0)) / F.lit(names.CELL_DEG)).cast("int")
    inside = in_grid(row, column)
    return F.when(inside, row).otherwise(-1), F.when(inside, column).otherwise(-1)


def edge_center(row: Column | str, column: Column | str) -> tuple[Column, Column]:
    """Centre of a ``floor_cell``."""
    lat = F.lit(90.0) - (col(row) + F.lit(0.5)) * F.lit(names.CELL_DEG)
    lon = F.lit(-180.0) + (col(column) + F.lit(0.5)) * F.lit(names.CELL_DEG)
    return lat, lon


def block_index(lat: Column | str, lon: Column | str) -> tuple[Column, Column]:
    block_lat = F.floor((col(lat) + F.lit(90.0)) / F.lit(names.BLOCK_DEG)).cast("int")
    block_lon = F.floor((col(lon) + F.lit(180.0)) / F.lit(names.BLOCK_DEG)).cast("int")
    return block_lat, block_lon


def block_id(lat: Column | str, lon: Column | str) -> Column:
    parts = block_index(lat, lon)
    return F.concat(parts[0].cast("string"), F.lit("_"), parts[1].cast("string"))


def cell_block_id(row: Column | str, column: Column | str) -> Column:
    """Block of five by five cells."""
    parts = [F.floor(col(c) / names.BLOCK_CELLS).cast("int").cast("string") for c in (row, column)]
    return F.concat(parts[0], F.lit("_"), parts[1])


def block_bounds(block_lat: Column | str, block_lon: Column | str) -> dict[str, Column]:
    lat_min = F.lit(-90.0) + col(block_lat) * F.lit(names.BLOCK_DEG)
    lon_min = F.lit(-180.0) + col(block_lon) * F.lit(names.BLOCK_DEG)
    half = F.lit(names.BLOCK_DEG / 2)
    return {
        "lat_min": lat_min,
        "lat_max": lat_min + F.lit(names.BLOCK_DEG),
        "lon_min": lon_min,
        "lon_max": lon_min + F.lit(names.BLOCK_DEG),
        "lat_center": lat_min + half,
        "lon_center": lon_min + half,
    }


def location_key(lat: Column | str, lon: Column | str, precision: float = names.LOCATION_PRECISION) -> Column:
    """Quantised coordinates as text, e.g. ``123456_-654321``."""
    parts = [F.rint(col(c) / F.lit(float(precision))).cast("bigint").cast("string") for c in (lat, lon)]
    return F.concat(parts[0], F.lit("_"), parts[1])


def site_hash(site_name: Column | str | None, lat: Column | str, lon: Column | str) -> Column:
    """First 12 hex digits of md5 over ``name|lat|lon`` with four fixed decimals.

    A missing name or coordinate counts as empty text, so ids are stable.
    """
    name = F.coalesce(col(site_name), F.lit("")) if site_name is not None else F.lit("")
    parts = [F.when(col(c).isNotNull(), F.format_string("%.4f", col(c))).otherwise("") for c in (lat, lon)]
    return F.substring(F.md5(F.concat_ws("|", name, *parts)), 1, 12)
