"""SQL views over the given tables that stand in for samples and rasters.

Each text runs unchanged in Spark and DuckDB. Views may use other views.
"""

from __future__ import annotations

from collections.abc import Sequence

from fieldmosaic import names

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

_CLASSES = names.VEGETATION_CLASSES + names.NONVEGETATION_CLASSES

# Share of customers per nation group, with one class raised per cell so that
# about half of the cells agree with the label of their samples.
_RAISED = {"GRA": 0, "SAV": 1, "OSH": 2, "BAR": 3}


def _class_share(i: int, name: str) -> str:
    raised = f" + CASE WHEN c_custkey % 25200 % 4 = {_RAISED[name]} THEN 6 ELSE 0 END" if name in _RAISED else ""
    return (
        f"round(CAST(sum(CASE WHEN c_nationkey % 17 = {i} THEN 1 ELSE 0 END){raised} AS DOUBLE)"
        f" / (count(*) + 6), 6) AS {name}"
    )


VIEWS: dict[str, str] = {
    "fx_obs": """
SELECT event_id AS sorting_id,
       CASE WHEN event_id % 97 = 0 THEN NULL ELSE 'site_' || CAST(user_id % 25200 AS STRING) END AS site_name,
       CASE WHEN event_id % 211 = 0 THEN CAST(95.5 AS DOUBLE)
            ELSE CAST((user_id % 25200) * 37 % 1400 - 700 AS DOUBLE) / CAST(10 AS DOUBLE) + CAST(0.03 AS DOUBLE) END AS lat,
       CAST((user_id % 25200) * 91 % 3600 - 1800 AS DOUBLE) / CAST(10 AS DOUBLE) + CAST(0.04 AS DOUBLE) AS lon,
       CASE WHEN event_id % 151 = 0 THEN 'bad' ELSE CAST(year(ts) * 10000 + month(ts) * 100 + day(ts) AS STRING) END AS date_raw,
       CASE WHEN event_id % 131 = 0 THEN 'n/a' ELSE CAST(value * 4 AS STRING) END AS lfmc_raw,
       CASE event_type WHEN 'click' THEN ' Graminoid ' WHEN 'view' THEN 'large shrub' WHEN 'error' THEN 'Small tree'
            WHEN 'signup' THEN 'Liana' ELSE NULL END AS functional_type,
       CASE event_id % 13 WHEN 0 THEN '7.0' WHEN 1 THEN '14B' WHEN 2 THEN '16' ELSE '1' END AS protocol,
       CASE WHEN event_id % 17 = 0 THEN 'possible Outlier' ELSE props END AS extra_info_flag,
       CASE WHEN event_id % 23 = 0 THEN 'Yes' ELSE '0' END AS isolated_raw,
       CASE user_id % 4 WHEN 0 THEN 'Grasslands' WHEN 1 THEN 'Savannas' WHEN 2 THEN 'Open Shrublands' ELSE 'Barren' END AS igbp_label,
       CASE user_id % 3 WHEN 0 THEN ' USA ' WHEN 1 THEN 'United States' ELSE 'Spain' END AS country,
       CASE WHEN user_id % 9 = 0 THEN 'Hawaii' ELSE 'X' END AS state_region,
       ts
FROM events""",
    "fx_grid_daily": """
SELECT CAST(ts AS DATE) AS date, CAST(user_id % 25200 AS INT) AS cell,
       CAST(899 - ((user_id % 25200) * 37 % 1400 - 700) AS INT) AS row,
       CAST((user_id % 25200) * 91 % 3600 AS INT) AS col,
       CASE WHEN min(event_id) % 7 = 0 THEN NULL ELSE round(avg(value), 6) END AS tau_ku_h,
       round(max(value), 6) AS tau_x_h, round(min(value), 6) AS tau_c_h,
       CAST(CASE WHEN min(event_id) % 5 = 0 THEN min(event_id) % 256 ELSE 0 END AS INT) AS qc_raw,
       CASE WHEN min(event_id) % 6 = 0 THEN NULL ELSE round(sum(value), 6) END AS rain
FROM events GROUP BY CAST(ts AS DATE), user_id % 25200""",
    "fx_fractions": """
SELECT CAST(c_custkey % 25200 AS INT) AS cell, 2023 AS year,
       round(sum(CASE WHEN c_mktsegment = 'BUILDING' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) / count(*), 6) AS gra,
       round(sum(CASE WHEN c_mktsegment = 'MACHINERY' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) / count(*), 6) AS sav,
       round(sum(CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) / count(*), 6) AS osh,
       round(sum(CASE WHEN c_mktsegment = 'FURNITURE' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) / count(*), 6) AS bar
FROM customer GROUP BY CAST(c_custkey % 25200 AS INT)""",
    "fx_pixels": """
SELECT CAST(l_partkey % 200 AS INT) AS row, CAST(l_suppkey % 100 AS INT) AS col,
       CASE WHEN min(l_quantity) >= 45 THEN CAST(255 AS DOUBLE) ELSE min(l_quantity) END AS raw_value
FROM lineitem GROUP BY CAST(l_partkey % 200 AS INT), CAST(l_suppkey % 100 AS INT)""",
    "fx_pred": """
SELECT l_returnflag AS grp, CASE l_linestatus WHEN 'O' THEN 'val' ELSE 'test' END AS split,
       l_extendedprice / CAST(1000 AS DOUBLE) AS y, l_quantity * CAST(1.5 AS DOUBLE) AS y_hat,
       l_orderkey, l_linenumber
FROM lineitem""",
    "fx_runs": """
SELECT 'S' || CAST(o_custkey % 3 AS STRING) AS scheme, 'M' || CAST(o_orderkey % 2 AS STRING) AS model,
       CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'val' ELSE 'test' END AS split,
       o_orderkey AS repeat_no, o_totalprice / CAST(1000 AS DOUBLE) AS rmse
FROM orders""",
    # Annual class shares of all seventeen classes, by cell.
    "fx_classes": (
        "\nSELECT CAST(c_custkey % 25200 AS INT) AS cell, 2023 AS year,\n"
        "       CAST(899 - ((c_custkey % 25200) * 37 % 1400 - 700) AS INT) AS row, CAST((c_custkey % 25200) * 91 % 3600 AS INT) AS col,\n       "
        + ",\n       ".join(_class_share(i, name) for i, name in enumerate(_CLASSES))
        + "\nFROM customer GROUP BY c_custkey % 25200"
    ),
    # Canopy height and biomass by cell.
    "fx_static": """
SELECT CAST(899 - ((s_suppkey % 25200) * 37 % 1400 - 700) AS INT) AS row, CAST((s_suppkey % 25200) * 91 % 3600 AS INT) AS col,
       CASE WHEN s_suppkey % 25200 % 40 = 11 THEN NULL ELSE round((max(s_acctbal) + 1000) / 400, 6) END AS canopy_height,
       round((min(s_acctbal) + 1000) / 50, 6) AS agb
FROM supplier GROUP BY s_suppkey % 25200""",
    # 8-day leaf area; the third window of the year is missing.
    "fx_lai8": """
SELECT CAST(ts AS DATE) - CAST((dayofyear(ts) - 1) % 8 AS INT) AS index_date,
       CAST(899 - ((user_id % 25200) * 37 % 1400 - 700) AS INT) AS row, CAST((user_id % 25200) * 91 % 3600 AS INT) AS col,
       CASE WHEN min(event_id) % 9 = 0 THEN NULL ELSE round(max(value) / 100, 6) END AS lai
FROM events WHERE dayofyear(ts) NOT BETWEEN 17 AND 24
GROUP BY CAST(ts AS DATE) - CAST((dayofyear(ts) - 1) % 8 AS INT), user_id % 25200""",
    # Samples with their cell.
    "fx_points": """
SELECT event_id AS sample_id, CAST(ts AS DATE) AS date, CAST(year(ts) AS INT) AS year,
       CAST(899 - ((user_id % 25200) * 37 % 1400 - 700) AS INT) AS row, CAST((user_id % 25200) * 91 % 3600 AS INT) AS col,
       value * 4 AS lfmc_pct
FROM events""",
    # Model-ready predictor rows.
    "fx_predictors": (
        """
SELECT e.event_id AS sample_id, CAST(e.ts AS DATE) AS date,
       CAST((e.user_id % 25200) * 37 % 1400 - 700 AS DOUBLE) / CAST(10 AS DOUBLE) + CAST(0.05 AS DOUBLE) AS lat,
       CAST((e.user_id % 25200) * 91 % 3600 - 1800 AS DOUBLE) / CAST(10 AS DOUBLE) + CAST(0.05 AS DOUBLE) AS lon,
       CASE WHEN e.event_id % 89 = 0 THEN CAST(0 AS DOUBLE) WHEN e.event_id % 101 = 0 THEN NULL ELSE e.value * 4 END AS lfmc_pct,
       CASE e.event_type WHEN 'click' THEN 'Tree' WHEN 'view' THEN 'Shrub' WHEN 'error' THEN 'Herb' WHEN 'signup' THEN 'Mix' ELSE NULL END AS FT,
       CASE e.user_id % 4 WHEN 0 THEN 'Grasslands' WHEN 1 THEN 'Savannas' WHEN 2 THEN 'Open Shrublands' ELSE 'Barren' END AS igbp_label,
       CASE e.user_id % 3 WHEN 0 THEN ' USA ' WHEN 1 THEN 'United States' ELSE 'Spain' END AS country,
       CASE WHEN e.user_id % 9 = 0 THEN 'Hawaii' ELSE 'X' END AS state_region,
"""
        + "".join(
            f"       CASE WHEN e.event_id % 53 = 0 OR e.event_id % {m} = 0 THEN NULL ELSE (e.value + {i}) / 100 END AS {band},\n"
            for i, (band, m) in enumerate(zip(names.BANDS, [3, 4, 5, 6, 7, 8]))
        )
        + """       CASE WHEN e.event_id % 43 = 0 THEN NULL ELSE e.value / 100 END AS LAI,
       CAST(e.user_id % 37 AS DOUBLE) AS Hveg,
       CASE WHEN e.event_id % 47 = 0 THEN NULL ELSE e.value / 1000 END AS SM,
       270 + e.value / 10 AS LST,
       """
        + ", ".join(f"c.{name}" for name in _CLASSES)
        + "\nFROM events e JOIN fx_classes c ON CAST(e.user_id % 25200 AS INT) = c.cell"
    ),
}

_NEEDS = {"fx_predictors": ["fx_classes"]}


def closure(wanted: Sequence[str]) -> list[str]:
    """Views in the order they have to be defined."""
    out: list[str] = []
    for name in wanted:
        for part in [*closure(_NEEDS.get(name, ())), name]:
            if part not in out:
                out.append(part)
    return out


def with_views(text: str, wanted: Sequence[str]) -> str:
    """The text with its views as leading common table expressions."""
    if not wanted:
        return text
    heads = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in closure(wanted))
    body = text.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {heads},\n{body[5:]}"
    return f"WITH {heads}\n{body}"
