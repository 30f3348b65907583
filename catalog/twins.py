"""Shared pieces of the SQL twins, written for DuckDB independently of the operators."""

from __future__ import annotations

from fieldmosaic import names

STD = """std AS (
  SELECT sorting_id, site_name, lat, lon, ts, country, state_region, functional_type, protocol, extra_info_flag, igbp_label,
         CAST(TRY_STRPTIME(date_raw, '%Y%m%d') AS DATE) AS date, TRY_CAST(lfmc_raw AS DOUBLE) AS lfmc_pct,
         lower(trim(isolated_raw)) IN ('1', 'true', 't', 'yes', 'y') AS isolated_iforest,
         substr(md5(coalesce(site_name, '') || '|' || printf('%.4f', lat) || '|' || printf('%.4f', lon)), 1, 12) AS site_id
  FROM fx_obs)"""

FLAGGED = (
    STD
    + """, flagged AS (
  SELECT *, CASE WHEN date IS NULL THEN 1 ELSE 0 END AS bad_date,
         CASE WHEN lat IS NULL OR lon IS NULL OR lat < -90 OR lat > 90 OR lon < -180 OR lon > 180 THEN 1 ELSE 0 END AS bad_coord,
         CASE WHEN lfmc_pct IS NULL OR lfmc_pct < 0 OR lfmc_pct > 400 THEN 1 ELSE 0 END AS bad_lfmc,
         CASE WHEN regexp_replace(lower(trim(protocol)), '\\.0$', '') IN ('7', '9', '14b', '17', '27', '32c') THEN 1 ELSE 0 END AS dead_protocol,
         CASE WHEN regexp_matches(lower(extra_info_flag), 'outlier|anomal|error|suspect|dead|flower|bud|wrong|invalid') THEN 1 ELSE 0 END AS provider_suspect
  FROM std), strict AS (
  SELECT * FROM flagged WHERE bad_date = 0 AND bad_coord = 0 AND bad_lfmc = 0 AND dead_protocol = 0)"""
)

VEG = """CASE WHEN lower(trim(functional_type)) IN ('grass', 'graminoid', 'sedge', 'forb', 'geophyte') THEN 'Grass'
              WHEN lower(trim(functional_type)) IN ('shrub', 'large shrub', 'subshrub') THEN 'Shrub'
              WHEN lower(trim(functional_type)) IN ('tree', 'small tree') THEN 'Tree' ELSE 'Unknown' END"""

LOC = "CAST(CAST(round_even(lat / 1e-4, 0) AS BIGINT) AS VARCHAR) || '_' || CAST(CAST(round_even(lon / 1e-4, 0) AS BIGINT) AS VARCHAR)"

ROW = "CAST(least(greatest(round_even((89.95e0 - lat) / 0.1e0, 0), 0), 1799) AS INT)"
WRAP = "((lon + 180 - floor((lon + 180) / 360) * 360) - 180)"
COL = f"CAST(least(greatest(round_even(({WRAP} + 179.95e0) / 0.1e0, 0), 0), 3599) AS INT)"

# Site-day rows of the strict view, grouped by location.
SITE_DAY = (
    FLAGGED
    + f""", keyed AS (SELECT *, {LOC} AS site_loc_id, {VEG} AS veg_type FROM strict),
modes AS (
  SELECT site_loc_id, date, veg_type, igbp_label AS igbp_500m FROM (
    SELECT site_loc_id, date, veg_type, igbp_label,
           row_number() OVER (PARTITION BY site_loc_id, date, veg_type ORDER BY count(*) DESC, igbp_label) AS rn
    FROM keyed WHERE igbp_label IS NOT NULL GROUP BY site_loc_id, date, veg_type, igbp_label) WHERE rn = 1),
ids AS (
  SELECT site_loc_id, date, veg_type, site_id FROM (
    SELECT site_loc_id, date, veg_type, site_id,
           row_number() OVER (PARTITION BY site_loc_id, date, veg_type ORDER BY count(*) DESC, site_id) AS rn
    FROM keyed GROUP BY site_loc_id, date, veg_type, site_id) WHERE rn = 1),
site_day AS (
  SELECT k.*, m.igbp_500m, i.site_id FROM (
    SELECT site_loc_id, date, veg_type, median(lfmc_pct) AS lfmc_pct, median(lat) AS lat, median(lon) AS lon, count(*) AS n_obs,
           arg_min(site_name, CASE WHEN site_name IS NOT NULL THEN sorting_id END) AS site_name,
           arg_min(protocol, CASE WHEN protocol IS NOT NULL THEN sorting_id END) AS protocol,
           count(DISTINCT igbp_label) AS igbp_500m_nunique, count(DISTINCT site_id) AS site_id_nunique,
           CASE WHEN veg_type = 'Unknown' THEN 1 ELSE 0 END AS veg_type_unknown_flag
    FROM keyed GROUP BY site_loc_id, date, veg_type) k
  LEFT JOIN modes m USING (site_loc_id, date, veg_type) LEFT JOIN ids i USING (site_loc_id, date, veg_type))"""
)

GRID_DAY = (
    SITE_DAY
    + f""", celled AS (SELECT *, {ROW} AS row, {COL} AS col FROM site_day),
grid_day AS (
  SELECT date, row, col, round(89.95e0 - row * 0.1e0, 2) AS grid_lat, round(-179.95e0 + col * 0.1e0, 2) AS grid_lon, veg_type,
         avg(lfmc_pct) AS lfmc_pct, CAST(sum(n_obs) AS BIGINT) AS n_obs_sum, count(*) AS n_records, count(DISTINCT site_id) AS n_sites
  FROM celled GROUP BY date, row, col, veg_type)"""
)


def argmax(classes: list[str], labels: list[str] | None = None) -> str:
    """First largest of some columns by an unpivoted list."""
    parts = ", ".join(f"greatest(coalesce({c}, 0), 0)" for c in classes)
    texts = ", ".join(f"'{t}'" for t in (labels or classes))
    return f"[{texts}][list_position([{parts}], list_max([{parts}]))]"


def total(classes: list[str]) -> str:
    return "(" + " + ".join(f"greatest(coalesce({c}, 0), 0)" for c in classes) + ")"


def _label_map() -> str:
    arms = " ".join(f"WHEN '{label}' THEN '{code}'" for label, code in names.CLASS_OF_LABEL.items())
    return f"CASE igbp_label {arms} ELSE 'Unknown' END"


LABEL_CLASS = _label_map()
_VEG_LIST = names.VEGETATION_CLASSES
_ENTROPY = f"list_sum(list_transform([{', '.join(f'greatest(coalesce({c}, 0), 0) / {total(_VEG_LIST)}' for c in _VEG_LIST)}], lambda p: -p * ln(least(greatest(p, 1e-12), 1.0))))"
_NONVEG = total(names.NONVEGETATION_CLASSES)


def base(core: list[str]) -> str:
    """Training base rows as the CTE ``base``."""
    needed = " AND ".join(f"{c} IS NOT NULL" for c in ["lfmc_pct", "lat", "lon", "date", *core])
    bands = ", ".join(names.BANDS)
    return f"""base AS (
  SELECT *, sin(2 * pi() * dayofyear(date) / 365.25) AS doy_sin, cos(2 * pi() * dayofyear(date) / 365.25) AS doy_cos, lat / 90 AS lat_norm,
         coalesce(igbp_label, 'Unknown') AS igbp_dom, CASE WHEN igbp_label IS NULL THEN 0.0 ELSE 1.0 END AS igbp_dom_frac,
         CASE WHEN igbp_label IS NULL THEN NULL ELSE 0.0 END AS igbp_entropy, CASE WHEN igbp_label IS NULL THEN 0.2 ELSE 1.0 END AS igbp_weight,
         CASE WHEN whole > 0 THEN {argmax(_VEG_LIST)} END AS lc_dom,
         top / nullif(whole, 0) AS lc_dom_frac, CASE WHEN whole > 0 THEN {_ENTROPY} ELSE 0.0 END AS lc_entropy,
         greatest(0.2, pow(least(coalesce(top / nullif(whole, 0), 0), 1), 2)) AS lc_weight,
         CASE WHEN {_NONVEG} > 1 THEN {_NONVEG} / 100 ELSE {_NONVEG} END AS nonveg_frac,
         {LABEL_CLASS} AS igbp_to_lc_dom
  FROM (SELECT *, {total(_VEG_LIST)} AS whole, list_max([{', '.join(f'greatest(coalesce({c}, 0), 0)' for c in _VEG_LIST)}]) AS top FROM fx_predictors)
  WHERE {needed} AND lfmc_pct <> 0 AND coalesce({bands}) IS NOT NULL)"""


def split_of(source: str, name: str, block: str = "block_id") -> str:
    """CTEs ``<name>_blocks`` with the split of every block of ``source``."""
    return f"""{name}_blocks AS (
  SELECT {block}, CASE WHEN rn <= round_even(n * 0.8e0, 0) THEN 'train'
                       WHEN rn <= round_even(n * 0.8e0, 0) + round_even(n * 0.1e0, 0) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT {block}, row_number() OVER (ORDER BY md5('42|' || {block}), {block}) AS rn, count(*) OVER () AS n
        FROM (SELECT DISTINCT {block} FROM {source} WHERE {block} IS NOT NULL)))"""


BLOCK = "CAST(CAST(floor((lat + 90) / 0.5e0) AS INT) AS VARCHAR) || '_' || CAST(CAST(floor((lon + 180) / 0.5e0) AS INT) AS VARCHAR)"
