"""Whole workflows: cleaning, alignment, experiment frames, daily product, comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmosaic import names
from fieldmosaic.operators import align, metrics
from fieldmosaic.plans import alignment, cleaning, experiments, frames, product
from fieldmosaic.session import durable, scratch_path
from fieldmosaic.sources import bucketed

from . import twins
from .registry import query, rounded, rounded_doubles

_HEADERS = {"date": "date_raw", "lfmc_pct": "lfmc_raw", "isolated_iforest_raw": "isolated_raw"}


def _cleaned(x):
    return cleaning.clean(x.fx_obs, cleaning.CleaningOptions(land_cover_column="igbp_label"), _HEADERS)


@query(
    "cp1_clean_grid_day",
    "WITH " + twins.GRID_DAY + " SELECT date, row, col, grid_lat, grid_lon, veg_type, round(lfmc_pct, 6) AS lfmc_pct, n_obs_sum, n_records, n_sites FROM grid_day",
    ["fx_obs"],
)
def _(x):
    return rounded(_cleaned(x).grid_day, "lfmc_pct")


@query(
    "cp1_clean_point_with_cell",
    "WITH " + twins.GRID_DAY + """ SELECT site_loc_id, date, veg_type, round(lfmc_pct, 6) AS lfmc_pct, n_obs, site_id, igbp_500m, row, col,
       count(*) OVER (PARTITION BY date, row, col, veg_type) AS n_site_samples_in_pixel_day FROM celled""",
    ["fx_obs"],
)
def _(x):
    made = _cleaned(x).point_with_cell.select(
        "site_loc_id", "date", "veg_type", "lfmc_pct", "n_obs", "site_id", "igbp_500m", "row", "col", "n_site_samples_in_pixel_day"
    )
    return rounded(made, "lfmc_pct")


@query(
    "cp1_full_report",
    "WITH " + twins.GRID_DAY + """ SELECT (SELECT count(*) FROM flagged) AS n_std, (SELECT count(*) FROM strict) AS n_strict, (SELECT count(*) FROM site_day) AS n_site_day,
       (SELECT count(*) FROM celled) AS n_scheme_a, (SELECT count(*) FROM grid_day) AS n_scheme_b, (SELECT count(DISTINCT site_id) FROM strict) AS n_sites,
       (SELECT max(date) FROM grid_day) AS last_day, (SELECT CAST(sum(dead_protocol) AS BIGINT) FROM flagged) AS n_dead_protocol""",
    ["fx_obs"],
)
def _(x):
    return cleaning.full_report(_cleaned(x)).select(
        F.col("std_summary.n_rows").alias("n_std"), F.col("strict_summary.n_rows").alias("n_strict"),
        F.col("site_day_summary.n_rows").alias("n_site_day"), F.col("scheme_a_summary.n_rows").alias("n_scheme_a"),
        F.col("scheme_b_summary.n_rows").alias("n_scheme_b"), F.col("strict_summary.n_sites").alias("n_sites"),
        F.col("scheme_b_summary.date_max").alias("last_day"), F.col("qc_report.n_dead_protocol").alias("n_dead_protocol"),
    )


_FLAG = """CASE WHEN qc_raw & 255 = 255 THEN 6 WHEN qc_raw & 16 <> 0 THEN 5 WHEN (qc_raw >> 2) & 3 = 2 THEN 4 WHEN (qc_raw >> 2) & 3 = 1 THEN 3
                WHEN qc_raw & 2 <> 0 THEN 2 WHEN qc_raw & 1 <> 0 THEN 1 ELSE 0 END"""


@query(
    "cp2_aligned_training_base",
    "WITH " + twins.GRID_DAY + f""", g AS (SELECT *, {_FLAG} AS vod_qc FROM fx_grid_daily),
    a AS (SELECT d.date, d.row, d.col, d.veg_type, round(d.lfmc_pct, 6) AS lfmc_pct, CASE WHEN g.vod_qc = 0 THEN g.tau_ku_h END AS tau_ku_h, CASE WHEN g.vod_qc = 0 THEN g.tau_x_h END AS tau_x_h,
                 g.vod_qc, s.canopy_height, s.agb, l.lai, CAST(date_trunc('year', d.date) AS DATE) + CAST((dayofyear(d.date) - 1) // 8 * 8 AS INT) AS start, c.GRA
          FROM grid_day d LEFT JOIN g ON g.date = d.date AND g.row = d.row AND g.col = d.col LEFT JOIN fx_static s ON s.row = d.row AND s.col = d.col
          LEFT JOIN fx_lai8 l ON l.index_date = CAST(date_trunc('year', d.date) AS DATE) + CAST((dayofyear(d.date) - 1) // 8 * 8 AS INT) AND l.row = d.row AND l.col = d.col
          LEFT JOIN fx_classes c ON c.year + 1 = year(d.date) AND c.row = d.row AND c.col = d.col)
    SELECT * EXCLUDE (start), CASE WHEN start IN (SELECT index_date FROM fx_lai8) THEN start END AS lai_index_date FROM a""",
    ["fx_obs", "fx_grid_daily", "fx_static", "fx_lai8", "fx_classes"],
)
def _(x):
    placed = alignment.place_on_grid(_cleaned(x).grid_day.select("date", "grid_lat", "grid_lon", "veg_type", "lfmc_pct"))
    annual = x.fx_classes.select((F.col("year") + 1).alias("year"), "row", "col", "GRA")
    made = alignment.align_all(
        placed, x.fx_grid_daily, ["tau_ku_h", "tau_x_h"], x.fx_static, annual, eight_day={"lai": x.fx_lai8}
    )
    picked = made.select("date", "row", "col", "veg_type", "lfmc_pct", "tau_ku_h", "tau_x_h", "vod_qc", "canopy_height", "agb", "lai", "lai_index_date", "GRA")
    return rounded(picked, "lfmc_pct")


# What each experiment keeps, written out for the twins: category, features, weight, further row filters.
_VOD = "VOD_Ku_Hpol_Asc VOD_Ku_Vpol_Asc VOD_X_Hpol_Asc VOD_X_Vpol_Asc VOD_C_Hpol_Asc VOD_C_Vpol_Asc"
_ANY_VOD = f"coalesce({_VOD.replace(' ', ', ')}) IS NOT NULL"
_SAME = "igbp_to_lc_dom = lc_dom"
_FULL = f"{_VOD} LAI Hveg SM LST doy_sin doy_cos lat_norm"
_LC = "greatest(coalesce(lc_weight, 0.2), 0.2)"
_LABEL = "greatest(coalesce(igbp_weight, 0.2), 0.2)"
_TWIN_SCHEMES = {
    "S1_FT": ("FT", f"{_FULL}", "1.0", [_ANY_VOD]),
    "S2_IGBP_DOM": ("igbp_dom", f"{_FULL}", "1.0", [_ANY_VOD]),
    "S3_IGBP_DOM_FE": ("igbp_dom", f"{_FULL} igbp_dom_frac igbp_entropy", "1.0", [_ANY_VOD]),
    "S4_IGBP_DOM_FE_W": ("igbp_dom", f"{_FULL} igbp_dom_frac igbp_entropy", _LABEL, [_ANY_VOD]),
    "S5_LC_DOM_FE_W": ("lc_dom", f"{_FULL} lc_dom_frac lc_entropy", _LC, [_ANY_VOD]),
    "S6_LC_DOM_FE_W_CONS": ("lc_dom", f"{_FULL} lc_dom_frac lc_entropy", _LC, [_ANY_VOD, _SAME]),
    "S7_LC_DOM_FE_W_CONS_NV": ("lc_dom", f"{_FULL} lc_dom_frac lc_entropy", _LC, [_ANY_VOD, _SAME, "nonveg_frac < 0.05"]),
}
_TWIN_ABLATIONS = {
    "A0_FULL_S6": ("lc_dom", f"{_FULL} lc_dom_frac lc_entropy", _LC, [_ANY_VOD, _SAME]),
    "A1_NO_CONS": ("lc_dom", f"{_FULL} lc_dom_frac lc_entropy", _LC, [_ANY_VOD]),
    "A2_NO_WEIGHT": ("lc_dom", f"{_FULL} lc_dom_frac lc_entropy", "1.0", [_ANY_VOD, _SAME]),
    "A3_NO_FRAC_ENTROPY": ("lc_dom", _FULL, _LC, [_ANY_VOD, _SAME]),
    "A4_NO_FRAC": ("lc_dom", f"{_FULL} lc_entropy", _LC, [_ANY_VOD, _SAME]),
    "A5_NO_ENTROPY": ("lc_dom", f"{_FULL} lc_dom_frac", _LC, [_ANY_VOD, _SAME]),
    "A6_NO_VOD": ("lc_dom", "LAI Hveg SM LST doy_sin doy_cos lat_norm lc_dom_frac lc_entropy", _LC, [_SAME]),
    "A7_NO_CORE": ("lc_dom", f"{_VOD} doy_sin doy_cos lat_norm lc_dom_frac lc_entropy", _LC, [_ANY_VOD, _SAME]),
    "A8_NO_SEASON": ("lc_dom", f"{_VOD} LAI Hveg SM LST lc_dom_frac lc_entropy", _LC, [_ANY_VOD, _SAME]),
    "A9_NO_IGBP_PROPS": ("lc_dom", f"{_FULL} lc_dom_frac lc_entropy", _LC, [_ANY_VOD, _SAME]),
}
_LEFT_OUT = {"B1_NO_DOY_SIN": "doy_sin", "B2_NO_DOY_COS": "doy_cos", "B3_NO_LAT_NORM": "lat_norm", "B4_NO_LAI": "LAI", "B5_NO_SM": "SM", "B6_NO_LST": "LST", "B7_NO_HVEG": "Hveg"}
_TWIN_FINE = {
    "FULL_S6": ("lc_dom", f"{_FULL} lc_dom_frac lc_entropy", _LC, [_ANY_VOD, _SAME]),
    **{code: ("lc_dom", " ".join(c for c in f"{_FULL} lc_dom_frac lc_entropy".split() if c != gone), _LC, [_ANY_VOD, _SAME]) for code, gone in _LEFT_OUT.items()},
    "NO_CONS": ("lc_dom", f"{_FULL} lc_dom_frac lc_entropy", _LC, [_ANY_VOD]),
}
# A label mixture: three vegetation labels with gaps, negative and infinite entries, and one label that is none.
_PROPS = "IGBP_prop_Grasslands IGBP_prop_Savannas IGBP_prop_Open_Shrublands"
_TWIN_MIXED = {
    "S2_IGBP_DOM": ("igbp_dom", f"{_FULL} {_PROPS}", "1.0", [_ANY_VOD]),
    "S4_IGBP_DOM_FE_W": ("igbp_dom", f"{_FULL} {_PROPS} igbp_dom_frac igbp_entropy", _LABEL, [_ANY_VOD]),
    "A9_NO_IGBP_PROPS": ("lc_dom", f"{_FULL} lc_dom_frac lc_entropy", _LC, [_ANY_VOD, _SAME]),
}


def _features(experiments: dict) -> list[str]:
    return list(dict.fromkeys(c for _, some, _, _ in experiments.values() for c in some.split()))


def _experiments_sql(experiments: dict, base: str) -> str:
    parts, picks = [], []
    every = _features(experiments)
    for i, (code, (category, some, weight, filters)) in enumerate(experiments.items()):
        mine = some.split()
        strict = [c for c in mine if not c.startswith("VOD_")]
        keep = " AND ".join(["lfmc_pct IS NOT NULL", f"{category} IS NOT NULL", *filters, *[f"{c} IS NOT NULL" for c in strict]])
        shown = ", ".join(f"round(CAST({c if c in mine else 'NULL'} AS DOUBLE), 6) AS {c}" for c in every)
        parts.append(
            f"x{i} AS (SELECT sample_id, {category} AS category, {weight} AS sample_weight, {twins.BLOCK} AS block_id, {shown} FROM base WHERE {keep}), {twins.split_of(f'x{i}', f'x{i}')}"
        )
        picks.append(
            f"SELECT '{code}' AS code, sample_id, category, round(sample_weight, 6) AS sample_weight, '{','.join(mine)}' AS feature_names, block_id, split, {', '.join(every)} FROM x{i} JOIN x{i}_blocks USING (block_id)"
        )
    return f"WITH {base}, " + ", ".join(parts) + " " + " UNION ALL ".join(picks)


def _frames(predictors: DataFrame, specs, experiments: dict) -> DataFrame:
    every = _features(experiments)
    # features are rounded once a row, not once a row and experiment; no filter or weight reads their values
    made = frames.experiment_matrix(rounded(frames.training_base(predictors), *every), specs)
    # feature order is not part of the comparison
    ordered = F.lit(None).cast("string")
    for code, (_, some, _, _) in experiments.items():
        same = F.array_sort(F.split("feature_names", ",")) == F.array_sort(F.array(*[F.lit(c) for c in some.split()]))
        ordered = F.when((F.col("code") == code) & same, ",".join(some.split())).otherwise(ordered)
    picked = made.select("code", "sample_id", "category", "sample_weight", ordered.alias("feature_names"), "block_id", "split", *every)
    return rounded(picked, "sample_weight")


@query("cp3_scheme_frames", _experiments_sql(_TWIN_SCHEMES, twins.base(names.CORE_FEATURES)), ["fx_predictors"])
def _(x):
    return _frames(x.fx_predictors, frames.SCHEMES, _TWIN_SCHEMES)


@query("cp4_ablation_frames", _experiments_sql(_TWIN_ABLATIONS, twins.base(names.CORE_FEATURES)), ["fx_predictors"])
def _(x):
    return _frames(x.fx_predictors, frames.ABLATIONS, _TWIN_ABLATIONS)


@query("cp5_fine_ablation_frames", _experiments_sql(_TWIN_FINE, twins.base(names.CORE_FEATURES)), ["fx_predictors"])
def _(x):
    return _frames(x.fx_predictors, frames.FINE_ABLATIONS, _TWIN_FINE)


_MIXED_BASE = twins.base(names.CORE_FEATURES) + """, plain AS (SELECT * FROM base), mix AS (
  SELECT * EXCLUDE (igbp_dom, igbp_dom_frac, igbp_entropy, igbp_weight),
         CASE WHEN sample_id % 7 <> 0 THEN CAST(sample_id % 5 AS DOUBLE) END AS IGBP_prop_Grasslands,
         CASE WHEN sample_id % 11 <> 0 THEN CAST(sample_id % 3 AS DOUBLE) END AS IGBP_prop_Savannas,
         CASE WHEN sample_id % 13 = 0 THEN -1.0 ELSE sample_id % 2 END AS IGBP_prop_Open_Shrublands FROM plain),
shares AS (SELECT *, [coalesce(IGBP_prop_Grasslands, 0), coalesce(IGBP_prop_Savannas, 0), greatest(IGBP_prop_Open_Shrublands, 0)] AS p FROM mix),
mixed AS (SELECT *, list_sum(p) AS whole_p, list_max(p) AS top_p FROM shares)"""
_MIXED_BASE = _MIXED_BASE.replace("base AS (", "base0 AS (", 1).replace("SELECT * FROM base)", "SELECT * FROM base0)") + """, base AS (
  SELECT *, CASE WHEN whole_p > 0 THEN ['Grasslands', 'Savannas', 'Open Shrublands'][list_position(p, top_p)] END AS igbp_dom, top_p / nullif(whole_p, 0) AS igbp_dom_frac,
         CASE WHEN whole_p > 0 THEN list_sum(list_transform(p, lambda v: -(v / whole_p) * ln(least(greatest(v / whole_p, 1e-12), 1.0)))) ELSE 0.0 END AS igbp_entropy,
         greatest(0.2, pow(least(coalesce(top_p / nullif(whole_p, 0), 0), 1), 2)) AS igbp_weight FROM mixed)"""


@query("cp3_label_mixture_frames", _experiments_sql(_TWIN_MIXED, _MIXED_BASE), ["fx_predictors"])
def _(x):
    """Label proportions with NaN, infinite and negative entries: all count as 0 in shares; rows
    where a proportion is no number leave the experiments that use it as a feature."""
    k = F.col("sample_id")
    mixed = x.fx_predictors.withColumns(
        {
            "IGBP_prop_Grasslands": F.when(k % 7 == 0, float("nan")).otherwise(k % 5),
            "IGBP_prop_Savannas": F.when(k % 11 == 0, float("inf")).otherwise(k % 3),
            "IGBP_prop_Open_Shrublands": F.when(k % 13 == 0, -1.0).otherwise(k % 2),
            "IGBP_prop_Barren": F.lit(9.0),
        }
    )
    specs = [s for s in [*frames.SCHEMES, *frames.ABLATIONS] if s.code in _TWIN_MIXED]
    return _frames(mixed, specs, _TWIN_MIXED)


_FINAL_COLUMNS = ["LAI", "Hveg", "LST", "VOD_X_Vpol_Asc", "doy_sin", "lat_norm"]


@query(
    "cp6_final_frame",
    f"""WITH {twins.base(names.CORE_FEATURES_LITE)}, k AS (SELECT *, {twins.BLOCK} AS block_id FROM base WHERE igbp_to_lc_dom = lc_dom), {twins.split_of('k', 's')}
        SELECT sample_id, date, lfmc_pct, lc_dom, 1.0 AS sample_weight, split, {', '.join(f'round({c}, 9) AS {c}' for c in _FINAL_COLUMNS)} FROM k JOIN s_blocks USING (block_id)""",
    ["fx_predictors"],
)
def _(x):
    made = frames.final_frame(x.fx_predictors).select("sample_id", "date", "lfmc_pct", "lc_dom", "sample_weight", "split", *_FINAL_COLUMNS)
    return rounded(made, *_FINAL_COLUMNS, digits=9)


_MOVED = "CASE WHEN igbp_label = 'Savannas' THEN date ELSE CAST(date - INTERVAL (sample_id % 3) YEAR AS DATE) END"


@query(
    "cp6_transfer_frame",
    f"""WITH {twins.base(names.CORE_FEATURES_LITE).replace("FROM fx_predictors)", f"FROM (SELECT * REPLACE ({_MOVED} AS date) FROM fx_predictors))")}, k AS (SELECT *, {twins.BLOCK} AS block_id,
          lower(trim(country)) IN ('usa', 'united states') AND NOT contains(lower(state_region), 'hawai') AS home FROM base WHERE igbp_to_lc_dom = lc_dom),
        seen AS (SELECT DISTINCT block_id FROM k WHERE home AND year(date) = 2022)
        SELECT sample_id, country, state_region, block_id, CASE WHEN NOT home THEN 'test_external' WHEN year(date) = 2022 THEN 'train_us'
               WHEN block_id IN (SELECT block_id FROM seen) THEN 'val_us_overlap' ELSE 'val_us_nonoverlap' END AS split FROM k WHERE NOT home OR year(date) IN (2022, 2024)""",
    ["fx_predictors"],
)
def _(x):
    """Samples of three years, one label only in the last; the middle year is in neither period."""
    years_back = F.when(F.col("igbp_label") == "Savannas", 0).otherwise(F.col("sample_id") % 3)
    moved = x.fx_predictors.withColumn("date", F.add_months("date", (-12 * years_back).cast("int")))
    made = frames.transfer_frame(moved, train_years=(2022, 2022), future_years=(2024, 2024))
    return made.select("sample_id", "country", "state_region", "block_id", "split")


_VEG = names.VEGETATION_CLASSES


@query(
    "cp7_scoring_alignment",
    f"""SELECT sample_id, round(sin(2 * pi() * dayofyear(date) / 365.25), 9) AS doy_sin, round(lat / 90, 9) AS lat_norm, CASE WHEN {twins.total(_VEG)} > 0 THEN {twins.argmax(_VEG)} END AS lc_dom,
               {twins.LABEL_CLASS} AS igbp_to_lc_dom FROM fx_predictors""",
    ["fx_predictors"],
)
def _(x):
    made = frames.aligned_for_scoring(x.fx_predictors).select("sample_id", "doy_sin", "lat_norm", "lc_dom", "igbp_to_lc_dom")
    return rounded(made, "doy_sin", "lat_norm", digits=9)


_NEWEST = "(SELECT max(date) FROM fx_grid_daily)"


@query(
    "cp8_daily_feature_table",
    f"""WITH g AS (SELECT * FROM fx_grid_daily WHERE date = {_NEWEST}),
        r AS (SELECT row, col, sum(rain) AS r7, count(rain) AS n7 FROM fx_grid_daily WHERE date > {_NEWEST} - 7 GROUP BY row, col),
        br AS (SELECT (SELECT max(index_date) FROM fx_lai8 WHERE index_date <= {_NEWEST} - 5) AS lo, (SELECT min(index_date) FROM fx_lai8 WHERE index_date >= {_NEWEST} - 5) AS hi),
        w AS (SELECT lo, hi, CASE WHEN lo = hi THEN 0 ELSE ({_NEWEST} - 5 - lo) / (hi - lo) END AS w FROM br),
        la AS (SELECT a.row, a.col, a.lai * (1 - w.w) + b.lai * w.w AS lai FROM w JOIN fx_lai8 a ON a.index_date = w.lo JOIN fx_lai8 b ON b.index_date = w.hi AND b.row = a.row AND b.col = a.col),
        cells AS (SELECT row, col FROM (SELECT DISTINCT row, col FROM r UNION SELECT row, col FROM la UNION SELECT row, col FROM fx_static UNION SELECT row, col FROM fx_classes)),
        f AS (SELECT c.row, c.col, CASE WHEN g.qc_raw & 255 = 0 THEN g.tau_ku_h END AS tau_ku_h, g.qc_raw AS VOD_QC, g.tau_x_h AS LST, r.r7, coalesce(r.n7, 0) AS n7, la.lai, s.canopy_height,
                     k.GRA, k.BAR, {', '.join(f"{' + '.join(m)} AS m_{n}" for n, m in names.MERGED_CLASSES.items())}
              FROM cells c LEFT JOIN g USING (row, col) LEFT JOIN r USING (row, col) LEFT JOIN la USING (row, col) LEFT JOIN fx_static s USING (row, col) LEFT JOIN fx_classes k USING (row, col))
        SELECT CAST(row // 300 AS INT) AS band, 300 * 3600 AS n_cells, count(tau_ku_h) AS n_bands, round(sum(tau_ku_h), 6) AS sum_bands, count(LST) AS n_lst, round(sum(r7), 6) AS sum_rain_7day,
               CAST(sum(n7) AS BIGINT) AS sum_rain_days, count(lai) AS n_lai, round(sum(lai), 6) AS sum_lai, round(sum(canopy_height), 6) AS sum_height, count(GRA) AS n_classes, round(sum(m_Herb), 6) AS sum_herb,
               count(*) FILTER (tau_ku_h IS NOT NULL OR lai IS NOT NULL OR LST IS NOT NULL) AS n_valid FROM f GROUP BY 1""",
    ["fx_grid_daily", "fx_lai8", "fx_static", "fx_classes"],
)
def _(x):
    """Feature table of the newest day over all 6.48 million cells, summed per strip of cells that have data."""
    grid = x.fx_grid_daily
    newest = grid.agg(F.max("date").alias("date"))
    shifted = x.fx_lai8.select(F.date_add("index_date", 5).alias("date"), "row", "col", F.col("lai").alias("LAI"))
    table = product.daily_features(
        newest,
        grid.withColumnRenamed("qc_raw", "VOD_QC").select("date", "row", "col", "VOD_QC", "tau_ku_h"),
        shifted,
        grid.select("date", "row", "col", F.col("tau_x_h").alias("LST")),
        grid.select("date", "row", "col", "rain"),
        x.fx_static.select("row", "col", F.col("canopy_height").alias("Hveg")),
        x.fx_classes.drop("cell").withColumn("year", F.col("year") + 1),
        bands=["tau_ku_h"],
    )
    made = table.groupBy(F.floor(F.col("row") / 300).cast("int").alias("band")).agg(
        F.count(F.lit(1)).cast("int").alias("n_cells"), F.count("tau_ku_h").alias("n_bands"), F.sum("tau_ku_h").alias("sum_bands"),
        F.count("LST").alias("n_lst"), F.sum("rain_7day").alias("sum_rain_7day"), F.sum("rain_7day_valid_days").alias("sum_rain_days"),
        F.count("LAI").alias("n_lai"), F.sum("LAI").alias("sum_lai"), F.sum("Hveg").alias("sum_height"), F.count("GRA").alias("n_classes"),
        F.sum("Herb").alias("sum_herb"), F.sum("valid_for_inference").alias("n_valid"),
    )
    return rounded_doubles(made.where("n_classes > 0"), 6)


_ALL_DAYS_SQL = f"""WITH days AS (SELECT DISTINCT date FROM fx_grid_daily), comp AS (SELECT DISTINCT index_date + 5 AS d FROM fx_lai8),
        br AS (SELECT date, max(CASE WHEN d <= date THEN d END) AS lo, min(CASE WHEN d >= date THEN d END) AS hi FROM days, comp GROUP BY date),
        la AS (SELECT br.date, a.row, a.col, CASE WHEN lo = hi THEN a.lai ELSE a.lai * (1 - (br.date - lo) / (hi - lo)) + b.lai * ((br.date - lo) / (hi - lo)) END AS lai
               FROM br JOIN fx_lai8 a ON a.index_date + 5 = br.lo JOIN fx_lai8 b ON b.index_date + 5 = br.hi AND b.row = a.row AND b.col = a.col),
        g AS (SELECT *, sum(rain) OVER w AS r7, count(rain) OVER w AS n7 FROM fx_grid_daily
              WINDOW w AS (PARTITION BY row, col ORDER BY date RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW)),
        f AS (SELECT g.date, g.row, {', '.join(f'CASE WHEN g.qc_raw & 255 = 0 THEN g.{b} END AS {b}' for b in ('tau_ku_h', 'tau_x_h', 'tau_c_h'))}, g.tau_x_h AS LST, g.r7, g.n7, la.lai, s.canopy_height, k.GRA,
                     {', '.join(f"{' + '.join(m)} AS m_{n}" for n, m in names.MERGED_CLASSES.items())}
              FROM g LEFT JOIN la ON la.date = g.date AND la.row = g.row AND la.col = g.col LEFT JOIN fx_static s ON s.row = g.row AND s.col = g.col LEFT JOIN fx_classes k ON k.row = g.row AND k.col = g.col)
        SELECT date, CAST(row // 300 AS INT) AS band, count(*) AS n_cells, {', '.join(f'count({b}) AS n_{b}, round(sum({b}), 9) AS sum_{b}' for b in ('tau_ku_h', 'tau_x_h', 'tau_c_h'))},
               count(LST) AS n_lst, round(sum(r7), 9) AS sum_rain_7day, CAST(sum(n7) AS BIGINT) AS sum_rain_days, count(lai) AS n_lai, round(sum(lai), 9) AS sum_lai, round(sum(canopy_height), 9) AS sum_height,
               count(GRA) AS n_classes, round(sum(m_Herb), 9) AS sum_herb, count(*) FILTER (tau_ku_h IS NOT NULL OR tau_x_h IS NOT NULL OR tau_c_h IS NOT NULL OR lai IS NOT NULL OR LST IS NOT NULL) AS n_valid
        FROM f GROUP BY 1, 2"""


def _by_day_and_strip(table, bands):
    sums = [f for b in bands for f in (F.count(b).alias(f"n_{b}"), F.sum(b).alias(f"sum_{b}"))]
    made = table.groupBy("date", F.floor(F.col("row") / 300).cast("int").alias("band")).agg(
        F.count(F.lit(1)).alias("n_cells"), *sums, F.count("LST").alias("n_lst"), F.sum("rain_7day").alias("sum_rain_7day"),
        F.sum("rain_7day_valid_days").alias("sum_rain_days"), F.count("LAI").alias("n_lai"), F.sum("LAI").alias("sum_lai"),
        F.sum("Hveg").alias("sum_height"), F.count("GRA").alias("n_classes"), F.sum("Herb").alias("sum_herb"), F.sum("valid_for_inference").alias("n_valid"),
    )
    return rounded_doubles(made, 9)


@query(
    "cp8_daily_features_all_days",
    _ALL_DAYS_SQL,
    ["fx_grid_daily", "fx_lai8", "fx_static", "fx_classes"],
)
def _(x):
    """Features of every day and all bands on the cells with data, summed per day and strip; strips without classes stay."""
    grid = x.fx_grid_daily
    bands = ["tau_ku_h", "tau_x_h", "tau_c_h"]
    table = product.daily_features(
        grid.select("date").distinct(),
        grid.withColumnRenamed("qc_raw", "VOD_QC").select("date", "row", "col", "VOD_QC", *bands),
        x.fx_lai8.select(F.date_add("index_date", 5).alias("date"), "row", "col", F.col("lai").alias("LAI")),
        grid.select("date", "row", "col", F.col("tau_x_h").alias("LST")),
        grid.select("date", "row", "col", "rain"),
        x.fx_static.select("row", "col", F.col("canopy_height").alias("Hveg")),
        x.fx_classes.drop("cell").withColumn("year", F.col("year") + 1),
        bands=bands,
        observed=grid,
    )
    return _by_day_and_strip(table, bands)


@query("cp8_bucketed_features", _ALL_DAYS_SQL, ["fx_grid_daily", "fx_lai8", "fx_static", "fx_classes"])
def _(x):
    """The same features from tables bucketed by cell: no join shuffles the cells of the days."""
    grid = x.fx_grid_daily
    bands = ["tau_ku_h", "tau_x_h", "tau_c_h"]
    path = scratch_path(x.spark, "buckets")
    count = int(x.spark.conf.get("spark.sql.shuffle.partitions"))

    def kept(name, df, partition=None):
        return bucketed.write_bucketed(df, f"{name}_{path[-12:]}", f"{path}/{name}", count, partition)

    lai = x.fx_lai8.select(F.date_add("index_date", 5).alias("date"), "row", "col", F.col("lai").alias("LAI"))
    daily = kept("daily", grid.select("date", "row", "col", F.col("qc_raw").alias("VOD_QC"), *bands, F.col("tau_x_h").alias("LST"), "rain"), "date")
    table = product.daily_features(
        grid.select("date").distinct(),
        daily.select("date", "row", "col", "VOD_QC", *bands),
        lai,
        daily.select("date", "row", "col", "LST"),
        daily.select("date", "row", "col", "rain"),
        kept("static", x.fx_static.select("row", "col", F.col("canopy_height").alias("Hveg"))),
        kept("annual", x.fx_classes.drop("cell").withColumn("year", F.col("year") + 1)),
        bands=bands,
        cells=kept("cells", grid.select("row", "col").distinct()),
        segments=kept("segments", align.composite_segments(lai, "LAI")),
    )
    seen = daily.select("date", "row", "col")
    return _by_day_and_strip(table.join(seen, ["date", "row", "col"], "left_semi"), bands)


@query(
    "cp9_experiment_runs",
    f"""SELECT code AS scheme, 'trees' AS model, CAST(r AS INT) AS repeat, split, count(*) AS n, true AS ordered_errors
        FROM ({_experiments_sql(_TWIN_SCHEMES, twins.base(names.CORE_FEATURES))}), (SELECT unnest([1, 2]) AS r) GROUP BY ALL""",
    ["fx_predictors"],
)
def _(x):
    """All schemes, two repeats, with very small boosted trees (their size is an argument): rows of each run."""
    base = durable(frames.training_base(x.fx_predictors))
    trainers = {"trees": experiments.tree_trainer(iterations=2, rate=0.3, depth=2)}
    made = experiments.run_experiments(base, frames.SCHEMES, trainers, repeats=2)
    return made.select("scheme", "model", F.col("repeat").cast("int").alias("repeat"), "split", "n", (F.col("RMSE") >= F.col("MAE")).alias("ordered_errors"))


@query(
    "cp9_resumed_runs",
    f"""SELECT code AS scheme, 'class_means' AS model, CAST(1 AS INT) AS repeat, split, count(*) AS n, CAST(1 AS INT) AS failed_first, CAST(0 AS INT) AS failed_then, CAST(1 AS INT) AS fits_then
        FROM ({_experiments_sql(_TWIN_SCHEMES, twins.base(names.CORE_FEATURES))}) GROUP BY ALL""",
    ["fx_predictors"],
)
def _(x):
    """All schemes, three at once; one run fails, and a second call does that run alone."""
    base, path, fits = durable(frames.training_base(x.fx_predictors)), scratch_path(x.spark, "runs"), []

    def class_means(frame, numeric, category, seed):
        fits.append(category)
        if category == "FT" and fits.count("FT") == 1:
            raise RuntimeError("lost")
        means = frame.where("split = 'train'").groupBy(category).agg(F.avg("lfmc_pct").alias("lfmc_pred"))
        whole = frame.where("split = 'train'").agg(F.avg("lfmc_pct").alias("overall")).first()["overall"]
        return frame.join(means, category, "left").fillna(whole, ["lfmc_pred"])

    counts = []
    for _ in range(2):
        before = len(fits)
        failed = experiments.run_resumable(base, frames.SCHEMES, {"class_means": class_means}, path)
        counts += [len(failed), len(fits) - before]
    shown = {"failed_first": counts[0], "failed_then": counts[2], "fits_then": counts[3]}
    made = experiments.finished_runs(x.spark, path)
    return made.select("scheme", "model", F.col("repeat").cast("int").alias("repeat"), "split", "n", *[F.lit(v).cast("int").alias(k) for k, v in shown.items()])


@query(
    "cp10_model_comparison",
    """SELECT scheme, model, split, round(avg(rmse), 6) AS rmse_mean, round(stddev_samp(rmse), 6) AS rmse_std, max(repeat_no) AS n_samples FROM fx_runs GROUP BY ALL ORDER BY 1, 2, 3""",
    ["fx_runs"],
)
def _(x):
    families = []
    for model in ("M0", "M1"):
        raw = x.fx_runs.where(F.col("model") == model).withColumnRenamed("repeat_no", "n")
        families.append((metrics.repeat_summary(raw, measures=["rmse"]), raw))
    return rounded_doubles(metrics.model_comparison(families))
