"""Column expressions: coercion, dates, cells, quality words, land cover, microwave chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmosaic import names
from fieldmosaic.functions import calendar, cells, landcover, microwave, qcbits, values

from . import twins
from .registry import query, rounded, rounded_doubles


@query(
    "fn1_numeric_coercion",
    """SELECT event_id, TRY_CAST(CASE WHEN event_id % 131 = 0 THEN 'n/a' WHEN event_id % 11 = 0 THEN ' ' || CAST(value AS VARCHAR) || ' '
              WHEN event_id % 13 = 0 THEN NULL ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS number FROM events""",
)
def _(x):
    text = (
        F.when(F.col("event_id") % 131 == 0, "n/a")
        .when(F.col("event_id") % 11 == 0, F.concat(F.lit(" "), F.col("value").cast("string"), F.lit(" ")))
        .when(F.col("event_id") % 13 == 0, F.lit("inf"))
        .otherwise(F.col("value").cast("string"))
    )
    return x.table("events").select("event_id", values.to_number(text).alias("number"))


@query(
    "fn2_date_parse",
    """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(ts AS DATE) END AS day FROM events""",
)
def _(x):
    number = F.date_format("ts", "yyyyMMdd")
    text = (
        F.when(F.col("event_id") % 7 == 0, "bad")
        .when(F.col("event_id") % 5 == 0, F.concat(number, F.lit(".0")))
        .when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd"))
        .when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .otherwise(number)
    )
    return x.table("events").select("event_id", calendar.parse_day(text).alias("day"))


@query(
    "fn3_sampling_moment",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) WHEN 3 THEN date_trunc('second', ts)
              ELSE date_trunc('minute', ts) END AS moment FROM events""",
)
def _(x):
    clock = (
        F.when(F.col("event_id") % 4 == 0, "noon")
        .when(F.col("event_id") % 4 == 1, F.date_format("ts", "HHmm"))
        .when(F.col("event_id") % 4 == 2, F.date_format("ts", "HH:mm"))
        .otherwise(F.date_format("ts", "HH:mm:ss"))
    )
    return x.table("events").select("event_id", calendar.sampling_moment(F.to_date("ts"), clock).alias("moment"))


@query(
    "fn4_alternative_moment",
    """SELECT event_id, CAST(ts AS DATE) AS day,
              CASE WHEN event_id % 3 = 0 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) ELSE date_trunc('minute', ts) END AS moment FROM events""",
)
def _(x):
    day = F.concat(F.date_format("ts", "yyyyMMdd"), F.when(F.col("event_id") % 2 == 0, ".0").otherwise(""))
    clock = F.when(F.col("event_id") % 3 == 0, "nan").otherwise(F.date_format("ts", "HH:mm"))
    return x.table("events").select(
        "event_id", calendar.parse_moment(day, clock).alias("day"), calendar.parse_moment(day, clock, to_day=False).alias("moment")
    )


@query(
    "fn5_truthy",
    """SELECT sorting_id, coalesce(lower(trim(isolated_raw)) IN ('1', 'true', 't', 'yes', 'y'), false) AS flag,
              coalesce(lower(functional_type) IN ('1', 'true', 't', 'yes', 'y'), false) AS other FROM fx_obs""",
    ["fx_obs"],
)
def _(x):
    return x.fx_obs.select("sorting_id", values.truthy("isolated_raw").alias("flag"), values.truthy("functional_type").alias("other"))


@query("fn6_site_hash", "WITH " + twins.STD + " SELECT sorting_id, site_id FROM std", ["fx_obs"])
def _(x):
    return x.fx_obs.select("sorting_id", cells.site_hash("site_name", "lat", "lon").alias("site_id"))


@query("fn7_location_key", f"SELECT sorting_id, {twins.LOC} AS site_loc_id FROM fx_obs", ["fx_obs"])
def _(x):
    return x.fx_obs.select("sorting_id", cells.location_key("lat", "lon").alias("site_loc_id"))


@query("fn8_vegetation_kind", f"SELECT sorting_id, {twins.VEG} AS veg_type FROM fx_obs", ["fx_obs"])
def _(x):
    return x.fx_obs.select("sorting_id", landcover.vegetation_kind("functional_type").alias("veg_type"))


@query("fn9_year_and_day", "SELECT o_orderkey, year(o_orderdate) AS year, dayofyear(o_orderdate) AS doy FROM orders")
def _(x):
    return x.table("orders").select("o_orderkey", F.year("o_orderdate").alias("year"), F.dayofyear("o_orderdate").alias("doy"))


@query(
    "fn10_season_terms",
    """SELECT sorting_id, round(sin(2 * pi() * dayofyear(ts) / 365.25), 9) AS doy_sin, round(cos(2 * pi() * dayofyear(ts) / 365.25), 9) AS doy_cos,
              round(sin(2 * pi() * dayofyear(ts) / 365.0), 9) AS doy_sin_365, round(lat / 90, 9) AS lat_norm, round(lon / 180, 9) AS lon_norm FROM fx_obs""",
    ["fx_obs"],
)
def _(x):
    sine, cosine = calendar.day_of_year_terms("ts")
    sine_365, _unused = calendar.day_of_year_terms("ts", 365.0)
    lat_norm, lon_norm = calendar.normalised_coordinates("lat", "lon")
    made = x.fx_obs.select(
        "sorting_id", sine.alias("doy_sin"), cosine.alias("doy_cos"), sine_365.alias("doy_sin_365"),
        lat_norm.alias("lat_norm"), lon_norm.alias("lon_norm"),
    )
    return rounded_doubles(made, 9)


@query(
    "fn11_eight_day_start",
    """SELECT o_orderkey, CAST(date_trunc('year', o_orderdate) AS DATE) + CAST((dayofyear(o_orderdate) - 1) // 8 * 8 AS INT) AS index_date FROM orders""",
)
def _(x):
    return x.table("orders").select("o_orderkey", calendar.eight_day_start(F.to_date("o_orderdate")).alias("index_date"))


@query(
    "fn12_cells",
    f"""SELECT sorting_id, {twins.ROW} AS near_row, {twins.COL} AS near_col,
               round(89.95e0 - {twins.ROW} * 0.1e0, 2) AS near_lat, round(-179.95e0 + {twins.COL} * 0.1e0, 2) AS near_lon,
               CAST(round_even((89.95e0 - round(lat, 2)) / 0.1e0, 0) AS INT) AS aligned_row,
               CAST(round_even((round(lon, 2) + 179.95e0) / 0.1e0, 0) AS INT) AS aligned_col,
               CASE WHEN lat > 90 OR lat <= -90 THEN -1 ELSE CAST(floor((90 - lat) / 0.1e0) AS INT) END AS floor_row,
               CASE WHEN lat > 90 OR lat <= -90 THEN -1 ELSE CAST(floor((lon + 180) / 0.1e0) AS INT) END AS floor_col,
               CASE WHEN lat > 90 THEN NULL ELSE round(90 - (floor((90 - lat) / 0.1e0) + 0.5) * 0.1e0, 6) END AS edge_lat,
               CASE WHEN lat > 90 THEN NULL ELSE round(-180 + (floor((lon + 180) / 0.1e0) + 0.5) * 0.1e0, 6) END AS edge_lon
        FROM fx_obs""",
    ["fx_obs"],
)
def _(x):
    aligned = cells.aligned_cell("lat", "lon")
    floors = cells.floor_cell("lat", "lon")
    made = x.fx_obs.select(
        "sorting_id",
        cells.nearest_row("lat").alias("near_row"), cells.nearest_col("lon").alias("near_col"),
        aligned[0].alias("aligned_row"), aligned[1].alias("aligned_col"),
        floors[0].alias("floor_row"), floors[1].alias("floor_col"),
    )
    edge = cells.edge_center("floor_row", "floor_col")
    inside = cells.in_grid("floor_row", "floor_col")
    return made.withColumns(
        {
            "near_lat": cells.center_lat("near_row"),
            "near_lon": cells.center_lon("near_col"),
            "edge_lat": F.when(inside, F.round(edge[0], 6)),
            "edge_lon": F.when(inside, F.round(edge[1], 6)),
        }
    )


@query(
    "fn13_blocks",
    f"""SELECT sorting_id, {twins.BLOCK} AS block_id, -90 + floor((lat + 90) / 0.5e0) * 0.5e0 AS lat_min, -90 + floor((lat + 90) / 0.5e0) * 0.5e0 + 0.5e0 AS lat_max,
               -180 + floor((lon + 180) / 0.5e0) * 0.5e0 AS lon_min, -180 + floor((lon + 180) / 0.5e0) * 0.5e0 + 0.5e0 AS lon_max,
               -90 + floor((lat + 90) / 0.5e0) * 0.5e0 + 0.25e0 AS lat_center, -180 + floor((lon + 180) / 0.5e0) * 0.5e0 + 0.25e0 AS lon_center,
               CAST({twins.ROW} // 5 AS VARCHAR) || '_' || CAST({twins.COL} // 5 AS VARCHAR) AS cell_block_id FROM fx_obs""",
    ["fx_obs"],
)
def _(x):
    block = cells.block_index("lat", "lon")
    made = x.fx_obs.select(
        "sorting_id", cells.block_id("lat", "lon").alias("block_id"), block[0].alias("b"), block[1].alias("c"),
        cells.cell_block_id(cells.nearest_row("lat"), cells.nearest_col("lon")).alias("cell_block_id"),
    )
    return made.withColumns(cells.block_bounds("b", "c")).drop("b", "c")


@query(
    "fn14_quality_bits",
    """SELECT date, row, col, qc_raw & 255 = 255 AS is_fill, qc_raw & 1 <> 0 AS is_frozen, qc_raw & 2 <> 0 AS is_polarisation_rfi,
              (qc_raw >> 2) & 3 = 1 AS is_spectral_medium, (qc_raw >> 2) & 3 = 2 AS is_spectral_severe, qc_raw & 16 <> 0 AS is_snow_ice
       FROM fx_grid_daily""",
    ["fx_grid_daily"],
)
def _(x):
    return x.fx_grid_daily.select("date", "row", "col", *[c.alias(n) for n, c in qcbits.decode("qc_raw").items()])


_FLAG = """CASE WHEN {fill} THEN 6 WHEN qc_raw & 16 <> 0 THEN 5 WHEN (qc_raw >> 2) & 3 = 2 THEN 4 WHEN (qc_raw >> 2) & 3 = 1 THEN 3
                WHEN qc_raw & 2 <> 0 THEN 2 WHEN qc_raw & 1 <> 0 THEN 1 ELSE 0 END"""
_TAUS = ["tau_ku_h", "tau_x_h", "tau_c_h"]


@query(
    "fn15_quality_flag",
    f"""SELECT date, row, col, {_FLAG.format(fill='qc_raw & 255 = 255 OR tau_ku_h IS NULL OR tau_x_h IS NULL OR tau_c_h IS NULL')} AS flag_joint,
               {_FLAG.format(fill='qc_raw & 255 = 255')} AS flag_independent FROM fx_grid_daily""",
    ["fx_grid_daily"],
)
def _(x):
    return x.fx_grid_daily.select(
        "date", "row", "col",
        qcbits.priority_flag("qc_raw", _TAUS, True).alias("flag_joint"),
        qcbits.priority_flag("qc_raw", _TAUS).alias("flag_independent"),
    )


@query(
    "fn16_keep_flag_mask",
    f"""SELECT date, row, col, {', '.join(f"CASE WHEN flag IN (0, 1) THEN {t} END AS {t}" for t in _TAUS)}
        FROM (SELECT *, {_FLAG.format(fill='qc_raw & 255 = 255')} AS flag FROM fx_grid_daily)""",
    ["fx_grid_daily"],
)
def _(x):
    return x.fx_grid_daily.select("date", "row", "col", *qcbits.mask_by_flag(_TAUS, qcbits.priority_flag("qc_raw"), (0, 1)))


@query(
    "fn17_raw_zero_mask",
    f"SELECT date, row, col, {', '.join(f'CASE WHEN qc_raw & 255 = 0 THEN {t} END AS {t}' for t in _TAUS)} FROM fx_grid_daily",
    ["fx_grid_daily"],
)
def _(x):
    return x.fx_grid_daily.select("date", "row", "col", *qcbits.mask_by_raw_zero(_TAUS, "qc_raw"))


@query(
    "fn18_raw_value_repair",
    """SELECT row, col, round(CASE WHEN raw_value BETWEEN 0 AND 100 THEN raw_value * 0.1e0 END, 9) AS lai,
              round(CASE WHEN raw_value * 6 BETWEEN 0 AND 250 THEN raw_value * 6 * 0.004e0 END, 9) AS fvc,
              round(CASE WHEN raw_value <> 0 AND raw_value * 400 BETWEEN 7500 AND 65535 THEN raw_value * 400 * 0.02e0 END, 9) AS lst,
              round(CASE WHEN raw_value <> 255 THEN raw_value * 0.01e0 END, 9) AS land_cover,
              CASE WHEN raw_value - 20 >= 0 THEN raw_value - 20 END AS rain FROM fx_pixels""",
    ["fx_pixels"],
)
def _(x):
    raw = F.col("raw_value")
    made = x.fx_pixels.select(
        "row", "col",
        values.repair_raw(raw, "lai").alias("lai"),
        values.repair_raw(raw * 6, "fvc").alias("fvc"),
        values.repair_raw(raw * 400, "lst").alias("lst"),
        values.repair_raw(raw, "land_cover").alias("land_cover"),
        values.repair_raw(raw - 20, "rain").alias("rain"),
    )
    return rounded(made, "lai", "fvc", "lst", "land_cover", digits=9)


@query(
    "fn19_safe_fractions",
    "SELECT event_id, CASE WHEN event_id % 9 = 0 OR value < 5 THEN 0.0 ELSE value - 5 END AS fraction FROM events",
)
def _(x):
    odd = F.when(F.col("event_id") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("value") - 5)
    return x.table("events").select("event_id", landcover.safe_fraction(odd).alias("fraction"))


_VEG = names.VEGETATION_CLASSES


@query(
    "fn20_dominant_class",
    f"""SELECT cell, CASE WHEN {twins.total(_VEG)} > 0 THEN {twins.argmax(_VEG)} END AS lc_dom, {twins.argmax(_VEG)} AS lc_dom_legacy,
               round(list_max([{', '.join(f'greatest(coalesce({c}, 0), 0)' for c in _VEG)}]) / nullif({twins.total(_VEG)}, 0), 9) AS lc_dom_frac
        FROM fx_classes""",
    ["fx_classes"],
)
def _(x):
    made = x.fx_classes.select(
        "cell", landcover.dominant_class(_VEG).alias("lc_dom"),
        landcover.dominant_class(_VEG, legacy_first_class=True).alias("lc_dom_legacy"),
        landcover.dominant_share(_VEG).alias("lc_dom_frac"),
    )
    return rounded(made, "lc_dom_frac", digits=9)


@query(
    "fn21_entropy",
    """SELECT cell, round(CASE WHEN whole > 0 THEN list_sum(list_transform([gra, sav, osh, bar], lambda v: -(v / whole) * ln(greatest(v / whole, 1e-12)))) ELSE 0 END, 9) AS entropy
       FROM (SELECT *, gra + sav + osh + bar AS whole FROM fx_fractions)""",
    ["fx_fractions"],
)
def _(x):
    return x.fx_fractions.select("cell", F.round(landcover.entropy(["gra", "sav", "osh", "bar"]), 9).alias("entropy"))


@query(
    "fn22_purity_weight",
    "SELECT event_id, round(CASE WHEN event_id % 10 = 0 THEN 0.2 ELSE greatest(0.2, pow(least(value / 100, 1), 2)) END, 9) AS weight FROM events",
)
def _(x):
    purity = F.when(F.col("event_id") % 10 != 0, F.col("value") / 100)
    return x.table("events").select("event_id", F.round(landcover.purity_weight(purity), 9).alias("weight"))


@query(
    "fn23_single_label_terms",
    """SELECT event_id, coalesce(label, 'Unknown') AS igbp_dom, CASE WHEN label IS NULL THEN 0.0 ELSE 1.0 END AS igbp_dom_frac,
              CASE WHEN label IS NULL THEN NULL ELSE 0.0 END AS igbp_entropy, CASE WHEN label IS NULL THEN 0.2 ELSE 1.0 END AS igbp_weight
       FROM (SELECT event_id, CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS label FROM events)""",
)
def _(x):
    label = F.when(F.col("event_type") != "view", F.col("event_type"))
    return x.table("events").select("event_id", *[c.alias(n) for n, c in landcover.single_label_terms(label).items()])


@query(
    "fn24_nonvegetation_share",
    """SELECT sample_id, round(CASE WHEN s > 1 THEN s / 100 ELSE s END, 9) AS nonveg_frac
       FROM (SELECT sample_id, greatest(coalesce(SNO * k, 0), 0) + greatest(coalesce(BAR * k, 0), 0) + greatest(coalesce(URB * k, 0), 0) + greatest(coalesce("Water" * k, 0), 0) AS s
             FROM (SELECT *, CASE WHEN sample_id % 2 = 0 THEN 1 ELSE 100 END AS k FROM fx_predictors))""",
    ["fx_predictors"],
)
def _(x):
    classes = names.NONVEGETATION_CLASSES
    percent = F.when(F.col("sample_id") % 2 == 0, 1).otherwise(100)
    made = x.fx_predictors.withColumns({c: F.col(c) * percent for c in classes})
    return made.select("sample_id", F.round(landcover.nonvegetation_share(classes), 9).alias("nonveg_frac"))


def _present_sum(members):
    return f"CASE WHEN coalesce({', '.join(members)}) IS NULL THEN NULL ELSE {' + '.join(f'coalesce({m}, 0)' for m in members)} END"


_GROUPED = ", ".join(f"{_present_sum(m)} AS {n}" for n, m in {**names.MERGED_CLASSES, "MixHerb": ["CVM", "WSA"]}.items())
_MERGED_LIST = ", ".join(f"coalesce({c}, -1)" for c in names.MERGED_ORDER)


@query(
    "fn25_merged_groups",
    f"""SELECT cell, round(NF, 9) AS NF, round(BF, 9) AS BF, round(SH, 9) AS SH, round(Herb, 9) AS Herb, round(NonVeg, 9) AS NonVeg, round(MixHerb, 9) AS MixHerb,
               [{', '.join(f"'{c}'" for c in names.MERGED_ORDER)}][list_position([{_MERGED_LIST}], list_max([{_MERGED_LIST}]))] AS lc_dom,
               round(list_max([{_MERGED_LIST}]), 9) AS lc_dom_frac, round(NonVeg, 9) AS nonveg_frac, CASE WHEN coalesce(NonVeg, 0) >= 0.05 THEN 1 ELSE 0 END AS nonveg_skip
        FROM (SELECT *, {_GROUPED} FROM (SELECT * REPLACE (CASE WHEN cell % 5 = 0 THEN NULL ELSE ENF END AS ENF, CASE WHEN cell % 5 = 0 THEN NULL ELSE DNF END AS DNF) FROM fx_classes))""",
    ["fx_classes"],
)
def _(x):
    holed = x.fx_classes.withColumns({c: F.when(F.col("cell") % 5 != 0, F.col(c)) for c in ("ENF", "DNF")})
    made = holed.withColumns(landcover.merged_groups(with_mixed_herb=True)).withColumns(landcover.merged_dominant())
    numbers = ["NF", "BF", "SH", "Herb", "NonVeg", "MixHerb", "lc_dom_frac", "nonveg_frac"]
    return rounded(made.select("cell", *numbers, "lc_dom", "nonveg_skip"), *numbers, digits=9)


@query("fn26_class_of_label", f"SELECT sorting_id, {twins.LABEL_CLASS} AS class_code FROM fx_obs", ["fx_obs"])
def _(x):
    return x.fx_obs.select("sorting_id", landcover.class_of_label("igbp_label").alias("class_code"))


@query(
    "fn27_home_country",
    """SELECT sorting_id, lower(trim(country)) IN ('usa', 'u.s.a.', 'us', 'u.s.', 'united states', 'united states of america')
              AND NOT contains(lower(trim(state_region)), 'hawai') AS is_home FROM fx_obs""",
    ["fx_obs"],
)
def _(x):
    return x.fx_obs.select("sorting_id", landcover.home_country("country", "state_region").alias("is_home"))


@query("fn28_safe_divide", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE round(value / (event_id % 3), 9) END AS quotient FROM events")
def _(x):
    quotient = values.safe_divide(F.col("value"), (F.col("event_id") % 3).cast("double"))
    return x.table("events").select("event_id", F.round(quotient, 9).alias("quotient"))


@query(
    "fn29_cover_proxy",
    """SELECT row, col, round(least(greatest(0.5 * least(greatest(coalesce(canopy_height / 20, 0), 0), 1) + 0.3 * (1 - exp(-0.6 * greatest(coalesce(canopy_height / 5, 0), 0)))
              + 0.2 * (1 - exp(-greatest(coalesce(agb, 0), 0) / 120)), 0), 1), 9) AS vegf FROM fx_static""",
    ["fx_static"],
)
def _(x):
    proxy = landcover.vegetation_cover_proxy(F.col("canopy_height") / 20, F.col("canopy_height") / 5, "agb")
    return x.fx_static.select("row", "col", F.round(proxy, 9).alias("vegf"))


@query(
    "fn30_gravimetric_moisture",
    """SELECT event_id, round(least(greatest(4 * value / (4 * value + 100), 0), 0.999999), 9) AS mg, round(value * 4, 6) AS lfmc_back FROM events""",
)
def _(x):
    made = x.table("events").select("event_id", microwave.gravimetric_moisture(F.col("value") * 4).alias("mg"))
    return made.select("event_id", F.round("mg", 9).alias("mg"), F.round(microwave.moisture_percent("mg"), 6).alias("lfmc_back"))


@query(
    "fn31_conductivity",
    """SELECT event_id, round(greatest(0.16 * s - 0.0013 * s * s, 0), 8) AS sigma,
              round(greatest(0.16 * s - 0.0013 * s * s, 0) * greatest(1 + 0.02 * (t - 22), 0), 8) AS sigma_t
       FROM (SELECT event_id, value / 2 AS s, value / 5 - 40 AS t FROM events)""",
)
def _(x):
    made = x.table("events").select("event_id", (F.col("value") / 2).alias("s"), (F.col("value") / 5 - 40).alias("t"))
    sigma = microwave.conductivity("s")
    return made.select(
        "event_id", F.round(sigma, 8).alias("sigma"), F.round(microwave.conductivity_at(sigma, "t"), 8).alias("sigma_t")
    )


_CHAIN = """w AS (
  SELECT event_id, 4 * value AS lfmc, band, hz, hz / 1e9 AS f, 2 + event_id % 20 AS h, (event_id % 11) / 10.0 AS v, value / 20 AS t
  FROM events, (VALUES ('C', 6.9e9), ('X', 10.65e9), ('Ku', 18.7e9)) b(band, hz)
  WHERE (event_id % 3 = 0 AND band = 'C') OR (event_id % 3 = 1 AND band = 'X') OR (event_id % 3 = 2 AND band = 'Ku')),
water AS (
  SELECT *, 4.9 + 75 / (1 + (f / 18) * (f / 18)) AS fw_re, -75 * (f / 18) / (1 + (f / 18) * (f / 18)) AS fw_im,
         sqrt(f / 0.18 / 2) AS q, least(greatest(lfmc / (lfmc + 100), 0), 0.999999) AS m FROM w),
bound AS (
  SELECT *, 2.9 + 55 * (1 + q) / ((1 + q) * (1 + q) + q * q) AS bw_re, -55 * q / ((1 + q) * (1 + q) + q * q) AS bw_im FROM water),
veg AS (
  SELECT *, 1.7 - 0.74 * m + 6.16 * m * m + greatest(m * (0.55 * m - 0.076), 0) * fw_re + 4.64 * m * m / (1 + 7.36 * m * m) * bw_re AS v_re,
         least(greatest(m * (0.55 * m - 0.076), 0) * fw_im + 4.64 * m * m / (1 + 7.36 * m * m) * bw_im, 0) AS v_im FROM bound),
can AS (
  SELECT *, 1 + v * (pow(sqrt(v_re * v_re + v_im * v_im), 1.0 / 3) * cos(atan2(v_im, v_re) / 3) - 1) AS t_re,
         v * pow(sqrt(v_re * v_re + v_im * v_im), 1.0 / 3) * sin(atan2(v_im, v_re) / 3) AS t_im FROM veg),
mixed AS (
  SELECT *, t_re * t_re * t_re - 3 * t_re * t_im * t_im AS c_re, 3 * t_re * t_re * t_im - t_im * t_im * t_im AS c_im FROM can),
depth AS (
  SELECT *, sqrt((sqrt(c_re * c_re + c_im * c_im) - c_re) / 2) AS loss FROM mixed)"""


def _chain(x):
    e = F.col("event_id")
    return x.table("events").select(
        "event_id", (F.col("value") * 4).alias("lfmc"),
        F.when(e % 3 == 0, "C").when(e % 3 == 1, "X").otherwise("Ku").alias("band"),
        (e % 20 + 2).cast("double").alias("h"), ((e % 11) / 10).alias("v"), (F.col("value") / 20).alias("t"),
    ).withColumn("f", microwave.band_hz("band") / 1e9)


@query(
    "fn32_free_water",
    f"""WITH {_CHAIN}, warm AS (
          SELECT *, 87.740 - 0.400081 * t + 9.398e-4 * t * t - 1.410e-6 * t * t * t AS es,
                 1 / (2 * pi() * 1.382264e-13 * exp(652.7648 / (t + 133.1383))) / 1e9 AS f0 FROM water)
        SELECT event_id, round(fw_re, 6) AS re, round(fw_im, 6) AS im, round(4.9 + (es - 4.9) / (1 + (f / f0) * (f / f0)), 6) AS re_t,
               round(-(es - 4.9) * (f / f0) / (1 + (f / f0) * (f / f0)) - 0.5 / (2 * pi() * 8.854e-12 * f * 1e9), 6) AS im_t FROM warm""",
)
def _(x):
    cold = microwave.free_water("f")
    warm = microwave.free_water("f", 0.5, "t")
    made = _chain(x).select("event_id", cold.alias("a"), warm.alias("b"))
    parts = {"re": "a", "im": "a", "re_t": "b", "im_t": "b"}
    return made.select("event_id", *[F.round(F.col(z).getField(n[:2]), 6).alias(n) for n, z in parts.items()])


@query("fn33_bound_water", f"WITH {_CHAIN} SELECT event_id, round(bw_re, 6) AS re, round(bw_im, 6) AS im FROM bound")
def _(x):
    made = _chain(x).select("event_id", microwave.bound_water("f").alias("z"))
    return made.select("event_id", F.round("z.re", 6).alias("re"), F.round("z.im", 6).alias("im"))


def _veg(x):
    staged = _chain(x).withColumns(
        {"mg": microwave.gravimetric_moisture("lfmc"), "free": microwave.free_water("f"), "bound": microwave.bound_water("f")}
    )
    return staged.withColumn("veg", microwave.plant_dielectric("mg", F.col("free"), F.col("bound")))


@query(
    "fn34_plant_dielectric",
    f"""WITH {_CHAIN} SELECT event_id, round(v_re, 6) AS re, round(v_im, 6) AS im,
               round(1.6 + 25 * least(greatest(lfmc / (100 + greatest(lfmc, 0)), 0), 0.999999), 6) AS rational_re,
               round(-(0.05 + 10 * least(greatest(lfmc / (100 + greatest(lfmc, 0)), 0), 0.999999)), 6) AS rational_im FROM veg""",
)
def _(x):
    made = _veg(x).withColumn("r", microwave.rational_dielectric("lfmc"))
    return made.select(
        "event_id", F.round("veg.re", 6).alias("re"), F.round("veg.im", 6).alias("im"),
        F.round("r.re", 6).alias("rational_re"), F.round("r.im", 6).alias("rational_im"),
    )


@query("fn35_canopy_mixture", f"WITH {_CHAIN} SELECT event_id, round(c_re, 6) AS re, round(c_im, 6) AS im FROM mixed")
def _(x):
    made = _veg(x).withColumn("can", microwave.mix_with_air(F.col("veg"), "v"))
    return made.select("event_id", F.round("can.re", 6).alias("re"), F.round("can.im", 6).alias("im"))


@query(
    "fn36_forward_depth",
    f"""WITH {_CHAIN} SELECT event_id, round(4 * pi() * h / (299792458.0 / hz) * loss, 6) AS vod, round(0.3 * loss, 6) AS vod_proportional,
               round(least(greatest(4 * pi() * h / (299792458.0 / hz) * loss, 0), 2), 6) AS vod_clamped FROM depth""",
)
def _(x):
    canopy = _veg(x).withColumn("can", microwave.mix_with_air(F.col("veg"), "v"))
    lam = microwave.wavelength_m(microwave.band_hz("band"))
    depths = canopy.withColumns(
        {
            "vod_proportional": microwave.optical_depth(F.col("can"), lam, "h", alpha=0.3),
            "vod_clamped": microwave.optical_depth(F.col("can"), lam, "h", clamp_max=2.0),
        }
    )
    whole = microwave.with_forward_depth(depths, "lfmc", "v", "h", "band", "vod")
    return rounded_doubles(whole.select("event_id", "vod", "vod_proportional", "vod_clamped"), 6)


@query(
    "fn37_file_name_dates",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders""",
)
def _(x):
    d, k = "o_orderdate", F.col("o_orderkey")
    number = F.concat(F.year(d).cast("string"), F.lpad(F.dayofyear(d).cast("string"), 3, "0"))
    name = (
        F.when(k % 3 == 0, F.concat(F.lit("GLASS01B01.V60.A"), number, F.lit(".hdf")))
        .when(k % 3 == 1, F.concat(F.lit("MOD11C1_"), number, F.lit("_All-weather.h5")))
        .otherwise(F.concat(F.date_format(d, "yyyyMMdd"), F.lit(".h5")))
    )
    return x.table("orders").select("o_orderkey", calendar.file_name_day(name).alias("day"))


@query(
    "fn38_constant_fill",
    "SELECT date, row, col, coalesce(tau_ku_h, -9999.0) AS filled, tau_ku_h AS kept FROM fx_grid_daily",
    ["fx_grid_daily"],
)
def _(x):
    return x.fx_grid_daily.select(
        "date", "row", "col", values.fill_missing("tau_ku_h", -9999.0).alias("filled"), values.fill_missing("tau_ku_h", None).alias("kept")
    )


