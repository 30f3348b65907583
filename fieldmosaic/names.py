"""Column names, class lists, word lists and thresholds."""

from __future__ import annotations

# Fixed values ---------------------------------------------------------------
# They have to be exactly these for results to be comparable.

# Core sample column -> spreadsheet headers it may come from, in order.
SAMPLE_HEADERS = {
    "sorting_id": ["Sorting ID", "sorting_id", "SortingID", "ID", "id"],
    "site_name": ["Site name", "Site Name", "site_name", "site"],
    "lat": ["Latitude (WGS84, EPSG:4326)", "Latitude", "lat", "LAT"],
    "lon": ["Longitude (WGS84, EPSG:4326)", "Longitude", "lon", "LON"],
    "date": ["Sampling date (YYYYMMDD)", "Sampling Date (YYYYMMDD)", "Sampling date", "date", "Date"],
    "sampling_time_raw": ["Sampling time (24h format)", "Sampling Time (24h format)", "Sampling time", "time", "Time"],
    "lfmc_pct": ["LFMC value (%)", "LFMC (%)", "LFMC", "lfmc", "lfmc_pct"],
    "extra_info_flag": ["Extra information/Quality Flag", "Extra Info Flag", "extra_info_flag"],
    "isolated_iforest_raw": ["Isolated data point", "isolated_iforest", "isolated"],
    "species": ["Species collected", "species", "Species"],
    "functional_type": ["Species functional type", "Functional type", "functional_type"],
    "protocol": ["Protocol", "protocol"],
    "source": ["Reference", "Database", "source", "dataset", "Source"],
}
TRUE_WORDS = ["1", "true", "t", "yes", "y"]
DEAD_PROTOCOLS = ["7", "9", "14b", "17", "27", "32c"]
SUSPECT_WORDS = ["outlier", "anomal", "error", "suspect", "dead", "flower", "bud", "wrong", "invalid"]
VEGETATION_KINDS = {
    "Grass": ["grass", "graminoid", "sedge", "forb", "geophyte"],
    "Shrub": ["shrub", "large shrub", "subshrub"],
    "Tree": ["tree", "small tree"],
}
CELL_KINDS = {
    "Tree": ["tree", "small tree"],
    "Shrub": ["shrub", "large shrub", "subshrub", "shrub/small tree"],
    "Herb": ["grass", "forb", "sedge", "graminoid", "geophyte"],
}
VALUE_MIN, VALUE_MAX = 0.0, 400.0
LOCATION_PRECISION = 1e-4

BANDS = [
    "VOD_Ku_Hpol_Asc", "VOD_Ku_Vpol_Asc",
    "VOD_X_Hpol_Asc", "VOD_X_Vpol_Asc",
    "VOD_C_Hpol_Asc", "VOD_C_Vpol_Asc",
]
CORE_FEATURES = ["LAI", "Hveg", "SM", "LST"]
CORE_FEATURES_LITE = ["LAI", "Hveg", "LST"]
SEASON_FEATURES = ["doy_sin", "doy_cos", "lat_norm"]
VEGETATION_CLASSES = [
    "ENF", "EBF", "DNF", "DBF", "MF", "CSH", "OSH",
    "WSA", "SAV", "GRA", "WET", "CRO", "CVM",
]
NONVEGETATION_CLASSES = ["SNO", "BAR", "URB", "Water"]
CLASS_OF_LABEL = {
    "Evergreen Needleleaf Forests": "ENF",
    "Evergreen Broadleaf Forests": "EBF",
    "Deciduous Needleleaf Forests": "DNF",
    "Deciduous Broadleaf Forests": "DBF",
    "Mixed Forests": "MF",
    "Closed Shrublands": "CSH",
    "Open Shrublands": "OSH",
    "Woody Savannas": "WSA",
    "Savannas": "SAV",
    "Grasslands": "GRA",
    "Permanent Wetlands": "WET",
    "Croplands": "CRO",
    "Cropland/Natural Vegetation Mosaics": "CVM",
    "Snow and Ice": "SNO",
    "Barren": "BAR",
    "Urban and Built-up Lands": "URB",
    "Water Bodies": "Water",
}
NONVEGETATION_LABELS = ["Barren", "Urban and Built-up Lands", "Water Bodies", "Snow and Ice"]
MERGED_CLASSES = {
    "NF": ["ENF", "DNF"],
    "BF": ["EBF", "DBF"],
    "SH": ["OSH", "CSH"],
    "Herb": ["CRO", "SAV", "GRA"],
    "NonVeg": ["URB", "BAR", "SNO", "Water"],
}
MERGED_ORDER = ["NF", "BF", "SH", "Herb", "WET", "WSA", "CVM", "MF", "NonVeg"]
CLASS_ALIASES = {
    "SNO": ["SNO", "Snow", "SnowIce", "PermanentSnowIce", "Permanent Snow and Ice"],
    "BAR": ["BAR", "Barren"],
    "URB": ["URB", "Urban", "UrbanBuiltup", "Urban_Builtup", "Urban and Builtup Lands"],
    "Water": ["Water", "WAT", "WaterBodies", "Water Bodies"],
}
HOME_COUNTRY_SPELLINGS = ["usa", "u.s.a.", "us", "u.s.", "united states", "united states of america"]
NONVEG_TRAINING_MAX = 0.05
NONVEG_INFERENCE_MAX = 0.7
WEIGHT_MIN, WEIGHT_GAMMA = 0.2, 2.0
SEASON_PERIOD = 365.25

GRID_ROWS, GRID_COLS, CELL_DEG = 1800, 3600, 0.1
BLOCK_DEG, BLOCK_CELLS = 0.5, 5
SPLIT_SEED, TRAIN_SHARE, VAL_SHARE = 42, 0.8, 0.1
SPLIT_CODES = {"train": 1, "val": 2, "test": 3}

# Raw product value -> physical value: fill value, valid range, scale.
PRODUCT_REPAIR = {
    "lai": {"fill": None, "valid": (0.0, 100.0), "scale": 0.1},
    "fvc": {"fill": None, "valid": (0.0, 250.0), "scale": 0.004},
    "lst": {"fill": 0.0, "valid": (7500.0, 65535.0), "scale": 0.02},
    "land_cover": {"fill": 255.0, "valid": None, "scale": 0.01},
    "rain": {"fill": None, "valid": (0.0, None), "scale": 1.0},
}

BAND_HZ = {"C": 6.9e9, "X": 10.65e9, "Ku": 18.7e9}
LIGHT_SPEED = 299_792_458.0
VACUUM_PERMITTIVITY = 8.854e-12

WINDOW_STEPS = 4
WINDOW_STATIC = ["Hveg", "lat_norm"]
WINDOW_DYNAMIC = BANDS + ["LAI", "LST", "doy_sin", "doy_cos"]

NON_FEATURE_COLUMNS = ["lfmc_pct", "date", "lat", "lon", "row", "col", "predictor_valid", "valid_for_inference"]
# End of fixed values --------------------------------------------------------
