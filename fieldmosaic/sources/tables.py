"""Sample and predictor tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import names
from ..functions import values
from ..operators.cleaning import clean_header, tidy_headers


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return df


def _suffix(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return f".{name.rsplit('.', 1)[-1].lower()}" if "." in name else ""


def _csv_schema(spark: SparkSession, path: str) -> T.StructType:
    """All-string schema from the header line; no pass over the data for inference."""
    header = spark.read.option("header", True).option("inferSchema", False).csv(path).columns
    return T.StructType([T.StructField(c, T.StringType()) for c in header])


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Raw samples as text columns from CSV, or as stored from Parquet; other files are refused."""
    suffix = _suffix(path)
    if suffix == ".csv":
        return spark.read.schema(_csv_schema(spark, path)).option("header", True).option("multiLine", False).csv(path)
    if suffix in (".parquet", ".pq"):
        return spark.read.parquet(path)
    raise ValueError(f"unsupported sample file: {path}")


def read_predictors(spark: SparkSession, path: str, required: Sequence[str], numeric: Sequence[str] = ()) -> DataFrame:
    """Predictor CSV with tidied headers, required columns checked, numbers parsed."""
    df = spark.read.schema(_csv_schema(spark, path)).option("header", True).option("enforceSchema", True).csv(path)
    df = require_columns(tidy_headers(df), required)
    return df.withColumns({c: values.to_number(c) for c in numeric if c in df.columns})


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV or Parquet by suffix."""
    suffix = _suffix(path)
    if suffix == ".csv":
        return spark.read.schema(_csv_schema(spark, path)).option("header", True).csv(path)
    if suffix in (".parquet", ".pq"):
        return spark.read.parquet(path)
    raise ValueError(f"Unsupported input format: {path}")


def coalesce_columns(df: DataFrame, wanted: dict[str, Sequence[str]], data_type: str = "double") -> DataFrame:
    """Rename each standard name from its first existing alias (any case), else add a NULL column."""
    by_lower = {c.lower(): c for c in reversed(df.columns)}
    picks, used = [], set()
    for name, aliases in wanted.items():
        exact = next((a for a in aliases if a in df.columns), None)
        found = exact or next((by_lower[a.lower()] for a in aliases if a.lower() in by_lower), None)
        used.add(found)
        picks.append((F.col(f"`{found}`") if found else F.lit(None)).cast(data_type).alias(name))
    rest = [F.col(f"`{c}`") for c in df.columns if c not in used and c not in wanted]
    return df.select(*rest, *picks)


def finite_columns(df: DataFrame) -> DataFrame:
    """NaN and infinities of all floating columns to NULL: apply once after reading."""
    floating = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: values.finite(c) for c in floating})


def feature_columns(df: DataFrame, excluded: Sequence[str] = tuple(names.NON_FEATURE_COLUMNS)) -> list[str]:
    return [c for c in df.columns if c not in excluded]


__all__ = [
    "clean_header", "coalesce_columns", "feature_columns", "finite_columns", "read_predictors", "read_samples",
    "read_table", "require_columns",
]
