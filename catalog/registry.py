"""Query registration."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import views

ENTRIES: dict[str, "Entry"] = {}


class Inputs:
    """The given tables and the views derived from them, for one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str, use: Sequence[str] = ()) -> DataFrame:
        """SQL over given tables and derived views; only tables the text names are registered."""
        full = views.with_views(text, use)
        for name in views.BASE_TABLES:
            if re.search(rf"\b{name}\b", full):
                self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(full)

    def __getattr__(self, name: str) -> DataFrame:
        """``inputs.fx_obs``: a derived view."""
        if name.startswith("fx_"):
            return self.sql(f"SELECT * FROM {name}", [name])
        raise AttributeError(name)


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


def query(name: str, sql: str | None = None, use: Sequence[str] = ()):
    """Register a query; ``use`` names the views its SQL twin reads."""

    def register(build: Callable[[Inputs], DataFrame]):
        if name in ENTRIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Inputs(spark, folder))

        ENTRIES[name] = Entry(run, views.with_views(sql, use) if sql else None)
        return build

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles at fixed decimals, so that sums in any order compare equal."""
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def rounded_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    return rounded(df, *[f.name for f in df.schema.fields if f.dataType.typeName() == "double"], digits=digits)
