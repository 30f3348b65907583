"""Spatially independent splits, transfer splits and seeded samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import names
from ..functions import cells, landcover
from ..session import scratch_path
from . import scale


def seeded_hash(seed: int, key: Column | str) -> Column:
    """md5 text of ``seed|key``: a shuffle order that does not depend on row order."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def assign_blocks(
    blocks: DataFrame,
    block: str = "block_id",
    seed: int = names.SPLIT_SEED,
    train: float = names.TRAIN_SHARE,
    val: float = names.VAL_SHARE,
    by: Sequence[str] = (),
) -> DataFrame:
    """Split of each distinct block; counts are ``rint(n * share)``, the rest is test.

    There are at most 360 x 720 blocks of half a degree on the globe, which
    bounds the ranking window whatever the number of samples. ``by`` splits
    the blocks of several experiments independently.
    """
    distinct = blocks.select(*by, block).where(F.col(block).isNotNull()).distinct()
    ranked = distinct.withColumns(
        {
            "__rn": F.row_number().over(Window.partitionBy(*by).orderBy(seeded_hash(seed, block), F.col(block))),
            "__n": F.count(F.lit(1)).over(Window.partitionBy(*by)),
        }
    )
    n_train = F.rint(F.col("__n") * F.lit(train))
    n_val = F.rint(F.col("__n") * F.lit(val))
    split = (
        F.when(F.col("__rn") <= n_train, "train").when(F.col("__rn") <= n_train + n_val, "val").otherwise("test")
    )
    return ranked.select(*by, block, split.alias("split"))


def stored_blocks(blocks: DataFrame, block: str = "block_id", seed: int = names.SPLIT_SEED, **options) -> DataFrame:
    """``assign_blocks``, written and read back: a join knows its size, which the globe bounds."""
    return _stored(assign_blocks(blocks, block, seed, **options), "blocks")


def with_blocks(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    block_lat, block_lon = cells.block_index(lat, lon)
    placed = df.withColumns({"block_lat": block_lat, "block_lon": block_lon})
    return placed.withColumn("block_id", F.concat_ws("_", "block_lat", "block_lon"))


def split_by_block(df: DataFrame, block: str = "block_id", seed: int = names.SPLIT_SEED, **shares) -> DataFrame:
    """Rows with their block's split; rows without a block are dropped."""
    return df.join(assign_blocks(df, block, seed, **shares), [block], "inner")


def spatial_split(df: DataFrame, seed: int = names.SPLIT_SEED) -> DataFrame:
    """80/10/10 split by half-degree block of lat/lon."""
    return split_by_block(with_blocks(df), "block_id", seed)


def cell_split(df: DataFrame, seed: int = names.SPLIT_SEED) -> DataFrame:
    """The same on blocks of five by five cells of row/col."""
    return split_by_block(df.withColumn("block_id_05deg", cells.cell_block_id("row", "col")), "block_id_05deg", seed)


def split_overlaps(df: DataFrame, block: str = "block_id") -> DataFrame:
    """Blocks that occur in more than one split; empty for an independent split."""
    pairs = df.select(block, "split").distinct()
    return pairs.groupBy(block).agg(F.count(F.lit(1)).alias("n_splits")).where(F.col("n_splits") > 1)


def transfer_split(
    df: DataFrame,
    country: str = "country",
    region: str | None = "state_region",
    train_years: tuple[int, int] = (2002, 2018),
    future_years: tuple[int, int] = (2019, 2023),
) -> DataFrame:
    """Home-country past for training, its future seen / unseen blocks, and the rest of the world.

    Home rows outside both periods are dropped. The overlap test joins the
    distinct training blocks, so no block has to fit into one task.
    """
    home = landcover.home_country(country, region)
    year = F.year("date")
    marked = with_blocks(df).withColumns(
        {"__home": home, "__train": home & year.between(*train_years), "__future": home & year.between(*future_years)}
    )
    seen = marked.where("__train").select("block_id").distinct().withColumn("__seen", F.lit(True))
    joined = marked.join(seen, ["block_id"], "left")
    split = (
        F.when(F.col("__train"), "train_us")
        .when(F.col("__future") & F.col("__seen").isNotNull(), "val_us_overlap")
        .when(F.col("__future"), "val_us_nonoverlap")
        .when(~F.col("__home"), "test_external")
    )
    return joined.withColumn("split", split).where(F.col("split").isNotNull()).drop("__home", "__train", "__future", "__seen")


def seeded_sample(
    df: DataFrame, keys: Sequence[str], row_key: Sequence[str], n: int, seed: int = names.SPLIT_SEED, unique: bool = False
) -> DataFrame:
    """At most n rows per group in a seeded order that depends on the row key only; ``unique`` counts equal rows once.

    Rows are counted per group and range of the hash, so only those of the lowest ranges are kept and
    ranked, however large a group is. With copies these may be too few: groups that lack rows take
    more ranges. The counts are jobs of their own.
    """
    hashed = df.withColumn("__hash", seeded_hash(seed, F.concat_ws("|", *[F.col(c).cast("string") for c in row_key])))
    hashed = hashed.withColumn("__range", F.conv(F.substring("__hash", 1, 3), 16, 10).cast("int"))
    counted = hashed.groupBy(*keys, "__range").agg(F.count(F.lit(1)).alias("__c"))
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = _stored(counted.withColumn("__before", F.coalesce(F.sum("__c").over(earlier), F.lit(0))), "ranges")
    wanted = n
    while True:
        # a range is needed if fewer rows than wanted are in the ranges before it
        cuts = ranges.groupBy(*keys).agg(
            F.max(F.when(F.col("__before") < wanted, F.col("__range"))).alias("__cut"), F.max("__range").alias("__last")
        )
        near = scale.match_on(hashed, _stored(cuts, "cuts"), keys).where(F.col("__range") <= F.col("__cut"))
        if not unique:
            break
        near = _stored(near.distinct(), "sample")
        found = near.groupBy(*keys, "__cut", "__last").agg(F.count(F.lit(1)).alias("__n"))
        if found.where((F.col("__n") < n) & (F.col("__cut") < F.col("__last"))).isEmpty():
            break
        wanted *= 8
    order = [F.col("__hash"), *[F.col(c) for c in row_key]]
    return scale.lowest_n(near, keys, order, n).select(*df.columns)


def _stored(df: DataFrame, label: str) -> DataFrame:
    """Rows written under the shared folder and read back, so that Spark knows how few they are."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def block_table(df: DataFrame) -> DataFrame:
    """One row per block: bounds, centre, split and split code."""
    firsts = df.groupBy("block_id", "block_lat", "block_lon").agg(F.min("split").alias("split"))
    return with_block_geometry(firsts)


def with_block_geometry(df: DataFrame) -> DataFrame:
    code = F.lit(0)
    for split, number in names.SPLIT_CODES.items():
        code = F.when(F.col("split") == split, number).otherwise(code)
    return df.withColumns({**cells.block_bounds("block_lat", "block_lon"), "split_code": code})


def split_code_grid(blocks: DataFrame) -> DataFrame:
    """Dense 360 x 720 table of split codes, 0 where there is no block."""
    spark = blocks.sparkSession
    lat_blocks, lon_blocks = int(round(180 / names.BLOCK_DEG)), int(round(360 / names.BLOCK_DEG))
    cells_of = spark.range(lat_blocks * lon_blocks).select(
        F.floor(F.col("id") / lon_blocks).cast("int").alias("block_lat"),
        F.pmod("id", F.lit(lon_blocks)).cast("int").alias("block_lon"),
    )
    codes = blocks.select("block_lat", "block_lon", "split_code")
    joined = cells_of.join(codes, ["block_lat", "block_lon"], "left")
    return joined.withColumn("split_code", F.coalesce("split_code", F.lit(0)))
