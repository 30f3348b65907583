"""Training base, scheme, ablation and final frames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import names
from ..functions import calendar, landcover
from ..functions import values as cols
from ..operators import splits
from ..sources.tables import require_columns

KEYS = ["sample_id", "date", "lat", "lon", "lfmc_pct"]
PROPORTION_PREFIX = "IGBP_prop_"


def proportion_columns(columns: Sequence[str]) -> tuple[list[str], list[str]]:
    """Label proportion columns that are vegetation, and their label texts."""
    picked = [c for c in columns if c.startswith(PROPORTION_PREFIX)]
    labels = [c[len(PROPORTION_PREFIX):].replace("_", " ") for c in picked]
    kept = [(c, t) for c, t in zip(picked, labels) if t not in names.NONVEGETATION_LABELS]
    return [c for c, _ in kept], [t for _, t in kept]


def base_filter(df: DataFrame, core: Sequence[str]) -> DataFrame:
    """Target, place and day present, target not 0, some band present, core features present."""
    return df.where(
        cols.all_present(["lfmc_pct", "lat", "lon", "date", *core])
        & (F.col("lfmc_pct") != 0)
        & cols.any_present(names.BANDS)
    )


def season_terms(lat: str = "lat", date: str = "date", period: float = names.SEASON_PERIOD) -> dict[str, Column]:
    sine, cosine = calendar.day_of_year_terms(date, period)
    return {"doy_sin": sine, "doy_cos": cosine, "lat_norm": F.col(lat) / F.lit(90.0)}


def training_base(df: DataFrame, core: Sequence[str] = tuple(names.CORE_FEATURES), label: str = "igbp_label") -> DataFrame:
    """Filtered predictor rows with season, dominance, entropy, weight and consistency columns.

    Narrow transformations only: no shuffle before the split.
    """
    require_columns(df, [*KEYS[1:], label, *names.BANDS, *core, *names.VEGETATION_CLASSES])
    props, labels = proportion_columns(df.columns)
    numbers = [c for c in [*names.BANDS, *core, *names.VEGETATION_CLASSES, *names.NONVEGETATION_CLASSES, *props] if c in df.columns]
    df = df.withColumns({c: F.expr(cols.finite_text(c)) for c in ["lfmc_pct", "lat", "lon", *numbers]})
    out = base_filter(df, core).withColumns(season_terms())
    classes = names.VEGETATION_CLASSES
    other = [c for c in names.NONVEGETATION_CLASSES if c in df.columns]
    out = out.withColumns({"__lc": landcover.fractions(classes), **({"__props": landcover.fractions(props)} if props else {})})
    labelled = dominance_terms(props, labels, "igbp_dom", "__props") if props else landcover.single_label_terms(label)
    out = out.withColumns(
        {
            **labelled,
            **dominance_terms(classes, classes, "lc_dom", "__lc"),
            "nonveg_frac": landcover.nonvegetation_share(other),
            "igbp_to_lc_dom": landcover.class_of_label(label),
        }
    )
    # A projection of its own: the weights name the shares several times.
    weights = {f"{k}_weight": landcover.purity_weight(f"{k}_dom_frac") for k in ("lc", "igbp")}
    return out.withColumns(weights).drop("__lc", "__props")


def dominance_terms(classes: Sequence[str], labels: Sequence[str], out: str, values: str | None = None) -> dict[str, Column]:
    """Dominant class, its share and entropy; ``values`` names a stored array of the fractions."""
    return {
        out: landcover.dominant_class(classes, labels, values=values),
        f"{out}_frac": landcover.dominant_share(classes, values),
        f"{out.removesuffix('_dom')}_entropy": landcover.entropy(classes, values),
    }


@dataclass(frozen=True)
class FrameSpec:
    """What one experiment keeps of the base frame."""

    code: str
    description: str
    category: str = "lc_dom"
    extra: tuple[str, ...] = ("lc_dom_frac", "lc_entropy")
    weight: str | None = "lc_weight"
    consistent_only: bool = True
    vegetated_only: bool = False
    bands: bool = True
    core: tuple[str, ...] = tuple(names.CORE_FEATURES)
    season: bool = True
    proportions: bool = True
    without: tuple[str, ...] = field(default=())


# Experiment codes and what each keeps or removes.
_IGBP = {"category": "igbp_dom", "consistent_only": False}
SCHEMES = [
    FrameSpec("S1_FT", "functional type only", "FT", (), None, False),
    FrameSpec("S2_IGBP_DOM", "largest label class", extra=(), weight=None, **_IGBP),
    FrameSpec("S3_IGBP_DOM_FE", "largest label class, its share and the mixture", extra=("igbp_dom_frac", "igbp_entropy"), weight=None, **_IGBP),
    FrameSpec("S4_IGBP_DOM_FE_W", "label class with share and mixture, rows weighted by purity", extra=("igbp_dom_frac", "igbp_entropy"), weight="igbp_weight", **_IGBP),
    FrameSpec("S5_LC_DOM_FE_W", "mapped class with share and mixture, rows weighted by purity", consistent_only=False),
    FrameSpec("S6_LC_DOM_FE_W_CONS", "as S5, rows whose label agrees with the map"),
    FrameSpec("S7_LC_DOM_FE_W_CONS_NV", "as S6, vegetated cells only", vegetated_only=True),
]
ABLATIONS = [
    FrameSpec("A0_FULL_S6", "full S6 frame"),
    FrameSpec("A1_NO_CONS", "without the consistency filter", consistent_only=False),
    FrameSpec("A2_NO_WEIGHT", "without weights", weight=None),
    FrameSpec("A3_NO_FRAC_ENTROPY", "without share and entropy", extra=()),
    FrameSpec("A4_NO_FRAC", "without share", extra=("lc_entropy",)),
    FrameSpec("A5_NO_ENTROPY", "without entropy", extra=("lc_dom_frac",)),
    FrameSpec("A6_NO_VOD", "without bands", bands=False),
    FrameSpec("A7_NO_CORE", "without core features", core=()),
    FrameSpec("A8_NO_SEASON", "without season terms", season=False),
    FrameSpec("A9_NO_IGBP_PROPS", "without label proportions", proportions=False),
]
FINE_ABLATIONS = [
    FrameSpec("FULL_S6", "full S6 frame"),
    FrameSpec("B1_NO_DOY_SIN", "without doy_sin", without=("doy_sin",)),
    FrameSpec("B2_NO_DOY_COS", "without doy_cos", without=("doy_cos",)),
    FrameSpec("B3_NO_LAT_NORM", "without lat_norm", without=("lat_norm",)),
    FrameSpec("B4_NO_LAI", "without LAI", without=("LAI",)),
    FrameSpec("B5_NO_SM", "without SM", without=("SM",)),
    FrameSpec("B6_NO_LST", "without LST", without=("LST",)),
    FrameSpec("B7_NO_HVEG", "without Hveg", without=("Hveg",)),
    FrameSpec("NO_CONS", "without the consistency filter", consistent_only=False),
]
FINAL = FrameSpec(
    "S6_LITE", "final frame", extra=(), weight=None, core=tuple(names.CORE_FEATURES_LITE), proportions=False
)
# End of fixed values.


def numeric_columns(base: DataFrame, spec: FrameSpec) -> list[str]:
    picked = list(names.BANDS) if spec.bands else []
    picked += spec.core
    picked += names.SEASON_FEATURES if spec.season else []
    picked += proportion_columns(base.columns)[0] if spec.proportions else []
    picked += spec.extra
    return [c for c in dict.fromkeys(picked) if c not in spec.without]


def _kept(base: DataFrame, spec: FrameSpec) -> Column:
    """Row filter of one experiment.

    Season terms and class entropy are present on every base row, so they are
    not tested: a test would copy their expressions into the pushed filter.
    """
    keep = cols.all_present(["lfmc_pct", spec.category])
    if spec.consistent_only:
        keep = keep & (F.col("igbp_to_lc_dom") == F.col("lc_dom"))
    if spec.vegetated_only:
        keep = keep & (F.col("nonveg_frac") < names.NONVEG_TRAINING_MAX)
    if spec.bands:
        keep = keep & cols.any_present(names.BANDS)
    certain = [*names.BANDS, *names.SEASON_FEATURES, "lc_entropy"]
    strict = [c for c in numeric_columns(base, spec) if c not in certain]
    return keep & cols.all_present(strict) if strict else keep


def _weight(spec: FrameSpec) -> Column:
    if not spec.weight:
        return F.lit(1.0)
    floor = F.lit(names.WEIGHT_MIN)
    return F.greatest(F.coalesce(F.col(spec.weight), floor), floor)


def experiment_rows(base: DataFrame, spec: FrameSpec, carry: Sequence[str] = ()) -> DataFrame:
    """Filtered and projected rows of one experiment with their weight; still no shuffle."""
    keys = [c for c in KEYS if c in base.columns]
    kept = base.where(_kept(base, spec))
    return kept.select(*keys, spec.category, *numeric_columns(base, spec), *carry, _weight(spec).alias("sample_weight"))


def experiment_matrix(base: DataFrame, specs: Sequence[FrameSpec], seed: int = names.SPLIT_SEED) -> DataFrame:
    """Rows of many experiments at once: code, keys, category, features, weight, block and split.

    There is a column for every feature of any experiment; it is NULL in the rows
    of an experiment that does not use it, and ``feature_names`` tells which it uses.
    Each row is expanded to the experiments that keep it, and blocks are split per
    experiment. Only code, category, weight and names differ between the copies of a row;
    features are carried beside them once and blanked by code after the expansion. The
    split of the blocks is a job of its own, so that the rows need no shuffle to meet it.
    """
    keys = [c for c in KEYS if c in base.columns]
    used = {spec.code: numeric_columns(base, spec) for spec in specs}
    features = list(dict.fromkeys(c for some in used.values() for c in some))
    entries = [
        F.when(
            _kept(base, spec),
            F.struct(
                F.lit(spec.code).alias("code"),
                F.col(spec.category).alias("category"),
                _weight(spec).alias("sample_weight"),
                F.lit(",".join(used[spec.code])).alias("feature_names"),
            ),
        )
        for spec in specs
    ]
    carried = [F.col(c).cast("double").alias(c) for c in features]
    placed = splits.with_blocks(base)
    where = ["block_lat", "block_lon", "block_id"]
    expanded = placed.select(*keys, *carried, *where, F.explode(F.array_compact(F.array(*entries))).alias("__e"))
    blanked = []
    for c in features:
        users = [code for code, some in used.items() if c in some]
        blanked.append(F.col(c) if len(users) == len(specs) else F.when(F.col("__e.code").isin(users), F.col(c)).alias(c))
    made = expanded.select(*keys, "__e.*", *blanked, *where)
    return made.join(splits.stored_blocks(made, "block_id", seed, by=["code"]), ["code", "block_id"], "inner")


def experiment_frame(base: DataFrame, spec: FrameSpec, seed: int = names.SPLIT_SEED) -> DataFrame:
    """Rows of one experiment with weight, block and split."""
    return splits.spatial_split(experiment_rows(base, spec), seed)


def final_frame(df: DataFrame, seed: int = names.SPLIT_SEED) -> DataFrame:
    """The final frame straight from predictor rows: lite core features, consistent rows, weight 1."""
    base = training_base(df, names.CORE_FEATURES_LITE)
    return experiment_frame(base, FINAL, seed)


def transfer_frame(df: DataFrame, country: str = "country", region: str = "state_region", **years) -> DataFrame:
    """Final-frame rows with the transfer split; country and region travel along, no join back."""
    base = training_base(df, names.CORE_FEATURES_LITE)
    rows = experiment_rows(base, FINAL, carry=(country, region))
    return splits.transfer_split(rows, country, region, **years)


def aligned_for_scoring(df: DataFrame, label: str | None = "igbp_label") -> DataFrame:
    """Season and class columns recomputed the training way on raw product columns."""
    classes = names.VEGETATION_CLASSES
    made = {
        **season_terms(),
        "lc_dom": landcover.dominant_class(classes),
        "lc_dom_frac": landcover.dominant_share(classes),
    }
    if label and label in df.columns:
        made["igbp_to_lc_dom"] = landcover.class_of_label(label)
    return df.withColumns(made)
