"""Land-cover fractions, labels, vegetation kinds and sample weights.

Arg-max, share and entropy work on one array of the class fractions. Written out
per class they grow past the size the JVM compiles, and filters on them, which
are pushed below projections, copy the whole expression. They are SQL text
because a row of seventeen classes would otherwise take hundreds of calls into
the JVM per expression.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import names
from .values import clip, col, finite, quoted, sum_present


def safe_fraction(c: Column | str) -> Column:
    """Missing, non-finite and negative fractions count as 0."""
    return F.greatest(F.coalesce(finite(c), F.lit(0.0)), F.lit(0.0))


def _safe_text(name: str) -> str:
    """``safe_fraction`` of a column that already went through the NaN policy of the readers."""
    return f"greatest(coalesce({quoted(name)}, 0D), 0D)"


def _array_text(classes: Sequence[str], values: str | None = None) -> str:
    return quoted(values) if values else f"array({', '.join(_safe_text(c) for c in classes)})"


def _total_text(classes: Sequence[str]) -> str:
    return "(" + " + ".join(_safe_text(c) for c in classes) + ")"


def fractions(classes: Sequence[str]) -> Column:
    """Safe fractions as an array: store it once, then name it as ``values`` below."""
    return F.expr(_array_text(classes))


def dominant_class(
    classes: Sequence[str],
    labels: Sequence[str] | None = None,
    legacy_first_class: bool = False,
    values: str | None = None,
) -> Column:
    """Class with the largest fraction, the first one on ties.

    Without any positive fraction the class is NULL; ``legacy_first_class``
    returns the first class instead, as an arg-max over zeros would. ``values``
    names a column that holds ``fractions(classes)``.
    """
    array = _array_text(classes, values)
    texts = ", ".join(f"'{label}'" for label in (labels or classes))
    place = f"CAST(array_position({array}, array_max({array})) AS INT)"
    best = f"element_at(array({texts}), {place})"
    return F.expr(best if legacy_first_class else f"CASE WHEN array_max({array}) > 0 THEN {best} END")


def _stored_sum(count: int, values: str, term: str = "{v}") -> str:
    """Sum over a stored array, item by item from the left: compiled, as a lambda is not."""
    return "(" + " + ".join(["0D", *[term.format(v=f"{quoted(values)}[{i}]") for i in range(count)]]) + ")"


def dominant_share(classes: Sequence[str], values: str | None = None) -> Column:
    array = _array_text(classes, values)
    if values:
        return F.expr(f"try_divide(array_max({array}), {_stored_sum(len(classes), values)})")
    return F.expr(f"try_divide(array_max({array}), aggregate({array}, 0D, (total, v) -> total + v))")


def entropy(classes: Sequence[str], values: str | None = None) -> Column:
    """Shannon entropy of the normalised fractions; 0 for a row without fractions.

    ``ln S - sum(v ln v) / S`` equals ``-sum(p ln p)`` with ``p = v / S`` and
    takes one pass over the classes.
    """
    if values:
        total, logs = _stored_sum(len(classes), values), _stored_sum(len(classes), values, "{v} * ln(greatest({v}, 1e-300D))")
        return F.expr(f"CASE WHEN {total} > 0 THEN greatest(ln({total}) - {logs} / {total}, 0D) + 0D ELSE 0D END")
    step = "struct(acc.total + v AS total, acc.logs + v * ln(greatest(v, 1e-300D)) AS logs)"
    done = "CASE WHEN acc.total > 0 THEN greatest(ln(acc.total) - acc.logs / acc.total, 0D) + 0D ELSE 0D END"
    start = "struct(0D AS total, 0D AS logs)"
    return F.expr(f"aggregate({_array_text(classes, values)}, {start}, (acc, v) -> {step}, acc -> {done})")


def purity_weight(
    purity: Column | str, gamma: float = names.WEIGHT_GAMMA, floor: float = names.WEIGHT_MIN
) -> Column:
    share = F.coalesce(clip(finite(purity), 0, 1), F.lit(0.0))
    return F.greatest(F.lit(float(floor)), F.pow(share, F.lit(float(gamma))))


def single_label_terms(label: Column | str) -> dict[str, Column]:
    """Dominant class terms when only one label per row is known."""
    known = F.coalesce(col(label), F.lit("Unknown"))
    unknown = known == "Unknown"
    share = F.when(unknown, F.lit(0.0)).otherwise(F.lit(1.0))
    return {
        "igbp_dom": known,
        "igbp_dom_frac": share,
        "igbp_entropy": F.when(unknown, F.lit(None).cast("double")).otherwise(F.lit(0.0)),
        "igbp_weight": purity_weight(share),
    }


def nonvegetation_share(classes: Sequence[str] = tuple(names.NONVEGETATION_CLASSES)) -> Column:
    """Sum of the non-vegetation classes; sums above 1 are taken as percent."""
    if not classes:
        return F.lit(0.0)
    whole = F.expr(_total_text(classes))
    return F.when(whole > 1.0, whole / F.lit(100.0)).otherwise(whole)


def merged_groups(with_mixed_herb: bool = False) -> dict[str, Column]:
    """Merged classes NF, BF, SH, Herb, NonVeg; NULL where no member is present."""
    groups = {name: sum_present(members) for name, members in names.MERGED_CLASSES.items()}
    if with_mixed_herb:
        groups["MixHerb"] = sum_present(["CVM", "WSA"])
    return groups


def merged_dominant() -> dict[str, Column]:
    """Dominant of the nine merged classes, over columns made by ``merged_groups``."""
    members = ", ".join(quoted(c) for c in names.MERGED_ORDER)
    texts = ", ".join(f"'{c}'" for c in names.MERGED_ORDER)
    best = f"element_at(array({texts}), CAST(array_position(array({members}), greatest({members})) AS INT))"
    nonveg = finite("NonVeg")
    return {
        "lc_dom": F.expr(f"CASE WHEN greatest({members}) IS NULL THEN 'Unknown' ELSE {best} END"),
        "lc_dom_frac": F.expr(f"greatest({members})"),
        "nonveg_frac": nonveg,
        "nonveg_skip": (F.coalesce(nonveg, F.lit(0.0)) >= names.NONVEG_TRAINING_MAX).cast("int"),
    }


def class_of_label(label: Column | str) -> Column:
    """Class code of a land-cover label; unmapped and missing labels are ``Unknown``."""
    table = F.create_map(*[F.lit(part) for pair in names.CLASS_OF_LABEL.items() for part in pair])
    return F.coalesce(F.element_at(table, col(label)), F.lit("Unknown"))


def _lookup(text: Column, table: dict[str, list[str]], default: str) -> Column:
    chain = None
    for kind, words in table.items():
        hit = text.isin(words)
        chain = F.when(hit, kind) if chain is None else chain.when(hit, kind)
    return chain.otherwise(default)


def vegetation_kind(functional_type: Column | str) -> Column:
    """Grass, Shrub, Tree or Unknown (borderline kinds stay Unknown on purpose)."""
    text = F.lower(F.trim(F.coalesce(col(functional_type), F.lit(""))))
    return _lookup(text, names.VEGETATION_KINDS, "Unknown")


def cell_kind(functional_type: Column | str) -> Column:
    """Kind used when the members of one cell are combined; NULL for other kinds."""
    text = F.lower(F.trim(col(functional_type)))
    found = _lookup(text, names.CELL_KINDS, "")
    return F.when(found != "", found)


def home_country(country: Column | str, region: Column | str | None = None) -> Column:
    """Mainland or Alaska: one of six spellings and not a region named like Hawaii."""
    named = F.lower(F.trim(F.coalesce(col(country), F.lit("")))).isin(names.HOME_COUNTRY_SPELLINGS)
    if region is None:
        return named
    place = F.lower(F.trim(F.coalesce(col(region), F.lit(""))))
    return named & ~place.contains("hawai")


def vegetation_cover_proxy(fvc: Column | str, lai: Column | str, agb: Column | str) -> Column:
    """Volume fraction proxy from cover, leaf area and biomass; missing inputs count as 0."""
    cover, leaf, biomass = [F.coalesce(finite(c), F.lit(0.0)) for c in (fvc, lai, agb)]
    leaf_term = F.lit(1.0) - F.exp(F.lit(-0.6) * clip(leaf, 0))
    mass_term = F.lit(1.0) - F.exp(-clip(biomass, 0) / F.lit(120.0))
    proxy = F.lit(0.5) * clip(cover, 0, 1) + F.lit(0.3) * leaf_term + F.lit(0.2) * mass_term
    return clip(proxy, 0, 1)
