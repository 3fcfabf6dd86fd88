"""Text and numeric scalar expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def str_c(*cols: Column) -> Column:
    """Concatenation that is NULL when any part is NULL."""
    return F.concat(*[c.cast("string") for c in cols])


def paste0(*cols: Column) -> Column:
    """Concatenation in which a NULL part reads 'NA'."""
    return F.concat(*[F.coalesce(c.cast("string"), F.lit("NA")) for c in cols])


def year_text(col: Column) -> Column:
    """The year part of a 'yyyy-MM' string."""
    return F.substring(col, 1, 4)


def year_of(col: Column) -> Column:
    """The year of a 'yyyy-MM' string as int, NULL when it is no number."""
    return year_text(col).try_cast("int")


def extract_first(col: Column, pattern: str) -> Column:
    """First regex match, NULL (not '') when there is none."""
    return F.regexp_substr(col, F.lit(pattern))


def replace_all(col: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Apply regex replacements in the given order."""
    for pattern, replacement in rules:
        col = F.regexp_replace(col, pattern, replacement)
    return col


def remove_all(col: Column, patterns: Sequence[str]) -> Column:
    return replace_all(col, [(p, "") for p in patterns])


def upper_if_three(col: Column) -> Column:
    """Three-letter names are shown in capitals."""
    return F.when(F.length(col) == 3, F.upper(col)).otherwise(col)


def round_to(col: Column, digits: int) -> Column:
    """Round half away from zero after scaling: plain double arithmetic, no decimal conversion."""
    scale = float(10**digits)
    return F.round(col * F.lit(scale)) / F.lit(scale)


def signif(col: Column, digits: int) -> Column:
    """Round to a number of significant digits; zero stays zero."""
    scale = F.pow(F.lit(10.0), F.lit(float(digits - 1)) - F.floor(F.log10(F.abs(col))))
    return F.when(col == 0, F.lit(0.0)).otherwise(F.round(col * scale) / scale)


def map_lookup(col: Column, table: Mapping[str, str]) -> Column:
    """Fixed small lookup as a literal map: NULL for names that are absent."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.element_at(F.create_map(*pairs), col)


def folded_aspect(aspect: Column) -> Column:
    """Aspect folded about the southwest-northeast line, in degrees (McCune & Keon 2002)."""
    return F.abs(F.lit(180.0) - F.abs(aspect - F.lit(225.0)))


def terrain_terms() -> dict[str, Column]:
    """Terrain terms from `aspect` and `slope`.

    The cosine is taken of the raw value, although the column holds degrees:
    that is what the published tables were made with.
    """
    fold, cosine = folded_aspect(F.col("aspect")), F.cos(F.col("aspect"))
    return {"folded_aspect": fold, "cosign_aspect": cosine,
            "slope_aspect": F.col("slope") * cosine, "slope_fa": F.col("slope") * fold}


def relative_richness(scale: float = 1.0) -> Column:
    """Exotic over total richness, NULL for a plot without species."""
    return F.try_divide(F.col("nspp_exotic").cast("double"), F.col("nspp_total")) * F.lit(scale)


def wrap_longitude(lon: Column) -> Column:
    """Longitudes on 0-360; values that are already positive stay."""
    return F.when(lon < 0, lon + F.lit(360.0)).otherwise(lon)


def significance_stars(p: Column) -> Column:
    return (F.when(p < 0.001, F.lit("***")).when(p < 0.01, F.lit("**"))
            .when(p < 0.05, F.lit("*")).when(p.isNotNull(), F.lit("")))


def excludes_zero(low: Column, high: Column) -> Column:
    return low * high > 0


def percent_if_invasion(response: Column, value: Column) -> Column:
    """Responses whose name starts with 'Invasion' are shown in percent."""
    return F.when(F.substring(response, 1, 8) == "Invasion", value * 100.0).otherwise(value)


def invasion_class(value: Column, full: float) -> Column:
    """Invasion level class; `full` is 100 on the percent scale and 1 on the fraction scale."""
    half = full / 2
    return (F.when(value == full, F.lit("100")).when(value == 0, F.lit("0"))
            .when((value > 0) & (value < half), F.lit("0-50"))
            .when((value >= half) & (value < full), F.lit("50-100")))
