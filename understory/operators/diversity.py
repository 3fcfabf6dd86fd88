"""Community metrics: taxon cover, richness, Shannon, relative cover, beta diversity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from understory.functions.missing import if_else
from understory.functions.scalars import extract_first, str_c, year_of
from understory.operators.joins import left_join, member_of, right_join
from understory.operators.ordering import join_back
from understory.operators.verbs import matching_columns, stack_frames, to_long, visited_years

SCALES = {"plot": ["site", "plot_id", "year"], "site": ["site", "year"]}
SUB_UNITS = {"plot": "subplot_id", "site": "plot_id"}


def taxon_cover(cover: DataFrame, scale: str = "plot") -> DataFrame:
    """Total cover per taxon and unit; missing cover adds nothing but the taxon counts as present."""
    return (cover.groupBy(*SCALES[scale], "species", "nativity")
            .agg(F.sum("cover").alias("cover")))


def diversity_metrics(cover: DataFrame, scale: str = "plot") -> DataFrame:
    """Richness, Shannon, relative exotic cover and the invaded label in two shuffles.

    A taxon counts once whatever its codes; one recorded as native and as exotic
    counts in both groups, each with its own cover. Records without a taxon add
    to the cover totals only.

    Shannon uses H = ln(T) - sum(c ln c)/T, which needs no per-unit total
    beforehand and hence no join or window.
    """
    groups = {"total": F.lit(True), "native": F.col("nativity") == "N",
              "exotic": F.col("nativity") == "I"}
    taxa = cover.groupBy(*SCALES[scale], "species").agg(*[
        a for name, cond in groups.items() for a in (
            F.count(F.when(cond, 1)).alias(f"_n_{name}"), F.sum(F.when(cond, F.col("cover"))).alias(f"_c_{name}"))])
    known, aggs = F.col("species").isNotNull(), []
    for name in groups:
        c = F.when(F.col(f"_c_{name}") > 0, F.col(f"_c_{name}"))
        aggs += [F.count(F.when(known & (F.col(f"_n_{name}") > 0), 1)).alias(f"nspp_{name}"),
                 F.sum(F.when(known, c)).alias(f"_t_{name}"), F.sum(c).alias(f"_a_{name}"),
                 F.sum(F.when(known, c * F.ln(c))).alias(f"_cl_{name}")]
    wide = taxa.groupBy(*SCALES[scale]).agg(*aggs)
    shannon = {f"shannon_{g}": F.ln(F.col(f"_t_{g}")) - F.try_divide(F.col(f"_cl_{g}"), F.col(f"_t_{g}"))
               for g in groups}
    exotic = F.coalesce(F.col("_a_exotic"), F.lit(0.0))
    return (wide.withColumns(shannon)
            .withColumn("rel_cover_exotic", F.try_divide(exotic, F.col("_a_total")))
            .withColumn("invaded", F.when(F.col("nspp_exotic") > 0, "invaded").otherwise("not invaded"))
            .drop(*[f"_{k}_{g}" for k in ("t", "a", "cl") for g in groups]))


def beta_diversity(cover: DataFrame, scale: str = "plot") -> DataFrame:
    """Multiple-site Sorensen dissimilarity and its turnover and nestedness parts (Baselga 2010).

    No pair of sub-units is formed. With S_i the richness of unit i, a_ij the
    shared species and n_k the number of units holding species k:
    sum a_ij = sum_k n_k(n_k-1)/2, min(b,c) = min(S_i,S_j) - a_ij, and
    sum min(S_i,S_j) follows from the richness histogram. NULL with one unit.
    """
    keys, unit = SCALES[scale], SUB_UNITS[scale]
    presence = cover.filter(F.col("species").isNotNull()).select(*keys, unit, "species").distinct()

    shared = (presence.groupBy(*keys, "species").agg(F.count(F.lit(1)).alias("n"))
              .groupBy(*keys)
              .agg(F.count(F.lit(1)).alias("_st"),
                   F.sum(F.col("n") * (F.col("n") - 1) / 2.0).alias("_a")))
    rich = presence.groupBy(*keys, unit).agg(F.count(F.lit(1)).alias("s"))
    hist = rich.groupBy(*keys, "s").agg(F.count(F.lit(1)).alias("m"))
    # one row per distinct richness: at most the species pool of the group
    higher = W.partitionBy(*keys).orderBy(F.col("s").desc()).rowsBetween(W.unboundedPreceding, -1)
    hist = hist.withColumn("_hi", F.coalesce(F.sum("m").over(higher), F.lit(0)))
    m, s = F.col("m"), F.col("s")
    units = hist.groupBy(*keys).agg(
        F.sum(m).alias("n_units"), F.sum(s * m).alias("_sum_s"),
        F.sum(s * (m * (m - 1) / 2.0 + m * F.col("_hi"))).alias("_min_s"))
    j = join_back(units, shared, keys)
    mins = F.col("_min_s") - F.col("_a")
    maxs = (F.col("n_units") - 1) * F.col("_sum_s") - F.col("_min_s") - F.col("_a")
    excess = F.col("_sum_s") - F.col("_st")
    return (j.withColumn("beta_sim", F.try_divide(mins, excess + mins))
            .withColumn("beta_sor", F.try_divide(mins + maxs, excess * 2 + mins + maxs))
            .withColumn("beta_nes", F.col("beta_sor") - F.col("beta_sim"))
            .select(*keys, "n_units", "beta_sor", "beta_sim", "beta_nes"))


def diversity_info(cover: DataFrame, scale: str) -> DataFrame:
    """All metrics of one scale, tagged with it."""
    keys = SCALES[scale]
    out = join_back(diversity_metrics(cover, scale), beta_diversity(cover, scale), keys)
    return out.withColumn("scale", F.lit(scale))


def site_plot_summaries(cover: DataFrame, visits: DataFrame, calendar: DataFrame) -> DataFrame:
    """Plot- and site-scale metrics stacked, attached to visit months, kept for calendar years.

    `visits` holds (site_id, monthyear); a site visited twice in a year doubles its rows.
    """
    stacked = stack_frames([diversity_info(cover, "plot"), diversity_info(cover, "site")])
    months = visits.select("site_id", "monthyear").distinct().withColumn("year", year_of(F.col("monthyear")))
    dated = right_join(stacked, months, [("site", "site_id"), ("year", "year")])
    return member_of(dated, visited_years(calendar), [("site", "site_id"), ("year", "year")])


def attach_structure(vegetation: DataFrame, lidar: DataFrame) -> DataFrame:
    """Vegetation rows whose plot-year has lidar, with the lidar metrics attached.

    Site-scale rows have no plot, hence no key and no lidar: they drop out.
    """
    metrics = lidar.withColumn("year_plot", str_c(year_of(F.col("monthyear")), F.col("plot_id")))
    drop = [c for c in ("monthyear", "sitemonthyear", "site_id", "year") if c in metrics.columns]
    metrics = metrics.drop(*drop)
    veg = vegetation.withColumn("year_plot", str_c(F.col("year").cast("int"), F.col("plot_id")))
    veg = member_of(veg, metrics, [("year_plot", "year_plot")])
    veg = veg.drop(*[c for c in ("subplot_id", "scale") if c in veg.columns])
    return left_join(veg, metrics, ["year_plot", "plot_id"])


def time_since_change(history: DataFrame) -> DataFrame:
    """Days since change for the row's own year; 0 ('never') becomes 99999.

    Columns named x_tsc...yyyy... hold one year each; those ending in median_1
    are left out. `history` has plot_id, site, year.
    """
    keys = ["plot_id", "year", "site"]
    cols = matching_columns(history, "x_tsc", not_suffix="median_1")
    long = to_long(history.select(*keys, *cols), keys, cols)
    hit = long.withColumn("_y", extract_first(F.col("name"), r"\d{4}").try_cast("int"))
    value = if_else(F.col("value") == 0, F.lit(99999), F.col("value"))
    return (hit.filter(F.col("year") == F.col("_y"))
            .select("plot_id", "year", value.alias("days_since_change"), "site").distinct())
