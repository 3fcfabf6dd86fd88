"""Assembly of the model table from plot metrics, disturbance history, centroids and climate grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from understory.functions.missing import if_else, not_in
from understory.functions.scalars import relative_richness, terrain_terms
from understory.operators.diversity import time_since_change
from understory.operators.joins import left_join, natural_left_join
from understory.operators.spatial import GridTransform, sample_raster, sample_raster_360
from understory.operators.verbs import split_by_site, stack_frames

# Sites left out of the study, and the Alaskan sites.
EXCLUDED_SITES = ("SJER", "ONAQ", "BLAN", "STEI")
ALASKA_SITES = ("HEAL", "DEJU", "BONA")

# Predictors and responses of the forests.
PREDICTORS = ("mean_max_canopy_ht", "rumple", "map", "mat", "deepgap_fraction", "latitude", "tmax", "tmin", "vert_cv",
              "entropy", "gfp", "vai", "nspp_native", "shannon_native", "folded_aspect", "min_elev", "slope")
RESPONSES = ("rel_cover_exotic", "rer", "i_cat")


def base_plots(centroids: DataFrame) -> DataFrame:
    return centroids.filter(F.col("subtype") == "basePlot").select("plot_id", "latitude", "longitude").distinct()


def build_model_table(insitu: DataFrame, history: DataFrame, centroids: DataFrame,
                      grid: tuple[DataFrame, GridTransform], grid_alaska: tuple[DataFrame, GridTransform],
                      excluded: Sequence[str] = EXCLUDED_SITES,
                      alaska: Sequence[str] = ALASKA_SITES) -> DataFrame:
    """Plot metrics with terrain terms, time since change, climate normals and coordinates.

    Alaskan rows are sampled from their own grid on 0-360 longitudes and have no
    time since change. Rows with a missing site stay with the rest.
    """
    dd = (insitu.withColumns(terrain_terms())
          .withColumns({"rer": relative_richness(),
                        "i_cat": if_else(F.col("nspp_exotic") > 0, F.lit(1), F.lit(0))})
          .filter(not_in(F.col("site"), excluded)))
    changes = time_since_change(history.filter(not_in(F.col("site"), excluded)))
    dd_ak, dd_rest = split_by_site(dd, "site", alaska)
    dd_rest = natural_left_join(dd_rest, changes)

    plots = base_plots(centroids)
    # the plot is the only key: a coordinate the plot table already has stays, and is no key
    known = [c for c in ("latitude", "longitude") if c in dd.columns]
    norms = sample_raster(plots, grid[0], grid[1]).drop("longitude", *known)
    norms_ak = sample_raster_360(plots, grid_alaska[0], grid_alaska[1]).drop("longitude", *known)
    return stack_frames([left_join(dd_rest, norms, ["plot_id"]), left_join(dd_ak, norms_ak, ["plot_id"])])
