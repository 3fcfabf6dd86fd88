"""Coordinates, tiles, box crops and raster sampling.

Range predicates are always carried by an equi-join on grid cells, so Spark
plans a hash or sort-merge join (with AQE skew splitting), never a nested loop.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from understory.functions.geodesy import to_utm
from understory.functions.scalars import wrap_longitude
from understory.session import broadcast_if_small

TILE_SIZE = 1000.0   # edge of a delivered point-cloud tile, metres
HALF_WIDTH = 100.0   # half the edge of a plot clip, metres


def with_utm(df: DataFrame, lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    return df.withColumns(to_utm(F.col(lon), F.col(lat)))


def cell_index(col: Column, size: float) -> Column:
    return F.floor(col / F.lit(float(size))).cast("long")


def _cells_between(low: Column, high: Column, size: float) -> Column:
    return F.explode(F.sequence(cell_index(low, size), cell_index(high, size)))


def tiles_for(plots: DataFrame, half: float = HALF_WIDTH, size: float = TILE_SIZE) -> DataFrame:
    """Distinct lower-left tile corners touched by the plots' buffers."""
    e = plots.select("northing", _cells_between(F.col("easting") - half, F.col("easting") + half, size).alias("_e"))
    n = e.select("_e", _cells_between(F.col("northing") - half, F.col("northing") + half, size).alias("_n"))
    return n.select((F.col("_e") * int(size)).alias("tile_e"), (F.col("_n") * int(size)).alias("tile_n")).distinct()


def with_tile(points: DataFrame, size: float = TILE_SIZE) -> DataFrame:
    """Add the tile corner columns used as partition columns of stored points."""
    return points.withColumns({"tile_e": cell_index(F.col("x"), size) * int(size),
                               "tile_n": cell_index(F.col("y"), size) * int(size)})


def crop(points: DataFrame, boxes: DataFrame, half: float = HALF_WIDTH, cell: float | None = None,
         match: Sequence[str] = ()) -> DataFrame:
    """Points inside each plot's half-open square; a point in two squares appears for both.

    Every box is listed under the cells it touches (at most nine with the default
    cell, which equals the half width) and each point under its own one cell, so
    a pair meets exactly once. `match` adds equality keys such as site and year.
    Boxes are broadcast only if Catalyst estimates them below the session limit.
    """
    cell = float(cell or half)
    tagged = boxes.select(
        *match, "plot_id", "easting", "northing",
        _cells_between(F.col("easting") - half, F.col("easting") + half, cell).alias("_cx"))
    tagged = tagged.select("*", _cells_between(F.col("northing") - half, F.col("northing") + half, cell).alias("_cy"))
    pts = points.withColumns({"_cx": cell_index(F.col("x"), cell), "_cy": cell_index(F.col("y"), cell)})
    inside = ((F.col("x") >= F.col("easting") - half) & (F.col("x") < F.col("easting") + half)
              & (F.col("y") >= F.col("northing") - half) & (F.col("y") < F.col("northing") + half))
    joined = pts.join(broadcast_if_small(tagged), [*match, "_cx", "_cy"]).filter(inside)
    return joined.drop("_cx", "_cy")


def clip_key(site: Column, monthyear: Column, easting: Column, northing: Column) -> Column:
    """Name of a plot clip; coordinates always with two decimals, whatever they were read as."""
    number = lambda c: F.format_string("%.2f", c.cast("double"))
    return F.concat(site, F.lit("_"), monthyear, F.lit("_"), number(easting), F.lit("_"), number(northing))


@dataclass(frozen=True)
class GridTransform:
    """Upper-left corner and cell sizes of a north-up grid."""

    x0: float
    y0: float
    dx: float
    dy: float

    def cell_of(self, x: Column, y: Column) -> tuple[Column, Column]:
        return (F.floor((F.lit(self.y0) - y) / F.lit(self.dy)).cast("int"),
                F.floor((x - F.lit(self.x0)) / F.lit(self.dx)).cast("int"))


def wide_cells(cells: DataFrame, layers: Sequence[str]) -> DataFrame:
    """Long (layer, cell_row, cell_col, value) to one row per cell with a column per layer."""
    return cells.groupBy("cell_row", "cell_col").agg(
        *[F.max(F.when(F.col("layer") == n, F.col("value"))).alias(n) for n in layers])


def sample_raster(points: DataFrame, cells: DataFrame, grid: GridTransform,
                  layers: Sequence[str] = ("map", "mat", "tmax", "tmin"),
                  lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """Layer values of the cell containing each point; NULL outside the grid or without data.

    The long grid is cut to the touched cells before its layers are brought side by side, so only those are shuffled.
    """
    placed, touched = _placed(points, grid, lon, lat)
    near = cells.filter(F.col("layer").isin(list(layers))).join(broadcast_if_small(touched), list(CELL_KEY), "left_semi")
    return placed.join(wide_cells(near, layers), list(CELL_KEY), "left").drop(*CELL_KEY)


CELL_KEY = ("cell_row", "cell_col")
TILE_KEY = ("tile_row", "tile_col")
TILE_CELLS = 64  # cells of a tile's side


def _placed(points: DataFrame, grid: GridTransform, lon: str, lat: str) -> tuple[DataFrame, DataFrame]:
    """Points with their cell, and the cells that have a point (rows and columns before the first are outside)."""
    row, col = grid.cell_of(F.col(lon), F.col(lat))
    placed = points.withColumns({"cell_row": row, "cell_col": col})
    return placed, placed.select(*CELL_KEY).filter("cell_row >= 0 AND cell_col >= 0").distinct()


def _with_tile(cells: DataFrame, side: int) -> DataFrame:
    return cells.withColumns({t: F.floor(F.col(c) / side).cast("int") for t, c in zip(TILE_KEY, CELL_KEY)})


def tile_raster(cells: DataFrame, path: str, layers: Sequence[str] = ("map", "mat", "tmax", "tmin"), side: int = TILE_CELLS) -> DataFrame:
    """Write a long grid once as cells with a column per layer, in folders of square tiles."""
    wide = _with_tile(wide_cells(cells.filter(F.col("layer").isin(list(layers))), layers), side)
    wide.repartition(*TILE_KEY).write.partitionBy(*TILE_KEY).parquet(path)
    return cells.sparkSession.read.schema(wide.schema).parquet(path)


def sample_tiles(points: DataFrame, tiles: DataFrame, grid: GridTransform, layers: Sequence[str] = ("map", "mat", "tmax", "tmin"),
                 lon: str = "longitude", lat: str = "latitude", side: int = TILE_CELLS) -> DataFrame:
    """`sample_raster` on a tiled grid: only the tiles in which a point lies are read (their folders are pruned at run time)."""
    placed, touched = _placed(points, grid, lon, lat)
    near = tiles.join(broadcast_if_small(_with_tile(touched, side)), [*TILE_KEY, *CELL_KEY], "left_semi").select(*CELL_KEY, *layers)
    return placed.join(near, list(CELL_KEY), "left").drop(*CELL_KEY)


def sample_raster_360(points: DataFrame, cells: DataFrame, grid: GridTransform,
                      layers: Sequence[str] = ("map", "mat", "tmax", "tmin"),
                      lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """The same for a grid whose longitudes run from 0 to 360."""
    shifted = points.withColumn("_lon360", wrap_longitude(F.col(lon)))
    return sample_raster(shifted, cells, grid, layers, "_lon360", lat).drop("_lon360")
