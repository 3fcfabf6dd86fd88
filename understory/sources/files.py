"""CSV, text-grid, record and point scans, and the matching sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from understory.functions.missing import nan_to_null
from understory.functions.scalars import map_lookup
from understory.operators.joins import member_of
from understory.operators.spatial import GridTransform
from understory.operators.verbs import canonical_names, map_columns
from understory.session import broadcast_if_small


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header; `NA` and empty fields are NULL, and so is NaN.

    Columns are found by the names of the header; every file must have the same
    header. Without a schema all columns are read and their types inferred.
    """
    how = {"header": True, "nullValue": "NA", "mode": "FAILFAST"}
    if schema is None:
        df = spark.read.csv(path, inferSchema=True, **how)
    else:
        found = spark.read.csv(path, header=True).columns
        if gone := [f.name for f in schema.fields if f.name not in found]:
            raise ValueError(f"no column {gone} in the header {found}")
        text = T.StructType([T.StructField(c, T.StringType()) for c in found])
        df = spark.read.csv(path, schema=text, enforceSchema=False, **how)
        df = df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])
    df = canonical_names(df)
    return map_columns(df, [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)], nan_to_null)


def scan_csv_text(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """CSV with every column (or those named) as text, for later try_cast."""
    columns = columns or spark.read.csv(path, header=True).columns
    return scan_csv(spark, path, T.StructType([T.StructField(c, T.StringType()) for c in columns]))


def write_csv(df: DataFrame, path: str, quote_all: bool = False) -> None:
    """CSV parts with header and `NA` for NULL; `quote_all` puts text in quotes."""
    (df.write.mode("errorifexists").option("header", True).option("nullValue", "NA")
     .option("quoteAll", quote_all).csv(path))


def scan_files(spark: SparkSession, root: str, glob: str = "*", regex: str | None = None) -> DataFrame:
    """Paths and sizes of the files below `root`, filtered by glob and regex, without their content."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", glob).load(root).select("path", "length"))
    return files.filter(F.col("path").rlike(regex)) if regex else files


def scan_matching(spark: SparkSession, fmt: str, root: str, glob: str, regex: str, schema: T.StructType) -> DataFrame:
    """Read every file below `root` whose path matches, with its `path`; other files are pruned at listing."""
    df = (spark.read.format(fmt).schema(schema).option("recursiveFileLookup", True)
          .option("pathGlobFilter", glob).load(root))
    return df.filter(F.col("_metadata.file_path").rlike(regex)).withColumn("path", F.col("_metadata.file_path"))


GRID_HEADER = ("ncols", "nrows", "xllcorner", "yllcorner", "cellsize", "nodata_value")


def scan_ascii_grid(spark: SparkSession, path: str, layers: Mapping[str, str],
                    name_pattern: str = r"([^/.]+)\.[^/]*$") -> tuple[DataFrame, DataFrame]:
    """Text grids as long cells plus a table with one transform row per layer.

    `name_pattern` picks a name out of each file's path (default: the file name
    without extension) and `layers` maps it to a layer; other files are skipped.
    The result frames are (layer, cell_row, cell_col, value) and
    (layer, x0, y0, dx, dy, nodata); no-data cells have a NULL value. Lines are
    numbered in each split and shifted by the lines of the splits before it, so no
    task holds a whole layer. Two files for one layer are an error.
    """
    name = F.regexp_extract(F.col("_metadata.file_path"), name_pattern, 1)
    lines = (spark.read.text(path)
             .select(map_lookup(name, layers).alias("layer"), F.col("_metadata.file_path").alias("_file"),
                     F.col("_metadata.file_block_start").alias("_at"),
                     F.monotonically_increasing_id().alias("_id"), F.trim("value").alias("line"))
             .filter(F.col("layer").isNotNull() & (F.col("line") != "")))
    parts = F.split("line", r"\s+")
    is_head = F.lower(parts[0]).isin(list(GRID_HEADER))
    head = (lines.filter(is_head).groupBy("layer")
            .agg(*[F.max(F.when(F.lower(parts[0]) == h, parts[1].cast("double"))).alias(h) for h in GRID_HEADER],
                 F.min("_file").alias("_first"), F.max("_file").alias("_last")))
    twice = F.raise_error(F.concat(F.lit("two files for layer "), F.col("layer")))
    head = head.withColumn("nodata_value", F.when(F.col("_first") == F.col("_last"), F.col("nodata_value")).otherwise(twice))
    transform = head.select(
        "layer", F.col("xllcorner").alias("x0"),
        (F.col("yllcorner") + F.col("nrows") * F.col("cellsize")).alias("y0"),
        F.col("cellsize").alias("dx"), F.col("cellsize").alias("dy"), F.col("nodata_value").alias("nodata"))
    body = lines.filter(~is_head)
    before = W.partitionBy("layer").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)  # one row per split
    shift = (body.groupBy("layer", "_at").agg(F.count(F.lit(1)).alias("_n"))
             .select("layer", "_at", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift")))
    in_split = W.partitionBy("layer", "_at").orderBy("_id")
    rows = (body.withColumn("_k", F.row_number().over(in_split) - 1).join(shift, ["layer", "_at"])
            .withColumn("cell_row", (F.col("_k") + F.col("_shift")).cast("int")))
    cells = rows.select("layer", "cell_row", F.posexplode(parts).alias("cell_col", "v"))
    cells = cells.join(broadcast_if_small(transform.select("layer", "nodata")), "layer", "left")
    v = F.col("v").cast("double")
    return cells.select("layer", "cell_row", "cell_col",
                        F.when(~v.eqNullSafe(F.col("nodata")), v).alias("value")), transform


def grid_transform(transform: DataFrame) -> GridTransform:
    """The common transform of a stack; layers on different grids are refused."""
    rows = transform.select("x0", "y0", "dx", "dy").distinct().limit(2).collect()
    if len(rows) != 1:
        raise ValueError("the layers have no common grid: sample them one by one")
    return GridTransform(*rows[0])


def write_cover(cover: DataFrame, path: str) -> None:
    """Land cover records partitioned by site."""
    cover.write.mode("errorifexists").partitionBy("site").parquet(path)


def scan_cover(spark: SparkSession, path: str, sites: Sequence[str] | None = None) -> DataFrame:
    """Landed cover records; a site list prunes partitions. Sites are text, so leading zeros stay."""
    found = spark.read.parquet(path).schema
    text = T.StructType([T.StructField("site", T.StringType()) if f.name == "site" else f for f in found.fields])
    df = spark.read.schema(text).parquet(path)
    return df.filter(F.col("site").isin(list(sites))) if sites else df


def write_points(points: DataFrame, path: str) -> None:
    """Store points partitioned by tile corner; one writer task per tile and hash slice.

    Tiles are spread by tile and a slice of the point position, so a dense tile
    is written by several tasks.
    """
    sliced = points.withColumn("_slice", F.pmod(F.xxhash64("x", "y"), F.lit(8)))
    (sliced.repartition("tile_e", "tile_n", "_slice").drop("_slice")
     .write.mode("errorifexists").partitionBy("tile_e", "tile_n").parquet(path))


def scan_points(spark: SparkSession, path: str, tiles: DataFrame | None = None) -> DataFrame:
    """Stored points, restricted to the needed tiles through the partition columns."""
    pts = spark.read.parquet(path)
    if tiles is None:
        return pts
    return member_of(pts, broadcast_if_small(tiles), [("tile_e", "tile_e"), ("tile_n", "tile_n")])
