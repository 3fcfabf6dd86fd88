"""Survey-shaped inputs derived from the provided tables.

Each view is plain SQL that reads the same in Spark and in the SQL oracle, so a
query and its oracle start from one definition of the input. NULLs are injected
on purpose: the provided tables have none.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

STRUCTURE = ("rumple", "deepgap_fraction", "mean_max_canopy_ht", "max_canopy_ht", "cover_fraction",
             "top_rugosity", "vert_sd", "vert_cv", "sd_sd", "entropy", "gfp", "vai", "vci", "q25", "q50")


def _structure_columns() -> str:
    cols = []
    for i, name in enumerate(STRUCTURE):
        value = f"CAST((c_custkey * {2 * i + 13} + {i}) % {97 + 6 * i} AS DOUBLE) / CAST({40 + 3 * i} AS DOUBLE)"
        if name == "sd_sd":
            value = f"CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE {value} END"
        cols.append(f"{value} AS {name}")
    return ",\n       ".join(cols)


VIEWS: dict[str, str] = {
    "v_cover": """
SELECT l.l_orderkey * 10 + l.l_linenumber AS rec_id,
       n.n_name AS site,
       n.n_name || '_' || lpad(CAST(c.c_custkey AS STRING), 6, '0') AS plot_id,
       CAST(l.l_linenumber % 4 AS INT) AS subplot_id,
       CAST(year(o.o_orderdate) AS INT) AS year,
       substr(CAST(o.o_orderdate AS STRING), 1, 7) AS monthyear,
       n.n_name || substr(CAST(o.o_orderdate AS STRING), 1, 7) AS sitemonthyear,
       CASE WHEN l.l_partkey % 97 = 5 THEN NULL ELSE 'sp' || lpad(CAST(l.l_partkey % 120 AS STRING), 3, '0') END AS species,
       CASE WHEN l.l_partkey % 120 < 8 AND n.n_regionkey <> 0 THEN 'I'
            WHEN l.l_partkey % 120 < 16 THEN 'UNK'
            WHEN l.l_partkey % 120 < 20 AND l.l_linenumber % 3 = 0 AND n.n_regionkey <> 0 THEN 'I' ELSE 'N' END AS nativity,
       CASE WHEN (l.l_orderkey + l.l_linenumber) % 17 = 0 AND c.c_mktsegment IN ('BUILDING', 'MACHINERY') THEN NULL
            ELSE l.l_quantity END AS cover
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey""",
    "v_dates": """
SELECT n_name AS site_id, '1996-05' AS date1,
       CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE '1998-07' END AS date2,
       CASE WHEN n_nationkey % 5 = 0 THEN '1998-09' WHEN n_nationkey % 7 = 0 THEN NULL ELSE '2000-06' END AS date3
FROM nation""",
    "v_centroids": """
SELECT n.n_name || '_' || lpad(CAST(c.c_custkey AS STRING), 6, '0') AS plot_id,
       CASE WHEN c.c_custkey % 10 = 3 THEN 'otherPlot' ELSE 'basePlot' END AS subtype,
       CAST(2500 + c.c_custkey * 37 % 4000 AS DOUBLE) / CAST(100 AS DOUBLE) AS latitude,
       CAST(-7000 - c.c_custkey * 53 % 8000 AS DOUBLE) / CAST(100 AS DOUBLE) AS longitude
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey""",
    "v_points": """
SELECT l_orderkey * 10 + l_linenumber AS rec_id,
       CAST(50000000 + (l_orderkey * 7919 + l_linenumber * 131) % 200000 AS DOUBLE) / CAST(100 AS DOUBLE) AS x,
       CAST(400000000 + (l_partkey * 104729 + l_suppkey * 17) % 200000 AS DOUBLE) / CAST(100 AS DOUBLE) AS y,
       CASE WHEN l_returnflag = 'R' THEN CAST(l_orderkey % 3 AS DOUBLE) / CAST(8 AS DOUBLE) ELSE l_quantity END AS z,
       CASE WHEN l_returnflag = 'R' THEN 2 ELSE 5 END AS class
FROM lineitem""",
    "v_boxes": """
SELECT 'P' || CAST(s_suppkey AS STRING) AS plot_id,
       CAST(500100 + (s_suppkey * 173 % 1800) AS DOUBLE) AS easting,
       CAST(4000100 + (s_suppkey * 311 % 1800) AS DOUBLE) AS northing
FROM supplier""",
    "v_raster": """
SELECT k.layer, CAST(floor(p_partkey / 50) AS INT) AS cell_row, CAST(p_partkey % 50 AS INT) AS cell_col,
       CAST(CASE WHEN k.layer = 'mat' AND p_partkey % 13 = 0 THEN NULL ELSE p_retailprice + CAST(k.off AS DOUBLE) END AS DOUBLE) AS value
FROM (SELECT 'map' AS layer, 0.0 AS off, p_partkey, p_retailprice FROM part
      UNION ALL SELECT 'mat', 1.5, p_partkey, p_retailprice FROM part
      UNION ALL SELECT 'tmax', 20.0, p_partkey, p_retailprice FROM part
      UNION ALL SELECT 'tmin', -20.0, p_partkey, p_retailprice FROM part) k""",
    "v_tsc": """
SELECT n.n_name || '_' || lpad(CAST(c.c_custkey AS STRING), 6, '0') AS plot_id, n.n_name AS site,
       CAST(c.c_custkey % 4 AS INT) AS x_tsc_1996, CAST(c.c_custkey % 5 AS INT) AS x_tsc_1998,
       CAST(CASE WHEN c.c_custkey % 6 = 0 THEN NULL ELSE c.c_custkey % 6 END AS INT) AS x_tsc_2000,
       CAST(c.c_custkey % 9 AS INT) AS x_tsc_1998_median_1
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey""",
    "v_nlcd": """
SELECT n.n_name || '_' || lpad(CAST(c.c_custkey AS STRING), 6, '0') AS plot_id,
       CASE WHEN c.c_custkey % 11 = 0 THEN NULL ELSE c.c_mktsegment END AS nlcd,
       c.c_mktsegment || ', ' || n.n_name AS classes
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey""",
    # one block of 5 variables x 3 responses x 10 repetitions x 30 points per 4500 events
    "v_curves": """
SELECT event_id AS rec_id, CAST(floor(event_id / 4500) AS INT) AS block, CAST(event_id % 10 AS INT) AS rep,
       CAST(floor(event_id / 10) AS INT) % 30 AS grid_idx,
       CASE CAST(floor(event_id / 300) AS INT) % 3 WHEN 0 THEN 'pi' WHEN 1 THEN 'ir' ELSE 'ii' END AS response,
       CASE CAST(floor(event_id / 900) AS INT) % 5 WHEN 0 THEN 'rumple' WHEN 1 THEN 'entropy' WHEN 2 THEN 'map'
            WHEN 3 THEN 'nspp_native' ELSE 'folded_aspect' END AS name,
       CAST((CAST(floor(event_id / 10) AS INT) % 30) * 100 + event_id % 10 AS DOUBLE) / CAST(100 AS DOUBLE) AS x, value AS yhat
FROM events""",
    "v_preds": """
SELECT e.event_id AS rec_id, CAST(e.user_id % 10 AS INT) AS fold, e.value AS truth,
       CASE WHEN e.event_id % 19 = 0 THEN NULL ELSE e.value * CAST(0.8 AS DOUBLE) + CAST(e.event_id % 7 AS DOUBLE) END AS pred,
       CASE WHEN e.event_type = 'purchase' THEN 1 ELSE 0 END AS label,
       CASE WHEN e.event_id % 4 = 0 THEN 1 ELSE 0 END AS pred_class,
       CAST(e.event_id % 1000 AS DOUBLE) / CAST(10000 AS DOUBLE) AS p_value
FROM events e""",
    "v_structure": f"""
SELECT n.n_name || '_' || lpad(CAST(c.c_custkey AS STRING), 6, '0') AS plot_id,
       CAST((c_custkey * 29) % 360 AS DOUBLE) AS aspect,
       CASE WHEN c_custkey % 31 = 0 THEN NULL ELSE CAST((c_custkey * 7) % 45 AS DOUBLE) END AS slope,
       CAST((c_custkey * 11) % 2500 AS DOUBLE) AS min_elev,
       {_structure_columns()}
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey""",
    # plot-year metrics; the oracle's own definition, Spark builds them with the diversity operators
    "v_plot_year": """
SELECT t.site, t.plot_id, t.year,
       CAST(count(DISTINCT species) AS BIGINT) AS nspp_total,
       CAST(count(DISTINCT CASE WHEN nativity = 'N' THEN species END) AS BIGINT) AS nspp_native,
       CAST(count(DISTINCT CASE WHEN nativity = 'I' THEN species END) AS BIGINT) AS nspp_exotic,
       coalesce(sum(CASE WHEN nativity = 'I' THEN cover END), CAST(0 AS DOUBLE)) / nullif(sum(cover), CAST(0 AS DOUBLE))
         AS rel_cover_exotic,
       CASE WHEN count(DISTINCT CASE WHEN nativity = 'I' THEN species END) > 0 THEN 'invaded' ELSE 'not invaded' END AS invaded,
       CASE WHEN count(DISTINCT CASE WHEN nativity = 'I' THEN species END) > 0 THEN 1 ELSE 0 END AS i_cat,
       CAST(count(DISTINCT CASE WHEN nativity = 'I' THEN species END) AS DOUBLE)
         / nullif(CAST(count(DISTINCT species) AS DOUBLE), CAST(0 AS DOUBLE)) AS rer
FROM v_cover t
GROUP BY t.site, t.plot_id, t.year""",
}


def with_views(sql: str) -> str:
    """Prefix a statement with the definitions of the views it names, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                visit(VIEWS[name])
                needed.append(name)

    visit(sql)
    if not needed:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in needed)
    body = sql.strip()
    return f"WITH {ctes}{', ' + body[5:] if body.upper().startswith('WITH ') else ' ' + body}"


class Inputs:
    """The views of one data folder as DataFrames, built on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        """Run SQL over the base tables and views of this folder."""
        full = with_views(text)
        for t in BASE_TABLES:
            if re.search(rf"\b{t}\b", full):
                self.table(t).createOrReplaceTempView(t)
        return self.spark.sql(full)

    def view(self, name: str) -> DataFrame:
        return self.sql(f"SELECT * FROM {name}")

    @cached_property
    def cover(self) -> DataFrame:
        return self.view("v_cover")

    @cached_property
    def plot_year(self) -> DataFrame:
        from pyspark.sql import functions as F

        from understory.functions.missing import if_else
        from understory.functions.scalars import relative_richness
        from understory.operators.diversity import diversity_metrics
        metrics = diversity_metrics(self.cover, "plot")
        return metrics.withColumns({"i_cat": if_else(F.col("nspp_exotic") > 0, F.lit(1), F.lit(0)),
                                    "rer": relative_richness()})
