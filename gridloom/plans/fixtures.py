"""Rasters derived from the orders table: 16 x 16 images of 256 consecutive orders each, the last partial
one left out. Four consecutive images form a frame set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.colour import div

SIDE = 16
# A palette of four colours.
PALETTE = ((18, 24, 56), (74, 122, 216), (216, 240, 255), (242, 193, 78))
_RAW = """
SELECT cast(o_orderkey {div} 256 AS int) AS image_id, cast(o_orderkey % 16 AS int) AS x, cast((o_orderkey {div} 16) % 16 AS int) AS y,
       cast(o_custkey % 256 AS int) AS r, cast(cast(floor(o_totalprice) AS bigint) % 256 AS int) AS g, cast(o_orderkey * 7 % 256 AS int) AS b,
       cast(CASE WHEN o_orderkey % 8 >= 6 OR (o_orderkey {div} 16) % 8 >= 6 THEN 0
                 WHEN o_orderstatus = 'F' THEN 255 WHEN o_orderstatus = 'O' THEN 128 ELSE 7 END AS int) AS a
FROM {orders} WHERE o_orderkey {div} 256 < (SELECT count(*) {div} 256 FROM {orders})
"""
_CLEAR = """
SELECT image_id, x, y, CASE WHEN a = 0 THEN 0 ELSE r END AS r, CASE WHEN a = 0 THEN 0 ELSE g END AS g, CASE WHEN a = 0 THEN 0 ELSE b END AS b, a, 16 AS w, 16 AS h
FROM ({raw})
"""
#: The same raster for the oracle: a common table expression px.
PX_SQL = "px AS (" + _CLEAR.replace("{raw}", _RAW.replace("{div}", "//").replace("{orders}", "orders")) + ")"
PALETTE_SQL = "pal(ord, pr, pg, pb) AS (VALUES " + ", ".join(str((i, *c)) for i, c in enumerate(PALETTE)) + ")"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    raw = _RAW.replace("{div}", "div")
    return spark.sql(_CLEAR.replace("{raw}", raw), orders=orders)


def palette(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES " + ", ".join(str((i, *c)) for i, c in enumerate(PALETTE)) + " AS t(ord, r, g, b)")


def frames(px: DataFrame) -> DataFrame:
    """set_id, frame and pixels."""
    return px.select(div("image_id", 4).cast("int").alias("set_id"), (F.col("image_id") % 4).alias("frame"), "x", "y", "r", "g", "b", "a", "w", "h")


#: What stays visible of the varied rasters: pixels of high alpha within cells whose size and offset depend on the image.
_STEP, _OFF = "(4 + image_id % 3 * 2)", "(image_id % 2)"
_SEEN = f"a >= 128 AND x >= {_OFF} AND y >= {_OFF} AND (x - {_OFF}) % {_STEP} < 3 AND (y - {_OFF}) % {_STEP} < 3"


def varied(px: DataFrame) -> DataFrame:
    """Rasters with few visible pixels, so that boxes and grids differ."""
    from gridloom.operators.cleanup import clear_where

    return clear_where(px, ~F.expr(_SEEN))


VARIED_SQL = "vx AS (SELECT image_id, x, y, " + ", ".join(f"CASE WHEN {_SEEN} THEN {c} ELSE 0 END AS {c}" for c in "rgba") + ", w, h FROM px)"
