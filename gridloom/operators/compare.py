"""Differences of two rasters on their common canvas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.colour import checked, within
from gridloom.model import CHANNELS
from gridloom.operators.segment import cells


def _sizes(px: DataFrame, pair: str, side: str) -> DataFrame:
    return px.groupBy(pair).agg(F.first("w").alias("w" + side), F.first("h").alias("h" + side))


def _aligned(a: DataFrame, b: DataFrame, pair: str, tolerance: int) -> DataFrame:
    """Every cell of the larger canvas with the condition ``differs``; what a side lacks is transparent."""
    checked("tolerance", tolerance, 0, 255)
    sizes = _sizes(a, pair, "_a").join(_sizes(b, pair, "_b"), pair)
    grid = cells(sizes.withColumn("w", F.greatest("w_a", "w_b")).withColumn("h", F.greatest("h_a", "h_b")), [pair])
    one = a.select(pair, "x", "y", *[F.col(c).alias(c + "_a") for c in CHANNELS])
    two = b.select(pair, "x", "y", *[F.col(c).alias(c + "_b") for c in CHANNELS])
    joined = grid.join(one, [pair, "x", "y"], "left").join(two, [pair, "x", "y"], "left")
    of = lambda side: [F.coalesce(F.col(c + side), F.lit(0)) for c in CHANNELS]
    return joined.select(pair, "x", "y", "w", "h", (~within(of("_a"), of("_b"), tolerance)).alias("differs"))


def frame_diff(a: DataFrame, b: DataFrame, pair: str = "pair_id", tolerance: int = 0) -> DataFrame:
    """Per pair: differing pixels, all pixels, percent, box of the differing ones, and both sizes where
    they are not the same."""
    x, y = F.when(F.col("differs"), F.col("x")), F.when(F.col("differs"), F.col("y"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    found = _aligned(a, b, pair, tolerance).groupBy(pair).agg(
        F.count_if("differs").alias("diff_pixels"), F.count(F.lit(1)).alias("total_pixels"), zero(F.min(x)).alias("bbox_x"), zero(F.min(y)).alias("bbox_y"),
        zero(F.max(x) + 1 - F.min(x)).alias("bbox_w"), zero(F.max(y) + 1 - F.min(y)).alias("bbox_h"),
    )
    sizes = _sizes(a, pair, "_a").join(_sizes(b, pair, "_b"), pair)
    unlike = (F.col("w_a") != F.col("w_b")) | (F.col("h_a") != F.col("h_b"))
    mismatch = F.when(unlike, F.struct(*[F.struct(F.col("w" + s).alias("w"), F.col("h" + s).alias("h")).alias(s[1:]) for s in ("_a", "_b")]))
    percent = F.coalesce(F.try_divide(100.0 * F.col("diff_pixels"), F.col("total_pixels")), F.lit(0.0))
    return found.join(sizes, pair).select(pair, "diff_pixels", "total_pixels", percent.alias("percent"), "bbox_x", "bbox_y", "bbox_w", "bbox_h", mismatch.alias("size_mismatch"))


def diff_overlay(a: DataFrame, b: DataFrame, pair: str = "pair_id", tolerance: int = 0) -> DataFrame:
    """The canvas: red where the sides differ, faint grey elsewhere."""
    found = _aligned(a, b, pair, tolerance)
    marks = zip(CHANNELS, (255, 0, 0, 255), (128, 128, 128, 64), strict=True)
    return found.select(pair, "x", "y", *[F.when(F.col("differs"), yes).otherwise(no).alias(c) for c, yes, no in marks], "w", "h")
