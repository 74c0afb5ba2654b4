"""Reports on images: counts, distinct colours, bounding box, pivot hint. One aggregation per image."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.colour import checked, div, premultiplied_rgba

COLOUR_CAP = 4096
BBOX_ALPHA = 8


def bbox_columns(seen) -> list:
    """Tight box of the pixels that the condition holds for; all 0 where there are none."""
    x, y = F.when(seen, F.col("x")), F.when(seen, F.col("y"))
    low_x, low_y = F.min(x), F.min(y)
    zero = F.lit(0)
    return [
        F.coalesce(low_x, zero).alias("bbox_x"), F.coalesce(low_y, zero).alias("bbox_y"),
        F.coalesce(F.max(x) + 1 - low_x, zero).alias("bbox_w"), F.coalesce(F.max(y) + 1 - low_y, zero).alias("bbox_h"),
    ]


def _stat_columns() -> list:
    opaque, partial = F.count_if(F.col("a") == 255), F.count_if(F.col("a").between(1, 254))
    return [
        F.count_if(F.col("a") == 0).alias("transparent"), opaque.alias("opaque"), partial.alias("fractional"),
        F.coalesce(F.try_divide(partial.cast("double"), opaque + partial), F.lit(0.0)).alias("aa_score"),
    ]


def image_stats(px: DataFrame) -> DataFrame:
    """Per image: size, alpha counts and the share of visible pixels that are partly transparent."""
    return px.groupBy("image_id", "w", "h").agg(*_stat_columns())


def unique_colours(px: DataFrame, cap: int = COLOUR_CAP) -> DataFrame:
    """Distinct premultiplied RGBA per image, transparent ones too, at most ``cap``. Colours are made
    distinct before the shuffle; the count of what is left takes a partial sum per image."""
    distinct = px.select("image_id", premultiplied_rgba().alias("c")).distinct()
    return distinct.groupBy("image_id").agg(F.least(F.lit(cap), F.count(F.lit(1))).alias("unique_colors"))


def unique_rgb(px: DataFrame) -> DataFrame:
    """Distinct straight RGB of visible pixels per image."""
    distinct = px.select("image_id", F.when(F.col("a") != 0, F.struct("r", "g", "b")).alias("c")).distinct()
    return distinct.groupBy("image_id").agg(F.count("c").alias("colors"))


def bbox(px: DataFrame, alpha_min: int = BBOX_ALPHA) -> DataFrame:
    """Box of the pixels with alpha above ``alpha_min``."""
    return px.groupBy("image_id").agg(*bbox_columns(F.col("a") > alpha_min))


def inspect_frame(px: DataFrame, threshold: int = 8) -> DataFrame:
    """The frame report: stats, box of alpha >= threshold, feet pivot of that box, distinct colours."""
    checked("alpha threshold", threshold, 1, 255)
    report = px.groupBy("image_id", "w", "h").agg(*_stat_columns(), *bbox_columns(F.col("a") > threshold - 1))
    some = F.col("bbox_w") > 0
    report = report.withColumn("pivot_x", F.when(some, F.col("bbox_x") + div("bbox_w", 2)).otherwise(0).cast("int"))
    report = report.withColumn("pivot_y", F.when(some, F.col("bbox_y") + F.col("bbox_h") - 1).otherwise(0).cast("int"))
    return report.join(unique_colours(px), "image_id").withColumn("bbox_alpha_threshold", F.lit(threshold))
