"""Whole-number scaling, and the choice of a factor that brings a subject to a height."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.colour import checked, div
from gridloom.operators.stats import bbox_columns

NORMALIZE_ALPHA = 8


def downscale(px: DataFrame, factor) -> DataFrame:
    """Nearest neighbour: every factor-th pixel, sizes rounded down. factor: number or column name."""
    f = F.col(factor) if isinstance(factor, str) else F.lit(checked("factor", factor, 1))
    w, h = div("w", f).cast("int"), div("h", f).cast("int")
    x, y = div("x", f).cast("int"), div("y", f).cast("int")
    kept = px.where((F.col("x") % f == 0) & (F.col("y") % f == 0) & (x < w) & (y < h))
    return kept.withColumns({"x": x, "y": y, "w": w, "h": h})


def shrink(px: DataFrame, factor: int) -> DataFrame:
    """downscale where both sides divide; other images are an error."""
    f = checked("factor", factor, 1)
    divides = (F.col("w") % f == 0) & (F.col("h") % f == 0)
    return downscale(px.where(F.when(divides, True).otherwise(F.raise_error(F.lit("factor does not divide the image")).cast("boolean"))), f)


def upscale(px: DataFrame, factor) -> DataFrame:
    """Every pixel becomes factor x factor pixels."""
    f = F.col(factor) if isinstance(factor, str) else F.lit(checked("factor", factor, 1))
    steps = F.sequence(F.lit(0), f - 1)
    grown = px.withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps))
    return grown.withColumns(
        {"x": (F.col("x") * f + F.col("_dx")).cast("int"), "y": (F.col("y") * f + F.col("_dy")).cast("int"), "w": (F.col("w") * f).cast("int"), "h": (F.col("h") * f).cast("int")}
    ).drop("_dx", "_dy")


def resize(px: DataFrame, up: int | None = None, down: int | None = None, method: str = "nearest") -> DataFrame:
    if (up is None) == (down is None):
        raise ValueError("give exactly one of up and down")
    if method != "nearest":
        raise ValueError("the only method is nearest")
    return upscale(px, up) if up is not None else shrink(px, down)


def resize_frames(frames: DataFrame, up: int | None = None, down: int | None = None) -> DataFrame:
    """Manifest frames (pivot struct, cell_w, cell_h) after a resize; rect, row, col, duration, tag stay."""
    if (up is None) == (down is None):
        raise ValueError("give exactly one of up and down")
    scaled = (lambda c: (c * up).cast("int")) if up is not None else (lambda c: div(c, down).cast("int"))
    pivot = F.when(F.col("pivot").isNotNull(), F.struct(scaled(F.col("pivot.x")).alias("x"), scaled(F.col("pivot.y")).alias("y")))
    return frames.withColumns({"pivot": pivot, "cell_w": scaled(F.col("cell_w")), "cell_h": scaled(F.col("cell_h")), "pivot_missing": F.col("pivot").isNull()})


def normalize_factors(px: DataFrame, target_height: int, threshold: int = NORMALIZE_ALPHA) -> DataFrame:
    """image_id, factor, input_bbox_h, output_bbox_h: of the common divisors of both sides, the one whose
    downscaled subject is nearest to the height, the smaller among equals. All divisors are read in one
    aggregation; nothing is downscaled for it."""
    checked("target height", target_height, 1)
    checked("threshold", threshold, 0, 255)
    seen = F.col("a") > max(threshold - 1, 0)
    sides = F.filter(F.sequence(F.lit(1), F.least("w", "h")), lambda f: (F.col("w") % f == 0) & (F.col("h") % f == 0))
    rows = px.where(seen).select("image_id", "x", "y", F.explode(sides).alias("f")).where("x % f = 0 and y % f = 0")
    heights = rows.groupBy("image_id", "f").agg((F.max(div("y", "f")) - F.min(div("y", "f")) + 1).cast("int").alias("height"))
    best = F.min_by(F.struct("f", "height"), F.struct(F.abs(F.col("height") - target_height), "f"))
    return heights.groupBy("image_id").agg(best.alias("best"), F.max(F.when(F.col("f") == 1, F.col("height"))).alias("input_bbox_h")).select(
        "image_id", F.col("best.f").alias("factor"), "input_bbox_h", F.col("best.height").alias("output_bbox_h")
    )


def normalize_detail(px: DataFrame, target_height: int | None = None, factor: int | None = None, threshold: int = NORMALIZE_ALPHA) -> DataFrame:
    """Images downscaled so that their subjects have about the target height, or by a factor that divides.
    An image without visible pixels before or after is an error."""
    if (target_height is None) == (factor is None):
        raise ValueError("give exactly one of target height and factor")
    out = shrink(px, factor) if factor is not None else downscale(px.join(normalize_factors(px, target_height, threshold), "image_id"), "factor").select(*px.columns)
    box = out.groupBy("image_id").agg(*bbox_columns(F.col("a") > max(threshold - 1, 0)))
    empty = F.when(F.col("bbox_h") > 0, True).otherwise(F.raise_error(F.lit("no visible pixels")).cast("boolean"))
    return out.join(box.where(empty).select("image_id"), "image_id").select(*px.columns)
