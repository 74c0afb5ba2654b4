"""Pivots of frames, and frames brought to a common pivot and canvas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.colour import div
from gridloom.model import CHANNELS
from gridloom.operators.segment import densify
from gridloom.operators.stats import bbox_columns

ANCHORS = ("centroid", "bbox", "feet")
IDS = ["set_id", "frame"]


def pivots(frames: DataFrame, anchor: str = "feet") -> DataFrame:
    """set_id, frame, w, h, pivot_x, pivot_y. feet: below the middle of the visible box; bbox: its middle;
    centroid: of alpha, halves up, and feet where nothing is visible. No box: the whole frame."""
    if anchor not in ANCHORS:
        raise ValueError(f"anchor must be one of {ANCHORS}")
    alpha = F.col("a").cast("long")
    found = frames.groupBy(*IDS, "w", "h").agg(*bbox_columns(F.col("a") > 0), F.sum(alpha).alias("sa"), F.sum(F.col("x") * alpha).alias("sx"), F.sum(F.col("y") * alpha).alias("sy"))
    none = F.col("bbox_w") == 0
    found = found.withColumns({"bw": F.when(none, F.col("w")).otherwise(F.col("bbox_w")), "bh": F.when(none, F.col("h")).otherwise(F.col("bbox_h"))})
    x = F.col("bbox_x") + div("bw", 2)
    feet, middle = F.col("bbox_y") + F.col("bh") - 1, F.col("bbox_y") + div("bh", 2)
    mean = lambda s: div(F.col(s) + div("sa", 2), F.nullif(F.col("sa"), F.lit(0)))
    px, py = {"feet": (x, feet), "bbox": (x, middle), "centroid": (F.coalesce(mean("sx"), x), F.coalesce(mean("sy"), feet))}[anchor]
    return found.select(*IDS, "w", "h", px.cast("int").alias("pivot_x"), py.cast("int").alias("pivot_y"))


def placements(found: DataFrame) -> DataFrame:
    """Per frame its shift on the set's canvas, the canvas, and the pivot there. The target is the median
    pivot of the set; the canvas always holds the origin."""
    median = lambda c: F.floor(F.median(c)).cast("int")
    targets = found.groupBy("set_id").agg(median("pivot_x").alias("tx"), median("pivot_y").alias("ty"))
    moved = found.join(targets, "set_id").withColumns({"dx": F.col("tx") - F.col("pivot_x"), "dy": F.col("ty") - F.col("pivot_y")})
    sides = moved.groupBy("set_id").agg(
        F.least(F.lit(0), F.min("dx")).alias("x0"), F.least(F.lit(0), F.min("dy")).alias("y0"),
        F.greatest(F.lit(0), F.max(F.col("dx") + F.col("w"))).alias("x1"), F.greatest(F.lit(0), F.max(F.col("dy") + F.col("h"))).alias("y1"),
    )
    joined = moved.join(sides, "set_id")
    return joined.select(
        *IDS, (F.col("dx") - F.col("x0")).alias("dx"), (F.col("dy") - F.col("y0")).alias("dy"), (F.col("x1") - F.col("x0")).alias("canvas_w"), (F.col("y1") - F.col("y0")).alias("canvas_h"),
        (F.col("tx") - F.col("x0")).alias("target_x"), (F.col("ty") - F.col("y0")).alias("target_y"), "pivot_x", "pivot_y",
    )


def align_frames(frames: DataFrame, anchor: str = "feet") -> DataFrame:
    """Pixels of all frames on their sets' canvases."""
    placed = placements(pivots(frames, anchor))
    moved = frames.join(placed.select(*IDS, "dx", "dy"), IDS).withColumns({"x": F.col("x") + F.col("dx"), "y": F.col("y") + F.col("dy")})
    return densify(moved.select(*IDS, "x", "y", *CHANNELS), placed.select(*IDS, F.col("canvas_w").alias("w"), F.col("canvas_h").alias("h")), IDS)


def align_manifest(frames: DataFrame, placed: DataFrame) -> DataFrame:
    """Manifest frames (set_id, frame, ...) with the canvas as cell and the target as every pivot; rect,
    row, col, tag and duration stay."""
    target = F.struct(F.col("target_x").alias("x"), F.col("target_y").alias("y"))
    joined = frames.drop("pivot", "cell_w", "cell_h").join(placed, IDS)
    return joined.select(*[c for c in frames.columns if c not in ("pivot", "cell_w", "cell_h")], F.col("canvas_w").alias("cell_w"), F.col("canvas_h").alias("cell_h"), target.alias("pivot"))
