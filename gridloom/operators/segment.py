"""Subjects of an image: morphology, connected components, reading order, and cells to put them in."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.colour import checked, div, round_up
from gridloom.model import CHANNELS
from gridloom.shipping import ship

CELL_STEP = 8
ANCHORS, FITS, SORTS = ("feet", "center", "top"), ("error", "scale", "crop"), ("ltr", "area", "none")


def _neighbours(mask: DataFrame, k: int) -> DataFrame:
    steps = F.sequence(F.lit(-k), F.lit(k))
    spread = mask.withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps))
    return spread.select("image_id", (F.col("x") + F.col("_dx")).alias("x"), (F.col("y") + F.col("_dy")).alias("y"), "w", "h")


def erode(mask: DataFrame, times: int = 1) -> DataFrame:
    """Foreground cells whose whole 3x3 surroundings are foreground, ``times`` times over; that is one
    stencil of 2 * times + 1, counted in one shuffle. Outside the image is background."""
    if not checked("erode", times, 0):
        return mask
    full = (2 * times + 1) ** 2
    return _neighbours(mask, times).groupBy("image_id", "x", "y", "w", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == full).drop("n")


def dilate(mask: DataFrame, times: int = 1) -> DataFrame:
    """Foreground cells and their 3x3 surroundings within the image, ``times`` times over."""
    if not checked("dilate", times, 0):
        return mask
    return _neighbours(mask, times).where("x between 0 and w - 1 and y between 0 and h - 1").distinct()


def _label(pdf: pd.DataFrame) -> pd.DataFrame:
    w, h = int(pdf["w"].iloc[0]), int(pdf["h"].iloc[0])
    label = np.zeros((h + 2) * (w + 2), dtype=np.int32)
    cells = (pdf["y"].to_numpy() + 1) * (w + 2) + pdf["x"].to_numpy() + 1
    label[cells] = -1
    found = 0
    for cell in np.sort(cells):
        if label[cell] != -1:
            continue
        found += 1
        label[cell] = found
        stack = [cell]
        while stack:
            at = stack.pop()
            for to in (at - 1, at + 1, at - w - 2, at + w + 2):
                if label[to] == -1:
                    label[to] = found
                    stack.append(to)
    return pdf.assign(comp_id=label[cells])


def components(mask: DataFrame) -> DataFrame:
    """mask with comp_id: 4-connected components, numbered from 1 in raster order of their first cells."""
    ship(mask.sparkSession)
    schema = mask.withColumn("comp_id", F.lit(0)).schema
    return mask.groupBy("image_id").applyInPandas(_label, schema)


def component_boxes(labelled: DataFrame) -> DataFrame:
    """One row per component: box (max exclusive) and area."""
    return labelled.groupBy("image_id", "w", "h", "comp_id").agg(
        F.min("x").alias("min_x"), F.min("y").alias("min_y"), (F.max("x") + 1).alias("max_x"), (F.max("y") + 1).alias("max_y"), F.count(F.lit(1)).alias("area")
    )


def auto_min_area():
    """A thousandth of the image, 64 at least."""
    return F.greatest(F.lit(64), F.ceil(F.col("w") * F.col("h") * 0.001)).cast("int")


def filter_components(boxes: DataFrame, min_area: int | None = None) -> DataFrame:
    """Components of min_area cells at least; none: a size that follows the image; 0 or less: all."""
    return boxes.where(F.col("area") >= (auto_min_area() if min_area is None else F.lit(min_area)))


def auto_cell(boxes: DataFrame, step: int = CELL_STEP) -> DataFrame:
    """Per image, the largest box size rounded up to a multiple of step."""
    size = lambda low, high: round_up(F.max(F.col(high) - F.col(low)), step)
    return boxes.groupBy("image_id").agg(size("min_x", "max_x").alias("cell_w"), size("min_y", "max_y").alias("cell_h"))


def row_tolerance(boxes: DataFrame) -> DataFrame:
    """Per image, half the upper median of box heights, 4 at least."""
    heights = F.sort_array(F.collect_list(F.col("max_y") - F.col("min_y")))
    middle = F.greatest(F.lit(1), F.element_at(heights, (div(F.size(heights), 2) + 1).cast("int")))
    return boxes.groupBy("image_id").agg(F.greatest(F.lit(4), div(middle, 2)).cast("int").alias("tolerance"))


def _rows(boxes: list[tuple[int, int, int, int]], tolerance: int) -> list[tuple[int, int]]:
    """(row, column) of each box (min_x, min_y, max_x, max_y)."""
    centre = [b[1] + (b[3] - b[1]) // 2 for b in boxes]
    order = sorted(range(len(boxes)), key=lambda i: (centre[i], boxes[i][1], boxes[i][0]))
    clusters: list[list[int]] = []
    middle: list[int] = []
    for i in order:
        near = [(abs(centre[i] - m), k) for k, m in enumerate(middle) if abs(centre[i] - m) <= tolerance]
        if near:
            k = min(near)[1]
            clusters[k].append(i)
            middle[k] = sum(centre[j] for j in clusters[k]) // len(clusters[k])
        else:
            clusters.append([i])
            middle.append(centre[i])
    place = [(0, 0)] * len(boxes)
    for row, k in enumerate(sorted(range(len(clusters)), key=lambda k: middle[k])):
        for col, i in enumerate(sorted(clusters[k], key=lambda i: (boxes[i][0], boxes[i][1]))):
            place[i] = (row, col)
    return place


def group_rows(boxes: DataFrame) -> DataFrame:
    """boxes with row_idx and col_idx in reading order. Which row a box joins depends on the rows that the
    boxes before it have formed, so an image's boxes are one group."""
    ship(boxes.sparkSession)
    sides = ["min_x", "min_y", "max_x", "max_y"]

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("comp_id")
        heights = np.sort((pdf["max_y"] - pdf["min_y"]).to_numpy())
        tolerance = max(4, max(1, int(heights[len(heights) // 2])) // 2)
        found = _rows([tuple(map(int, b)) for b in pdf[sides].to_numpy()], tolerance)
        return pdf.assign(row_idx=[r for r, _ in found], col_idx=[c for _, c in found])

    schema = boxes.withColumn("row_idx", F.lit(0)).withColumn("col_idx", F.lit(0)).schema
    return boxes.groupBy("image_id").applyInPandas(place, schema)


def ordered(boxes: DataFrame, sort: str = "ltr") -> DataFrame:
    """boxes with idx: in reading order, by area, or as they were found."""
    if sort not in SORTS:
        raise ValueError(f"sort must be one of {SORTS}")
    keys = {"ltr": ["row_idx", "col_idx"], "area": [F.desc("area"), "min_x", "min_y", "comp_id"], "none": ["comp_id"]}[sort]
    placed = group_rows(boxes) if sort == "ltr" else boxes
    return placed.withColumn("idx", F.row_number().over(W.partitionBy("image_id").orderBy(*keys)) - 1)


def anchor_offset(size, cell, axis: str, anchor: str):
    """Where a side of the given size starts in its cell; negative where it is cut."""
    if anchor not in ANCHORS:
        raise ValueError(f"anchor must be one of {ANCHORS}")
    if axis == "x" or anchor == "center":
        return div(cell - size, 2)
    return cell - size if anchor == "feet" else F.lit(0)


def cells(size: DataFrame, ids: list[str]) -> DataFrame:
    """All cells x, y of rows with w, h."""
    return size.select(*ids, "w", "h", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("x")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("h") - 1)))


def densify(frames: DataFrame, size: DataFrame, ids: list[str]) -> DataFrame:
    """All cells of rows with w, h; those that frames lack are transparent."""
    joined = cells(size, ids).join(frames.select(*ids, "x", "y", *CHANNELS), [*ids, "x", "y"], "left")
    return joined.select(*ids, "x", "y", *[F.coalesce(c, F.lit(0)).alias(c) for c in CHANNELS], "w", "h")


def to_cells(px: DataFrame, boxes: DataFrame, cell: tuple[int, int] | None = None, anchor: str = "feet", fit: str = "error") -> DataFrame:
    """The boxes' pixels, cut from px as it is (neighbours within a box included), each in a cell of one
    size per image. What is too large is an error, downscaled, or cropped."""
    if fit not in FITS:
        raise ValueError(f"fit must be one of {FITS}")
    sizes = auto_cell(boxes) if cell is None else boxes.select("image_id").distinct().withColumns({"cell_w": F.lit(cell[0]), "cell_h": F.lit(cell[1])})
    wide = boxes.join(sizes, "image_id").withColumns({"bw": F.col("max_x") - F.col("min_x"), "bh": F.col("max_y") - F.col("min_y")})
    large = (F.col("bw") > F.col("cell_w")) | (F.col("bh") > F.col("cell_h"))
    if fit == "error":
        wide = wide.where(F.when(~large, True).otherwise(F.raise_error(F.lit("a subject is larger than its cell")).cast("boolean")))
    factor = F.greatest(F.ceil(F.col("bw") / F.col("cell_w")), F.ceil(F.col("bh") / F.col("cell_h"))) if fit == "scale" else F.lit(1)
    wide = wide.withColumn("f", F.greatest(F.lit(1), factor).cast("int")).withColumns({"sw": div("bw", "f"), "sh": div("bh", "f")})
    wide = wide.withColumns({"ox": anchor_offset(F.col("sw"), F.col("cell_w"), "x", anchor), "oy": anchor_offset(F.col("sh"), F.col("cell_h"), "y", anchor)})
    cut = px.drop("w", "h").join(wide.select("image_id", "idx", "min_x", "min_y", "max_x", "max_y", "cell_w", "cell_h", "f", "sw", "sh", "ox", "oy"), "image_id")
    cut = cut.where("x >= min_x and x < max_x and y >= min_y and y < max_y").withColumns({"x": F.col("x") - F.col("min_x"), "y": F.col("y") - F.col("min_y")})
    cut = cut.where("x % f = 0 and y % f = 0 and x div f < sw and y div f < sh")
    cut = cut.withColumns({"x": (div("x", "f") + F.col("ox")).cast("int"), "y": (div("y", "f") + F.col("oy")).cast("int")})
    inside = cut.where("x >= 0 and x < cell_w and y >= 0 and y < cell_h").withColumnRenamed("idx", "frame")
    return densify(inside, wide.select("image_id", F.col("idx").alias("frame"), F.col("cell_w").alias("w"), F.col("cell_h").alias("h")), ["image_id", "frame"])


def segment_subjects(
    px: DataFrame, threshold: int = 1, erosions: int = 0, dilations: int = 0, min_area: int | None = None, sort: str = "ltr", expected: int = 0,
    cell: tuple[int, int] | None = None, anchor: str = "feet", fit: str = "error",
) -> tuple[DataFrame, DataFrame]:
    """(subjects in order, their frames' pixels): mask, erode, dilate, components, filter, order, cells."""
    checked("threshold", threshold, 0, 255)
    checked("expected", expected, 0)
    mask = dilate(erode(px.where(F.col("a") >= threshold).select("image_id", "x", "y", "w", "h"), erosions), dilations)
    kept = filter_components(component_boxes(components(mask)), min_area)
    if expected:
        counts = kept.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))
        right = F.when(F.col("n") == expected, True).otherwise(F.raise_error(F.format_string(f"expected {expected} subjects, found %d", "n")).cast("boolean"))
        kept = kept.join(counts.where(right).select("image_id"), "image_id")
    subjects = ordered(kept, sort)
    return subjects, to_cells(px, subjects, cell, anchor, fit)
