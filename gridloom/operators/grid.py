"""Grids: occupied bands, inferred layout, slicing into cells, and upscale detection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.colour import checked, div, premultiplied
from gridloom.model import CHANNELS
from gridloom.operators.stats import bbox
from gridloom.shipping import ship

LEAST_CONFIDENCE = 0.5
SCALES = (8, 4, 3, 2)
LEAST_UNIFORM = 0.95


def occupied(px: DataFrame) -> DataFrame:
    """image_id, axis ('x' or 'y'), i, length: columns and rows that hold a visible pixel."""
    sides = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("i"), F.col(n).alias("length")) for a, n in (("x", "w"), ("y", "h"))]))
    return px.where(F.col("a") > 0).select("image_id", sides.alias("s")).select("image_id", "s.axis", "s.i", "s.length").distinct()


def bands(px: DataFrame, min_gap: int = 1) -> DataFrame:
    """image_id, axis, length, band, start, stop: runs of occupied indexes. A gap of min_gap splits; a
    shorter gap at the end belongs to the last band."""
    checked("min gap", min_gap, 1)
    along = W.partitionBy("image_id", "axis").orderBy("i")
    gap = F.col("i") - F.lag("i").over(along) - 1
    marked = occupied(px).withColumn("broke", F.when(gap >= min_gap, 1).otherwise(0))
    numbered = marked.withColumn("band", F.sum("broke").over(along.rowsBetween(W.unboundedPreceding, 0)).cast("int"))
    found = numbered.groupBy("image_id", "axis", "length", "band").agg(F.min("i").alias("start"), (F.max("i") + 1).alias("stop"))
    last = F.col("band") == F.max("band").over(W.partitionBy("image_id", "axis"))
    return found.withColumn("stop", F.when(last & (F.col("length") - F.col("stop") < min_gap), F.col("length")).otherwise(F.col("stop")))


def axis_grids(px: DataFrame, min_gap: int = 1) -> DataFrame:
    """image_id, axis, cell, offset, confidence, n_bands for each axis that has a regular layout."""
    per = W.partitionBy("image_id", "axis")
    nth = F.row_number().over(per.orderBy("start")) - 1
    placed = bands(px, min_gap).withColumn("k", nth).withColumn("n", F.count(F.lit(1)).over(per))
    placed = placed.withColumn("offset", F.min(F.when(F.col("k") == 0, F.col("start"))).over(per))
    placed = placed.withColumn("cell", F.min(F.when(F.col("k") == 1, F.col("start"))).over(per) - F.col("offset"))
    low = F.col("offset") + F.col("k") * F.col("cell")
    high = low + F.col("cell")
    wrong = (F.col("start") < low) | (F.col("stop") > high)
    penalty = F.when(F.col("start") - low > 1, 0.25).otherwise(0.0) + F.when(high - F.col("stop") > 1, 0.1).otherwise(0.0)
    several = placed.where("n > 1 and cell > 0").groupBy("image_id", "axis", "length", "cell", "offset", "n").agg(
        F.bool_or(wrong).alias("wrong"), F.greatest(F.lit(0.0), 1 - F.sum(penalty) / F.col("n")).alias("confidence")
    )
    several = several.where(~F.col("wrong") & (F.col("length") % F.col("cell") == 0) & (F.col("offset") < F.col("cell")))
    one = placed.where((F.col("n") == 1) & (F.col("start") == 0) & (F.col("length") - F.col("stop") <= 1))
    whole = one.select("image_id", "axis", F.col("length").alias("cell"), F.lit(0).alias("offset"), F.lit(1.0).alias("confidence"), "n")
    return several.select("image_id", "axis", "cell", "offset", "confidence", "n").unionByName(whole)


def guess_grid(px: DataFrame, min_gap: int = 1) -> DataFrame:
    """cols, rows, cell and offset of each image that has a grid, and how sure that is. One band on both
    axes is no grid."""
    pick = lambda axis, c: F.max(F.when(F.col("axis") == axis, F.col(c)))
    both = axis_grids(px, min_gap).groupBy("image_id").agg(
        *[pick(a, c).alias(f"{c}_{a}") for a in "xy" for c in ("cell", "offset", "n", "confidence")], F.count(F.lit(1)).alias("axes")
    )
    sizes = px.groupBy("image_id").agg(F.first("w").alias("w"), F.first("h").alias("h"))
    found = both.where("axes = 2 and not (n_x = 1 and n_y = 1)").join(sizes, "image_id")
    return found.select(
        "image_id", div("w", "cell_x").cast("int").alias("cols"), div("h", "cell_y").cast("int").alias("rows"), F.col("cell_x").alias("cell_w"), F.col("cell_y").alias("cell_h"),
        F.col("offset_x"), F.col("offset_y"), F.least("confidence_x", "confidence_y").alias("confidence"),
    )


def inspect_sheet(px: DataFrame, declared: tuple[int, int] | None = None) -> DataFrame:
    """The sheet report: stats, distinct colours, and a grid. That is the detected one, if it is at all sure,
    or the declared one with a warning where no grid is detected, or one of other counts or cells."""
    from gridloom.operators.stats import image_stats, unique_colours

    found = image_stats(px).join(unique_colours(px), "image_id").join(guess_grid(px).where("confidence > 0"), "image_id", "left")
    if declared is None:
        return found.withColumn("grid_warning", F.lit(None).cast("string"))
    cols, rows = (checked("grid", v, 1) for v in declared)
    divides = (F.col("w") % cols == 0) & (F.col("h") % rows == 0)
    found = found.where(F.when(divides, True).otherwise(F.raise_error(F.lit("grid does not divide the sheet")).cast("boolean")))
    own = {"cols": F.lit(cols), "rows": F.lit(rows), "cell_w": div("w", cols).cast("int"), "cell_h": div("h", rows).cast("int")}
    same = F.lit(True)
    for name, value in own.items():
        same = same & (F.col(name) == value)
    text = F.format_string(
        f"declared grid {cols}x{rows} (cell %dx%d) does not match detected %dx%d (cell %dx%d, confidence %.2f)",
        own["cell_w"], own["cell_h"], "cols", "rows", "cell_w", "cell_h", "confidence",
    )
    warning = F.when(F.col("cols").isNull(), F.lit("auto-detection found no grid structure to compare against")).when(~same, text)
    found = found.withColumn("grid_warning", warning)
    return found.withColumns(own | {"offset_x": F.lit(0), "offset_y": F.lit(0), "confidence": F.lit(1.0)})


def crop(px: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    """The pixels of a rectangle, counted from its corner. A rectangle that is empty or reaches beyond an image
    is an error."""
    if w < 1 or h < 1:
        raise ValueError("crop rectangle is empty")
    inside = F.lit(x >= 0 and y >= 0) & (F.col("w") >= x + w) & (F.col("h") >= y + h)
    fine = px.where(F.when(inside, True).otherwise(F.raise_error(F.lit("crop rectangle is outside image bounds")).cast("boolean")))
    cut = fine.where(F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1))
    return cut.withColumns({"x": F.col("x") - x, "y": F.col("y") - y, "w": F.lit(w), "h": F.lit(h)})


def slice_grid(px: DataFrame, cols: int, rows: int = 1) -> DataFrame:
    """Pixels of the cells, row by row: frame (index), x and y within it, and its place in the sheet."""
    checked("cols", cols, 1)
    checked("rows", rows, 1)
    divides = (F.col("w") % cols == 0) & (F.col("h") % rows == 0)
    fine = px.where(F.when(divides, True).otherwise(F.raise_error(F.lit("grid does not divide the image")).cast("boolean")))
    return _sliced(fine.withColumn("cell_w", div("w", cols).cast("int")).withColumn("cell_h", div("h", rows).cast("int")).withColumn("cols", F.lit(cols)))


def _sliced(px: DataFrame) -> DataFrame:
    row, col = div("y", "cell_h").cast("int"), div("x", "cell_w").cast("int")
    return px.select(
        "image_id", (row * F.col("cols") + col).alias("frame"), (F.col("x") % F.col("cell_w")).alias("x"), (F.col("y") % F.col("cell_h")).alias("y"), *CHANNELS,
        F.col("cell_w").alias("w"), F.col("cell_h").alias("h"), (col * F.col("cell_w")).alias("src_x"), (row * F.col("cell_h")).alias("src_y"),
    )


def slice_auto(px: DataFrame, min_gap: int = 1) -> DataFrame:
    """Cells of the detected grid, from the sheet's corner whatever the grid's offset is. An image whose
    grid is unsure is an error."""
    sure = guess_grid(px, min_gap).select("image_id", "cols", "rows", "cell_w", "cell_h", "confidence")
    joined = px.join(sure, "image_id", "left")
    known = F.coalesce(F.col("confidence"), F.lit(0.0)) >= LEAST_CONFIDENCE
    return _sliced(joined.where(F.when(known, True).otherwise(F.raise_error(F.lit("no grid found")).cast("boolean"))).drop("rows", "confidence"))


def trim_frames(frames: DataFrame) -> DataFrame:
    """Frames cut to the box of their visible pixels; a frame without any stays. src_x, src_y move along."""
    ids = ["image_id", "frame"]
    one = frames.withColumn("image_id", F.struct("image_id", "frame"))
    box = bbox(one, 0).where("bbox_w > 0")
    joined = one.join(box, "image_id", "left").withColumn("frame", F.col("image_id.frame")).withColumn("image_id", F.col("image_id.image_id"))
    inside = F.col("bbox_w").isNull() | (
        F.col("x").between(F.col("bbox_x"), F.col("bbox_x") + F.col("bbox_w") - 1) & F.col("y").between(F.col("bbox_y"), F.col("bbox_y") + F.col("bbox_h") - 1)
    )
    off = lambda c: F.coalesce(F.col("bbox_" + c), F.lit(0))
    return joined.where(inside).select(
        *ids, (F.col("x") - off("x")).alias("x"), (F.col("y") - off("y")).alias("y"), *CHANNELS, F.coalesce("bbox_w", "w").alias("w"), F.coalesce("bbox_h", "h").alias("h"),
        (F.col("src_x") + off("x")).alias("src_x"), (F.col("src_y") + off("y")).alias("src_y"),
    )


def block_uniformity(px: DataFrame, factors: tuple[int, ...] = SCALES) -> DataFrame:
    """image_id, f, ox, oy, ratio: share of whole f x f blocks, starting at the offset, of one colour. A block
    has one colour if no pixel in it differs from its right or lower neighbour there, which prefix sums over an
    image tell for all blocks of an offset at once."""
    colour = (premultiplied("r") * 65536 + premultiplied("g") * 256 + premultiplied("b")).cast("long") * 256 + F.col("a")
    kind = px.schema["image_id"].dataType.simpleString()
    ship(px.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w, h = int(pdf["w"].iloc[0]), int(pdf["h"].iloc[0])
        image = np.zeros((h, w), dtype=np.int64)
        image[pdf["y"], pdf["x"]] = pdf["c"]
        right, down = np.zeros((h + 1, w + 1), np.int32), np.zeros((h + 1, w + 1), np.int32)
        right[1:, 2:] = np.cumsum(np.cumsum(image[:, 1:] != image[:, :-1], axis=0), axis=1)
        down[2:, 1:] = np.cumsum(np.cumsum(image[1:] != image[:-1], axis=0), axis=1)
        rows = []
        for f in factors:
            if f > w or f > h:
                continue
            for ox in range(min(f, w - f + 1)):
                for oy in range(min(f, h - f + 1)):
                    x, y = np.arange(ox, w - f + 1, f), np.arange(oy, h - f + 1, f)[:, None]
                    inner = lambda s, dx, dy: s[y + f, x + f] - s[y + dy, x + f] - s[y + f, x + dx] + s[y + dy, x + dx]  # noqa: B023, E731
                    same = (inner(right, 1, 0) == 0) & (inner(down, 0, 1) == 0)
                    rows.append((f, ox, oy, float(same.mean())))
        found = pd.DataFrame(rows, columns=["f", "ox", "oy", "ratio"])
        found.insert(0, "image_id", pdf["image_id"].iloc[0])
        return found

    slim = px.where("w > 1 and h > 1").select("image_id", "x", "y", "w", "h", colour.alias("c"))
    return slim.groupBy("image_id").applyInPandas(run, f"image_id {kind}, f int, ox int, oy int, ratio double")


def detect_scale(px: DataFrame) -> DataFrame:
    """image_id, factor: the largest of 8, 4, 3, 2 at which nearly all blocks are uniform, else 1."""
    good = block_uniformity(px).where(F.col("ratio") >= LEAST_UNIFORM).groupBy("image_id").agg(F.max("f").alias("factor"))
    return px.select("image_id").distinct().join(good, "image_id", "left").select("image_id", F.coalesce("factor", F.lit(1)).alias("factor"))
