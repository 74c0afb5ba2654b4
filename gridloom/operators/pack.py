"""Packing frames into one sheet."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.colour import checked, div
from gridloom.model import CHANNELS
from gridloom.operators.segment import _rows, cells
from gridloom.shipping import ship


def max_cell(frames: DataFrame) -> DataFrame:
    """Per set the largest frame sides, and whether sizes differ."""
    return frames.groupBy("set_id").agg(
        F.max("w").alias("cell_w"), F.max("h").alias("cell_h"), ((F.min("w") != F.max("w")) | (F.min("h") != F.max("h"))).alias("mixed_sizes")
    )


def _geometry(placed: DataFrame, cells_of: DataFrame, padding: int) -> DataFrame:
    """placed (set_id, frame, row, col) with places and the sheet's size."""
    side = lambda n, cell: n * F.col(cell) + F.greatest(F.lit(0), n - 1) * padding
    per = W.partitionBy("set_id")
    joined = placed.join(cells_of, "set_id").withColumns({"cols": F.max("cols_hint").over(per), "rows": F.max(F.col("row") + 1).over(per)})
    return joined.select(
        "set_id", "frame", "row", "col", "cols", "rows", (F.col("col") * (F.col("cell_w") + padding)).cast("int").alias("x"), (F.col("row") * (F.col("cell_h") + padding)).cast("int").alias("y"),
        "cell_w", "cell_h", side(F.col("cols"), "cell_w").cast("int").alias("sheet_w"), side(F.col("rows"), "cell_h").cast("int").alias("sheet_h"), "mixed_sizes",
    )


def pack_grid(frames: DataFrame, cols: int = 0, padding: int = 0) -> DataFrame:
    """Frames (set_id, frame, w, h) in order, cols to a row; 0: as near to a square as it gets."""
    checked("cols", cols, 0)
    checked("padding", padding, 0)
    order = F.row_number().over(W.partitionBy("set_id").orderBy("frame")) - 1
    n = F.count(F.lit(1)).over(W.partitionBy("set_id"))
    wide = F.lit(cols) if cols else F.ceil(F.sqrt(n)).cast("int")
    placed = frames.withColumn("k", order).withColumn("cols_hint", wide)
    placed = placed.select("set_id", "frame", div("k", "cols_hint").cast("int").alias("row"), (F.col("k") % F.col("cols_hint")).cast("int").alias("col"), "cols_hint")
    return _geometry(placed, max_cell(frames), padding)


def pack_positioned(frames: DataFrame, padding: int = 0) -> DataFrame:
    """Frames that have a row and a column of their own."""
    checked("padding", padding, 0)
    placed = frames.select("set_id", "frame", "row", "col", (F.col("col") + 1).alias("cols_hint"))
    return _geometry(placed, max_cell(frames), padding)


def pack_source_rows(frames: DataFrame, padding: int = 0) -> DataFrame:
    """Frames (with rect struct x, y, w, h) in the rows that their places in the source form."""
    ship(frames.sparkSession)

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        boxes = [(int(x), int(y), int(x + w), int(y + h)) for x, y, w, h in zip(pdf["rx"], pdf["ry"], pdf["rw"], pdf["rh"], strict=True)]
        heights = sorted(b[3] - b[1] for b in boxes)
        found = _rows(boxes, max(4, max(1, heights[len(heights) // 2]) // 2))
        return pdf[["set_id", "frame"]].assign(row=[r for r, _ in found], col=[c for _, c in found], cols_hint=[c + 1 for _, c in found])

    flat = frames.select("set_id", "frame", *[F.col(f"rect.{c}").alias("r" + c) for c in "xywh"])
    kinds = {c: frames.schema[c].dataType.simpleString() for c in ("set_id", "frame")}
    placed = flat.groupBy("set_id").applyInPandas(place, f"set_id {kinds['set_id']}, frame {kinds['frame']}, row int, col int, cols_hint int")
    return _geometry(placed, max_cell(frames), padding)


def pack(frames: DataFrame, cols: int = 0, padding: int = 0) -> DataFrame:
    """All sets of frames, each by the first way that fits: given columns; own rows and columns; rows of
    the source, where places differ and form several rows; else a square-like grid."""
    if cols:
        return pack_grid(frames, cols, padding)
    kinds = {f.name: f.dataType.simpleString() for f in frames.schema}
    for name in ("row", "col"):
        if name not in kinds:
            frames = frames.withColumn(name, F.lit(None).cast("int"))
    if "rect" not in kinds:
        frames = frames.withColumn("rect", F.lit(None).cast("struct<x:int,y:int,w:int,h:int>"))
    per = W.partitionBy("set_id")
    first = F.first("rect").over(per.orderBy("frame").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    way = frames.withColumn("own", F.min(F.col("row").isNotNull() & F.col("col").isNotNull()).over(per))
    way = way.withColumn("spread", F.max(F.coalesce(F.col("rect") != first, F.lit(False))).over(per) & F.min(F.col("rect").isNotNull()).over(per))
    columns = frames.columns
    positioned = pack_positioned(way.where("own").select(columns), padding)
    sourced = pack_source_rows(way.where("not own and spread").select(columns), padding)
    squared = pack_grid(way.where("not own and not spread").select(columns), 0, padding)
    one_row = sourced.where("rows = 1").select("set_id").distinct()
    square_again = pack_grid(way.where("not own and spread").select(columns).join(one_row, "set_id", "left_semi"), 0, padding)
    return positioned.unionByName(sourced.where("rows > 1")).unionByName(squared).unionByName(square_again)


def composite(frames: DataFrame, layout: DataFrame) -> DataFrame:
    """The sheet's pixels; where frames share a place the later one stays, its transparent pixels too."""
    shifted = frames.drop("w", "h").join(layout.select("set_id", "frame", F.col("x").alias("lx"), F.col("y").alias("ly")), ["set_id", "frame"])
    moved = shifted.select("set_id", "frame", (F.col("x") + F.col("lx")).alias("x"), (F.col("y") + F.col("ly")).alias("y"), F.struct(*CHANNELS).alias("c"))
    top = moved.groupBy("set_id", "x", "y").agg(F.max_by("c", "frame").alias("c")).select("set_id", "x", "y", "c.*")
    size = layout.select("set_id", F.col("sheet_w").alias("w"), F.col("sheet_h").alias("h")).distinct()
    grid = cells(size, ["set_id"]).join(top, ["set_id", "x", "y"], "left")
    return grid.select("set_id", "x", "y", *[F.coalesce(c, F.lit(0)).alias(c) for c in CHANNELS], "w", "h")


def sheet_manifest(frames: DataFrame, layout: DataFrame) -> DataFrame:
    """Frames with their places as rects. Rows, columns, paths of the input go before those of the layout;
    pivot, duration and tag pass through."""
    kept = [c for c in ("path", "pivot", "duration_ms", "tag") if c in frames.columns]
    own = {c: c in frames.columns for c in ("row", "col")}
    left = frames.select("set_id", "frame", F.col("w").alias("fw"), F.col("h").alias("fh"), *kept, *[F.col(c).alias("own_" + c) for c, has in own.items() if has])
    joined = left.join(layout, ["set_id", "frame"])
    rect = F.struct("x", "y", F.col("fw").alias("w"), F.col("fh").alias("h")).alias("rect")
    places = [(F.coalesce("own_" + c, c) if has else F.col(c)).alias(c) for c, has in own.items()]
    return joined.select("set_id", "frame", rect, *places, *kept, "cell_w", "cell_h", "cols", "rows", "sheet_w", "sheet_h")
