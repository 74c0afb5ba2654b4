"""Clean-up of pixels: alpha threshold, key colour, edge-connected background, and what changed."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.colour import checked, within
from gridloom.model import CHANNELS
from gridloom.shipping import ship


def clear_where(px: DataFrame, condition) -> DataFrame:
    """Pixels that the condition holds for become (0, 0, 0, 0)."""
    return px.withColumns({c: F.when(condition, F.lit(0)).otherwise(F.col(c)) for c in CHANNELS})


def threshold_alpha(px: DataFrame, low: int = 128, high: int | None = None) -> DataFrame:
    """Alpha below the higher threshold becomes transparent; the rest stays as it is."""
    return clear_where(px, F.col("a") < max(low, low if high is None else high))


def alpha_mask(px: DataFrame, threshold: int) -> DataFrame:
    """The foreground: pixels with alpha >= threshold (0: all)."""
    return px.where(F.col("a") >= threshold).select("image_id", "x", "y", "w", "h")


def key_removal(px: DataFrame, key: tuple[int, int, int], tolerance: int = 12) -> DataFrame:
    """Visible pixels near the key colour become transparent; alpha is not compared."""
    checked("tolerance", tolerance, 0, 255)
    near = within([F.col(c) for c in "rgb"], [F.lit(k) for k in key], tolerance)
    return clear_where(px, (F.col("a") != 0) & near)


def _flood(pdf: pd.DataFrame, tolerance: int, connectivity: int) -> pd.DataFrame:
    w, h = int(pdf["w"].iloc[0]), int(pdf["h"].iloc[0])
    image = np.zeros((h, w, 4), dtype=np.int32)
    image[pdf["y"], pdf["x"]] = pdf[CHANNELS]
    reached = np.zeros((h, w), dtype=bool)
    corners = [image[0, 0], image[0, w - 1], image[h - 1, 0], image[h - 1, w - 1]]
    near = [np.abs(image - c).max(axis=2) <= tolerance for c in corners]
    queue: deque[tuple[int, int, int]] = deque()
    # a border pixel starts with the first corner colour that it matches, and carries that colour on
    border = [p for x in range(w) for p in ((x, 0), (x, h - 1))] + [p for y in range(h) for p in ((0, y), (w - 1, y))]
    for x, y in border:
        own = next((k for k in range(4) if near[k][y, x]), None)
        if own is not None and not reached[y, x]:
            reached[y, x] = True
            queue.append((x, y, own))
    steps = [(-1, 0), (1, 0), (0, -1), (0, 1)]
    if connectivity == 8:
        steps += [(-1, -1), (1, -1), (-1, 1), (1, 1)]
    while queue:
        x, y, own = queue.popleft()
        for dx, dy in steps:
            i, j = x + dx, y + dy
            if 0 <= i < w and 0 <= j < h and not reached[j, i] and near[own][j, i]:
                reached[j, i] = True
                queue.append((i, j, own))
    gone = reached[pdf["y"], pdf["x"]]
    out = pdf.copy()
    out.loc[gone, CHANNELS] = 0
    return out


def edge_removal(px: DataFrame, tolerance: int = 12, connectivity: int = 4) -> DataFrame:
    """Pixels that the border's corner colours reach become transparent. Which corner's colour reaches a
    pixel first decides how it spreads, so each image is flooded in queue order as one group."""
    checked("tolerance", tolerance, 0, 255)
    if connectivity not in (4, 8):
        raise ValueError("connectivity must be 4 or 8")
    ship(px.sparkSession)
    return px.groupBy("image_id").applyInPandas(lambda pdf: _flood(pdf, tolerance, connectivity), px.schema)


def remove_background(px: DataFrame, method: str = "auto", key=None, tolerance: int = 12, connectivity: int = 0) -> DataFrame:
    """auto: by key colour if there is one, else from the edges."""
    if method not in ("auto", "key", "edge"):
        raise ValueError(f"unknown method: {method}")
    if method == "key" and key is None:
        raise ValueError("method key needs a key colour")
    if method == "key" or (method == "auto" and key is not None):
        return key_removal(px, key, tolerance)
    return edge_removal(px, tolerance, connectivity or 4)


def _compared(old, new) -> list:
    both_clear = (old["a"] == 0) & (new["a"] == 0)
    clear = F.struct(*[F.lit(0).alias(c) for c in CHANNELS])
    return [
        F.count_if(old["a"].between(1, 254) & (new["a"] == 0)).alias("fractional_pixels_zeroed"),
        F.count_if(~both_clear & (old != new)).alias("changed_pixels"),
        F.count_if((old != clear) & (new == clear)).alias("removed_pixels"),
    ]


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per image: partly transparent pixels that became transparent, pixels that changed (all transparent
    ones are alike), and pixels that were cleared. For images of any two sources, joined by place."""
    new = after.select("image_id", "x", "y", F.struct(*CHANNELS).alias("n"))
    joined = before.select("image_id", "x", "y", F.struct(*CHANNELS).alias("o")).join(new, ["image_id", "x", "y"])
    return joined.groupBy("image_id").agg(*_compared(F.col("o"), F.col("n")))


def changes_of(px: DataFrame, operator) -> DataFrame:
    """The same for an operator on pixels: each row carries what it was, so that nothing is joined."""
    kept = operator(px.withColumn("o", F.struct(*CHANNELS))).withColumn("n", F.struct(*CHANNELS))
    return kept.groupBy("image_id").agg(*_compared(F.col("o"), F.col("n")))
