"""Palettes: histogram, extraction by median cut, nearest-colour snapping, dithering."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.colour import checked, distance, premultiplied
from gridloom.model import CHANNELS
from gridloom.shipping import ship

MOST_PALETTE = 65_536  # colours of a palette that may be broadcast


def histogram(px: DataFrame) -> DataFrame:
    """Counts of the premultiplied colours of visible pixels per image."""
    visible = px.where(F.col("a") != 0).select("image_id", *[premultiplied(c).alias(c) for c in "rgb"])
    return visible.groupBy("image_id", "r", "g", "b").agg(F.count(F.lit(1)).alias("weight"))


def _ranked(colours: DataFrame, most: int) -> DataFrame:
    order = W.partitionBy("image_id").orderBy(F.desc("weight"), "r", "g", "b")
    return colours.withColumn("ord", F.row_number().over(order) - 1).where(F.col("ord") < most)


class _Box:
    def __init__(self, bins: np.ndarray):
        self.bins = bins
        self.low, self.high = bins[:, :3].min(0), bins[:, :3].max(0)
        self.weight = int(bins[:, 3].sum())

    def rank(self) -> tuple:
        return (-int((self.high - self.low).max()), -self.weight, *self.low.tolist())

    def halves(self):
        channel = int(np.argmax(self.high - self.low))
        b = self.bins
        order = np.lexsort((-b[:, 3], b[:, 2], b[:, 1], b[:, 0], b[:, channel]))
        b = b[order]
        reached = np.flatnonzero(np.cumsum(b[:-1, 3]) >= self.weight // 2)
        if not len(reached):
            return None
        at = int(reached[0]) + 1
        return _Box(b[:at]), _Box(b[at:])


def median_cut(bins: np.ndarray, most: int) -> list[tuple[int, int, int, int]]:
    """(r, g, b, weight) of at most ``most`` colours from histogram rows (r, g, b, weight). The widest box
    is cut at its median until there are enough; a box that has no cut ends the cutting."""
    boxes = [_Box(bins.astype(np.int64))]
    while len(boxes) < most:
        able = [(box.rank(), i) for i, box in enumerate(boxes) if len(box.bins) > 1]
        if not able:
            break
        at = min(able)[1]
        halves = boxes[at].halves()
        if halves is None:
            break
        boxes[at] = halves[0]
        boxes.append(halves[1])
    found: dict[tuple[int, int, int], int] = {}
    for box in boxes:
        total = box.weight
        mean = tuple(int((box.bins[:, c] * box.bins[:, 3]).sum() + total // 2) // total for c in range(3))
        found.setdefault(mean, total)
    return sorted([(*c, w) for c, w in found.items()], key=lambda c: (-c[3], *c[:3]))[:most]


def extract_palette(px: DataFrame, most: int = 16) -> DataFrame:
    """image_id, ord, r, g, b, weight: the histogram itself where it is small enough, else a median cut of
    it. Only histograms, which partial aggregation has shrunk, reach the grouped function."""
    checked("max colours", most, 1)
    bins = histogram(px)
    small = bins.groupBy("image_id").agg((F.count(F.lit(1)) <= most).alias("few"))
    marked = bins.join(small, "image_id")
    few = _ranked(marked.where("few").drop("few"), most)
    ship(px.sparkSession)

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        found = median_cut(pdf[["r", "g", "b", "weight"]].to_numpy(), most)
        out = pd.DataFrame(found, columns=["r", "g", "b", "weight"])
        out.insert(0, "image_id", pdf["image_id"].iloc[0])
        out["ord"] = range(len(found))
        return out

    kind = px.schema["image_id"].dataType.simpleString()
    many = marked.where(~F.col("few")).groupBy("image_id").applyInPandas(cut, f"image_id {kind}, r int, g int, b int, weight bigint, ord int")
    return few.unionByName(many)


def nearest(colours: DataFrame, palette: DataFrame) -> DataFrame:
    """For rows r, g, b: the palette's nearest colour nr, ng, nb; the first entry among equals. The palette
    has a bounded number of colours and is folded into one array, which every row scans in place."""
    entries = F.array_sort(F.collect_list(F.struct("ord", F.col("r").alias("pr"), F.col("g").alias("pg"), F.col("b").alias("pb"))))
    listed = palette.agg(F.assert_true(F.count(F.lit(1)) <= MOST_PALETTE, "palette too large"), entries.alias("pal")).select("pal")
    joined = colours.join(F.broadcast(listed))
    off = F.transform("pal", lambda p: F.struct(distance(F.col("r"), F.col("g"), F.col("b"), p["pr"], p["pg"], p["pb"]).alias("d"), p["ord"], p["pr"], p["pg"], p["pb"]))
    best = F.array_min(off)
    return joined.select(*colours.columns, best["pr"].alias("nr"), best["pg"].alias("ng"), best["pb"].alias("nb"))


def snap(px: DataFrame, palette: DataFrame) -> DataFrame:
    """Visible pixels take the nearest palette colour and keep their alpha; an empty palette changes
    nothing. Distances are worked out once for each distinct colour. Transparent pixels, which all have one
    colour, stand apart, so that they never meet under one key; of visible ones a hot colour can be split."""
    visible = px.where(F.col("a") != 0)
    joined = visible.join(nearest(visible.select("r", "g", "b").distinct(), palette), ["r", "g", "b"], "left")
    picked = joined.withColumns({c: F.coalesce(F.col("n" + c), F.col(c)) for c in "rgb"}).select(*px.columns)
    clear = px.where("a = 0").withColumns({c: F.lit(0).cast(px.schema[c].dataType) for c in "rgb"})
    return picked.unionByName(clear.select(*px.columns))


def _diffuse(pdf: pd.DataFrame, colours: np.ndarray) -> pd.DataFrame:
    w, h = int(pdf["w"].iloc[0]), int(pdf["h"].iloc[0])
    # errors are carried at 16 bits in sixteenths; transparent pixels enter as black and pass errors on
    image = np.zeros((h, w, 3), dtype=np.int64)
    image[pdf["y"], pdf["x"]] = pdf[["r", "g", "b"]].to_numpy() * 257
    wide = [tuple(c) for c in (colours.astype(np.int64) * 257).tolist()]
    toward = lambda value, error: min(65535, max(0, value + (error // 16 if error >= 0 else -(-error // 16))))
    now = [[0, 0, 0] for _ in range(w + 2)]
    chosen = np.zeros((h, w), dtype=np.int64)
    for y, line in enumerate(image.tolist()):
        after = [[0, 0, 0] for _ in range(w + 2)]
        for x, pixel in enumerate(line):
            r, g, b = map(toward, pixel, now[x + 1])
            at = min(range(len(wide)), key=lambda i: ((r - wide[i][0]) ** 2 >> 2) + ((g - wide[i][1]) ** 2 >> 2) + ((b - wide[i][2]) ** 2 >> 2))  # noqa: B023
            chosen[y, x] = at
            for c, error in enumerate((r - wide[at][0], g - wide[at][1], b - wide[at][2])):
                after[x][c] += error * 3
                after[x + 1][c] += error * 5
                after[x + 2][c] += error
                now[x + 2][c] += error * 7
        now = after
    result = pdf.copy()
    result[["r", "g", "b"]] = colours[chosen[pdf["y"], pdf["x"]]]
    result.loc[pdf["a"] == 0, CHANNELS] = 0
    return result


def dither(px: DataFrame, palette: list[tuple[int, int, int]]) -> DataFrame:
    """Floyd-Steinberg error diffusion onto a palette, alpha kept. Each pixel needs the errors of those
    before it, so an image is one group."""
    if not palette:
        return px
    checked("palette colours", len(palette), 1, MOST_PALETTE)
    ship(px.sparkSession)
    colours = np.array(palette)
    return px.groupBy("image_id").applyInPandas(lambda pdf: _diffuse(pdf, colours), px.schema)
