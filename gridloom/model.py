"""The relations of the library.

A raster is a set of pixel rows, one for each cell, with straight (not premultiplied) 8-bit channels. A
pixel with alpha 0 is (0, 0, 0, 0). The image's width and height travel with its pixels, so that a filter
on pixels never changes what an image's size is."""

from __future__ import annotations

from pyspark.sql import types as T

PIXEL = ["x", "y", "r", "g", "b", "a"]
CHANNELS = ["r", "g", "b", "a"]
PIXELS = T.StructType([T.StructField("image_id", T.StringType(), False), *[T.StructField(c, T.IntegerType(), False) for c in [*PIXEL, "w", "h"]]])
IMAGES = T.StructType(
    [T.StructField("image_id", T.StringType(), False), T.StructField("w", T.IntegerType(), False), T.StructField("h", T.IntegerType(), False), T.StructField("data", T.BinaryType(), False)]
)
_RECT = T.StructType([T.StructField(c, T.IntegerType()) for c in "xywh"])
_POINT = T.StructType([T.StructField(c, T.IntegerType()) for c in "xy"])
FRAME = T.StructType(
    [
        T.StructField("index", T.IntegerType()), T.StructField("path", T.StringType()),
        *[T.StructField(c, T.IntegerType()) for c in "xywh"], T.StructField("rect", _RECT),
        T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType()), T.StructField("pivot", _POINT),
        T.StructField("duration_ms", T.IntegerType()), T.StructField("tag", T.StringType()),
    ]
)
MANIFEST = T.StructType(
    [
        T.StructField("version", T.IntegerType()), T.StructField("source", T.StringType()),
        *[T.StructField(c, T.IntegerType()) for c in ("cell_w", "cell_h", "cols", "rows")], T.StructField("sheet", T.StringType()),
        T.StructField("sheet_size", T.StructType([T.StructField(c, T.IntegerType()) for c in "wh"])), T.StructField("frames", T.ArrayType(FRAME)),
    ]
)
