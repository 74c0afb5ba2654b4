"""PNG images as binary files: decoding to pixel relations and encoding from them, in plain Python."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.model import CHANNELS, IMAGES
from gridloom.shipping import ship
from gridloom.sources.files import write_bytes

SIGNATURE = b"\x89PNG\r\n\x1a\n"
# Channels of each colour type, and the start and step of Adam7's passes.
CHANNELS_OF = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _chunks(data: bytes):
    at = len(SIGNATURE)
    while at + 12 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError("not a PNG: bad checksum")
        yield kind, body
        at += 12 + size


def _unfiltered(raw: memoryview, width: int, rows: int, per_pixel: int) -> tuple[np.ndarray, int]:
    """rows x width bytes without their filters, and the bytes read. width: of a row, in bytes."""
    out = np.zeros((rows, width), dtype=np.uint8)
    above = np.zeros(width, dtype=np.uint8)
    at = 0
    for y in range(rows):
        kind, line = raw[at], np.frombuffer(raw[at + 1 : at + 1 + width], np.uint8)
        at += 1 + width
        if kind == 1:
            line = np.cumsum(line.reshape(-1, per_pixel), axis=0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            line = line + above
        elif kind in (3, 4):
            line = _from_left(line.tolist(), above.tolist(), per_pixel, kind == 4)
        elif kind:
            raise ValueError("not a PNG: unknown filter")
        out[y] = line
        above = out[y]
    return out, at


def _from_left(line: list[int], above: list[int], per_pixel: int, best_of_three: bool) -> np.ndarray:
    """The two filters in which a byte depends on the one before it and on those above: their mean, or the one of
    three that is nearest to left + above - above left."""
    line, above = [0] * per_pixel + line, [0] * per_pixel + above
    for i in range(per_pixel, len(line)):
        a, b = line[i - per_pixel], above[i]
        if best_of_three:
            c = above[i - per_pixel]
            near_a, near_b, near_c = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            line[i] = (line[i] + (a if near_a <= near_b and near_a <= near_c else b if near_b <= near_c else c)) & 255
        else:
            line[i] = (line[i] + ((a + b) >> 1)) & 255
    return np.array(line[per_pixel:], dtype=np.uint8)


def _samples(rows: np.ndarray, width: int, channels: int, depth: int) -> np.ndarray:
    if depth == 8:
        return rows.reshape(len(rows), width, channels)
    if depth == 16:
        return rows.reshape(len(rows), width, channels, 2)[..., 0]
    bits = np.unpackbits(rows, axis=1)[:, : width * depth].reshape(len(rows), width, depth)
    return (bits @ (1 << np.arange(depth)[::-1])).astype(np.uint8)[..., None]


def decode(data: bytes) -> np.ndarray:
    """h x w x 4 bytes, straight alpha; a transparent pixel is (0, 0, 0, 0). Any other input is an error."""
    if not data.startswith(SIGNATURE):
        raise ValueError("not a PNG")
    head, palette, clear, body = None, None, None, []
    for kind, chunk in _chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = chunk
        elif kind == b"IDAT":
            body.append(chunk)
    if head is None or not body or head[3] not in CHANNELS_OF or (head[3] == 3 and palette is None):
        raise ValueError("not a PNG: incomplete")
    width, height, depth, colour, _, _, interlaced = head
    channels = CHANNELS_OF[colour]
    raw = memoryview(zlib.decompress(b"".join(body)))
    image, at = np.zeros((height, width, channels), np.uint8), 0
    # 16-bit samples keep their high byte; a transparent colour is compared on that
    for x0, y0, dx, dy in PASSES if interlaced else ((0, 0, 1, 1),):
        w, h = -(-(width - x0) // dx), -(-(height - y0) // dy)
        if w > 0 and h > 0:
            rows, used = _unfiltered(raw[at:], (w * channels * depth + 7) // 8, h, max(1, channels * depth // 8))
            at += used
            image[y0::dy, x0::dx] = _samples(rows, w, channels, depth)
    out = np.full((height, width, 4), 255, np.uint8)
    if colour == 3:
        alpha = np.full(256, 255, np.uint8)
        alpha[: len(clear or b"")] = np.frombuffer(clear or b"", np.uint8)
        if int(image.max(initial=0)) >= len(palette):
            raise ValueError("not a PNG: colour outside the palette")
        out[..., :3], out[..., 3] = palette[image[..., 0]], alpha[image[..., 0]]
    else:
        grey = channels < 3
        shown = image[..., :1].astype(np.uint16) * (255 // ((1 << depth) - 1)) if grey and depth < 8 else image[..., : 1 if grey else 3]
        out[..., :3] = shown
        if colour in (4, 6):
            out[..., 3] = image[..., -1]
        elif clear:
            key = np.array(struct.unpack(f">{len(clear) // 2}H", clear)) >> (8 if depth == 16 else 0)
            out[..., 3] = np.where((image == key).all(axis=2), 0, 255)
    out[out[..., 3] == 0] = 0
    return out


def encode(image: np.ndarray) -> bytes:
    """An h x w x 4 image as an 8-bit RGBA PNG."""
    height, width = image.shape[:2]
    rows = np.zeros((height, 1 + 4 * width), np.uint8)
    rows[:, 1:] = image.reshape(height, 4 * width)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def read_images(spark: SparkSession, path, glob: str = "*.png", recursive: bool = False) -> DataFrame:
    """image_id (the file's path), w, h, data of all PNG files under a path."""
    ship(spark)
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
    files = reader.load(path).select("path", "content")

    def run(batches):
        for pdf in batches:
            images = [decode(bytes(c)) for c in pdf["content"]]
            yield pd.DataFrame({"image_id": pdf["path"], "w": [i.shape[1] for i in images], "h": [i.shape[0] for i in images], "data": [i.tobytes() for i in images]})

    return files.mapInPandas(run, IMAGES)


def pixels_of(images: DataFrame) -> DataFrame:
    """Images as pixel rows, taken apart in the JVM: one byte is one channel."""
    cell = F.explode(F.sequence(F.lit(0), F.col("w") * F.col("h") - 1)).alias("i")
    rows = images.where("w > 0 and h > 0").select("*", cell)
    byte = lambda k: F.conv(F.hex(F.substring(F.col("data"), F.col("i") * 4 + k + 1, F.lit(1))), 16, 10).cast("int")
    others = [c for c in images.columns if c not in ("data", "w", "h")]
    return rows.select(*others, (F.col("i") % F.col("w")).alias("x"), F.expr("i div w").cast("int").alias("y"), *[byte(k).alias(c) for k, c in enumerate(CHANNELS)], "w", "h")


def images_of(px: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """Pixel rows as images (ids, w, h, data); cells without a row are transparent."""
    ids = ids or ["image_id"]
    ship(px.sparkSession)

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        w, h = int(pdf["w"].iloc[0]), int(pdf["h"].iloc[0])
        image = np.zeros((h, w, 4), np.uint8)
        image[pdf["y"], pdf["x"]] = pdf[CHANNELS]
        return pdf.iloc[:1][ids].assign(w=w, h=h, data=[image.tobytes()])

    kinds = ", ".join(f"{c} {px.schema[c].dataType.simpleString()}" for c in ids)
    return px.select(*ids, "x", "y", *CHANNELS, "w", "h").groupBy(*ids).applyInPandas(join, f"{kinds}, w int, h int, data binary")


def write_images(images: DataFrame, folder: str, name: str = "image_id") -> list[str]:
    """Each image as <folder>/<name>.png, on any file system that Spark can write; the paths. Workers encode;
    the driver takes one file at a time and puts it in its place, since workers may share no folder with it."""
    spark = images.sparkSession
    ship(spark)

    def run(batches):
        for pdf in batches:
            files = [encode(np.frombuffer(bytes(d), np.uint8).reshape(h, w, 4)) for w, h, d in zip(pdf["w"], pdf["h"], pdf["data"], strict=True)]
            yield pd.DataFrame({"name": pdf[name].astype(str), "png": files})

    paths = []
    for row in images.select(name, "w", "h", "data").mapInPandas(run, "name string, png binary").toLocalIterator():
        paths.append(f"{folder}/{row.name}.png")
        write_bytes(spark, paths[-1], bytes(row.png))
    return paths
