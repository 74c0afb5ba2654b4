"""Frame sets on disk: by manifest, by directories that are rows, or by file names."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.sources.files import listed
from gridloom.sources.manifests import frames_of, read_manifests
from gridloom.sources.png import read_images

NAME = "frame_*.png"
COLUMNS = ["index", "path", "rect", "row", "col", "pivot", "duration_ms", "tag", "w", "h", "data"]
_POINT, _RECT = "struct<x:int,y:int>", "struct<x:int,y:int,w:int,h:int>"


def _filled(frames: DataFrame) -> DataFrame:
    kinds = {"rect": _RECT, "row": "int", "col": "int", "pivot": _POINT, "duration_ms": "int", "tag": "string"}
    for name, kind in kinds.items():
        if name not in frames.columns:
            whole = F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), "w", "h") if name == "rect" else F.lit(None).cast(kind)
            frames = frames.withColumn(name, whole)
    return frames.select(*COLUMNS)


def _needed(frames: DataFrame, what: str) -> DataFrame:
    if frames.isEmpty():
        raise ValueError(what)
    return frames


def by_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Frames in manifest order with their images; a frame without its file is an error."""
    listed = frames_of(read_manifests(spark, os.path.join(folder, "manifest.json"))).withColumn("key", F.regexp_extract("path", r"([^/]*)$", 1))
    images = read_images(spark, folder).withColumn("key", F.regexp_extract("image_id", r"([^/]*)$", 1)).select("key", "w", "h", "data")
    joined = listed.join(images, "key", "left")
    there = F.when(F.col("data").isNotNull(), True).otherwise(F.raise_error(F.concat(F.lit("missing frame: "), "path")).cast("boolean"))
    return _needed(_filled(joined.where(there)), "the manifest has no frames")


def _numbered(images: DataFrame, numbers: dict) -> DataFrame:
    """images with numbers over all of them. Only their names are put in order, in one task; the images are
    joined with that."""
    every = W.partitionBy(F.lit(0))
    names = images.select("image_id", *[c for c in images.columns if c in ("tag", "path")])
    ranked = names.withColumns({name: value(every) - 1 for name, value in numbers.items()}).select("image_id", *numbers)
    return images.join(ranked, "image_id")


def by_names(spark: SparkSession, folder: str) -> DataFrame:
    """frame_*.png in the order of their names; each is its own rect."""
    images = read_images(spark, folder, NAME).withColumn("path", F.regexp_extract("image_id", r"([^/]*)$", 1))
    found = _numbered(images, {"index": lambda w: F.row_number().over(w.orderBy("image_id"))})
    return _needed(_filled(found), "no frames")


def by_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Each directory that has frames is a row, named by it; rows and frames go by name."""
    images = read_images(spark, os.path.join(folder, "*"), NAME)
    parts = images.withColumn("tag", F.regexp_extract("image_id", r"([^/]*)/[^/]*$", 1)).withColumn("path", F.regexp_extract("image_id", r"([^/]*/[^/]*)$", 1))
    numbers = {
        "row": lambda w: F.dense_rank().over(w.orderBy("tag")), "index": lambda w: F.row_number().over(w.orderBy("tag", "image_id")),
        "col": lambda w: F.row_number().over(W.partitionBy("tag").orderBy("image_id")),
    }
    return _needed(_filled(_numbered(parts, numbers)), "no frames")


def read_frames(spark: SparkSession, folder: str, rows: bool = False) -> DataFrame:
    """The first of manifest, (if rows) directories, names that the folder has."""
    entries = listed(spark, folder)
    if entries is None:
        raise ValueError(f"not a directory: {folder}")
    if entries.get("manifest.json") is False:
        return by_manifest(spark, folder)
    inner = lambda name: listed(spark, f"{folder}/{name}") or {}
    if rows and any(is_folder and any(n.startswith("frame_") and n.endswith(".png") for n in inner(name)) for name, is_folder in entries.items()):
        return by_rows(spark, folder)
    return by_names(spark, folder)
