"""Manifests of frame sets: JSON files with a header and an ordered list of frames."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.model import MANIFEST
from gridloom.sources.files import write_bytes

VERSION = 1


def read_manifests(spark: SparkSession, path) -> DataFrame:
    """origin (the file), header columns, and frames whose rect is a struct: flat x, y, w, h win where all
    four are there, else the nested rect of older files; a frame with neither, or with some of the four
    only and no rect, is an error. No version means the first; unknown fields are not read."""
    raw = spark.read.schema(MANIFEST).option("multiLine", True).json(path).withColumn("origin", F.col("_metadata.file_path"))

    def settled(f):
        flat = f["x"].isNotNull() & f["y"].isNotNull() & f["w"].isNotNull() & f["h"].isNotNull()
        missing = F.raise_error(F.lit("a frame has no rect")).cast("struct<x:int,y:int,w:int,h:int>")
        rect = F.when(flat, F.struct(f["x"].alias("x"), f["y"].alias("y"), f["w"].alias("w"), f["h"].alias("h"))).when(f["rect"].isNotNull(), f["rect"]).otherwise(missing)
        return F.struct(*[f[c].alias(c) for c in ("index", "path")], rect.alias("rect"), *[f[c].alias(c) for c in ("row", "col", "pivot", "duration_ms", "tag")])

    version = F.when(F.coalesce("version", F.lit(0)) == 0, VERSION).otherwise(F.col("version"))
    return raw.withColumn("version", version).withColumn("frames", F.transform("frames", settled))


def frames_of(manifests: DataFrame) -> DataFrame:
    """One row per frame, in manifest order (position)."""
    return manifests.select("origin", "cell_w", "cell_h", "cols", "rows", F.posexplode("frames").alias("position", "f")).select("origin", "cell_w", "cell_h", "cols", "rows", "position", "f.*")


def manifest_dict(header: dict, frames: list[dict]) -> dict:
    """A manifest ready for JSON: rects flat, absent values left out, version 1 unless another is given."""
    out = {"version": header.get("version") or VERSION}
    out |= {k: header.get(k) if header.get(k) is not None else ("" if k == "source" else 0) for k in ("source", "cell_w", "cell_h", "cols", "rows")}
    out |= {k: header[k] for k in ("sheet", "sheet_size") if header.get(k)}
    out["frames"] = [
        {"index": f["index"], "path": f["path"]} | {c: f["rect"][c] for c in "xywh"} | {k: f[k] for k in ("row", "col", "pivot", "duration_ms") if f.get(k) is not None} | ({"tag": f["tag"]} if f.get("tag") else {})
        for f in frames
    ]
    return out


def write_manifest(spark: SparkSession, path: str, header: dict, frames: list[dict]) -> None:
    write_bytes(spark, path, (json.dumps(manifest_dict(header, frames), indent=2) + "\n").encode())
