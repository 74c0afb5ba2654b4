"""Images as a stream: a folder is watched, and every image that arrives gets its report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.stats import BBOX_ALPHA, _stat_columns, bbox_columns
from gridloom.shipping import ship
from gridloom.sources.png import decode, pixels_of

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def watch(spark: SparkSession, folder: str, most_files: int = 1000) -> DataFrame:
    """A stream of image_id, arrived, w, h, data."""
    import pandas as pd

    ship(spark)
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.png").option("maxFilesPerTrigger", most_files).load(folder)

    def run(batches):
        for pdf in batches:
            images = [decode(bytes(c)) for c in pdf["content"]]
            yield pd.DataFrame({"image_id": pdf["path"], "arrived": pdf["modificationTime"], "w": [i.shape[1] for i in images], "h": [i.shape[0] for i in images], "data": [i.tobytes() for i in images]})

    return files.select("path", "modificationTime", "content").mapInPandas(run, "image_id string, arrived timestamp, w int, h int, data binary")


def reports(images: DataFrame, late: str = "1 hour") -> DataFrame:
    """A report for each image; state is held per image until the watermark has passed it."""
    px = pixels_of(images).withWatermark("arrived", late)
    return px.groupBy("image_id", "arrived", "w", "h").agg(*_stat_columns(), *bbox_columns(F.col("a") > BBOX_ALPHA))
