"""Frames kept as image files, through Spark's image reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def image_frames(spark: SparkSession, root: str, pattern: str = "*.png") -> DataFrame:
    """Rows (folder, frame, stamp, width, height, bgr): colour images named Image<stamp>, in the order of their stamps.

    Files that are no images, and names without a stamp, are left out; the first frame is 0.
    """
    rows = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).where("image.nChannels = 3")
    stamp = F.expr("try_cast(regexp_extract(image.origin, 'Image([0-9]+)[.][^.]*$', 1) AS bigint)")
    named = rows.select(F.regexp_extract("image.origin", "^(.*)/[^/]*$", 1).alias("folder"), stamp.alias("stamp"), "image.width", "image.height", F.col("image.data").alias("bgr")).where("stamp is not null")
    places = named.select("folder", "stamp").withColumn("frame", F.row_number().over(Window.partitionBy("folder").orderBy("stamp")) - 1)
    return named.join(places, ["folder", "stamp"]).select("folder", "frame", "stamp", "width", "height", "bgr")
