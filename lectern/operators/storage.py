"""Cutting lineage between the rounds of an iteration."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """Writes a frame to the folder that spark.checkpoint.dir names and reads it back; locally, where none is named, to one of its own. The table goes when the driver's JVM ends."""
    spark = df.sparkSession
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = os.path.join(tempfile.gettempdir(), f"lectern-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", named)
    path = f"{named.rstrip('/')}/lectern-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)
