"""The upload folder as a stream: each new file is taken in once, in micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexloom.functions.embed import Provider
from lexloom.plans.ingest import ingest
from lexloom.sources.store import Store


def files(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """title, content of text and Markdown files as they come."""
    raw = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{txt,md}").option("maxFilesPerTrigger", per_batch).load(folder)
    name = F.url_decode(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    return raw.select(name.alias("title"), F.col("value").alias("content"), F.lit("upload").alias("source"), name.alias("original_filename"))


def watch(store: Store, folder: str, checkpoint: str, make: Callable[[], Provider], model: str, once: bool = False, **options) -> StreamingQuery:
    def batch(df: DataFrame, _: int) -> None:
        df = df.filter(F.trim("content") != "")
        if not df.isEmpty():
            ingest(store, df, make, model, replace_titles=True, **options)

    writer = files(store.spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
