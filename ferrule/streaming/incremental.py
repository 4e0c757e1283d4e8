"""Publishing from a stream of files: what a run has seen is kept by the stream's checkpoint, what it wrote by batch.

A trigger reads all files there are and ends, so the same code serves a nightly run and a continuous one. Each batch
writes to a folder named after its number: a batch that is tried again after a failure replaces its own output and
nothing else, and papers published by earlier batches are left out, so every paper is published once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession

from ferrule.session import exists, work_dir

PAGES = "paper_id string, page int, text string"


def stage_pages(pages: DataFrame) -> str:
    """Write pages as files that a stream can read; returns their folder in the shared storage."""
    folder = f"{work_dir(pages.sparkSession)}/pages-{uuid.uuid4().hex}"
    pages.select("paper_id", "page", "text").write.parquet(folder)
    return folder


def publish(spark: SparkSession, source: str, target: str, extract: Callable[[DataFrame], DataFrame], files_per_batch: int = 1000, on_batch: Callable[[int], None] | None = None, stop: Callable[[], bool] | None = None) -> None:
    """Read what is new in ``source``, extract, and write each batch under ``target``; ``on_batch`` is told of each batch done.

    ``stop`` is asked before each batch; once it says so, the batch isn't begun and the stream ends. What is left is read by
    the next run.
    """

    class Stopped(Exception):
        pass

    def one(batch: DataFrame, number: int) -> None:
        if stop and stop():
            raise Stopped
        out = extract(batch)
        others = f"{target}/data"
        if exists(spark, others):
            done = spark.read.option("basePath", others).parquet(others)
            done = done.where(done["batch"] != number).select("paper_id").distinct()
            out = out.join(done, "paper_id", "left_anti")
        out.write.mode("overwrite").parquet(f"{others}/batch={number}")
        if on_batch:
            on_batch(number)

    stream = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException:
        if not (stop and stop()):
            raise


def published(spark: SparkSession, source: str, extract: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Publish a folder to its end and read the result."""
    target = f"{work_dir(spark)}/published-{uuid.uuid4().hex}"
    publish(spark, source, target, extract)
    return spark.read.option("basePath", f"{target}/data").parquet(f"{target}/data").drop("batch")
