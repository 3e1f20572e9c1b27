"""A folder that grows: its new files are converted as they come, in micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

FILES = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, state: str, each: Callable[[DataFrame, int], None], glob: str = "*", once: bool = True, files_per_batch: int = 100) -> StreamingQuery:
    """Call each(files, batch) for the files of folder that weren't seen yet.

    What was seen is kept in state, so a restart goes on where it stopped; a batch that failed is given again with
    the same number, so `each` should write to a place named by it. once: take what is there and stop."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).load(folder)
    writer = files.writeStream.option("checkpointLocation", state).foreachBatch(each)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
