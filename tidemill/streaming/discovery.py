"""New files as a stream of paths, drained once per run."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import few_listing_tasks
from ..sources.store import Files

DISCOVERY = "path string, modificationTime timestamp, length long, content binary"
#: Files of one batch at most; a larger backlog comes in several, oldest first.
MOST_FILES = 10_000


def drain(spark: SparkSession, glob: str, checkpoint: str, handle: Callable[[list[str], tuple[str, int]], None], most: int = MOST_FILES) -> None:
    """Call ``handle(paths, (stream, number))`` for files not yet handled, once, and remember them.

    The stream carries paths only. Its name is the checkpoint's own, so numbers of
    a new checkpoint are never taken for those of a lost one. A failed batch is
    offered again by the next run; with nothing new, nothing happens.
    """
    base = glob.rsplit("/", 1)[0]
    files = Files(spark, checkpoint)
    if not Files(spark, base).exists(base):
        return

    def each(batch: DataFrame, batch_id: int) -> None:
        paths = [r[0] for r in batch.select("path").collect()]
        if paths:
            stream = json.loads(files.read(f"{checkpoint}/metadata"))["id"]
            handle(sorted(paths), (stream, batch_id))

    with few_listing_tasks(spark):
        found = spark.readStream.schema(DISCOVERY).format("binaryFile").option("maxFilesPerTrigger", most).load(glob).select("path")
        query = found.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
