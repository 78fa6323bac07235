"""A stream over transcript roots that runs a sync for each batch of new files.

File streams see new files but not those that grow, so the stream only triggers: the sync itself compares all files with its manifest.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from threadloom.config import Config
from threadloom.operators.store import Store
from threadloom.plans.sync import Summary, run_sync


def watch(
    spark: SparkSession,
    store_root: str,
    roots: dict[str, list[str]],
    checkpoint: str,
    clock: Callable[[], str],
    config: Config = Config(),
    embedder=None,
    on_sync: Callable[[Summary], None] | None = None,
    once: bool = True,
) -> StreamingQuery | None:
    """Starts one query over all roots, none where there are no roots. ``once``: take what is there and end; else go on until stopped."""

    def sync(batch: DataFrame, batch_id: int) -> None:
        summary = run_sync(batch.sparkSession, Store(batch.sparkSession, store_root), roots, clock(), config, embedder)
        if on_sync:
            on_sync(summary)

    streams = [
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.jsonl")
        .load(root)
        .select("path", "length")
        for rs in roots.values()
        for root in rs
    ]
    if not streams:
        return None
    # one query over all roots: a batch is one sync, and the next one waits for it
    writer = reduce(DataFrame.unionByName, streams).writeStream.foreachBatch(sync).option("checkpointLocation", checkpoint)
    query = (writer.trigger(availableNow=True) if once else writer).start()
    if once:
        query.awaitTermination()
    return query
