"""Streaming forms: ingest with a ledger, dedup, windows and upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryProgress

from kgflow.sources.keyed import GraphStore, KeyedTable


#: State in RocksDB; a batch stores what it has changed, and snapshots follow in the background.
_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> list[StreamingQueryProgress]:
    """Processes what is there and stops; the checkpoint makes a later run go on from there.

    Gives what Spark tells of the last batches.
    """
    conf = stream.sparkSession.conf
    before = {k: conf.get(k, None) for k in _STORE}
    for k, v in _STORE.items():
        conf.set(k, v)
    try:
        query = stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return query.recentProgress
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def stream_ingest(stream: DataFrame, out: str, ledger: str, checkpoint: str, stage: str, key: str) -> None:
    """Writes each batch, then a ledger row per item; a batch that comes again replaces itself."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        batch.groupBy(key).agg(F.count("*").alias("n_chunks")).select(key, F.lit(stage).alias("stage"), F.lit("done").alias("status"), "n_chunks").write.mode("overwrite").parquet(f"{ledger}/batch={number}")

    run_available(stream, sink, checkpoint)


def stream_dedup(stream: DataFrame, time: str, keys: list[str], late: str) -> DataFrame:
    """The first event of each key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def event_windows(stream: DataFrame, time: str, by: str, width: str, late: str) -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def stream_upsert_graph(stream: DataFrame, table: KeyedTable, checkpoint: str, most: int = 8) -> None:
    """Upserts each batch into a keyed table, and compacts buckets of more than ``most`` files; a batch that comes again changes nothing."""

    def sink(batch: DataFrame, number: int) -> None:
        table.upsert(batch, checkpoint, number)
        table.compact(most)

    run_available(stream, sink, checkpoint)


def stream_merge_graph(stream: DataFrame, store: GraphStore, split: Callable[[DataFrame], tuple[DataFrame, DataFrame]], checkpoint: str, most: int = 8) -> None:
    """Merges the nodes and edges that ``split`` makes of each batch into a graph, nodes first."""

    def sink(batch: DataFrame, number: int) -> None:
        store.upsert(*split(batch), checkpoint, number)
        store.compact(most)

    run_available(stream, sink, checkpoint)


def event_sessions(stream: DataFrame, time: str, by: str, gap: str, late: str) -> DataFrame:
    """(session, key, n, total) for a query in append mode: the events of a key between gaps of that length.

    An event that comes late joins sessions that are open, and may merge two.  A session is told once the watermark,
    ``late`` behind the latest event, has passed its end; events whose own gap ends before it are dropped, and
    ``dropped_late`` counts those.
    """
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("session"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def dropped_late(progress: list[StreamingQueryProgress]) -> int:
    """Rows that the batches dropped because they came behind the watermark."""
    return sum(op.numRowsDroppedByWatermark for p in progress for op in p.stateOperators)


def current_graph(deltas: DataFrame, keys: list[str]) -> DataFrame:
    """The row of each key from its highest batch."""
    return deltas.groupBy(*keys).agg(F.max_by("row", "batch").alias("row")).select(*keys, "row.*")
