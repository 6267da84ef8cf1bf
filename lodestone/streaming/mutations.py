"""File-change events as a stream: the last event of a file decides, and its rows are refreshed batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.incremental import latest_mutations


def follow(events: DataFrame, refresh: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Calls refresh(last events of the batch's files, batch id); refresh has to be repeatable, as a batch can come twice."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        refresh(latest_mutations(batch), batch_id)

    writer = events.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def merged(state: DataFrame, latest: DataFrame) -> DataFrame:
    """State (path, ts, event_id, event_type, ...) with newer events in place of older ones."""
    return latest_mutations(state.unionByName(latest))
