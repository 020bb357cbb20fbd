"""Quads that arrive as a stream go into a store batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quadrille.plans.store import Store


def ingest(stream: DataFrame, store: Store, checkpoint: str, update_closure: bool = True, available_now: bool = True) -> StreamingQuery:
    """Adds each batch of (s, p, o, g) to the store, and brings the closure up to date with it.

    Adding has set semantics, so a batch that is delivered again after a failure changes nothing.
    """

    def batch(df: DataFrame, _: int) -> None:
        store.add(df)
        if update_closure:
            store.update_closure()

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
