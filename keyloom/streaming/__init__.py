"""Applying streams of mutations to stored tables, one micro-batch a transaction."""

from __future__ import annotations

from pyspark.sql import DataFrame

from keyloom.operators import mutate
from keyloom.sources.store import Store


def apply_changes(changes: DataFrame, store: Store, table: str, checkpoint: str, *, once: bool = True):
    """Starts a query that applies a stream (seq, op, key columns, value columns) to a map in batches; each batch is one commit.

    The batch number is kept in the table's sequence, so a batch that is replayed after a failure isn't applied twice.
    """

    def step(batch: DataFrame, number: int) -> None:
        with store.transaction() as w:
            if w.sequence(table) > number:
                return
            new, _ = mutate.apply_mixed(w.table(table), batch)
            w.put_table(table, new, sequence=number + 1)

    writer = changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
