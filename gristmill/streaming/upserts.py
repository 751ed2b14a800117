"""The upsert as a stream: snapshot files arrive, each micro-batch is a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.silver import deactivate, upsert
from ..schema import CANONICAL, struct_type
from ..sources.files import Store


def stream_snapshots(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """Canonical listings from JSON-lines files as they appear in a folder."""
    return spark.readStream.schema(struct_type(CANONICAL)).option("maxFilesPerTrigger", files_per_batch).json(path)


def upsert_stream(source: DataFrame, store: Store, table: str, checkpoint: str, now: str, close_missing: bool = False) -> StreamingQuery:
    """Each micro-batch is one run; a batch that is repeated after a failure upserts the same rows again, to the same end."""

    def one(batch: DataFrame, batch_id: int) -> None:
        run = f"batch_{batch_id}"
        state = upsert(store.read(table), batch, run, now)
        store.write(table, deactivate(state, run) if close_missing else state)

    return source.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
