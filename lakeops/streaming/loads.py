"""Replay-safe loads from a landing folder, driven by Structured Streaming.

The stream only finds new files; each micro-batch runs the batch operators, which add
nothing when a batch is replayed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException

from lakeops.operators.ordered import latest
from lakeops.sources.files import not_loaded


def landed_json(spark: SparkSession, path: str, schema: str, file_filter: str = "*.json") -> DataFrame:
    """Landed JSON pages as a stream; the schema is declared, as file streams require."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    return reader.option("pathGlobFilter", file_filter).json(path)


def append_new(target: str, keys: Sequence[str], order: Sequence[str]):
    """A ``foreachBatch`` function: rows whose key the target lacks, the latest per key."""

    def load(batch: DataFrame, _batch_id: int) -> None:
        rows = latest(batch, keys, order)
        try:
            have = batch.sparkSession.read.parquet(target)
        except AnalysisException:  # the first batch makes the table
            rows.write.parquet(target)
            return
        not_loaded(rows, have, keys).write.mode("append").parquet(target)

    return load


def load_available(stream: DataFrame, target: str, checkpoint: str, keys: Sequence[str], order: Sequence[str]) -> None:
    """Load everything that has landed so far, then stop."""
    query = (
        stream.writeStream.foreachBatch(append_new(target, keys, order))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
