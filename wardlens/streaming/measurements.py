"""Incremental refresh of the measurement table (S3 for D9, streaming form).

The original rebuilds its measurement view from scratch.  When measurement
files keep arriving, the same branch (item filter, dictionary label, cohort
restriction) runs as a Structured Streaming query: a stream-static inner
join against the materialized cohort, appended to a parquet table with its
progress in the shared checkpoint folder, so a restarted or failed job
resumes where it stopped.  The hourly operators then read that table in
batch; hours count from each label's first measurement over the whole
history, which a streaming aggregate cannot update in place.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from wardlens.operators.series import measurement_branch
from wardlens.session import ensure_checkpoint_dir


def stream_measurements(spark: SparkSession, source_dir: str, source_schema,
                        to_facts: Callable[[DataFrame], DataFrame], dictionary: DataFrame,
                        item_ids: Sequence[int], cohort: DataFrame, join_keys: Sequence[str],
                        sink_path: str, checkpoint: str | None = None, glob: str | None = None,
                        available_now: bool = True) -> StreamingQuery:
    """Start the append-only measurement stream; returns the running query."""
    reader = spark.readStream.schema(source_schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    facts = to_facts(reader.parquet(source_dir))
    rows = measurement_branch(facts, dictionary, item_ids, cohort, join_keys)
    if checkpoint is None:
        checkpoint = os.path.join(ensure_checkpoint_dir(spark), "streams", uuid.uuid4().hex)
    writer = rows.writeStream.format("parquet").outputMode("append") \
        .option("checkpointLocation", checkpoint).option("path", sink_path)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
