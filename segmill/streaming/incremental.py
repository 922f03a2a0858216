"""The per-document summary over drawings that keep arriving: every micro-batch is scanned and summarised as one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from segmill.operators import segments
from segmill.sources import svg


def summaries(drawings: DataFrame) -> DataFrame:
    """Axis summary of each drawing (doc_id, svg); works on a batch."""
    s = svg.segments(drawings).withColumn("side", F.lit("svg"))
    return segments.axis_summary(segments.features(s), "doc_id")


def follow(drawings: DataFrame, out: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Append a summary row for each new drawing of a stream (doc_id, svg) to Parquet at ``out``. A batch that is run again
    after a failure overwrites its own folder, so rows appear once."""

    def put(batch: DataFrame, number: int) -> None:
        summaries(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return drawings.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
