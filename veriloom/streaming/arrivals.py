"""Leak scans of artifacts as they arrive: idempotent runs over micro-batches, no state between them.

The batch operators need no watermark: a match depends on one artifact and the protected sources. A batch that is
run again after a failure finds its receipts published under the same digest and leaves them as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.overlap import leak_matches, leak_receipts
from ..sources.files import publish


def scan_arrivals(spark: SparkSession, folder: str, schema: StructType, sources: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Parquet files that appear in a folder, scanned against `sources` (item_id, text); a receipt table for each batch."""

    def scan(batch: DataFrame, number: int) -> None:
        receipts = leak_receipts(batch, leak_matches(batch, sources))
        publish(receipts, out, "receipts", F.concat_ws(":", "doc_id", "match_count", "status"))

    arriving = spark.readStream.schema(schema).parquet(folder)
    return arriving.writeStream.foreachBatch(scan).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
