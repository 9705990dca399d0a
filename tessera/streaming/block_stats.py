"""Block statistics kept up to date from a stream of cells.

Each micro-batch is reduced to statistics per block, which are merged with those
of earlier batches; a batch that is delivered again replaces its own part, so
the totals count every cell once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.stats import grouped, merged


def follow(stream: DataFrame, keys: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Write the statistics of each micro-batch of cells (keys and x) to its own part of ``path``."""

    def part(batch: DataFrame, number: int) -> None:
        grouped(batch, *keys).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(part).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics over all batches written so far."""
    return merged(parts.select(*keys, "n", "mean", "s"), *keys)
