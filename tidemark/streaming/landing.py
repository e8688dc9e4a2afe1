"""New payload files in a landing folder, normalized once each.

The normalizers are projections, so a streaming run needs no state and no
watermark: the checkpoint remembers which files were taken, and the file sink
commits each of them exactly once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def normalize_landing(
    spark: SparkSession,
    landing: str,
    normalize: Callable[[DataFrame], DataFrame],
    output: str,
    checkpoint: str,
    partition_by: Sequence[str] = (),
    max_files: int = 1000,
) -> StreamingQuery:
    """Take all files that arrived since the last run, then stop.

    ``normalize`` is one of the payload normalizers. Schedule the call as often
    as the source is exported; ``max_files`` bounds one micro-batch.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(landing)
    writer = normalize(lines).writeStream.format("parquet").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.trigger(availableNow=True).start(output)
