"""New pages as they arrive: the batch operators run on each micro-batch of whole reports.

Reports are independent of one another, so no state is kept between batches; a batch is
written under its own number, which makes a repeated batch overwrite itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def process_new_files(spark: SparkSession, source: str, schema: str, plan: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, files_at_once: int = 1000) -> StreamingQuery:
    """Run ``plan`` on the files that appeared in ``source`` since the last run, then stop."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
