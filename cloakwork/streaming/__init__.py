"""The same operators on streams: all are row by row, so a stream needs no state, no watermark and no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.detection import sanitize
from ..sources.files import as_files, sanitize_files


def sanitize_stream(stream: DataFrame, mode: str = "redact", text: str = "text", key: str | None = None) -> DataFrame:
    """A stream with `clean` and `n_spans`."""
    return sanitize(stream, mode, text, key)


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    """New files at a path, as they come."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)


def run_available(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands all that is there to `write`, a micro-batch at a time; the checkpoint folder remembers what is done."""
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def sanitize_new_files(spark: SparkSession, path: str, out: str, checkpoint: str, mode: str = "redact") -> StreamingQuery:
    """Rewrites new files and appends (file_id, sanitized, pii_count, problem) at `out`, once for each file.

    A micro-batch that runs again after a failure overwrites its own folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        files = as_files(batch.selectExpr("path", "element_at(split(path, '/'), -1) as filename", "content"))
        sanitize_files(files, mode).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return run_available(file_stream(spark, path), write, checkpoint)
