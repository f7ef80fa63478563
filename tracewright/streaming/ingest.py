"""Files that arrive in a folder become rows of a trace table, each file once."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.formats import parse_files


def ingest(spark: SparkSession, folder: str, table_path: str, checkpoint: str, glob: str = "*", **options) -> StreamingQuery:
    """Reads what is in ``folder`` now and not yet in the checkpoint, appends its traces as Parquet, and ends."""
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", glob).schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    writer = parse_files(files, **options).writeStream.format("parquet").option("path", table_path).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start()
