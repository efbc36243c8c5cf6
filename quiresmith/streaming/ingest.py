"""Incremental ingest of document files with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from quiresmith.sources.pdf import parsed_rows

FILES = "path string, modificationTime timestamp, length long, content binary"
#: Spark leaves out files older than this against the newest one seen, by default a week; a century keeps all.
MAX_FILE_AGE = "36500d"


def file_stream(spark: SparkSession, path: str, pattern: str = "*.pdf", files_per_trigger: int = 1000) -> DataFrame:
    """New files below a folder, each once, of any modification time."""
    return spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).option("maxFileAge", MAX_FILE_AGE).load(path)


def distinct_contents(files: DataFrame) -> DataFrame:
    """Files whose content was never seen, whatever their modification time: state is a hash for each distinct content, kept for good."""
    return files.withColumn("content_sha256", F.sha2("content", 256)).dropDuplicates(["content_sha256"])


def ingest(files: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Parse a stream of files into the table of parsed documents at ``path``; runs until what is there now is done."""
    return parsed_rows(files).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
