"""Documents that arrive as files, parsed by the same operator; an extension beside the batch engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.parsers import BINARY
from ..sources.reader import parse

FILES = "path string, modificationTime timestamp, length long, content binary"  # fixed value: rows of binaryFile


def read_folder(spark: SparkSession, folder: str, fmt: str, pattern: str = "*", **options) -> DataFrame:
    """Events of the files of a folder, as a stream; the path is the document id."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).load(folder)
    source = F.col("content") if fmt in BINARY else F.decode("content", "UTF-8")
    return parse(files.select("path", source.alias("source_text")), fmt, id_col="path", **options)


def write_events(events: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends events as Parquet, each file once, and ends when nothing is left."""
    return events.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
