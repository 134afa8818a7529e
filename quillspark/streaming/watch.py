"""A drop folder as a stream: new files are tokenized by the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_kind
from ..operators.tokens import PATTERN

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """``path``, ``modificationTime``, ``kind``, ``rtf`` of files as they arrive."""
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return files.select("path", "modificationTime", file_kind(F.col("path")).alias("kind"), F.col("content").alias("rtf"))


def token_stream(files: DataFrame) -> DataFrame:
    """``path``, ``modificationTime``, ``pos``, ``tok`` of a stream of files; stateless."""
    text = F.decode("rtf", "ISO-8859-1")
    return files.select("path", "modificationTime", F.posexplode(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).alias("pos", "tok"))


def words_by_window(tokens: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Control words per window of arrival, with a watermark for late files."""
    word = F.regexp_extract("tok", r"^\\([a-zA-Z]+)", 1)
    return tokens.withWatermark("modificationTime", late).filter(word != "").groupBy(F.window("modificationTime", window), word.alias("word")).count()
