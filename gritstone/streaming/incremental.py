"""Incremental forms of the stateless chain and of exact deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import explode_lines, keep_lines, parse_filename
from ..operators.dedup import normalised


def filing_stream(spark: SparkSession, folder: str, min_len: int = 1) -> DataFrame:
    """Cleaned lines of filings as their files arrive in a folder."""
    raw = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", "*.txt").load(folder)
    named = raw.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("filename"), F.col("value").alias("content"))
    return keep_lines(explode_lines(parse_filename(named)), min_len)


def exact_dedup_stream(sentences: DataFrame, text: str, time: str, delay: str = "1 hour") -> DataFrame:
    """The first arrival of each normalised text within the watermark; state is dropped behind it."""
    keyed = sentences.withColumn("_norm", normalised(F.col(text))).withWatermark(time, delay)
    return keyed.dropDuplicatesWithinWatermark(["_norm"]).drop("_norm")
