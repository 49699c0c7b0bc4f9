"""The standard tables in the shapes that the operators work on, in DataFrame form and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, filename, content): documents as filings of their source."""
    name = F.format_string("%s_%s_%d0101.txt", "source", F.upper("lang"), 2019 + F.col("doc_id") % 4)
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("filename"), F.col("text").alias("content"))


FILINGS = "SELECT doc_id, source || '_' || upper(lang) || '_' || CAST(2019 + doc_id % 4 AS VARCHAR) || '0101.txt' AS filename, text AS content FROM documents"


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, doc_id, pos, sent_id, sentence): lines of documents."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "sentence"))
    return d.select(
        (F.col("doc_id") * 100000 + F.col("pos")).alias("row_id"), "doc_id", F.col("pos").cast("bigint").alias("pos"), F.format_string("%d-%d", "doc_id", "pos").alias("sent_id"), "sentence"
    )


SENTENCES = """SELECT doc_id * 100000 + pos AS row_id, doc_id, pos, doc_id || '-' || pos AS sent_id, sentence
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS sentence, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)"""


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, cluster, embedding, x, y): embeddings with cluster ids as text; each 17th is noise."""
    cluster = F.when(F.col("vec_id") % 17 == 0, "-1").otherwise(F.col("label").cast("string"))
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("row_id"), cluster.alias("cluster"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y")
    )


CLUSTERED = """SELECT vec_id AS row_id, CASE WHEN vec_id % 17 = 0 THEN '-1' ELSE CAST(label AS VARCHAR) END AS cluster,
CAST(embedding AS DOUBLE[]) AS embedding, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings"""


def html_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sent_id, sentence_raw): pages without tags; entities supply semicolons."""
    return table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("sent_id"), F.regexp_replace("html", "<[^>]+>", " ").alias("sentence_raw"))


HTML_TEXTS = "SELECT CAST(page_id AS VARCHAR) AS sent_id, regexp_replace(html, '<[^>]+>', ' ', 'g') AS sentence_raw FROM pages"


def cluster_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, cluster, sentence): lines of documents, clustered by source."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "sentence"))
    return d.select((F.col("doc_id") * 100000 + F.col("pos")).alias("row_id"), F.col("source").alias("cluster"), "sentence")


CLUSTER_SENTENCES = """SELECT doc_id * 100000 + pos AS row_id, source AS cluster, sentence
FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS sentence, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)"""
