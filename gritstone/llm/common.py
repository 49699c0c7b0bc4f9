"""Helpers shared by the corpus operators: durable intermediate tables, sizes, words."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import durable, shared_dir, ship

#: Words of the contracts: runs of digits, lower-case ASCII letters and anything non-ASCII,
#: taken from bytes in which A-Z are already lower-cased.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


#: Write a table to the shared folder and read it back, so that a lost executor costs a reread only.
written = durable


def fresh(name: str, *tables: DataFrame) -> str:
    """A column name like the one given that no table has, in any case."""
    used = {c.lower() for t in tables for c in t.columns}
    while name.lower() in used:
        name += "_"
    return name


#: Arrow batches of whole texts stay this small unless the session asks for other sizes.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4194304b")}


#: What a Python worker has built for an operator's tasks, by name.
_tables: dict[str, object] = {}


def worker_table(name: str, make):
    """The worker's table of that name, built once; ``mapped`` must be told the name as ``holds``."""
    if name not in _tables:
        _tables[name] = make()
    return _tables[name]


def release(holds: str | None) -> None:
    """Drop all of the worker's tables but one."""
    for name in [n for n in _tables if n != holds]:
        del _tables[name]


def mapped(df: DataFrame, run, schema, holds: str | None = None) -> DataFrame:
    """``mapInArrow`` with this package on the workers' path and batches of a few MB. Spark gives a worker from one
    operator to the next: at its first task of another, what it built for the one before goes."""
    spark = df.sparkSession
    ship(spark)
    for key, (default, ours) in BATCH.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, ours)

    def alone(batches):
        release(holds)
        yield from run(batches)

    return df.mapInArrow(alone, schema)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def column_or_null(df: DataFrame, name: str, kind: str):
    """The column if the table has it, else a typed null: a missing column is an empty one."""
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def words_of(text: bytes | None) -> list[bytes]:
    return WORD.findall(text.lower()) if text else []


__all__ = ["BATCH", "WORD", "column_or_null", "fresh", "mapped", "release", "shared_dir", "shuffle_width", "words_of", "worker_table", "written"]
