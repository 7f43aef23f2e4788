"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and the control characters 9 to 13.
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: A word is a run of anything else.  The same pattern serves Java, RE2 and Python.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_ASCII_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_SPACE_TABLE = {ord(c): " " for c in SPACE_CHARS}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    A folder of our own is set only where the session names none (tests in one
    JVM); a cluster has to name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, and the
    table outlives any executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tidemark-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key that holds more than one in so many rows is joined by broadcast, so that at most
#: so many keys are ever broadcast for a join.
HEAVY_PART = 1_000


def heavy_join(rows: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of ``rows`` with ``facts``, which has each of ``keys`` once and in
    ``weight`` at least the number of its rows.

    The heaviest keys' facts, at most :data:`HEAVY_PART` as their weights add up to no
    more than all rows do, are broadcast, so that their rows stay where they are; the
    rest is shuffled.
    """
    total = facts.agg(F.sum("weight")).first()[0]
    heavy = facts.where(F.col("weight") > (total or 0) / HEAVY_PART)
    if not total or heavy.isEmpty():
        return rows.join(facts, keys)
    heavy = F.broadcast(heavy)
    light = facts.where(F.col("weight") <= total / HEAVY_PART)
    return rows.join(heavy, keys).unionByName(rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys))


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """With the id itself, tells rows apart; rows equal in both columns may share it."""
    return F.xxhash64(F.col(text_col), F.col(id_col))


def lower_ascii(text: str) -> str:
    """A-Z lower-cased and nothing else."""
    return text.lower() if text.isascii() else text.translate(_ASCII_LOWER)


def words_of(text: str) -> list[str]:
    """Runs of characters other than :data:`SPACE_CHARS`, unchanged."""
    if text.isascii():
        # str.split() also splits at 0x1c to 0x1f, which are word characters here
        if not any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return text.split()
    return [w for w in text.translate(_SPACE_TABLE).split(" ") if w]


def row_slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Record batches cut small, so that a batch of long texts is never unpacked at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x
