"""Folds over a stream of operations.

``stream`` reads a log directory as it grows.  ``latest`` and ``counters`` are native
streaming aggregations; ``apply_batches`` keeps a Parquet table of cells up to date,
exactly once: every micro-batch writes the cells of its own version and which entries
are in them.  ``contiguous`` releases each site's
entries in order and holds back what lies behind a gap.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions import hlc as H
from tidemark.functions import scalars as S
from tidemark.operators import merge as M
from tidemark.sources import files


def stream(spark: SparkSession, root: str) -> DataFrame:
    """The log directory as a stream of operations."""
    schema = spark.createDataFrame([], M.OP_LOG).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).json(root)


def latest(ops: DataFrame) -> DataFrame:
    """(tbl, key_id, col, val, hlc, site): last-writer-wins cells, in complete or update mode."""
    wins = ops.where("kind = 'cell_lww'").groupBy("tbl", "key_id", "col").agg(F.max_by(F.struct("val", "hlc", "site"), H.event(F.col("hlc"), F.col("site"))).alias("w"))
    return wins.select("tbl", "key_id", "col", "w.val", "w.hlc", "w.site")


def counters(ops: DataFrame) -> DataFrame:
    """(tbl, key_id, col, value): counters, each operation once."""
    once = ops.where("kind = 'cell_counter'").dropDuplicates(["site", "seq", "op_idx"])
    return once.groupBy("tbl", "key_id", "col").agg(F.sum(F.when(F.col("d") == "inc", F.col("n")).otherwise(-F.col("n"))).alias("value"))


_HELD = "seq long, body string"
_OUT = "site string, seq long, body string"


def contiguous(entries: DataFrame) -> DataFrame:
    """(site, seq, body) of each site in order and without gaps, from the same columns in
    any order and with repeats; what follows a gap waits for it to be filled."""

    def release(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        expected, held = state.get if state.exists else (1, "{}")
        held = json.loads(held)
        for f in frames:
            for seq, body in zip(f["seq"], f["body"], strict=True):
                if seq >= expected:
                    held.setdefault(str(seq), body)
        out = []
        while str(expected) in held:
            out.append((key[0], expected, held.pop(str(expected))))
            expected += 1
        state.update((expected, json.dumps(held)))
        yield pd.DataFrame(out, columns=["site", "seq", "body"])

    return entries.select("site", "seq", "body").groupBy("site").applyInPandasWithState(release, _OUT, "expected long, held string", "append", GroupStateTimeout.NoTimeout)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The micro-batches whose output is complete."""
    found = [n for n in files.names(spark, path) if n.startswith("v=")]
    return sorted(int(n[2:]) for n in found if files.exists(spark, f"{path}/{n}/applied/_SUCCESS"))


def _version(path: str, batch: int) -> str:
    return f"{path.rstrip('/')}/v={batch:012d}"


def current_cells(spark: SparkSession, path: str) -> DataFrame:
    """The cells after the last micro-batch that was completed."""
    versions = _versions(spark, path)
    schema = spark.createDataFrame([], M.CELLS).schema
    return spark.read.schema(schema).parquet(_version(path, versions[-1]) + "/cells") if versions else spark.createDataFrame([], schema)


def merged_ranges(ranges: DataFrame) -> DataFrame:
    """(site, low, high) of the same entries with as few rows as there are gaps."""
    by_site = W.partitionBy("site").orderBy("low", "high")
    reach = F.max("high").over(by_site.rowsBetween(W.unboundedPreceding, -1))
    fresh = ranges.withColumn("fresh", F.when(F.col("low") > F.coalesce(reach, F.lit(-1)) + 1, 1).otherwise(0))
    island = fresh.withColumn("island", F.sum("fresh").over(by_site.rowsBetween(W.unboundedPreceding, 0)))
    return island.groupBy("site", "island").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("island")


_APPLIED = "site string, low bigint, high bigint"


def apply_batches(ops: DataFrame, path: str, checkpoint: str, kept_versions: int = 2) -> StreamingQuery:
    """Starts a query that folds each micro-batch into the cells below ``path``, in any
    store that Spark writes to.

    A version holds the cells and the entries that are in them, as ranges by site; entries
    that come again, in one micro-batch or in several, count once.  A micro-batch that is
    repeated replaces its own output.  It is an error that the version before it is gone.
    Only the last ``kept_versions`` stay.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        earlier = [v for v in _versions(spark, path) if v < number]
        if number and (not earlier or earlier[-1] != number - 1):
            raise RuntimeError(f"the cells of micro-batch {number - 1} are not below {path}")
        last = _version(path, number - 1)
        cells = spark.read.schema(M.CELLS).parquet(f"{last}/cells") if number else spark.createDataFrame([], M.CELLS)
        applied = spark.read.schema(_APPLIED).parquet(f"{last}/applied") if number else spark.createDataFrame([], _APPLIED)
        known = applied.select(F.col("site").alias("_site"), "low", "high")
        fresh = M.exactly_once(batch).join(known, (F.col("site") == F.col("_site")) & F.col("seq").between(F.col("low"), F.col("high")), "left_anti")
        out = M.fold_cells(cells, fresh.select(*M._OP_COLUMNS))
        out.write.mode("overwrite").parquet(f"{_version(path, number)}/cells")
        entries = batch.select("site", F.col("seq").alias("low"), F.col("seq").alias("high")).distinct()
        merged_ranges(applied.unionByName(entries)).write.mode("overwrite").parquet(f"{_version(path, number)}/applied")
        for old in earlier[: max(0, len(earlier) + 1 - kept_versions)]:
            files.remove(spark, _version(path, old))

    return ops.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def values(cells: DataFrame) -> DataFrame:
    """Streaming cells with their values as text, for sinks without structs."""
    return cells.withColumn("value", S.text_of(F.col("val")))
