"""Removal of lines that many documents share, by levelled sorted runs of line hashes.

Documents come in batches.  A batch's line keys are hashed (128 bits), counted and
sorted by hash, and merge-anti-joined with the runs there are: keys that no run holds
become a run of their own, (key, documents, largest id), and keys that one holds become
counted updates.  So every key is in one run at most.  When a level holds ``fanout``
runs they are merged into one run of the next level, so every key is rewritten a
logarithmic number of times; updates are compacted alike.  What all say of a key is the
sum of its counts and its largest id (``LineRuns.totals``).

Defined results: a text is split at line feeds only; a null or empty text is one
empty line.  A line's key is the line without white space at both ends and with A-Z
lower-cased; keys of fewer than ``min_chars`` code points are never dropped.  A line
that occurs again in its document counts once for it.  Every row is a document;
lines of rows that share the largest id all stay; a null id comes before all others.
Other columns are ignored, or kept by ``drop_shared_lines``.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import SPACE_CHARS, heavy_join, lower_ascii, row_slices, shared_folder, unused, written

MIN_CHARS = 20
MIN_DOCS = 3
FANOUT = 2
BATCHES = 6


def line_key(line: str) -> str:
    return lower_ascii(line.strip(SPACE_CHARS))


def _hashed(line: str, min_chars: int) -> bytes | None:
    if len(line) < min_chars:
        return None
    key = line_key(line)
    return xxhash.xxh3_128_digest(key.encode("utf-8")) if len(key) >= min_chars else None


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key): the hashes of a document's keys, each once for a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches):
            at, keys = [], []
            for i, text in enumerate(part.column(1).to_pylist()):
                own = {_hashed(x, min_chars) for x in (text or "").split("\n")} - {None}
                at += [i] * len(own)
                keys += own
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int32())), pa.array(keys, pa.binary())], ["id", "key"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, key binary")


class LineRuns:
    """Sorted runs of line hashes in levels, on the shared folder, and updates of them."""

    def __init__(self, fanout: int = FANOUT):
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = []
        self.updates: list[list[DataFrame]] = []

    @staticmethod
    def _merged(rows: DataFrame, n: Column) -> DataFrame:
        return rows.groupBy("key").agg(F.sum(n).alias("n"), F.max("last").alias("last"))

    @staticmethod
    def _run(rows: DataFrame) -> DataFrame:
        return written(rows.sortWithinPartitions("key"))

    @staticmethod
    def _union(runs: list[DataFrame]) -> DataFrame:
        out = runs[0]
        for run in runs[1:]:
            out = out.unionByName(run)
        return out

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _push(self, levels: list[list[DataFrame]], run: DataFrame) -> None:
        """Adds a run to the lowest level, and compacts levels that are full."""
        for level in range(len(levels) + 1):
            if level == len(levels):
                levels.append([])
            levels[level].append(run)
            if len(levels[level]) < self.fanout:
                return
            run = self._run(self._merged(self._union(levels[level]), F.col("n")))
            levels[level] = []

    def unseen(self, lines: DataFrame) -> DataFrame:
        """``lines`` with ``seen``, null where no run so far holds the key: a sort-merge
        join with the runs, of which a key is in one at most."""
        if not self.runs():
            return lines.withColumn("seen", F.lit(None).cast("boolean"))
        held = self._union([r.select("key") for r in self.runs()]).withColumn("seen", F.lit(True))
        return lines.join(held.hint("merge"), "key", "left")

    def add(self, lines: DataFrame) -> None:
        """Adds a batch (id, key): unseen keys as a run, seen ones as an update."""
        batch = self._run(self.unseen(self._merged(lines.select("key", F.col("id").alias("last")), F.lit(1))))
        known = bool(self.runs())
        self._push(self.levels, batch.where("seen is null").drop("seen"))
        if known:
            self._push(self.updates, batch.where("seen").drop("seen"))

    def totals(self) -> DataFrame:
        """(key, n, last): documents that hold the key, and the largest id of them."""
        return self._merged(self._union([run for level in [*self.levels, *self.updates] for run in level]), F.col("n"))


def shared_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keys): for each id the hashes of the keys whose lines go."""
    spark = docs.sparkSession
    hashed = line_hashes(docs, min_chars, id_col, text_col).withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int"))
    path = f"{shared_folder(spark).rstrip('/')}/tidemark-lines-{uuid.uuid4().hex}"
    hashed.write.partitionBy("batch").option("compression", "zstd").parquet(path)
    lines = spark.read.schema(hashed.schema).parquet(path)
    runs = LineRuns(fanout)
    for b in range(batches):
        runs.add(lines.where(F.col("batch") == b))
    common = written(runs.totals().where(F.col("n") >= min_docs).select("key", "last", F.col("n").alias("weight")))
    dropped = heavy_join(lines, common, ["key"]).where(~F.col("id").eqNullSafe(F.col("last")))
    return dropped.groupBy("id").agg(F.collect_set("key").alias("keys"))


def drop_shared_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT, id_col: str = "doc_id", text_col: str = "text", info_col: str = "line_dedup") -> DataFrame:
    """The columns of ``docs``, texts without shared lines, and (n_lines, n_dropped,
    kept_sha256) under those names, in a struct column ``info_col``, a name that ``docs``
    must not have."""
    gone_id, gone_keys = unused(docs, "_gone_id"), unused(docs, "_gone_keys")
    gone = shared_lines(docs, min_docs, min_chars, batches, fanout, id_col, text_col).toDF(gone_id, gone_keys)
    joined = docs.join(gone, F.col(id_col).eqNullSafe(F.col(gone_id)), "left")
    others = [c for c in docs.columns if c != text_col]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(parts):
            rows = []
            for text, keys in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                whole = text or ""
                n = whole.count("\n") + 1
                kept, left = whole, n
                if keys:
                    gone = set(keys)
                    lines = [x for x in whole.split("\n") if _hashed(x, min_chars) not in gone]
                    kept, left = "\n".join(lines), len(lines)
                digest = hashlib.sha256(kept.encode("utf-8")).hexdigest()
                rows.append((text if n == left else kept, {"n_lines": n, "n_dropped": n - left, "kept_sha256": digest}))
            texts, infos = zip(*rows, strict=True) if rows else ((), ())
            kind = pa.struct([("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())])
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *part.columns[2:], pa.array(infos, kind)], [text_col, *others, info_col])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in [text_col, *others])
    out = joined.select(*(F.col(f"`{c}`") for c in [text_col, gone_keys, *others])).mapInArrow(run, f"{schema}, `{info_col}` struct<n_lines:long,n_dropped:long,kept_sha256:string>")
    return out.select(*(F.col(f"`{c}`") for c in [*docs.columns, info_col]))
