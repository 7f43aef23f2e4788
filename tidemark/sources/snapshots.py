"""Snapshots: cells in Parquet under a manifest that is swapped atomically.

``<root>/segments/<uuid>/`` holds immutable cells, in a folder for each table and
partition, whose names are encoded (:func:`folder_of`), and sorted by key; ``<root>/manifest.json`` names the current ones and how far each
site's log is in them.  A manifest is published only over the version that its author
has seen.
"""

from __future__ import annotations

import fcntl
import json
import os
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import hlc as H
from tidemark.functions.hlc import is_hex
from tidemark.operators import merge as M
from tidemark.operators import tables as T
from tidemark.plans.catalog import CRDTS, INFORMATION_SCHEMA, Schemas, TableSchema
from tidemark.sources.oplog import OpLog


class SnapshotError(ValueError):
    """A manifest, segment or schema that is not well formed."""


@dataclass(frozen=True)
class Segment:
    path: str
    tbl: str
    part: str
    row_count: int
    key_min: str
    key_max: str
    hlc_max: str
    key_kinds: tuple[int, int] = (1, 1)  # of key_min and key_max: 0 for a number, 1 for a string

    def ordered(self) -> bool:
        """Whether key_min comes no later than key_max: numbers by value, then strings."""
        place = lambda kind, key: (kind, float(key), "") if kind == 0 else (kind, 0.0, key)
        return place(self.key_kinds[0], self.key_min) <= place(self.key_kinds[1], self.key_max)


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    compaction_hlc: str = "0x0"
    data: str | None = None
    segments: tuple[Segment, ...] = ()
    sites_compacted: dict[str, int] = field(default_factory=dict)


def safe_path(path: str) -> bool:
    """A relative path that stays below its root."""
    parts = path.split("/")
    return bool(path) and not path.startswith("/") and "\\" not in path and all(p not in ("", ".", "..") for p in parts)


def check_manifest(m: Manifest) -> None:
    if m.version < 0 or not is_hex(m.compaction_hlc):
        raise SnapshotError("version or clock is not valid")
    if m.data is not None and not safe_path(m.data):
        raise SnapshotError(f"unsafe path {m.data!r}")
    if len({s.path for s in m.segments}) != len(m.segments):
        raise SnapshotError("a segment is listed twice")
    for s in m.segments:
        if not safe_path(s.path) or s.row_count < 1 or not s.ordered() or not is_hex(s.hlc_max):
            raise SnapshotError(f"segment {s.path!r} is not valid")
    if any(not site or seq < 0 for site, seq in m.sites_compacted.items()):
        raise SnapshotError("a site's position is not valid")


def check_schemas(schemas: Schemas) -> None:
    for name, s in schemas.items():
        if not name or s.pk not in s.columns or s.crdt(s.pk) != "scalar" or any(k not in CRDTS for k, _ in s.columns.values()) or (s.partition_by is not None and s.partition_by not in s.columns):
            raise SnapshotError(f"schema of {name!r} is not valid")


def folder_of(value: Column) -> Column:
    """A folder name for any table or partition name: never empty, safe in a path, and
    another one for another name."""
    return F.concat(F.regexp_replace(F.substring(value, 1, 40), "[^A-Za-z0-9_]", "_"), F.lit("-"), F.substring(F.sha2(value, 256), 1, 16))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The files under a path as they are, folder names included."""
    return spark.read.schema(f"{M.CELLS}, part string, in_tbl string, in_part string").parquet(path)


def in_partition(stored: DataFrame, table: str, part: Column) -> DataFrame:
    """The cells of a table's partition; folders of others are not read."""
    return stored.where((F.col("in_tbl") == folder_of(F.lit(table))) & (F.col("tbl") == table) & (F.col("in_part") == folder_of(part)) & (F.col("part") == part))


def check_segment(cells: DataFrame) -> DataFrame:
    """(file, row, tbl, part, key_id, col) of stored cells that come before their
    predecessor in the order of keys and columns within their table and partition, or whose
    type, key or column is unknown; none in a good segment.  Works file by file."""
    place = F.struct("tbl", "part", T.key_order(F.col("key"), F.col("key_id")).alias("key"), "col")
    stored = cells.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), "tbl", "part", "key_id", "col", "typ", place.alias("place"))
    before = F.lag("place").over(W.partitionBy("file").orderBy("row"))
    bad = ~F.col("typ").isin(1, 2, 3, 4) | F.col("typ").isNull() | F.col("key_id").isNull() | F.col("col").isNull() | (F.col("col") == "")
    return stored.withColumn("before", before).where(bad | (F.col("before") >= F.col("place"))).drop("before", "place", "typ")


class SnapshotStore:
    def __init__(self, root: str):
        self.root = root
        os.makedirs(os.path.join(root, "segments"), exist_ok=True)

    def manifest(self) -> Manifest:
        try:
            with open(os.path.join(self.root, "manifest.json"), encoding="utf-8") as f:
                raw = json.load(f)
        except FileNotFoundError:
            return Manifest()
        out = Manifest(raw["version"], raw["compaction_hlc"], raw["data"], tuple(Segment(**s | {"key_kinds": tuple(s.get("key_kinds", (1, 1)))}) for s in raw["segments"]), raw["sites_compacted"])
        check_manifest(out)
        return out

    def publish(self, new: Manifest, seen: int) -> bool:
        """Puts ``new`` in the place of version ``seen``; False if that is no longer there."""
        if new.version != seen + 1:
            raise SnapshotError(f"version {new.version} cannot follow {seen}")
        check_manifest(new)
        with open(os.path.join(self.root, "manifest.lock"), "w") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)
            if self.manifest().version != seen:
                return False
            draft = os.path.join(self.root, f".manifest.{uuid.uuid4().hex}")
            with open(draft, "w", encoding="utf-8") as f:
                json.dump(asdict(new), f)
                f.flush()
                os.fsync(f.fileno())
            os.replace(draft, os.path.join(self.root, "manifest.json"))
            return True

    def stored(self, spark: SparkSession, data: str) -> DataFrame:
        return read_segments(spark, os.path.join(self.root, data))

    def cells(self, spark: SparkSession, table: str | None = None, part: str | Column | None = None, data: str | None = None) -> DataFrame:
        """The cells under ``data``, by default the current ones; a table and a partition
        prune the scan."""
        data = data or self.manifest().data
        schema = spark.createDataFrame([], f"{M.CELLS}, part string").schema
        if data is None:
            return spark.createDataFrame([], schema)
        found = self.stored(spark, data)
        if table is not None:
            found = found.where((F.col("in_tbl") == folder_of(F.lit(table))) & (F.col("tbl") == table))
        if part is not None and table is not None:
            found = in_partition(found, table, F.lit(part) if isinstance(part, str) else part)
        return found.select(*schema.names)

    def routed(self, spark: SparkSession, tail: DataFrame, table: str, part: str | Column, data: str | None = None) -> DataFrame:
        """The cells that a query of one partition needs, with the tail's operations: the
        partition's own, and those of rows in other partitions that the tail writes to,
        since a write can move a row."""
        own = self.cells(spark, table, part, data).drop("part")
        touched = tail.where(F.col("tbl") == table)
        part = F.lit(part) if isinstance(part, str) else part
        moved = self.cells(spark, table, data=data).where(F.col("part") != part).drop("part").join(touched.select("key_id").distinct(), "key_id", "left_semi")
        return M.fold_cells(own.unionByName(moved), touched)

    def put_schemas(self, schemas: Schemas) -> None:
        check_schemas(schemas)
        draft = os.path.join(self.root, f".schemas.{uuid.uuid4().hex}")
        with open(draft, "w", encoding="utf-8") as f:
            json.dump({n: {"pk": s.pk, "partition_by": s.partition_by, "columns": s.columns} for n, s in schemas.items()}, f)
        os.replace(draft, os.path.join(self.root, "schemas.json"))

    def schemas(self) -> Schemas:
        try:
            with open(os.path.join(self.root, "schemas.json"), encoding="utf-8") as f:
                raw = json.load(f)
        except FileNotFoundError:
            return {}
        out = {n: TableSchema(s["pk"], {c: tuple(k) for c, k in s["columns"].items()}, s["partition_by"]) for n, s in raw.items()}
        check_schemas(out)
        return out


@dataclass(frozen=True)
class Compaction:
    applied: bool
    manifest: Manifest
    operations: int


def write_segments(placed: DataFrame, path: str) -> None:
    """Writes cells with their partitions, in key order within each file.  A partition is
    dealt to as many files as range partitioning by key makes of it, so that a large one,
    or a table without partitions, is not one task's."""
    named = placed.withColumns({"in_tbl": folder_of(F.col("tbl")), "in_part": folder_of(F.col("part")), "_key": T.key_order(F.col("key"), F.col("key_id"))})
    dealt = named.repartitionByRange("tbl", "part", "_key").sortWithinPartitions("in_tbl", "in_part", "_key", "col").drop("_key")
    dealt.write.partitionBy("in_tbl", "in_part").option("compression", "zstd").option("parquet.bloom.filter.enabled#key_id", "true").parquet(path)


def compact(spark: SparkSession, log: OpLog, store: SnapshotStore, schemas: Schemas, now_ms: int, row_ttl_ms: int | None = None, tombstone_ttl_ms: int | None = None) -> Compaction:
    """Folds the contiguous tail of every site into a new snapshot.

    The information_schema tables are always part of it.  Retention happens only where a
    TTL is given.  If another compaction was faster, nothing changes.  Operations that lack
    a part, and events with two payloads, are errors.
    """
    before = store.manifest()
    cursors = spark.createDataFrame(list(before.sites_compacted.items()) or [], "site string, seq bigint")
    tail = M.contiguous_prefix(M.exactly_once(log.table(spark)), cursors)
    positions = {r.site: r.seq for r in M.heads(tail).collect()}  # one row per site
    if not positions:
        return Compaction(False, before, 0)
    clash = M.conflicts(tail).limit(1).collect()
    if clash:
        raise SnapshotError(f"two payloads of one event: {clash[0].tbl} {clash[0].key_id} {clash[0].col} {clash[0].site}")
    wrong = tail.join(M.valid_ops(tail).select("site", "seq", "op_idx"), ["site", "seq", "op_idx"], "left_anti").limit(1).collect()
    if wrong:
        raise SnapshotError(f"operation {wrong[0].site}/{wrong[0].seq}/{wrong[0].op_idx} lacks what its kind needs")
    ops = tail.count()
    cells = M.fold_cells(store.cells(spark).drop("part"), tail.select(*M._OP_COLUMNS))
    if row_ttl_ms is not None or tombstone_ttl_ms is not None:
        never = now_ms + 1
        cells = M.prune(cells, now_ms, never if row_ttl_ms is None else row_ttl_ms, never if tombstone_ttl_ms is None else tombstone_ttl_ms)
    placed = T.with_partition(cells, schemas | INFORMATION_SCHEMA)
    data = f"segments/{uuid.uuid4().hex}"
    write_segments(placed, os.path.join(store.root, data))
    refs = T.segment_refs(store.stored(spark, data)).select("tbl", "part", "row_count", "key_min", "key_max", H.to_hex(F.coalesce("hlc_max", H.struct(F.lit(0), F.lit(0)))).alias("hlc_max"), F.col("least.kind").alias("a"), F.col("most.kind").alias("b"), folder_of(F.col("tbl")).alias("in_tbl"), folder_of(F.col("part")).alias("in_part"))
    segments = tuple(Segment(f"{data}/in_tbl={r.in_tbl}/in_part={r.in_part}", r.tbl, r.part, r.row_count, r.key_min, r.key_max, r.hlc_max, (r.a, r.b)) for r in refs.orderBy("tbl", "part").collect())
    clock = tail.agg(H.to_hex(F.max("hlc")).alias("h")).first().h
    new = Manifest(before.version + 1, clock, data, segments, before.sites_compacted | positions)
    return Compaction(store.publish(new, before.version), new, ops)
