"""A replica: one site's view of the replicated tables.

``execute`` turns statements into pending operations, ``push`` appends them to the log,
``pull`` moves the cursors forward, ``query`` reads.  A replica's rows are a fold of
the snapshot that it has taken over, of the log between that and its cursors, and of
its pending operations; nothing else is state, and the state file is replaced as a
whole.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.hlc import Clock, Hlc
from tidemark.functions.scalars import Value, value_of
from tidemark.operators import merge as M
from tidemark.operators import tables as T
from tidemark.plans import catalog
from tidemark.plans.catalog import COLUMNS, INFORMATION_SCHEMA, TABLES, Schemas
from tidemark.plans.dialect import SqlError
from tidemark.plans.operations import Plan, Planner, SelectPlan
from tidemark.sources.oplog import LogError, OpLog
from tidemark.sources.snapshots import SnapshotStore


class Replica:
    def __init__(self, spark: SparkSession, site: str, log: OpLog, snapshots: SnapshotStore | None = None, state: str | None = None, wall: Callable[[], int] | None = None):
        self.spark, self.site, self.log, self.snapshots, self.state = spark, site, log, snapshots, state
        self.pending: list[dict] = []
        self.cursors: dict[str, tuple[int, str]] = {}  # site: last entry and its clock
        self.version, self.base = 0, {}  # the snapshot taken over, and its sites' positions
        self.data: str | None = None  # where its cells are
        last = self._load()
        self.clock = Clock(wall, last)
        self._schemas: Schemas | None = None

    # state

    def _load(self) -> Hlc | None:
        if not self.state or not os.path.exists(self.state):
            return None
        with open(self.state, encoding="utf-8") as f:
            raw = json.load(f)
        if raw["site"] != self.site:
            raise ValueError(f"the state is that of {raw['site']}")
        self.pending, self.cursors = raw["pending"], {s: tuple(c) for s, c in raw["cursors"].items()}
        self.version, self.base, self.data = raw["version"], raw["base"], raw["data"]
        return Hlc.from_hex(raw["clock"]) if raw["clock"] else None

    def _save(self) -> None:
        if not self.state:
            return
        os.makedirs(os.path.dirname(os.path.abspath(self.state)), exist_ok=True)
        draft = f"{self.state}.{uuid.uuid4().hex}"
        with open(draft, "w", encoding="utf-8") as f:
            json.dump({"site": self.site, "pending": self.pending, "cursors": self.cursors, "version": self.version, "base": self.base, "data": self.data, "clock": self.clock.last.hex() if self.clock.last else None}, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(draft, self.state)

    # rows

    def operations(self) -> DataFrame:
        """The operations after the snapshot: from the log up to the cursors, and pending."""
        log = M.exactly_once(self.log.table(self.spark))
        reach = self.spark.createDataFrame([(s, self.base.get(s, 0), c[0]) for s, c in self.cursors.items()] or [], "site string, low bigint, high bigint")
        seen = log.join(F.broadcast(reach), "site").where("seq > low and seq <= high").select(*M._OP_COLUMNS)
        return seen.unionByName(self.spark.createDataFrame(self.pending, M.OP)) if self.pending else seen

    def cells(self) -> DataFrame:
        ops = self.operations()
        if self.snapshots is None or self.data is None:
            return M.fold(ops)
        return M.fold_cells(self.snapshots.cells(self.spark, data=self.data).drop("part"), ops)

    def _cells_for(self, plan: SelectPlan) -> DataFrame:
        """The cells of a planned SELECT: a route prunes the snapshot's partitions."""
        if self.snapshots is None or self.data is None or plan.route is None or plan.partition_by is None:
            return self.cells()
        return self.snapshots.routed(self.spark, self.operations(), plan.table, T.partition_of_value(plan.value), self.data)

    def schemas(self) -> Schemas:
        """Schemas derived from the merged information_schema."""
        if self._schemas is None:
            cells = self.cells().where(F.col("tbl").isin(TABLES, COLUMNS))
            rows = {}
            for t in (TABLES, COLUMNS):  # one row per table and per column
                rows[t] = [r.asDict() for r in T.gold(cells, t, catalog.DERIVED_FROM[t]).collect()]
            found = catalog.derived(rows[TABLES], rows[COLUMNS])
            if not found and self.snapshots is not None:
                found = self.snapshots.schemas()
            self._schemas = found
        return self._schemas

    def _resolve(self, table: str, key_id: str, column: str, value: Value) -> list[tuple[Hlc, str]]:
        return [(Hlc(r.wall_ms, r.counter), r.site) for r in M.observed_tags(self.cells(), table, key_id, column, value).collect()]  # one set's tags of one value

    def plan(self, sql: str) -> Plan:
        return Planner(self.site, self.clock.tick, self.schemas(), self._resolve).replicated(sql)

    # the interface

    def execute(self, sql: str) -> int:
        """Carries out a statement that writes; returns its number of operations."""
        plan = self.plan(sql)
        if plan.kind != "write":
            raise SqlError("use query() to read")
        self.pending += plan.ops
        if any(op["tbl"] in INFORMATION_SCHEMA for op in plan.ops):
            self._schemas = None
        self._save()
        return len(plan.ops)

    def query(self, sql: str, collation: str | None = None) -> DataFrame:
        plan = self.plan(sql)
        if plan.kind != "read":
            raise SqlError("use execute() to write")
        schema = catalog.effective(self.schemas())[plan.select.table]
        return T.run_select(self._cells_for(plan.select), plan.select, schema, collation)

    def table(self, name: str) -> DataFrame:
        """A merged table, to be used in any DataFrame or SQL query."""
        return T.gold(self.cells(), name, catalog.effective(self.schemas())[name])

    def push(self) -> int:
        """Appends everything pending as one entry; returns its sequence number, or 0."""
        if not self.pending:
            return 0
        seq = self.log.append(self.site, self.pending)
        before = self.cursors.get(self.site, (0, ""))[0]
        if seq == before + 1:
            self.cursors[self.site] = (seq, Hlc(**self.pending[-1]["hlc"]).hex())
        self.pending = []
        self._save()
        return seq

    def pull(self) -> int:
        """Takes over a newer snapshot if it covers this replica, then reads every site's
        contiguous tail; returns how many entries came."""
        self._cut_over()
        came = 0
        for site in self.log.sites():
            at, clock = self.cursors.get(site, (0, ""))
            if self.log.head(site) < at:
                raise LogError(f"{site}: the log ends before entry {at}, which was read")
            if at and clock:
                held = self.log.entry(site, at)
                if held is None or held.hlc.hex() != clock:
                    raise LogError(f"{site}: entry {at} is not the one that was read")
            for entry in self.log.read_since(site, at):
                if site != self.site:
                    self.clock.receive(entry.hlc)
                self.cursors[site] = (entry.seq, entry.hlc.hex())
                came += 1
        if came:
            self._schemas = None
        self._save()
        return came

    def sync(self) -> int:
        self.push()
        return self.pull()

    def _cut_over(self) -> None:
        if self.snapshots is None:
            return
        m = self.snapshots.manifest()
        known = {s for s, (seq, _) in self.cursors.items() if seq} | {s for s in self.log.sites() if self.log.head(s)}
        if m.version <= self.version or not known <= m.sites_compacted.keys():
            return
        self.version, self.base, self.data = m.version, dict(m.sites_compacted), m.data
        for site, seq in m.sites_compacted.items():
            if self.cursors.get(site, (0, ""))[0] < seq:
                held = self.log.entry(site, seq)
                self.cursors[site] = (seq, held.hlc.hex() if held else "")
        self._schemas = None

    def synced_heads(self) -> dict[str, int]:
        return {s: c[0] for s, c in self.cursors.items()}

    def pending_count(self) -> int:
        return len(self.pending)


def rows(df: DataFrame) -> list[dict]:
    """Small results as Python rows, scalars unwrapped."""
    out = []
    for r in df.collect():
        out.append({k: value_of(v) if hasattr(v, "k") else v for k, v in r.asDict().items()})
    return out
