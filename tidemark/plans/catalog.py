"""Table schemas, and how statements change them.

Schemas are themselves replicated: CREATE and ALTER write cells of the two
information_schema tables, and every replica derives its schemas from the fold.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from tidemark.plans.dialect import AddColumn, ColumnDef, CreateTable, DropTable, SqlError, Statement

#: What a cell of a column merges as.
KINDS = {"scalar": "lww", "lww": "lww", "counter": "pn_counter", "set": "or_set", "register": "mv_register"}
SCALARS = ("STRING", "NUMBER", "BOOLEAN")
CRDTS = ("scalar", "lww", "pn_counter", "or_set", "mv_register")
TABLES, COLUMNS = "information_schema.tables", "information_schema.columns"


@dataclass(frozen=True)
class TableSchema:
    """``columns``: name to (crdt, declared scalar type or None)."""

    pk: str
    columns: dict[str, tuple[str, str | None]] = field(hash=False)
    partition_by: str | None = None

    def crdt(self, column: str) -> str | None:
        return self.columns.get(column, (None, None))[0]

    def same(self, other: TableSchema) -> bool:
        """Equal but for declared scalar types."""
        return (self.pk, self.partition_by) == (other.pk, other.partition_by) and {c: k for c, (k, _) in self.columns.items()} == {c: k for c, (k, _) in other.columns.items()}


Schemas = dict[str, TableSchema]


def _meta(pk: str, *others: str) -> TableSchema:
    return TableSchema(pk, {pk: ("scalar", "STRING")} | {c: ("lww", "STRING") for c in others})


#: Schemas that every replica has.
INFORMATION_SCHEMA: Schemas = {
    TABLES: _meta("table_name", "pk_column", "partition_by"),
    COLUMNS: _meta("column_id", "table_name", "column_name", "crdt_kind"),
}


#: What schemas are derived from: declared scalar types are replicated beside the columns
#: that information_schema shows.
DERIVED_FROM: Schemas = {TABLES: INFORMATION_SCHEMA[TABLES], COLUMNS: _meta("column_id", "table_name", "column_name", "crdt_kind", "scalar_type")}


def effective(schemas: Schemas) -> Schemas:
    return schemas | INFORMATION_SCHEMA


def created(s: CreateTable) -> TableSchema:
    keys = [c.name for c in s.columns if c.primary]
    if len(keys) != 1:
        raise SqlError(f"table {s.table} needs one primary key, not {len(keys)}")
    if len({c.name for c in s.columns}) != len(s.columns):
        raise SqlError(f"table {s.table} names a column twice")
    if s.partition_by is not None and s.partition_by not in {c.name for c in s.columns}:
        raise SqlError(f"table {s.table} has no column {s.partition_by} to partition by")
    columns = {c.name: ("scalar", None) if c.primary else (KINDS[c.type.kind], c.type.scalar) for c in s.columns}
    return TableSchema(keys[0], columns, s.partition_by)


def widened(schema: TableSchema, table: str, column: ColumnDef) -> TableSchema:
    if column.name in schema.columns:
        raise SqlError(f"table {table} already has a column {column.name}")
    crdt = "scalar" if column.type.kind == "scalar" else KINDS[column.type.kind]
    return TableSchema(schema.pk, schema.columns | {column.name: (crdt, column.type.scalar)}, schema.partition_by)


def after_ddl(schemas: Schemas, s: Statement) -> Schemas:
    """The schemas after a local CREATE, DROP or ALTER."""
    match s:
        case CreateTable():
            if s.table in schemas:
                raise SqlError(f"table {s.table} exists")
            return schemas | {s.table: created(s)}
        case DropTable():
            if s.table not in schemas:
                raise SqlError(f"no table {s.table}")
            return {t: x for t, x in schemas.items() if t != s.table}
        case AddColumn():
            if s.table not in schemas:
                raise SqlError(f"no table {s.table}")
            return schemas | {s.table: widened(schemas[s.table], s.table, s.column)}
    raise SqlError("no schema statement")


def derived(tables: Iterable[dict], columns: Iterable[dict]) -> Schemas:
    """Schemas from the visible rows of the two information_schema tables."""
    found: dict[str, dict[str, tuple[str, str | None]]] = {}
    for r in columns:
        t, c, k, s = (r.get(x) for x in ("table_name", "column_name", "crdt_kind", "scalar_type"))
        if isinstance(t, str) and isinstance(c, str) and k in CRDTS:
            found.setdefault(t, {})[c] = (k, s if s in SCALARS else None)
    out: Schemas = {}
    for r in tables:
        t, pk, by = r.get("table_name"), r.get("pk_column"), r.get("partition_by")
        own = found.get(t, {}) if isinstance(t, str) else {}
        if isinstance(pk, str) and own.get(pk, ("", None))[0] == "scalar":
            out[t] = TableSchema(pk, dict(sorted(own.items())), by if by in own else None)
    return out
