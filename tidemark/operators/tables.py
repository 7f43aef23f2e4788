"""Tables from cells: one row per visible key, one column per declared column."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import predicates as P
from tidemark.functions import scalars as S
from tidemark.operators import merge as M
from tidemark.plans.catalog import TableSchema
from tidemark.plans.dialect import Where
from tidemark.plans.operations import DEFAULT_PARTITION, SelectPlan

#: Prefixes of the untyped working columns.
_VALUE, _HAS = "_v_", "_has_"


def wide(cells: DataFrame, table: str, schema: TableSchema, columns: list[str] | None = None, hidden: bool = False) -> DataFrame:
    """(key_id, key, _v_<column>, _has_<column>): one aggregation over a table's cells.

    Values are scalars for keys and last-writer-wins columns, doubles for counters and
    arrays of scalars for sets and registers.  Only ``columns`` are aggregated; the scan
    reads no other cells.
    """
    wanted = [c for c in schema.columns if c != schema.pk and (columns is None or c in columns)]
    own = cells.where((F.col("tbl") == table) & F.col("col").isin(M.EXISTS, *schema.columns)) if columns is None else cells.where(F.col("tbl") == table)
    aggs: list[Column] = [F.min("key").alias("key"), F.coalesce(F.max(F.when(F.col("col") == M.EXISTS, F.col("val.b"))), F.lit(True)).alias("_visible")]
    for c in wanted:
        here = F.col("col") == c
        crdt = schema.crdt(c)
        value = {"pn_counter": M.counter_value(F.col("inc"), F.col("dec")), "or_set": M.set_values(F.col("elements")), "mv_register": M.register_values(F.col("values"))}.get(crdt, F.col("val"))
        aggs += [F.first(F.when(here, value), ignorenulls=True).alias(_VALUE + c), F.coalesce(F.max(here), F.lit(False)).alias(_HAS + c)]
    rows = own.groupBy("key_id").agg(*aggs)
    if not hidden:
        rows = rows.where("_visible")
    return rows.withColumn(_VALUE + schema.pk, F.col("key")).withColumn(_HAS + schema.pk, F.lit(True)).drop("_visible")


def condition(schema: TableSchema, column: str, op: str, value: S.Value, collation: str | None = None) -> Column:
    """A condition over ``wide`` rows."""
    crdt = schema.crdt(column)
    if crdt is None:
        return F.lit(False)
    actual = F.col(_VALUE + column)
    if crdt == "pn_counter":
        test = P.compare_typed(actual, "number", op, value)
    elif crdt == "or_set":
        test = P.compare_array(actual, op, value)
    elif crdt == "mv_register":
        test = P.compare_register(actual, op, value, collation)
    else:
        test = P.compare_scalar(actual, op, value, collation)
    return P.guarded(F.col(_HAS + column), test)


def _each(array: Column, one: Callable[[Column], Column]) -> Column:
    return F.transform(array, lambda x: one(x))


def typed(rows: DataFrame, schema: TableSchema, columns: list[str]) -> DataFrame:
    """The declared columns of ``wide`` rows.  Columns of a declared scalar type are of
    that type, others come as text; names that the schema lacks are null."""
    out = []
    for c in dict.fromkeys(columns):
        crdt, kind = schema.columns.get(c, (None, None))
        value = F.col(_VALUE + c) if crdt else None
        kind = kind and kind.lower()
        one = partial(S.unwrap, kind=kind) if kind else S.text_of
        if crdt is None:
            out.append(F.lit(None).cast("string").alias(c))
        elif crdt == "pn_counter":
            out.append(value.alias(c))
        elif crdt in ("or_set", "mv_register"):
            out.append(_each(value, one).alias(c))
        else:
            out.append(one(value).alias(c))
    return rows.select(*out)


def gold(cells: DataFrame, table: str, schema: TableSchema) -> DataFrame:
    """The table as users see it."""
    return typed(wide(cells, table, schema), schema, list(schema.columns))


def run_select(cells: DataFrame, plan: SelectPlan, schema: TableSchema, collation: str | None = None) -> DataFrame:
    """A planned SELECT.  A condition on the primary key is put below the aggregation;
    conditions on merged values stay above it."""
    columns = list(schema.columns) if plan.columns is None else list(plan.columns)
    used = {*columns, *(c.column for c in plan.filters)}
    for c in plan.filters:
        if c.column == schema.pk and c.op == "=" and isinstance(c.value, (str, int, float)) and not isinstance(c.value, bool):
            cells = cells.where(F.col("key_id") == S.key_text(c.value))
    rows = wide(cells, plan.table, schema, sorted(used & set(schema.columns)))
    return typed(rows.where(where(schema, plan.filters, collation)), schema, columns)


def where(schema: TableSchema, filters: Where, collation: str | None = None) -> Column:
    return P.every(condition(schema, c.column, c.op, c.value, collation) for c in filters)


def partition_of(rows: DataFrame, schema: TableSchema) -> Column:
    """The partition of ``wide`` rows: the text of the partition column, a common one for
    null, absent and array values."""
    by = schema.partition_by
    if by is None or by not in schema.columns:
        return F.lit(DEFAULT_PARTITION)
    value, crdt = F.col(_VALUE + by), schema.crdt(by)
    if crdt == "pn_counter":
        text = S.number_as_text(value)
    elif crdt == "or_set":
        text = F.lit(None).cast("string")
    elif crdt == "mv_register":
        text = F.when(F.size(value) == 1, S.text_of(F.element_at(value, 1)))
    else:
        text = S.text_of(value)
    return F.coalesce(F.when(F.col(_HAS + by), text), F.lit(DEFAULT_PARTITION))


def partition_of_value(value: S.Value) -> Column:
    """The partition of a row whose partition column holds ``value``."""
    return F.coalesce(S.text_of(S.literal(value)), F.lit(DEFAULT_PARTITION))


def key_order(key: Column, key_id: Column) -> Column:
    """Keys in order: numbers by value, then strings by code point."""
    number = key["k"] == "number"
    return F.struct(F.when(number, 0).otherwise(1).alias("kind"), F.when(number, key["n"]).alias("n"), key_id.alias("key_id"))


def with_partition(cells: DataFrame, schemas: dict[str, TableSchema]) -> DataFrame:
    """Cells of known tables with their row's partition, in a column ``part``."""
    out = None
    for table, schema in sorted(schemas.items()):
        own = cells.where(F.col("tbl") == table)
        if schema.partition_by is None:
            placed = own.withColumn("part", F.lit(DEFAULT_PARTITION))
        else:
            rows = wide(cells, table, schema, [schema.partition_by], hidden=True)
            placed = own.join(rows.select("key_id", partition_of(rows, schema).alias("part")), "key_id").select(*own.columns, "part")
        out = placed if out is None else out.unionByName(placed)
    return out if out is not None else cells.limit(0).withColumn("part", F.lit(DEFAULT_PARTITION))


def segment_refs(cells: DataFrame) -> DataFrame:
    """(tbl, part, row_count, key_min, key_max, hlc_max, least, most) of partitioned cells;
    the last two are the keys' places in :func:`key_order`."""
    clock = F.greatest(F.col("hlc"), F.array_max(F.transform("elements", lambda e: F.struct(e["wall_ms"], e["counter"]))), F.array_max(F.transform("values", lambda e: F.struct(e["wall_ms"], e["counter"]))), F.array_max(F.transform("tombstones", lambda e: F.struct(e["wall_ms"], e["counter"]))))
    return cells.withColumn("_c", clock).groupBy("tbl", "part").agg(F.countDistinct("key_id").alias("row_count"), F.min(key_order(F.col("key"), F.col("key_id"))).alias("_min"), F.max(key_order(F.col("key"), F.col("key_id"))).alias("_max"), F.max("_c").alias("hlc_max")).select("tbl", "part", "row_count", F.col("_min.key_id").alias("key_min"), F.col("_max.key_id").alias("key_max"), "hlc_max", F.col("_min").alias("least"), F.col("_max").alias("most"))
