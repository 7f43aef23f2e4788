"""Merging operations into converged cells, and cells into tables.

``OP_LOG`` is one row per operation.  ``fold`` turns operations into cells, one row per
(table, row, column), whatever order they come in; ``fold_cells`` does the same for
cells of a snapshot and the operations after it.  The aggregation is two-level: first
by site, which spreads rows that all sites write to, then by cell.

Counters add up, so an operation must count once: ``exactly_once`` drops redelivered
rows and comes before any fold of a raw log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import hlc as H
from tidemark.functions import scalars as S

_TAG = "struct<wall_ms:bigint,counter:int,site:string>"
_ELEMENT = f"struct<val:{S.SCALAR},wall_ms:bigint,counter:int,site:string>"
OP = f"tbl string, key_id string, key {S.SCALAR}, hlc {H.HLC}, site string, kind string, col string, exists boolean, val {S.SCALAR}, d string, n double, tags array<{_TAG}>"
OP_LOG = f"site string, seq bigint, op_idx int, {OP.replace(' site string,', '')}"
CELLS = f"tbl string, key_id string, key {S.SCALAR}, col string, typ int, val {S.SCALAR}, hlc {H.HLC}, site string, inc map<string,double>, dec map<string,double>, elements array<{_ELEMENT}>, tombstones array<{_TAG}>, values array<{_ELEMENT}>"

EXISTS = "_exists"
LWW, COUNTER, OR_SET, REGISTER = 1, 2, 3, 4
TYPE_OF_KIND = {"row_exists": LWW, "cell_lww": LWW, "cell_counter": COUNTER, "cell_or_set_add": OR_SET, "cell_or_set_remove": OR_SET, "cell_mv_register": REGISTER}
TYPE_OF_CRDT = {"scalar": LWW, "lww": LWW, "pn_counter": COUNTER, "or_set": OR_SET, "mv_register": REGISTER}
_OP_COLUMNS = ["tbl", "key_id", "key", "hlc", "site", "kind", "col", "exists", "val", "d", "n", "tags"]


def exactly_once(log: DataFrame) -> DataFrame:
    """The log without redelivered operations."""
    return log.dropDuplicates(["site", "seq", "op_idx"])


def contiguous_prefix(log: DataFrame, cursors: DataFrame | None = None) -> DataFrame:
    """Of each site the entries after its cursor (site, seq; 0 where it has none), up to
    the first gap.  Works on entries (site, seq), so a site's operations cost nothing."""
    entries = log.select("site", "seq").distinct()
    if cursors is None:
        entries = entries.withColumn("since", F.lit(0).cast("bigint"))
    else:
        entries = entries.join(cursors.select("site", F.col("seq").alias("since")), "site", "left").withColumn("since", F.coalesce("since", F.lit(0)))
    after = entries.where("seq > since").select("site", "seq", "since")
    # a site's prefix ends before the first number that is wanted and not there
    wanted = after.select("site", (F.col("seq") + 1).alias("seq")).unionByName(entries.select("site", (F.col("since") + 1).alias("seq")).distinct())
    ends = wanted.join(after.select("site", "seq"), ["site", "seq"], "left_anti").groupBy("site").agg(F.min("seq").alias("end"))
    kept = after.join(ends, "site").where("seq < end").select("site", "seq")
    return log.join(kept, ["site", "seq"], "left_semi")


def read_since(log: DataFrame, site: str, since: int) -> DataFrame:
    """One site's contiguous entries after ``since``."""
    return contiguous_prefix(log.where((F.col("site") == site) & (F.col("seq") > since)).withColumn("seq", F.col("seq") - since)).withColumn("seq", F.col("seq") + since)


def heads(log: DataFrame) -> DataFrame:
    """(site, seq): the highest entry of each site."""
    return log.groupBy("site").agg(F.max("seq").alias("seq"))


def sites(log: DataFrame) -> DataFrame:
    return log.select("site").distinct()


def max_clock(ops: DataFrame) -> DataFrame:
    """(hlc): the highest clock of all."""
    return ops.agg(F.max("hlc").alias("hlc"))


def valid_ops(ops: DataFrame) -> DataFrame:
    """Operations with everything that their kind needs."""
    named = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    kind = F.col("kind")
    payload = (
        F.when(kind == "row_exists", F.col("exists").isNotNull())
        .when(kind.isin("cell_lww", "cell_or_set_add", "cell_mv_register"), named("col") & F.col("val").isNotNull())
        .when(kind == "cell_counter", named("col") & F.col("d").isin("inc", "dec") & (F.col("n") >= 0) & ~F.isnan("n") & (F.col("n") < F.lit(float("inf"))))
        .when(kind == "cell_or_set_remove", named("col") & F.col("tags").isNotNull())
        .otherwise(F.lit(False))
    )
    return ops.where(named("tbl") & named("site") & F.col("key_id").isNotNull() & F.col("hlc").isNotNull() & F.coalesce(payload, F.lit(False)))


def _event() -> Column:
    return H.event(F.col("hlc"), F.col("site"))


def _tagged(val: Column) -> Column:
    return F.struct(val.alias("val"), F.col("hlc.wall_ms").alias("wall_ms"), F.col("hlc.counter").alias("counter"), F.col("site"))


def _added(maps: Column) -> Column:
    """The sum of a list of maps by key, without zeros, keys in order."""
    none = F.create_map().cast("map<string,double>")
    some = F.filter(maps, lambda m: m.isNotNull())
    added = F.aggregate(some, none, lambda a, m: F.map_zip_with(a, m, lambda _, x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0))))
    return F.map_from_entries(F.array_sort(F.map_entries(F.map_filter(added, lambda _, n: n != 0))))


def fold(ops: DataFrame) -> DataFrame:
    """Cells of operations.  The operations must be distinct; order does not matter.  It is
    an error that a site's latest event for a cell says two things."""
    kind = F.col("kind")
    lww_kind = kind.isin("row_exists", "cell_lww")
    least = lambda cond, value: F.min(F.when(cond, F.struct((-F.col("hlc.wall_ms")).alias("w"), (-F.col("hlc.counter")).alias("c"), value.alias("v"))))
    col = F.when(kind == "row_exists", F.lit(EXISTS)).otherwise(F.col("col"))
    typ = F.lit(None).cast("int")
    for name, t in TYPE_OF_KIND.items():
        typ = F.when(kind == name, t).otherwise(typ)
    val = F.when(kind == "row_exists", S.of_boolean(F.col("exists"))).otherwise(F.col("val"))
    amount = lambda d: F.sum(F.when(F.col("d") == d, F.col("n")))
    per_site = ops.groupBy("tbl", "key_id", col.alias("col"), "site").agg(
        F.min(F.struct(F.col("hlc"), F.col("key"))).alias("first"),
        F.min(typ).alias("t1"), F.max(typ).alias("t2"),
        F.max(F.when(lww_kind, F.struct(F.col("hlc").alias("o"), val.alias("v")))).alias("lww"), least(lww_kind, val).alias("lww_least"),
        amount("inc").alias("inc"), amount("dec").alias("dec"),
        F.collect_list(F.when(kind == "cell_or_set_add", _tagged(F.col("val")))).alias("adds"),
        F.flatten(F.collect_list(F.when(kind == "cell_or_set_remove", F.col("tags")))).alias("removes"),
        F.max(F.when(kind == "cell_mv_register", F.struct(F.col("hlc").alias("o"), F.col("val").alias("v")))).alias("mv"), least(kind == "cell_mv_register", F.col("val")).alias("mv_least"),
    )
    # one event says one thing: the largest and the smallest payload of the latest are the same
    clash = lambda c: F.when(F.col(c).isNotNull() & (F.col(f"{c}.v") != F.col(f"{c}_least.v")), F.raise_error(F.concat_ws(" ", F.lit("two payloads of one event:"), "tbl", "key_id", "col", "site")).cast(per_site.schema[c].dataType)).otherwise(F.col(c))
    per_site = per_site.withColumns({"lww": clash("lww"), "mv": clash("mv")})
    map_of = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.coalesce(F.col(c), F.lit(0.0)) != 0, F.struct("site", c)))))
    mv = F.when(F.col("mv").isNotNull(), F.struct(F.col("mv.v").alias("val"), F.col("mv.o.wall_ms").alias("wall_ms"), F.col("mv.o.counter").alias("counter"), F.col("site")))
    lww = F.when(F.col("lww").isNotNull(), F.struct(F.col("lww.o").alias("o"), F.col("site"), F.col("lww.v").alias("v")))
    cells = per_site.groupBy("tbl", "key_id", "col").agg(
        F.min(F.struct(F.col("first.hlc"), F.col("site"), F.col("first.key").alias("key"))).alias("first"),
        F.min("t1").alias("t1"), F.max("t2").alias("t2"), F.max(lww).alias("lww"),
        map_of("inc").alias("inc"), map_of("dec").alias("dec"),
        F.flatten(F.collect_list("adds")).alias("adds"), F.array_distinct(F.flatten(F.collect_list("removes"))).alias("tombstones"),
        F.collect_list(mv).alias("mv"),
    )
    return _shaped(cells)


def _live(adds: Column, tombstones: Column) -> Column:
    """Elements that no tombstone names, in the order of their tags: both are sorted
    together by tag, tombstones first, and an element stays if its tag is new."""
    mark = lambda e, kind, val: F.struct(e["wall_ms"].alias("wall_ms"), e["counter"].alias("counter"), e["site"].alias("site"), F.lit(kind).alias("kind"), val.alias("val"))
    gone = F.transform(F.array_distinct(tombstones), lambda t: mark(t, 0, F.lit(None).cast(S.SCALAR)))
    own = F.transform(F.array_distinct(adds), lambda e: mark(e, 1, e["val"]))
    tag = lambda e: F.struct(e["wall_ms"], e["counter"], e["site"])
    before = lambda all_, i: F.try_element_at(all_, F.when(i > 0, i).otherwise(F.size(all_) + 1))
    kept = S.bound(F.array_sort(F.concat(gone, own)), lambda all_: F.filter(all_, lambda e, i: (e["kind"] == 1) & ~F.coalesce((before(all_, i)["kind"] == 0) & (tag(before(all_, i)) == tag(e)), F.lit(False))))
    return F.transform(kept, lambda e: F.struct(e["val"].alias("val"), e["wall_ms"].alias("wall_ms"), e["counter"].alias("counter"), e["site"].alias("site")))


def _latest(values: Column) -> Column:
    """Of each site its latest value: the last one where values lie by site and clock."""
    ordered = F.array_sort(F.transform(values, lambda e: F.struct(e["site"].alias("site"), e["wall_ms"].alias("wall_ms"), e["counter"].alias("counter"), e["val"].alias("val"))))
    last = S.bound(ordered, lambda all_: F.filter(all_, lambda e, i: ~F.coalesce(F.try_element_at(all_, i + 2)["site"] == e["site"], F.lit(False))))
    return F.transform(last, lambda e: F.struct(e["val"].alias("val"), e["wall_ms"].alias("wall_ms"), e["counter"].alias("counter"), e["site"].alias("site")))


def _shaped(cells: DataFrame) -> DataFrame:
    typ = F.col("t2")
    none = lambda t: F.lit(None).cast(t)
    clash = F.when(F.col("t1") != F.col("t2"), F.raise_error(F.concat_ws(" ", F.lit("cell written as two types:"), "tbl", "key_id", "col")).cast("int"))
    empty_tags = F.array().cast(f"array<{_TAG}>")
    return cells.select(
        "tbl", "key_id", F.col("first.key").alias("key"), "col", F.coalesce(clash, typ).alias("typ"),
        F.when(typ == LWW, F.col("lww.v")).alias("val"), F.when(typ == LWW, F.col("lww.o")).alias("hlc"), F.when(typ == LWW, F.col("lww.site")).alias("site"),
        F.when(typ == COUNTER, F.col("inc")).otherwise(none("map<string,double>")).alias("inc"), F.when(typ == COUNTER, F.col("dec")).otherwise(none("map<string,double>")).alias("dec"),
        F.when(typ == OR_SET, _live(F.col("adds"), F.coalesce("tombstones", empty_tags))).alias("elements"), F.when(typ == OR_SET, F.array_sort("tombstones")).alias("tombstones"),
        F.when(typ == REGISTER, _live(F.col("mv"), empty_tags)).alias("values"),
    )


def merge_cells(cells: DataFrame) -> DataFrame:
    """One cell for each (table, row, column) from cells of disjoint operations, such as a
    snapshot's and a tail's: counters add up, everything else merges."""
    ordered = F.when(F.col("hlc").isNotNull(), F.struct(F.col("hlc").alias("o"), "site", F.col("val").alias("v")))
    grouped = cells.groupBy("tbl", "key_id", "col").agg(
        F.min(F.struct(F.col("hlc"), F.col("site"), F.col("key").alias("key"))).alias("first"),
        F.min("typ").alias("t1"), F.max("typ").alias("t2"), F.max(ordered).alias("lww"),
        _added(F.collect_list("inc")).alias("inc"), _added(F.collect_list("dec")).alias("dec"),
        F.flatten(F.collect_list("elements")).alias("adds"), F.array_distinct(F.flatten(F.collect_list("tombstones"))).alias("tombstones"),
        _latest(F.flatten(F.collect_list("values"))).alias("mv"),
    )
    return _shaped(grouped)


def fold_cells(cells: DataFrame, tail: DataFrame) -> DataFrame:
    """A snapshot's cells with the operations after it."""
    return merge_cells(cells.unionByName(fold(tail)))


def merge_counter_states(states: DataFrame) -> DataFrame:
    """State-based merge of counters (tbl, key_id, col, inc, dec): the largest number by
    site.  For states that may share operations; never for a snapshot and its tail."""
    flat = states.select("tbl", "key_id", "col", F.explode("inc").alias("s", "n"), F.lit("inc").alias("d")).unionByName(states.select("tbl", "key_id", "col", F.explode("dec").alias("s", "n"), F.lit("dec").alias("d")))
    top = flat.groupBy("tbl", "key_id", "col", "d", "s").agg(F.max("n").alias("n"))
    pairs = lambda d: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("d") == d, F.struct("s", "n")))))
    return top.groupBy("tbl", "key_id", "col").agg(pairs("inc").alias("inc"), pairs("dec").alias("dec"))


def counter_value(inc: Column, dec: Column) -> Column:
    add = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda a, x: a + x)
    return F.coalesce(add(inc), F.lit(0.0)) - F.coalesce(add(dec), F.lit(0.0))


def set_values(elements: Column) -> Column:
    """Distinct values in the order of their tags."""
    return F.array_distinct(F.transform(elements, lambda e: e["val"]))


def register_values(values: Column) -> Column:
    return F.transform(values, lambda e: e["val"])


def or_set_elements(ops: DataFrame) -> DataFrame:
    """Live elements, one row each (tbl, key_id, col, val, wall_ms, counter, site), by an
    anti-join: for sets too large for one array."""
    adds = ops.where("kind = 'cell_or_set_add'").select("tbl", "key_id", "col", "val", "hlc.wall_ms", "hlc.counter", "site").distinct()
    gone = ops.where("kind = 'cell_or_set_remove'").select("tbl", "key_id", "col", F.explode("tags").alias("t")).select("tbl", "key_id", "col", "t.*")
    return adds.join(gone, ["tbl", "key_id", "col", "wall_ms", "counter", "site"], "left_anti")


def observed_tags(cells: DataFrame, tbl: str, key_id: str, col: str, value: S.Value) -> DataFrame:
    """(wall_ms, counter, site) of a set's elements that hold a value."""
    from tidemark.functions.predicates import same

    found = cells.where((F.col("tbl") == tbl) & (F.col("key_id") == key_id) & (F.col("col") == col)).select(F.explode("elements").alias("e"))
    return found.where(same(F.col("e.val"), value)).select("e.wall_ms", "e.counter", "e.site")


def payload(ops: DataFrame) -> Column:
    """What an operation says, as text: operations of one event must say the same."""
    tags = F.transform("tags", lambda t: F.concat_ws(":", t["wall_ms"].cast("string"), t["counter"].cast("string"), t["site"]))
    none = F.lit("")
    return F.concat_ws("|", "kind", F.coalesce(F.col("exists").cast("string"), none), F.when(F.col("val").isNotNull(), S.fingerprint(F.col("val"))).otherwise(none), F.coalesce("d", none), F.coalesce(F.col("n").cast("string"), none), F.coalesce(F.concat_ws(",", tags), none))


def conflicts(ops: DataFrame) -> DataFrame:
    """(tbl, key_id, col, hlc, site, payloads): events with more than one payload."""
    col = F.when(F.col("kind") == "row_exists", F.lit(EXISTS)).otherwise(F.col("col"))
    return ops.groupBy("tbl", "key_id", col.alias("col"), "hlc", "site").agg(F.countDistinct(payload(ops)).alias("payloads")).where("payloads > 1")


def type_clashes(ops: DataFrame) -> DataFrame:
    """(tbl, key_id, col, types): cells written as more than one type."""
    typ = F.lit(None).cast("int")
    for name, t in TYPE_OF_KIND.items():
        typ = F.when(F.col("kind") == name, t).otherwise(typ)
    col = F.when(F.col("kind") == "row_exists", F.lit(EXISTS)).otherwise(F.col("col"))
    return ops.groupBy("tbl", "key_id", col.alias("col")).agg(F.countDistinct(typ).alias("types")).where("types > 1")


def future_ops(ops: DataFrame, now_ms: int, max_drift_ms: int = H.MAX_DRIFT_MS) -> DataFrame:
    """Operations whose clocks are further ahead than allowed."""
    return ops.where(~H.within_drift(F.col("hlc"), now_ms, max_drift_ms))


def prune(cells: DataFrame, now_ms: int, row_ttl_ms: int, tombstone_ttl_ms: int) -> DataFrame:
    """Cells without rows deleted at least ``row_ttl_ms`` ago, and without tombstones of
    elements added at least ``tombstone_ttl_ms`` ago.  Forgetting is lossy: an old element
    that is merged again afterwards stays."""
    dead = cells.where((F.col("col") == EXISTS) & ~F.col("val.b") & (F.col("hlc.wall_ms") <= now_ms - row_ttl_ms)).select("tbl", "key_id")
    kept = cells.join(dead, ["tbl", "key_id"], "left_anti")
    cut = F.lit(now_ms - tombstone_ttl_ms)
    return kept.withColumn("tombstones", F.filter("tombstones", lambda t: t["wall_ms"] > cut)).select(*cells.columns)


def state_hash(rows: DataFrame) -> DataFrame:
    """(rows, hash) of a table, whatever the order of its rows."""
    one = F.xxhash64(F.to_json(F.struct(*sorted(rows.columns))))
    return rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(one.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string").alias("hash"))


def reached(synced: DataFrame, target: DataFrame) -> DataFrame:
    """(reached): whether every site's synced head is at least the target's."""
    joined = target.select("site", F.col("seq").alias("want")).join(synced.select("site", "seq"), "site", "left")
    return joined.agg(F.coalesce(F.bool_and(F.coalesce("seq", F.lit(0)) >= F.col("want")), F.lit(True)).alias("reached"))
