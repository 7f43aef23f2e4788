"""One query per operator over the driver's tables, each with SQL that says the same.

The ``events`` table is read as an operation log: the event type is the site, the user
the row, time and event number the clock.  Every event writes to a register; views and
purchases write a value, purchases and errors count up and down, clicks add to a set
and every third of them is removed again by the site that reports errors; some errors
delete the row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import hlc as H
from tidemark.functions import scalars as S
from tidemark.operators import merge as M
from tidemark.operators import tables as T
from tidemark.plans import catalog
from tidemark.plans.dialect import CreateTable, parse
from tidemark.plans.operations import Planner, plan_select
from tidemark.sources.files import scratch
from tidemark.sources.snapshots import in_partition, read_segments, write_segments

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TABLE = "users"
SCHEMA_SQL = "CREATE TABLE users (id PRIMARY KEY, value LWW<NUMBER>, owner LWW<STRING>, points COUNTER, tags SET<STRING>, status REGISTER<STRING>) PARTITION BY owner"
SCHEMAS = {TABLE: catalog.created(parse(SCHEMA_SQL))}


def _query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = _COMMON + sql
        return f

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as an operation log; entries are numbered by event, operations within."""
    e = events(spark, sf_dir)
    wall = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    n, kind = F.col("event_id"), F.col("event_type")
    base = e.select("event_id", F.col("user_id").cast("string").alias("key_id"), S.of_number(F.col("user_id")).alias("key"), kind.alias("event_type"), "value", H.struct(wall, n % 65536).alias("hlc"))
    null = lambda t: F.lit(None).cast(t)
    tag = f"array<{M._TAG}>"

    def op(name: str, when: Column, col: str | None = None, exists: Column | None = None, val: Column | None = None, d: Column | None = None, amount: Column | None = None, tags: Column | None = None, site: Column | None = None, later: bool = False) -> Column:
        clock = H.struct(F.col("hlc.wall_ms") + 1, F.col("hlc.counter")) if later else F.col("hlc")
        made = F.struct(
            (site if site is not None else kind).alias("site"), F.lit(name).alias("kind"), F.lit(col).cast("string").alias("col"), (exists if exists is not None else null("boolean")).alias("exists"), (val if val is not None else null(S.SCALAR)).alias("val"),
            (d if d is not None else null("string")).alias("d"), (amount if amount is not None else null("double")).alias("n"), (tags if tags is not None else null(tag)).alias("tags"), clock.alias("hlc"),
        )
        return F.when(when, made)

    is_ = lambda *names: kind.isin(*names)
    own_tag = F.array(F.struct(F.col("hlc.wall_ms"), F.col("hlc.counter"), kind.alias("site")))
    ops = F.array_compact(
        F.array(
            op("row_exists", is_("signup", "error"), exists=~(is_("error") & (n % 4 == 0))),
            op("cell_lww", is_("view", "purchase"), "value", val=S.of_number(F.when(n % 10 != 0, F.col("value")))),
            op("cell_lww", is_("signup", "view"), "owner", val=S.of_string(F.concat(F.lit("o"), (n % 3).cast("string")))),
            op("cell_counter", is_("purchase"), "points", d=F.lit("inc"), amount=(n % 7).cast("double")),
            op("cell_counter", is_("error"), "points", d=F.lit("dec"), amount=(n % 5).cast("double")),
            op("cell_or_set_add", is_("click"), "tags", val=S.of_string(F.concat(F.lit("t"), (n % 20).cast("string")))),
            op("cell_or_set_remove", is_("click") & (n % 3 == 0), "tags", tags=own_tag, site=F.lit("error"), later=True),
            op("cell_mv_register", F.lit(True), "status", val=S.of_string(F.concat(kind, (n % 3).cast("string")))),
        )
    )
    out = base.select("event_id", "key_id", "key", F.posexplode(ops).alias("op_idx", "o"))
    return out.select("o.site", F.col("event_id").cast("bigint").alias("seq"), "op_idx", F.lit(TABLE).alias("tbl"), "key_id", "key", "o.hlc", "o.kind", "o.col", "o.exists", "o.val", "o.d", "o.n", "o.tags")


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).select(*M._OP_COLUMNS)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.fold(ops(spark, sf_dir))


def select(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    plan = plan_select(parse(sql), SCHEMAS)
    return T.run_select(cells(spark, sf_dir), plan, SCHEMAS[TABLE])


_COMMON = """
WITH e AS (SELECT event_id AS i, (epoch_us(ts) // 1000)::bigint AS w, (event_id % 65536)::int AS c, user_id::varchar AS u, event_type AS t, value AS v FROM events),
lww AS (SELECT u, arg_max_null(CASE WHEN i % 10 <> 0 THEN v END, row(w, c, t)) AS value FROM e WHERE t IN ('view', 'purchase') GROUP BY u),
own AS (SELECT u, arg_max('o' || (i % 3), row(w, c, t)) AS owner FROM e WHERE t IN ('signup', 'view') GROUP BY u),
vis AS (SELECT u, arg_max(NOT (t = 'error' AND i % 4 = 0), row(w, c, t)) AS visible FROM e WHERE t IN ('signup', 'error') GROUP BY u),
pn AS (SELECT u, sum(CASE WHEN t = 'purchase' THEN i % 7 ELSE -(i % 5) END)::double AS points FROM e WHERE t IN ('purchase', 'error') GROUP BY u),
adds AS (SELECT u, 't' || (i % 20) AS val, w, c, i FROM e WHERE t = 'click'),
live AS (SELECT * FROM adds WHERE i % 3 <> 0),
tags AS (SELECT u, list_sort(list(DISTINCT val)) AS tags FROM live GROUP BY u),
mv AS (SELECT u, t, arg_max(t || (i % 3), row(w, c)) AS val FROM e GROUP BY u, t),
status AS (SELECT u, list_sort(list(val)) AS status FROM mv GROUP BY u),
users AS (SELECT DISTINCT u FROM e),
gold AS (SELECT u AS id, value, lww.u IS NOT NULL AS has_value, owner, own.u IS NOT NULL AS has_owner, points, pn.u IS NOT NULL AS has_points,
    coalesce(tags, []) AS tags, EXISTS (SELECT 1 FROM adds a WHERE a.u = users.u) AS has_tags, status
  FROM users LEFT JOIN vis USING (u) LEFT JOIN lww USING (u) LEFT JOIN own USING (u) LEFT JOIN pn USING (u) LEFT JOIN tags USING (u) LEFT JOIN status USING (u) WHERE coalesce(visible, true))
"""


@_query("SELECT u AS id, value FROM lww")
def lww_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cells(spark, sf_dir).where("col = 'value'")
    return found.select(F.col("key_id").alias("id"), S.unwrap(F.col("val"), "number").alias("value"))


@_query("SELECT u AS id, coalesce(visible, true) AS visible FROM vis")
def row_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).where(F.col("col") == M.EXISTS).select(F.col("key_id").alias("id"), F.col("val.b").alias("visible"))


@_query("SELECT u AS id, points FROM pn")
def pn_counter_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).where("col = 'points'").select(F.col("key_id").alias("id"), M.counter_value(F.col("inc"), F.col("dec")).alias("points"))


@_query("SELECT u AS id, d, t AS site, n FROM (SELECT u, t, CASE WHEN t = 'purchase' THEN 'inc' ELSE 'dec' END AS d, sum(CASE WHEN t = 'purchase' THEN i % 7 ELSE i % 5 END)::double AS n FROM e WHERE t IN ('purchase', 'error') GROUP BY u, t) WHERE n <> 0")
def pn_counter_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cells(spark, sf_dir).where("col = 'points'")
    sides = [found.select(F.col("key_id").alias("id"), F.lit(d).alias("d"), F.explode(d).alias("site", "n")) for d in ("inc", "dec")]
    return sides[0].unionByName(sides[1])


@_query("SELECT u AS id, t AS site, max(n) AS n FROM (SELECT u, t, b, sum(i % 7)::double AS n FROM (SELECT *, unnest([0, 1]) AS b FROM e) WHERE t = 'purchase' AND (b = 0 OR i % 2 = 0) GROUP BY u, t, b) WHERE n <> 0 GROUP BY u, t")
def pn_counter_state_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two replicas' states, one of which has seen a part of the operations only."""
    whole = log(spark, sf_dir).where("kind = 'cell_counter'")
    states = M.fold(whole.select(*M._OP_COLUMNS)).unionByName(M.fold(whole.where("seq % 2 = 0").select(*M._OP_COLUMNS)))
    return M.merge_counter_states(states).select(F.col("key_id").alias("id"), F.explode("inc").alias("site", "n"))


@_query("SELECT u AS id, coalesce(tags.tags, []) AS tags FROM (SELECT DISTINCT u FROM adds) LEFT JOIN tags USING (u)")
def or_set_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cells(spark, sf_dir).where("col = 'tags'")
    return found.select(F.col("key_id").alias("id"), F.array_sort(F.transform(M.set_values(F.col("elements")), lambda x: x["s"])).alias("tags"))


@_query("SELECT u AS id, val, w AS wall_ms, c AS counter, 'click' AS site FROM live")
def or_set_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.or_set_elements(ops(spark, sf_dir)).select(F.col("key_id").alias("id"), F.col("val.s").alias("val"), "wall_ms", "counter", "site")


@_query("SELECT u AS id, count(*) AS tombstones FROM adds WHERE i % 3 = 0 GROUP BY u")
def or_set_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).where("col = 'tags'").select(F.col("key_id").alias("id"), F.size("tombstones").cast("long").alias("tombstones")).where("tombstones > 0")


@_query("SELECT w AS wall_ms, c AS counter, 'click' AS site FROM live WHERE u = '7' AND val = 't1'")
def or_set_observed_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.observed_tags(cells(spark, sf_dir), TABLE, "7", "tags", "t1")


@_query("SELECT u AS id, status FROM status")
def mv_register_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cells(spark, sf_dir).where("col = 'status'")
    return found.select(F.col("key_id").alias("id"), F.array_sort(F.transform(M.register_values(F.col("values")), lambda x: x["s"])).alias("status"))


@_query("SELECT u AS id, list(val ORDER BY w, c) AS added FROM live GROUP BY u")
def or_set_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live elements in the order of their tags, as they are stored."""
    found = cells(spark, sf_dir).where("col = 'tags' and size(elements) > 0")
    return found.select(F.col("key_id").alias("id"), F.transform("elements", lambda x: x["val"]["s"]).alias("added"))


@_query("SELECT u AS id, list(val ORDER BY r) AS status FROM (SELECT u, t, max(row(w, c, t)) AS r, arg_max(t || (i % 3), row(w, c)) AS val FROM e GROUP BY u, t) GROUP BY u")
def mv_register_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A register's values in the order of their events, as they are stored."""
    found = cells(spark, sf_dir).where("col = 'status'")
    return found.select(F.col("key_id").alias("id"), F.transform(M.register_values(F.col("values")), lambda x: x["s"]).alias("status"))


@_query("SELECT u AS id, CASE WHEN len(status) = 1 THEN status[1] END AS status FROM status")
def mv_register_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cells(spark, sf_dir).where("col = 'status'")
    return found.select(F.col("key_id").alias("id"), F.when(F.size("values") == 1, F.element_at("values", 1)["val"]["s"]).alias("status"))


_SORTED = ("tags", "status")


def _sorted(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.array_sort(c) for c in _SORTED if c in df.columns})


@_query("SELECT id, value, owner, points, CASE WHEN has_tags THEN tags END AS tags, status FROM gold")
def table_materialize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: a whole table from its operations."""
    return _sorted(T.gold(cells(spark, sf_dir), TABLE, SCHEMAS[TABLE]))


@_query("SELECT id, points FROM gold WHERE has_points AND points >= 10 AND has_owner AND owner = 'o1'")
def select_filter_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sorted(select(spark, sf_dir, "SELECT id, points FROM users WHERE points >= 10 AND owner = 'o1'"))


@_query("SELECT id, value, owner, points, CASE WHEN has_tags THEN tags END AS tags, status FROM gold WHERE id = '7'")
def select_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sorted(select(spark, sf_dir, "SELECT * FROM users WHERE id = 7"))


@_query("SELECT id FROM gold WHERE has_value AND value IS NULL")
def filter_null_equals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sorted(select(spark, sf_dir, "SELECT id FROM users WHERE value = NULL"))


@_query("SELECT id, value FROM gold WHERE has_value AND (value IS NULL OR value <> 5)")
def filter_not_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null differs from a number; an absent cell fails."""
    return _sorted(select(spark, sf_dir, "SELECT id, value FROM users WHERE value != 5"))


@_query("SELECT id FROM gold WHERE has_value")
def filter_type_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sorted(select(spark, sf_dir, "SELECT id FROM users WHERE value != 'a text'"))


@_query("SELECT id, tags FROM gold WHERE has_tags AND list_contains(tags, 't1')")
def filter_set_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sorted(select(spark, sf_dir, "SELECT id, tags FROM users WHERE tags = 't1'"))


@_query("SELECT id FROM gold WHERE has_tags AND NOT list_contains(tags, 't1')")
def filter_set_lacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sorted(select(spark, sf_dir, "SELECT id FROM users WHERE tags != 't1'"))


@_query("SELECT id, status FROM gold WHERE list_contains(status, 'click1')")
def filter_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sorted(select(spark, sf_dir, "SELECT id, status FROM users WHERE status = 'click1'"))


@_query("SELECT id, NULL::varchar AS nothing FROM gold WHERE false")
def filter_unknown_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sorted(select(spark, sf_dir, "SELECT id, nothing FROM users WHERE nothing != 1"))


@_query("SELECT id, owner FROM gold WHERE has_owner AND owner = 'o2'")
def partition_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a written snapshot, of which the route leaves one partition's files."""
    plan = plan_select(parse("SELECT id, owner FROM users WHERE owner = 'o2'"), SCHEMAS)
    stored = _snapshot(spark, T.with_partition(cells(spark, sf_dir), SCHEMAS))
    return T.run_select(in_partition(stored, TABLE, T.partition_of_value(plan.value)), plan, SCHEMAS[TABLE])


def _snapshot(spark: SparkSession, placed: DataFrame) -> DataFrame:
    path = scratch(spark)
    write_segments(placed, path)
    return read_segments(spark, path)


@_query("""SELECT p AS part, u AS id FROM (SELECT DISTINCT u, CASE u::bigint % 8 WHEN 0 THEN '' WHEN 1 THEN 'a/b' WHEN 2 THEN 'a' || chr(92) || 'b' WHEN 3 THEN '..' WHEN 4 THEN 'é ü' WHEN 5 THEN '12345678.5' WHEN 6 THEN 'true' ELSE '_default' END AS p FROM e) WHERE p <> 'true'""")
def partition_odd_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by partition from a written snapshot, each partition read by its route: empty
    texts, separators, numbers and nulls come back, booleans are not asked for."""
    values = ["", "a/b", "a\\b", "..", "é ü", 12345678.5, True, None]
    users = events(spark, sf_dir).select(F.col("user_id").alias("u")).distinct()
    val = S.literal(values[-1])
    for i, v in enumerate(values[:-1]):
        val = F.when(F.col("u") % 8 == i, S.literal(v)).otherwise(val)
    null = lambda t: F.lit(None).cast(t)
    made = users.select(F.lit("t").alias("tbl"), F.col("u").cast("string").alias("key_id"), S.of_number(F.col("u")).alias("key"), H.struct(F.lit(1), F.lit(1)).alias("hlc"), F.lit("a").alias("site"), F.lit("cell_lww").alias("kind"), F.lit("p").alias("col"), null("boolean").alias("exists"), val.alias("val"), null("string").alias("d"), null("double").alias("n"), null(f"array<{M._TAG}>").alias("tags"))
    schema = catalog.created(parse("CREATE TABLE t (id PRIMARY KEY, p LWW<STRING>) PARTITION BY p"))
    stored = _snapshot(spark, T.with_partition(M.fold(made), {"t": schema}))
    out = None
    for v in values:
        if v is not True:
            own = in_partition(stored, "t", T.partition_of_value(v)).select("part", F.col("key_id").alias("id"))
            out = own if out is None else out.unionByName(own)
    return out


@_query("SELECT coalesce(owner, '_default') AS part, count(*) AS n FROM gold GROUP BY 1")
def all_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.wide(cells(spark, sf_dir), TABLE, SCHEMAS[TABLE], ["owner"])
    return rows.groupBy(T.partition_of(rows, SCHEMAS[TABLE]).alias("part")).agg(F.count("*").alias("n"))


# logs: an order is an entry of its customer's nation-sized site, gaps included


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries (site, seq) of 50 sites; in five of them some are missing."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.where("not (o_orderkey % 997 = 0 and o_orderkey % 50 < 5)").select((F.col("o_orderkey") % 50).cast("string").alias("site"), (F.floor(F.col("o_orderkey") / 50) + 1).cast("bigint").alias("seq"))


_LOG = ", n AS (SELECT (o_orderkey % 50)::varchar AS site, (o_orderkey // 50 + 1)::bigint AS seq FROM orders WHERE NOT (o_orderkey % 997 = 0 AND o_orderkey % 50 < 5))"


@_query(_LOG + " SELECT site, seq FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY seq) AS rn FROM (SELECT DISTINCT * FROM n)) WHERE seq = rn")
def contiguous_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.contiguous_prefix(_entries(spark, sf_dir))


@_query(_LOG + " SELECT site, seq FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY seq) AS rn FROM n WHERE seq > 10) WHERE seq - 10 = rn")
def read_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _entries(spark, sf_dir)
    return M.contiguous_prefix(entries, entries.select("site", F.lit(10).cast("bigint").alias("seq")).distinct())


@_query(_LOG + " SELECT site, max(seq) AS seq FROM n GROUP BY site")
def site_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.heads(_entries(spark, sf_dir))


@_query(_LOG + " SELECT DISTINCT site FROM n")
def list_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.sites(_entries(spark, sf_dir))


@_query(_LOG + ", p AS (SELECT site, max(seq) AS seq FROM n WHERE seq <= 20 GROUP BY site), h AS (SELECT site, max(seq) AS seq FROM n GROUP BY site) SELECT bool_and(coalesce(p.seq, 0) >= h.seq) AS reached FROM h LEFT JOIN p USING (site)")
def heads_reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _entries(spark, sf_dir)
    return M.reached(M.heads(entries.where("seq <= 20")), M.heads(entries))


@_query("SELECT u AS id, points FROM pn")
def dedup_redelivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of which a third is delivered twice counts once."""
    whole = log(spark, sf_dir).where("kind = 'cell_counter'")
    twice = whole.unionByName(whole.where("seq % 3 = 0"))
    found = M.fold(M.exactly_once(twice).select(*M._OP_COLUMNS))
    return found.select(F.col("key_id").alias("id"), M.counter_value(F.col("inc"), F.col("dec")).alias("points"))


@_query("SELECT id, value, owner, points, CASE WHEN has_tags THEN tags END AS tags, status FROM gold")
def snapshot_plus_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of one half of the log, folded with the other half's operations."""
    whole = log(spark, sf_dir)
    half = F.pmod(F.xxhash64("seq"), F.lit(2)) == 0
    snapshot = M.fold(whole.where(half).select(*M._OP_COLUMNS))
    merged = M.fold_cells(snapshot, whole.where(~half).select(*M._OP_COLUMNS))
    return _sorted(T.gold(merged, TABLE, SCHEMAS[TABLE]))


_NOW = "(SELECT max(w) FROM e)"
_DAY = 86_400_000


@_query(f""", d AS (SELECT u, arg_max(row(NOT (t = 'error' AND i % 4 = 0), w), row(w, c, t)) AS r FROM e WHERE t IN ('signup', 'error') GROUP BY u),
    gone AS (SELECT u FROM d WHERE NOT r[1] AND r[2] <= {_NOW} - {_DAY} * 3)
    SELECT u AS id, count(*) FILTER (WHERE i % 3 = 0 AND w > {_NOW} - {_DAY} * 7)::bigint AS tombstones FROM adds WHERE u NOT IN (SELECT u FROM gone) GROUP BY u""")
def retention_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = events(spark, sf_dir).agg(F.max(F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")).alias("m")).first().m
    kept = M.prune(cells(spark, sf_dir), now, 3 * _DAY, 7 * _DAY).where("col = 'tags'")
    return kept.select(F.col("key_id").alias("id"), F.size("tombstones").cast("long").alias("tombstones"))


@_query(""", r AS (SELECT users.u, coalesce(owner, '_default') AS part FROM users LEFT JOIN own USING (u))
    SELECT part, count(*) AS row_count, arg_min(u, u::bigint) AS key_min, arg_max(u, u::bigint) AS key_max FROM r GROUP BY part""")
def segment_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = T.with_partition(cells(spark, sf_dir), SCHEMAS)
    return T.segment_refs(placed).select("part", "row_count", "key_min", "key_max")


@_query(", m AS (SELECT max(row(w, c)) AS h FROM (SELECT w, c FROM e UNION ALL SELECT w + 1, c FROM adds WHERE i % 3 = 0)) SELECT '0x' || lower(to_hex(h[1] * 65536 + h[2])) AS hlc FROM m")
def compaction_hlc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.max_clock(ops(spark, sf_dir)).select(H.to_hex(F.col("hlc")).alias("hlc"))


@_query("SELECT i AS event_id, '0x' || lower(to_hex(w * 65536 + c)) AS hlc, w AS wall_ms, c AS counter, true AS valid FROM e")
def hlc_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    wall = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    text = events(spark, sf_dir).select("event_id", H.to_hex(H.struct(wall, F.col("event_id") % 65536)).alias("hlc"))
    back = text.withColumn("b", H.from_hex(F.col("hlc")))
    return back.select("event_id", "hlc", "b.wall_ms", "b.counter", H.valid_hex(F.col("hlc")).alias("valid"))


@_query("SELECT u AS id, w AS wall_ms, c AS counter, 2::bigint AS payloads FROM e WHERE t = 'view' AND i % 11 = 0 AND i % 10 <> 0")
def event_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some views arrive again under the same event with another value."""
    views = log(spark, sf_dir).where("kind = 'cell_lww' and col = 'value' and site = 'view'")
    # by event number, of which the clock's counter is a remainder; a text differs from null and any number
    other = views.where("seq % 11 = 0 and seq % 10 <> 0").withColumn("val", S.of_string(F.lit("another")))
    found = M.conflicts(views.unionByName(other))
    return found.select(F.col("key_id").alias("id"), "hlc.wall_ms", "hlc.counter", "payloads")


@_query("SELECT DISTINCT u AS id, 2::bigint AS types FROM e WHERE t = 'purchase' AND i % 5 = 0")
def type_clashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = log(spark, sf_dir).where("col = 'value'")
    wrong = whole.where("site = 'purchase' and seq % 5 = 0").withColumn("kind", F.lit("cell_mv_register"))
    return M.type_clashes(whole.unionByName(wrong)).select(F.col("key_id").alias("id"), "types")


@_query("SELECT count(*) AS ahead FROM e WHERE t = 'view' AND w > (SELECT max(w) FROM e) - 86400000 * 2 + 60000")
def future_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = ops(spark, sf_dir).where("col = 'value' and site = 'view'")
    now = events(spark, sf_dir).agg(F.max(F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")).alias("m")).first().m
    return M.future_ops(views, now - 2 * _DAY).agg(F.count("*").alias("ahead"))


@_query("SELECT kind, count(*) AS n FROM (SELECT 'cell_counter' AS kind FROM e WHERE t IN ('purchase', 'error') AND NOT (t = 'purchase' AND i % 7 = 3) UNION ALL SELECT 'cell_or_set_add' FROM e WHERE t = 'click') GROUP BY kind")
def valid_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations that lack a part, here some counters with a negative amount, go."""
    found = ops(spark, sf_dir).where("kind in ('cell_counter', 'cell_or_set_add')")
    broken = found.withColumn("n", F.when((F.col("d") == "inc") & (F.col("n") == 3), F.lit(-1.0)).otherwise(F.col("n")))
    return M.valid_ops(broken).groupBy("kind").agg(F.count("*").alias("n"))


def _schema_ops(spark: SparkSession) -> DataFrame:
    ticks = iter(range(1, 10_000))
    planner = Planner("a", lambda: H.Hlc(1_700_000_000_000, next(ticks)), {})
    made = planner.create(CreateTable(**vars(parse(SCHEMA_SQL))))
    return spark.createDataFrame(list(made), M.OP)


@_query("SELECT * FROM (VALUES ('users:id', 'users', 'id', 'scalar'), ('users:value', 'users', 'value', 'lww'), ('users:owner', 'users', 'owner', 'lww'), ('users:points', 'users', 'points', 'pn_counter'), ('users:tags', 'users', 'tags', 'or_set'), ('users:status', 'users', 'status', 'mv_register')) AS c(column_id, table_name, column_name, crdt_kind)")
def information_schema_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.gold(M.fold(_schema_ops(spark)), catalog.COLUMNS, catalog.INFORMATION_SCHEMA[catalog.COLUMNS])


@_query("SELECT * FROM (VALUES ('id', 'scalar', NULL), ('value', 'lww', 'NUMBER'), ('owner', 'lww', 'STRING'), ('points', 'pn_counter', NULL), ('tags', 'or_set', 'STRING'), ('status', 'mv_register', 'STRING'), ('added', 'lww', 'BOOLEAN')) AS c(column_name, crdt, scalar)")
def schema_after_alter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schema that a replica derives from CREATE and ALTER, declared types included."""
    ticks = iter(range(10_000, 20_000))
    planner = Planner("b", lambda: H.Hlc(1_700_000_000_000, next(ticks)), SCHEMAS)
    altered = spark.createDataFrame(list(planner.add_column(parse("ALTER TABLE users ADD COLUMN added LWW<BOOLEAN>"))), M.OP)
    merged = M.fold(_schema_ops(spark).unionByName(altered))
    rows = {t: [r.asDict() for r in T.gold(merged, t, s).collect()] for t, s in catalog.DERIVED_FROM.items()}
    found = catalog.derived(rows[catalog.TABLES], rows[catalog.COLUMNS])[TABLE]
    return spark.createDataFrame([(c, k, s) for c, (k, s) in found.columns.items()], "column_name string, crdt string, scalar string")


@_query("SELECT 'users' AS table_name, 'id' AS pk_column, 'owner' AS partition_by")
def information_schema_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.gold(M.fold(_schema_ops(spark)), catalog.TABLES, catalog.INFORMATION_SCHEMA[catalog.TABLES])


_STATEMENTS = (
    "INSERT INTO users (id, value, points, tags, status) VALUES ('u8', 41.25, 6, 'vip', 'away')",
    "UPDATE users SET value = NULL, status = 'home' WHERE id = 'u8'",
    "INC users.points BY 12 WHERE id = 'u8'",
    "DEC users.points BY 7 WHERE id = 'u8'",
    "ADD 'night' TO users.tags WHERE id = 'u8'",
    "REMOVE 'vip' FROM users.tags WHERE id = 'u8'",
    "DELETE FROM users WHERE id = 'u9'",
)


@_query("""SELECT * FROM (VALUES (1, 'row_exists', NULL, 'u8'), (2, 'cell_lww', 'value', 'u8'), (3, 'cell_counter', 'points', 'u8'), (4, 'cell_or_set_add', 'tags', 'u8'), (5, 'cell_mv_register', 'status', 'u8'),
    (6, 'row_exists', NULL, 'u8'), (7, 'cell_lww', 'value', 'u8'), (8, 'cell_mv_register', 'status', 'u8'), (9, 'row_exists', NULL, 'u8'), (10, 'cell_counter', 'points', 'u8'), (11, 'row_exists', NULL, 'u8'), (12, 'cell_counter', 'points', 'u8'),
    (13, 'row_exists', NULL, 'u8'), (14, 'cell_or_set_add', 'tags', 'u8'), (15, 'row_exists', NULL, 'u8'), (16, 'cell_or_set_remove', 'tags', 'u8'), (17, 'row_exists', NULL, 'u9')) AS o(counter, kind, col, key_id)""")
def statement_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the write statements turn into."""
    ticks = iter(range(1, 10_000))
    planner = Planner("a", lambda: H.Hlc(1_700_000_000_000, next(ticks)), SCHEMAS, lambda *_: [(H.Hlc(1_700_000_000_000, 4), "a")])
    made = [op for s in _STATEMENTS for op in planner.writes(parse(s))]
    return spark.createDataFrame(made, M.OP).select("hlc.counter", "kind", "col", "key_id")


@_query("SELECT n_name, count(*) AS users, sum(points)::double AS points FROM gold JOIN customer ON c_custkey::varchar = id JOIN nation ON n_nationkey = c_nationkey WHERE has_points GROUP BY n_name")
def merged_table_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A merged table in an ordinary query."""
    users = _sorted(T.gold(cells(spark, sf_dir), TABLE, SCHEMAS[TABLE]).select("id", "points")).where("points is not null")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("string").alias("id"), "c_nationkey")
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")
    joined = users.join(customers, "id").join(nations, F.col("n_nationkey") == F.col("c_nationkey"))
    return joined.groupBy("n_name").agg(F.count("*").alias("users"), F.sum("points").alias("points"))
