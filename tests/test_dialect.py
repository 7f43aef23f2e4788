import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.functions.hlc import COUNTER_LIMIT, Clock, ClockError, Fence, Hlc, check_increasing, is_hex
from tidemark.functions.scalars import key_text, number_text, scalar, value_of
from tidemark.plans import catalog
from tidemark.plans.dialect import AddColumn, ColumnDef, ColumnType, Condition, Count, CreateTable, Delete, DropTable, Insert, Select, SetChange, SqlError, Update, parse, select_sql, to_sql
from tidemark.plans.operations import DEFAULT_PARTITION, Planner, operations_of, partition_key, plan_select

name = st.from_regex(r"[a-z][a-z0-9_]{0,14}", fullmatch=True)
value = st.one_of(st.none(), st.booleans(), st.text(max_size=40), st.integers(-1_000_000, 1_000_000), st.decimals(-1_000_000, 1_000_000, places=6, allow_nan=False).map(float).filter(lambda x: "e" not in number_text(x)))
where = st.lists(st.builds(Condition, name, st.sampled_from(["=", "!=", "<", ">", "<=", ">="]), value), min_size=1, max_size=4).map(tuple)
kind = st.one_of(st.just(ColumnType("counter")), st.builds(ColumnType, st.sampled_from(["scalar", "lww", "set", "register"]), st.sampled_from(["STRING", "NUMBER", "BOOLEAN"])))
column = st.one_of(st.builds(lambda n: ColumnDef(n, None, True), name), st.builds(ColumnDef, name, kind))
reserved = {"primary"}
statements = st.one_of(
    st.builds(CreateTable, name, st.lists(column, min_size=1, max_size=5).map(tuple), st.none() | name),
    st.builds(DropTable, name),
    st.builds(AddColumn, name, st.builds(ColumnDef, name, kind)),
    st.lists(st.tuples(name, value), min_size=1, max_size=5).flatmap(lambda p: st.builds(Insert, name, st.just(tuple(a for a, _ in p)), st.just(tuple(b for _, b in p)))),
    st.builds(Update, name, st.lists(st.tuples(name, value), min_size=1, max_size=4).map(tuple), where),
    st.builds(Select, name, st.none() | st.lists(name.filter(lambda n: n != "from"), min_size=1, max_size=4).map(tuple), st.just(()) | where),
    st.builds(Delete, name, where),
    st.builds(Count, name, name, st.integers(0, 10_000), st.booleans(), where),
    st.builds(SetChange, name, name, value, st.booleans(), where),
)


@settings(max_examples=300, deadline=None)
@given(statements)
def test_text_and_back(s):
    assert parse(to_sql(s)) == s
    assert parse(to_sql(s).replace(" ", "\n ") + " ;") == s or "'" in to_sql(s)


@pytest.mark.parametrize("sql", ["", "SELECT", "SELECT * FROM", "SELECT a b FROM t", "SELECT * FROM t WHERE a <> 1", "SELECT * FROM t;;", "UPDATE t SET a = 1", "DELETE FROM t", "INSERT INTO t (a, b) VALUES (1)", "CREATE TABLE t (a STRING PRIMARY KEY)", "CREATE TABLE t (a INT)", "INC t BY 1 WHERE a = 1", "ADD 'x' FROM t.a WHERE id = 1", "SELECT * FROM t WHERE a = 'open", "SELECT * FROM t WHERE a = 1 OR b = 2", "SELECT * FROM t WHERE a = .5", "SELECT * FROM t -- no comments"])
def test_what_is_no_statement(sql):
    with pytest.raises(SqlError):
        parse(sql)


def test_numbers_as_keys():
    assert [number_text(x) for x in (1.0, -1.5, 0.0, -0.0, 1e21, 1e20, 1e-7, 1e-6, 123456789012345680000.0, 0.1, 5e-324, 1.5e300, 100)] == ["1", "-1.5", "0", "0", "1e+21", "100000000000000000000", "1e-7", "0.000001", "123456789012345680000", "0.1", "5e-324", "1.5e+300", "100"]
    assert key_text(1) == key_text("1") == key_text(1.0)
    for v in (None, True, 1, 1.5, "x"):
        assert value_of(scalar(v)) == v


SCHEMA = catalog.created(parse("CREATE TABLE t (id PRIMARY KEY, a LWW<STRING>, b NUMBER, n COUNTER, s SET<STRING>, r REGISTER<STRING>) PARTITION BY a"))


def planner(tags=()):
    ticks = iter(range(1, 1000))
    return Planner("me", lambda: Hlc(5, next(ticks)), {"t": SCHEMA}, lambda *_: list(tags))


def test_schemas():
    assert SCHEMA.columns["b"] == ("lww", "NUMBER") and SCHEMA.pk == "id" and SCHEMA.partition_by == "a"
    for bad in ("CREATE TABLE t (a STRING)", "CREATE TABLE t (a PRIMARY KEY, b PRIMARY KEY)", "CREATE TABLE t (a PRIMARY KEY, b STRING, b STRING)", "CREATE TABLE t (a PRIMARY KEY) PARTITION BY x"):
        with pytest.raises(SqlError):
            catalog.created(parse(bad))
    wide = catalog.after_ddl({"t": SCHEMA}, parse("ALTER TABLE t ADD COLUMN z COUNTER"))["t"]
    assert wide.crdt("z") == "pn_counter"
    assert catalog.after_ddl({"t": SCHEMA}, parse("DROP TABLE t")) == {}
    with pytest.raises(SqlError):
        catalog.after_ddl({"t": SCHEMA}, parse("ALTER TABLE t ADD COLUMN a COUNTER"))
    rows = [{"table_name": "t", "pk_column": "id", "partition_by": "gone"}, {"table_name": "u", "pk_column": "id", "partition_by": None}, {"table_name": None, "pk_column": "id"}]
    columns = [{"table_name": "t", "column_name": "id", "crdt_kind": "scalar"}, {"table_name": "t", "column_name": "x", "crdt_kind": "lww"}, {"table_name": "t", "column_name": "y", "crdt_kind": "odd"}, {"table_name": "u", "column_name": "id", "crdt_kind": "lww"}]
    found = catalog.derived(rows, columns)
    assert list(found) == ["t"] and found["t"].partition_by is None and set(found["t"].columns) == {"id", "x"}


def test_operations():
    ops = planner().writes(parse("INSERT INTO t (id, a, n, s, r) VALUES (1, 'x', 2, 'y', NULL)"))
    assert [(o["kind"], o["col"]) for o in ops] == [("row_exists", None), ("cell_lww", "a"), ("cell_counter", "n"), ("cell_or_set_add", "s"), ("cell_mv_register", "r")]
    assert [o["hlc"]["counter"] for o in ops] == [1, 2, 3, 4, 5] and {o["key_id"] for o in ops} == {"1"}
    assert planner().writes(parse("REMOVE 'x' FROM t.s WHERE id = 1")) == ()
    gone = planner([(Hlc(1, 2), "you")]).writes(parse("REMOVE 'x' FROM t.s WHERE id = 1"))
    assert gone[1]["tags"] == [{"wall_ms": 1, "counter": 2, "site": "you"}]
    assert [o["exists"] for o in planner().writes(parse("DELETE FROM t WHERE id = 1 AND a = 'not looked at'"))] == [False]
    for bad in ("UPDATE t SET id = 2 WHERE id = 1", "UPDATE t SET n = 2 WHERE id = 1", "UPDATE t SET s = 'x' WHERE id = 1", "UPDATE t SET a = 'x' WHERE a = 'y'", "INC t.a BY 1 WHERE id = 1", "INC t.n BY -1 WHERE id = 1", "ADD 'x' TO t.a WHERE id = 1", "INSERT INTO t (a) VALUES ('x')", "INSERT INTO t (id, n) VALUES (1, -1)", "INSERT INTO t (id, n) VALUES (1, 'x')", "INSERT INTO t (id, q) VALUES (1, 1)", "INSERT INTO t (id) VALUES (NULL)", "DELETE FROM u WHERE id = 1", "DELETE FROM information_schema.tables WHERE table_name = 't'"):
        with pytest.raises(SqlError):
            planner().writes(parse(bad))
    with pytest.raises(SqlError):
        operations_of("SELECT * FROM t", planner())
    p = planner()
    assert p.replicated("CREATE TABLE t (id PRIMARY KEY, a STRING, b NUMBER, n COUNTER, s SET<STRING>, r REGISTER<STRING>) PARTITION BY a").ops == ()
    for bad in ("CREATE TABLE t (id PRIMARY KEY)", "DROP TABLE t", "ALTER TABLE t ADD COLUMN a COUNTER"):
        with pytest.raises(SqlError):
            p.replicated(bad)
    assert p.replicated("ALTER TABLE t ADD COLUMN a STRING").ops == ()
    made = p.replicated("CREATE TABLE u (id PRIMARY KEY, b COUNTER)").ops
    assert [o["key_id"] for o in made if o["kind"] == "row_exists"] == ["u", "u:b", "u:id"]


def test_select_plans():
    p = plan_select(parse("SELECT * FROM t WHERE b = 1 AND a = 'x' AND a = 'y'"), {"t": SCHEMA})
    assert p.route == "x" and len(p.filters) == 3
    assert plan_select(parse("SELECT * FROM t WHERE b = 1"), {"t": SCHEMA}).route is None
    assert plan_select(parse("SELECT * FROM t WHERE a = NULL"), {"t": SCHEMA}).route == DEFAULT_PARTITION
    assert partition_key(True) == "true" and partition_key(2.0) == "2"
    assert parse(select_sql("t", ["a"], [("b", ">=", 2)])) == Select("t", ("a",), (Condition("b", ">=", 2),))


@settings(max_examples=200, deadline=None)
@given(st.integers(0, (1 << 64) - 1), st.lists(st.integers(0, 200_000), min_size=1, max_size=30))
def test_clocks(packed, walls):
    assert Hlc.from_hex(Hlc.from_packed(packed).hex()).packed() == packed
    it = iter(walls)
    at = [0]

    def wall():
        at[0] = next(it, at[0])
        return at[0]

    clock, seen = Clock(wall, max_drift_ms=1 << 40), []
    for i in range(len(walls)):
        seen.append(clock.tick() if i % 3 else clock.receive(Hlc(walls[i] // 2, i)))
    check_increasing(seen)


def test_clock_bounds():
    clock = Clock(lambda: 1000, Hlc(1000, COUNTER_LIMIT - 1))
    assert clock.tick() == Hlc(1001, 0)
    with pytest.raises(ClockError):
        Clock(lambda: 1000).receive(Hlc(61_001, 0))
    assert Clock(lambda: 1000).receive(Hlc(61_000, 3)) == Hlc(61_000, 4)
    assert Clock(lambda: 1000).receive(Hlc(5, 3)) == Hlc(1000, 0)
    fence = Fence(Hlc(1, 1))
    fence.accept(Hlc(1, 2))
    for bad in (Hlc(1, 2), Hlc(0, 9)):
        with pytest.raises(ClockError):
            fence.accept(bad)
    assert is_hex("0x0") and not is_hex("0x") and not is_hex("10") and not is_hex("0x" + "0" * 17)
    with pytest.raises(ClockError):
        Hlc(1 << 48, 0)
