from tidemark.cli import run
from tidemark.functions.display import table
from tidemark.plans.operations import plan_select
from tidemark.plans.dialect import parse
from tidemark.replica import Replica
from tidemark.sources.oplog import OpLog
from tidemark.sources.snapshots import SnapshotStore, compact


def test_display():
    text = table(["a", "b"], [(1.0, None), (True, ["x", 2])])
    assert text.splitlines()[3] == "│ 1    │ NULL   │" and text.endswith("(2 rows)")
    assert table(["a"], []).endswith("(0 rows)")


def test_session_and_routed_reads(spark, tmp_path):
    log, store = OpLog(str(tmp_path / "log")), SnapshotStore(str(tmp_path / "snap"))
    a = Replica(spark, "a", log, store)
    lines = ["CREATE TABLE t (id PRIMARY KEY, owner LWW<STRING>, n COUNTER) PARTITION BY owner", *(f"INSERT INTO t (id, owner, n) VALUES ({i}, '{'xy'[i % 2]}', {i})" for i in range(4)), ".sync", ".tables", "SELECT id FROM t WHERE owner = 'x'", "nonsense", "DROP TABLE t", ".quit", ".help"]
    out = list(run(a, lines))
    assert out[0] == "16 operations" and out[-4] == "t" and "(2 rows)" in out[-3]
    assert out[-2].startswith("error") and out[-1].startswith("error")
    assert compact(spark, log, store, a.schemas(), 1).applied
    a.pull()
    assert a.version == 1 and a.data
    a.execute("UPDATE t SET owner = 'y' WHERE id = 0")  # moves a row to another partition
    a.execute("INC t.n BY 5 WHERE id = 0")
    a.execute("INSERT INTO t (id, owner) VALUES (9, 'y')")
    got = lambda sql: sorted((r.id, r.n) for r in a.query(sql).collect())
    assert got("SELECT * FROM t WHERE owner = 'x'") == [("2", 2.0)]
    assert got("SELECT * FROM t WHERE owner = 'y'") == [("0", 5.0), ("1", 1.0), ("3", 3.0), ("9", None)]
    plan = plan_select(parse("SELECT * FROM t WHERE owner = 'x'"), a.schemas())
    text = a._cells_for(plan)._jdf.queryExecution().executedPlan().toString()
    assert "in_part#" in text and "PartitionFilters: [isnotnull(in_tbl" in text
