"""Folds against an independent fold in Python; any order, splits, redelivery."""

import random

import pytest

from tidemark.functions.hlc import Hlc
from tidemark.functions.scalars import scalar, value_of
from tidemark.operators import merge as M
from tidemark.operators import tables as T
from tidemark.plans import catalog
from tidemark.plans.dialect import parse
from tidemark.plans.operations import plan_select

SCHEMA = catalog.created(parse("CREATE TABLE t (id PRIMARY KEY, a LWW<STRING>, b LWW<NUMBER>, n COUNTER, m COUNTER, s SET<STRING>, r REGISTER<STRING>) PARTITION BY a"))


def random_log(seed, size=300):
    rng = random.Random(seed)
    out, adds, seq = [], [], {}
    for i in range(size):
        site = rng.choice(["x", "y", "z"])
        seq[site] = seq.get(site, 0) + 1
        hlc = Hlc(1000 + rng.randrange(60), i)
        key = rng.choice([1, "1", 2, "k", "ü"])
        kind = rng.choice(["row_exists", "cell_lww", "cell_counter", "cell_or_set_add", "cell_or_set_remove", "cell_mv_register"])
        op = {"site": site, "seq": seq[site], "op_idx": 0, "tbl": "t", "key_id": str(key), "key": scalar(key), "hlc": {"wall_ms": hlc.wall_ms, "counter": hlc.counter}, "kind": kind, "col": None, "exists": None, "val": None, "d": None, "n": None, "tags": None}
        if kind == "row_exists":
            op["exists"] = rng.random() < 0.7
        elif kind == "cell_lww":
            op["col"] = rng.choice("ab")
            op["val"] = scalar(rng.choice([None, "v", "w", "é"]) if op["col"] == "a" else rng.choice([None, 1, 2.5, "odd"]))
        elif kind == "cell_counter":
            op |= {"col": rng.choice("nm"), "d": rng.choice(["inc", "dec"]), "n": float(rng.randrange(5))}
        elif kind == "cell_or_set_remove":
            op |= {"col": "s", "tags": rng.sample(adds, min(len(adds), rng.randint(0, 3))) + ([{"wall_ms": 5, "counter": 5, "site": "q"}] if rng.random() < 0.2 else [])}
        else:
            op |= {"col": "s" if kind == "cell_or_set_add" else "r", "val": scalar(rng.choice(["p", "q", None, 3]))}
            if kind == "cell_or_set_add":
                adds.append({**op["hlc"], "site": site})
        out.append(op)
    return out


def python_fold(log):
    cells = {}
    event = lambda o: (o["hlc"]["wall_ms"], o["hlc"]["counter"], o["site"])
    for o in sorted(log, key=lambda o: (o["site"], o["seq"])):
        k = (o["key_id"], o["col"] or "_exists")
        c = cells.setdefault(k, {})
        if o["kind"] in ("row_exists", "cell_lww"):
            new = (event(o), o["exists"] if o["kind"] == "row_exists" else value_of(o["val"]))
            if "lww" not in c or new[0] > c["lww"][0]:
                c["lww"] = new
        elif o["kind"] == "cell_counter":
            c["pn"] = c.get("pn", 0) + (o["n"] if o["d"] == "inc" else -o["n"])
        elif o["kind"] == "cell_or_set_add":
            c.setdefault("add", {})[event(o)] = value_of(o["val"])
        elif o["kind"] == "cell_or_set_remove":
            c.setdefault("gone", set()).update((t["wall_ms"], t["counter"], t["site"]) for t in o["tags"])
        else:
            old = c.setdefault("mv", {}).get(o["site"])
            if old is None or event(o) > old[0]:
                c["mv"][o["site"]] = (event(o), value_of(o["val"]))
    out = {}
    for k, c in cells.items():
        if "lww" in c:
            out[k] = c["lww"][1]
        elif "pn" in c:
            out[k] = c["pn"]
        elif "mv" in c:
            out[k] = [v for _, v in sorted(c["mv"].values(), key=lambda x: x[0])]
        else:
            out[k] = list(dict.fromkeys(v for t, v in sorted(c.get("add", {}).items()) if t not in c.get("gone", ())))
    return out


def spark_cells(cells):
    out = {}
    for r in cells.collect():
        value = {1: lambda r: value_of(r.val), 2: lambda r: sum((r.inc or {}).values()) - sum((r.dec or {}).values()), 3: lambda r: list(dict.fromkeys(value_of(e.val) for e in r.elements)), 4: lambda r: [value_of(e.val) for e in r["values"]]}[r.typ](r)
        out[(r.key_id, r.col)] = value
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_fold_in_any_order_with_redelivery(spark, seed):
    log = random_log(seed)
    rng = random.Random(seed)
    shuffled = log + rng.sample(log, 80)
    rng.shuffle(shuffled)
    got = M.fold(M.exactly_once(spark.createDataFrame(shuffled, M.OP_LOG)).select(*M._OP_COLUMNS))
    assert spark_cells(got) == python_fold(log)


@pytest.mark.parametrize("cut", [0, 7, 60, 10_000])
def test_snapshot_and_tail(spark, cut):
    log = random_log(3)
    df = lambda rows: spark.createDataFrame(rows, M.OP_LOG).select(*M._OP_COLUMNS)
    head, tail = [o for o in log if o["seq"] <= cut], [o for o in log if o["seq"] > cut]
    assert spark_cells(M.fold_cells(M.fold(df(head)), df(tail))) == python_fold(log)


def test_tables_and_conditions(spark):
    log = random_log(4)
    cells = M.fold(spark.createDataFrame(log, M.OP_LOG).select(*M._OP_COLUMNS))
    want = python_fold(log)
    keys = sorted({k for k, _ in want})
    visible = [k for k in keys if want.get((k, "_exists"), True)]
    assert sorted(r.id for r in T.gold(cells, "t", SCHEMA).collect()) == visible

    def check(sql, test):
        got = sorted(r.id for r in T.run_select(cells, plan_select(parse(sql), {"t": SCHEMA}), SCHEMA).collect())
        assert got == [k for k in visible if test(k)], sql

    cell = lambda k, c: want.get((k, c), "absent")
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    check("SELECT id FROM t WHERE a = 'v'", lambda k: cell(k, "a") == "v")
    check("SELECT id FROM t WHERE a != 'v'", lambda k: cell(k, "a") not in ("v", "absent"))
    check("SELECT id FROM t WHERE a = NULL", lambda k: cell(k, "a") is None)
    check("SELECT id FROM t WHERE a >= NULL", lambda k: cell(k, "a") is None)
    check("SELECT id FROM t WHERE b < 2", lambda k: number(cell(k, "b")) and cell(k, "b") < 2)
    check("SELECT id FROM t WHERE b != 2", lambda k: cell(k, "b") != "absent" and cell(k, "b") != 2)
    check("SELECT id FROM t WHERE n > 0", lambda k: cell(k, "n") != "absent" and cell(k, "n") > 0)
    check("SELECT id FROM t WHERE s = NULL", lambda k: None in cell(k, "s") if isinstance(cell(k, "s"), list) else False)
    check("SELECT id FROM t WHERE s != 'p'", lambda k: isinstance(cell(k, "s"), list) and "p" not in cell(k, "s"))
    check("SELECT id FROM t WHERE s < 'p'", lambda k: False)
    check("SELECT id FROM t WHERE zzz != 'p'", lambda k: False)
    check("SELECT id FROM t WHERE id = 1", lambda k: k == "1")


def test_conflicts_clashes_and_validity(spark):
    log = random_log(5, 60)
    odd = next(o for o in log if o["kind"] == "cell_lww")
    again = odd | {"val": scalar("other")}
    found = M.conflicts(spark.createDataFrame([*log, again, odd], M.OP_LOG)).collect()
    assert [(r.key_id, r.col, r.payloads) for r in found] == [(odd["key_id"], odd["col"], 2)]
    wrong = odd | {"kind": "cell_mv_register", "hlc": {"wall_ms": 9999, "counter": 1}}
    df = spark.createDataFrame([*log, wrong], M.OP_LOG)
    assert [(r.key_id, r.types) for r in M.type_clashes(df).collect()] == [(odd["key_id"], 2)]
    with pytest.raises(Exception, match="two types"):
        M.fold(df.select(*M._OP_COLUMNS)).collect()
    bad = [odd | {"val": None}, odd | {"tbl": ""}, odd | {"kind": "nothing"}, odd | {"kind": "cell_counter", "d": "inc", "n": -1.0}]
    assert M.valid_ops(spark.createDataFrame(bad, M.OP_LOG)).count() == 0
    assert M.valid_ops(spark.createDataFrame(log, M.OP_LOG)).count() == len(log)


def test_prefix_heads_and_reach(spark):
    log = spark.createDataFrame([("a", 1), ("a", 2), ("a", 4), ("b", 3), ("c", 1), ("c", 1)], "site string, seq bigint")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(M.contiguous_prefix(log)) == [("a", 1), ("a", 2), ("c", 1), ("c", 1)]
    cursors = spark.createDataFrame([("a", 3), ("b", 2)], "site string, seq bigint")
    assert rows(M.contiguous_prefix(log, cursors)) == [("a", 4), ("b", 3), ("c", 1), ("c", 1)]
    assert rows(M.read_since(log, "a", 1)) == [("a", 2)]
    assert rows(M.heads(log)) == [("a", 4), ("b", 3), ("c", 1)]
    assert M.reached(M.heads(log), cursors).first().reached and not M.reached(cursors, M.heads(log)).first().reached


def test_retention(spark):
    day = 86_400_000
    base = {"site": "x", "op_idx": 0, "tbl": "t", "col": None, "exists": None, "val": None, "d": None, "n": None, "tags": None}
    op = lambda key, wall, **k: base | {"seq": wall, "key_id": key, "key": scalar(key), "hlc": {"wall_ms": wall, "counter": 0}} | k
    log = [op("old", day, kind="row_exists", exists=False), op("old", 5, kind="cell_lww", col="a", val=scalar("x")), op("new", day + 1, kind="row_exists", exists=False), op("set", 9, kind="cell_or_set_remove", col="s", tags=[{"wall_ms": w, "counter": 0, "site": "x"} for w in (day, day + 1)])]
    kept = M.prune(M.fold(spark.createDataFrame(log, M.OP_LOG).select(*M._OP_COLUMNS)), 8 * day, 7 * day, 7 * day).collect()
    assert {r.key_id for r in kept} == {"new", "set"}
    assert [t.wall_ms for r in kept if r.key_id == "set" for t in r.tombstones] == [day + 1]
