"""Replicas over a shared log: zones, types, snapshots, cursors, chaos, streams."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.hlc import ClockError
from tidemark.functions.scalars import scalar
from tidemark.operators import merge as M
from tidemark.plans.dialect import SqlError
from tidemark.replica import Replica
from tidemark.sources.oplog import LogError, OpLog
from tidemark.sources.snapshots import Manifest, Segment, SnapshotError, SnapshotStore, check_manifest, check_segment, compact, safe_path
from tidemark.streaming import ingest

CREATE = "CREATE TABLE wells (code PRIMARY KEY, name LWW<STRING>, depth LWW<NUMBER>, dry LWW<BOOLEAN>, litres COUNTER, crews SET<STRING>, state REGISTER<STRING>, zone LWW<STRING>) PARTITION BY zone"


def wall():
    now = [1_700_000_000_000]

    def tick():
        now[0] += 1
        return now[0]

    return tick


def well(replica, code):
    r = replica.query(f"SELECT * FROM wells WHERE code = {code!r}").collect()
    return (r[0].name, r[0].depth, r[0].dry, r[0].litres, list(r[0].crews or ()), set(r[0].state or ())) if r else None


ZONES = ["''", "'a/b'", "'back\\slash'", "'..'", "12345678.5", "0.000001234", "7", "'7 '", "TRUE", "NULL"]


def test_zones_types_and_cut_over(spark, tmp_path):
    """Partitions of any value survive compaction, types come back, and a replica that is
    cut over to a snapshot reads each zone as one that has read the log does."""
    log, store, clock = OpLog(str(tmp_path / "log")), SnapshotStore(str(tmp_path / "snap")), wall()
    north, south = (Replica(spark, s, log, store, str(tmp_path / s), clock) for s in ("north", "south"))
    north.execute(CREATE)
    for i, z in enumerate(ZONES):
        north.execute(f"INSERT INTO wells (code, name, depth, dry, litres, zone) VALUES ({i * 9}, 'w{i}', {i}.25, {'TRUE' if i % 2 else 'FALSE'}, {i}, {z})")
    north.push()
    south.pull()
    assert south.query("SELECT depth, dry FROM wells WHERE code = 9").dtypes == [("depth", "double"), ("dry", "boolean")]
    assert south.query("SELECT code FROM wells WHERE depth = 1.25").first().code == "9"
    south.execute("INC wells.litres BY 1 WHERE code = 9")
    south.push()

    done = compact(spark, log, store, north.schemas(), clock())
    assert done.applied and {s.part for s in done.manifest.segments if s.tbl == "wells"} == {"", "a/b", "back\\slash", "..", "12345678.5", "0.000001234", "7", "7 ", "true", "_default"}
    assert store.manifest() == done.manifest
    assert check_segment(store.stored(spark, done.manifest.data)).count() == 0
    south.execute("UPDATE wells SET zone = 'a/b' WHERE code = 0")  # out of the empty zone
    south.execute("DEC wells.litres BY 2 WHERE code = 9")
    south.push()
    late = Replica(spark, "late", log, store, wall=clock)
    late.pull()
    assert late.version == 1
    for z, codes in (("''", []), ("'a/b'", ["0", "9"]), ("'back\\slash'", ["18"]), ("12345678.5", ["36"]), ("TRUE", ["72"]), ("NULL", ["81"])):
        assert sorted(r.code for r in late.query(f"SELECT code FROM wells WHERE zone = {z}").collect()) == codes
    assert late.table("wells").schema == north.table("wells").schema and well(late, 9)[1:4] == (1.25, True, 0.0)

    # sets and registers of sites that did not see each other
    north.execute("ADD 'ada' TO wells.crews WHERE code = 9")
    late.execute("ADD 'bo' TO wells.crews WHERE code = 9")
    late.execute("UPDATE wells SET state = 'open' WHERE code = 9")
    north.execute("UPDATE wells SET state = 'shut' WHERE code = 9")
    late.push()
    north.sync()
    assert north.execute("REMOVE 'bo' FROM wells.crews WHERE code = 9") == 2 and north.execute("REMOVE 'cy' FROM wells.crews WHERE code = 9") == 0
    north.execute("ALTER TABLE wells ADD COLUMN lined LWW<BOOLEAN>")
    north.push()
    for r in (south, late):
        r.pull()
    assert well(south, 9) == well(late, 9) == well(north, 9) == ("w1", 1.25, True, 0.0, ["ada"], {"open", "shut"})
    assert dict(late.query("SELECT lined FROM wells").dtypes) == {"lined": "boolean"}
    assert late.synced_heads() == {"north": 3, "south": 2, "late": 1} and late.pending_count() == 0
    assert compact(spark, log, store, north.schemas(), clock()).applied and not compact(spark, log, store, north.schemas(), clock()).applied

    # deletion hides a row, any write brings it back with what it had
    late.execute("DELETE FROM wells WHERE code = 9")
    assert well(late, 9) is None
    late.execute("INC wells.litres BY 4 WHERE code = 9")
    assert well(late, 9)[3] == 4.0
    with pytest.raises(SqlError):
        late.execute("DROP TABLE wells")

    # state survives a restart; a log that lost what was read is refused
    south.execute("INC wells.litres BY 1 WHERE code = 18")
    again = Replica(spark, "south", log, store, str(tmp_path / "south"), clock)
    assert again.pending_count() == 2 and well(again, 18) == well(south, 18)
    os.unlink(os.path.join(str(tmp_path / "log"), "site=north", "0000000003.json"))
    with pytest.raises(LogError):
        again.pull()


def test_compaction_refuses_conflicts_and_broken_operations(spark, tmp_path):
    op = {"tbl": "t", "key_id": "k", "key": scalar("k"), "hlc": {"wall_ms": 5, "counter": 1}, "kind": "cell_lww", "col": "a", "exists": None, "val": scalar("x"), "d": None, "n": None, "tags": None}
    for i, (ops, message) in enumerate([([op, op | {"val": scalar("y")}], "two payloads"), ([op | {"val": None}], "lacks")]):
        log, store = OpLog(str(tmp_path / f"log{i}")), SnapshotStore(str(tmp_path / f"snap{i}"))
        log.append("s", ops)
        with pytest.raises(SnapshotError, match=message):
            compact(spark, log, store, {}, 10)
        assert store.manifest().version == 0


def test_segments_out_of_order_are_found(spark, tmp_path):
    key = lambda k: scalar(k)
    blank = {"tbl": "t", "typ": 1, "val": scalar(1), "hlc": None, "site": "s", "inc": None, "dec": None, "elements": None, "tombstones": None, "values": None, "part": "p"}
    rows = lambda keys: [blank | {"key_id": str(k), "key": key(k), "col": "c"} for k in keys]
    for keys, bad in (([2, 9, 10, "1a", "a"], []), ([10, 9, "a", "b"], ["9"]), (["a", 3], ["3"]), ([4, 4], ["4"])):
        path = str(tmp_path / "-".join(map(str, keys)))
        spark.createDataFrame(rows(keys), M.CELLS + ", part string").coalesce(1).write.parquet(path)
        assert [r.key_id for r in check_segment(spark.read.parquet(path)).collect()] == bad
    assert Segment("a/b", "t", "p", 1, "9", "10", "0x0", (0, 0)).ordered() and not Segment("a/b", "t", "p", 1, "9", "10", "0x0").ordered()


def test_gaps_drift_and_manifests(spark, tmp_path):
    log = OpLog(str(tmp_path / "log"))
    clock = wall()
    a = Replica(spark, "a", log, wall=clock)
    a.execute("CREATE TABLE t (id PRIMARY KEY, n COUNTER)")
    a.push()
    for _ in range(3):
        a.execute("INC t.n BY 1 WHERE id = 1")
        a.push()
    path = os.path.join(str(tmp_path / "log"), "site=a", "0000000003.json")
    os.rename(path, path + ".away")
    b = Replica(spark, "b", log, wall=clock)
    assert b.pull() == 2 and b.query("SELECT * FROM t").first().n == 1.0 and log.head("a") == 4
    os.rename(path + ".away", path)
    assert b.pull() == 2 and b.query("SELECT * FROM t WHERE id = 1").first().n == 3.0
    slow = Replica(spark, "s", log, wall=lambda: 1_600_000_000_000)
    with pytest.raises(ClockError):
        slow.pull()
    store = SnapshotStore(str(tmp_path / "snap"))
    assert store.publish(Manifest(1), 0) and not store.publish(Manifest(1), 0)
    with pytest.raises(SnapshotError):
        store.publish(Manifest(5), 1)
    with pytest.raises(SnapshotError):
        check_manifest(Manifest(1, "nonsense"))
    assert safe_path("a/b") and not safe_path("../a") and not safe_path("/a") and not safe_path("a//b")
    # a manifest that leaves a known site out is not taken over
    c = Replica(spark, "c", log, store, wall=clock)
    c.pull()
    assert c.version == 0 and c.query("SELECT * FROM t").first().n == 3.0


def test_chaos_converges(spark, tmp_path):
    rng = random.Random(11)
    log, clock = OpLog(str(tmp_path / "log")), wall()
    replicas = [Replica(spark, s, log, wall=clock) for s in ("ebb", "flow", "slack")]
    replicas[0].execute(CREATE)
    replicas[0].push()
    for r in replicas:
        r.pull()
    total, tags = 0, set()
    for i in range(24):
        r = rng.choice(replicas)
        key = rng.choice(["w4", "w7"])
        x = rng.random()
        if x < 0.35:
            n = rng.randint(1, 5)
            r.execute(f"INC wells.litres BY {n} WHERE code = '{key}'")
            total += n
        elif x < 0.7:
            r.execute(f"ADD 'tag-{i}' TO wells.crews WHERE code = '{key}'")
            tags.add(f"tag-{i}")
        else:
            r.execute(f"UPDATE wells SET name = 'x{i}', state = '{rng.choice(['open', 'done'])}' WHERE code = '{key}'")
        if rng.random() < 0.3:
            r.sync()
    for _ in range(2):
        for r in replicas:
            r.sync()
    tables = [sorted((r.code, r.name, r.litres, sorted(r.crews or ()), sorted(r.state or ())) for r in x.table("wells").collect()) for x in replicas]
    assert tables[0] == tables[1] == tables[2]
    assert sum(r[2] or 0 for r in tables[0]) == total and {t for r in tables[0] for t in r[3]} == tags
    hashes = {tuple(M.state_hash(x.table("wells").withColumns({c: F.array_sort(c) for c in ("crews", "state")})).first()) for x in replicas}
    assert len(hashes) == 1


def test_streams_equal_batches(spark, tmp_path):
    log, clock = OpLog(str(tmp_path / "log")), wall()
    a, b = (Replica(spark, s, log, wall=clock) for s in "ab")
    a.execute(CREATE)
    a.sync()
    b.pull()
    cells, checkpoint = str(tmp_path / "cells"), str(tmp_path / "checkpoint")

    def run():
        q = ingest.apply_batches(ingest.stream(spark, log.root), cells, checkpoint)
        assert q.awaitTermination(120)

    for i in range(3):
        for r in (a, b):
            r.execute(f"INC wells.litres BY {i + 1} WHERE code = 'w4'")
            r.execute(f"ADD '{r.site}{i}' TO wells.crews WHERE code = 'w4'")
            r.execute(f"UPDATE wells SET name = '{r.site}{i}', state = 'open' WHERE code = 'w4'")
            r.push()
        run()
    a.pull()
    flat = lambda df: sorted((r.tbl, r.key_id, r.col, str(r.val), str(r.inc), sorted(map(str, r.elements or ())), sorted(map(str, r["values"] or ()))) for r in df.collect())
    assert flat(ingest.current_cells(spark, cells)) == flat(a.cells())

    entries = str(tmp_path / "entries")
    os.makedirs(entries)
    seen = (spark.readStream.schema("site string, seq long, body string").json(entries)).transform(ingest.contiguous)
    q = seen.writeStream.format("memory").queryName("released").option("checkpointLocation", str(tmp_path / "c2")).outputMode("append").start()
    try:
        for n, rows in enumerate([[("a", 1), ("a", 3), ("b", 2)], [("a", 2), ("a", 2), ("b", 1)]]):
            with open(f"{entries}/.{n}", "w") as f:
                f.writelines(f'{{"site": "{s}", "seq": {i}, "body": "{s}{i}"}}\n' for s, i in rows)
            os.rename(f"{entries}/.{n}", f"{entries}/{n}.json")
            q.processAllAvailable()
            got = sorted((r.site, r.seq) for r in spark.table("released").collect())
            assert got == ([("a", 1)] if n == 0 else [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 2)])
    finally:
        q.stop()
