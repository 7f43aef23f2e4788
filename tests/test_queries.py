"""Queries against their SQL on events that the smaller tables lack."""

from collections import Counter

import duckdb

from tidemark.plans.queries import ORACLES, QUERIES


def check(spark, folder, name, made):
    """``made`` selects the events from n, numbers on both sides of the clock's 65,536."""
    path = f"{folder}/events.parquet"
    con = duckdb.connect()
    con.execute(f"COPY (SELECT n::bigint AS event_id, TIMESTAMP '2024-01-01' + INTERVAL 7 MILLISECOND * n AS ts, {made}, '{{}}' AS props FROM (SELECT unnest(range(65300, 65800) || range(131000, 131200)) AS n)) TO '{path}' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}'")
    want = con.execute(ORACLES[name]).fetchall()
    assert len(want) > 10
    assert Counter(map(tuple, QUERIES[name](spark, str(folder)).collect())) == Counter(want)


def test_conflicts_by_event_number(spark, tmp_path):
    check(spark, tmp_path, "event_conflicts", "(n % 9)::bigint AS user_id, 'view' AS event_type, (n % 100)::double AS value")


def test_conflicts_whatever_the_value(spark, tmp_path):
    odd = "CASE n % 5 WHEN 0 THEN NULL WHEN 1 THEN 'nan'::double WHEN 2 THEN 'inf'::double WHEN 3 THEN 1e300 ELSE -1.0 END"
    check(spark, tmp_path, "event_conflicts", f"(n % 9)::bigint AS user_id, 'view' AS event_type, {odd} AS value")


def test_clashes_by_event_number(spark, tmp_path):
    check(spark, tmp_path, "type_clashes", "n::bigint % 350 AS user_id, CASE WHEN n % 3 = 0 THEN 'view' ELSE 'purchase' END AS event_type, (n % 100)::double AS value")
