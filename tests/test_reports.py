"""Reports whose figures stand on the edge of rounding, against their SQL."""

from __future__ import annotations

import duckdb
import pytest

from threadloom import catalog

#: Sessions of 5,888 tokens of 20,480: 28.75 %, whose double times 100 is below it.
EDGE = [(1, "click", 516.0, 6), (2, "view", 517.0, 2), (3, "purchase", 517.0, 2)]


@pytest.mark.parametrize("name", ["rp01_context_reports", "rp02_clean_reports"])
def test_reports_round_as_their_sql(spark, tmp_path, name):
    con = duckdb.connect()
    values = ", ".join(f"({i}::BIGINT, TIMESTAMP '2024-01-01', {i}::BIGINT, '{kind}', {value}::DOUBLE, '{{\"k\": {k}}}')" for i, kind, value, k in EDGE)
    con.execute(f"CREATE TABLE events AS SELECT * FROM (VALUES {values}) t(event_id, ts, user_id, event_type, value, props)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    wanted = con.execute(catalog.ORACLE_SQL[name]).fetchall()
    found = [tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).select("session_id", "report").collect()]
    assert sorted(found) == sorted(wanted)
    if name == "rp01_context_reports":
        assert all("(28.8%)" in report for _, report in found)
