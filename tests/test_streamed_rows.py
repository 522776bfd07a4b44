"""What the stream of steps makes of rows before its state sees them."""

from __future__ import annotations

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.scenes import frame
from tests.test_steps import CONFIG, Handle, scene, taken
from threadloom.functions import tokens as tk
from threadloom.operators import items, steps
from threadloom.schema import as_messages
from threadloom.sources import tables
from threadloom.streaming import steps as streamed

CASES = ((False, True), (True, True), (False, False), (True, False))


def test_a_result_in_each_case_counts_as_it_is_classified(spark):
    """Against the rules and the meter of the batch, case by case; what is the same in two cases is given once."""
    messages = as_messages(frame(spark, {f"s{k}": scene(k) for k in range(6)}))
    rows = items.with_facts(items.superseded(items.with_calls(messages))).withColumns({"pin_files": F.array(F.when(F.col("session_id") > "s2", "a.py")), "pin_held": F.col("session_id") == "s5"}).cache()
    got = {(r.session_id, r.message_index): r for r in streamed._with_values(rows, CONFIG).select("session_id", "message_index", "role", "values", "cases").collect()}
    assert len(got) == rows.count() and any(c is None for r in got.values() for c in r.cases or ()) and any(c for r in got.values() for c in r.cases or ())
    for k, (sup, new) in enumerate(CASES):
        each = items.judged(rows.withColumns({"superseded_by": F.when(F.lit(sup), F.col("message_index")), "is_recent": F.lit(new), "is_latest_user": F.lit(False)}), CONFIG["limits"]["oversizedTokens"])
        pinned = ~F.col("engine_stub") & (F.coalesce(F.arrays_overlap("related_files", "pin_files"), F.lit(False)) | F.col("pin_held"))
        each = steps.counted(each.withColumn("pinned", pinned).withColumn("class", F.when(F.col("pinned"), "critical").otherwise(F.col("class"))), CONFIG)
        for r in each.select("session_id", "message_index", F.array(*(F.col(c).cast("long") for c in steps.sum_names(CONFIG))).alias("sums")).collect():
            mine = got[r.session_id, r.message_index]
            if mine.role in ("toolResult", "bashExecution"):
                assert ((mine.cases[k - 1] if k else None) or mine["values"]) == r.sums
            elif not k:
                assert mine["values"] == r.sums and mine.cases is None


def test_rows_of_a_session_are_joined_and_come_apart():
    rows = [("b", 9, '"x"', None), ("a", 3, None, '{"t":"é\\n"}'), ("b", 1, '[["c","read","{}"]]', None), ("a", 5, None, None)]
    texts = [streamed.TEXT.join([str(place), link or "", message or ""]) for _, place, link, message in rows]
    batch = pa.RecordBatch.from_pydict({"session_id": [r[0] for r in rows], "rows": texts})
    joined = [r for b in streamed._joined(iter([batch, batch.slice(0, 0)])) for r in b.to_pylist()]
    assert sorted(r["session_id"] for r in joined) == ["a", "b"]
    assert sorted((x for r in joined for x in streamed._parted((r["session_id"], r["rows"]))), key=str) == sorted(rows, key=str)


def test_joined_rows_are_taken_like_rows_of_their_own():
    """Also when a message's other cases stand beside it; a row that only tells its calls gives nothing."""
    place = lambda at, part=streamed.COMES: at * streamed.PARTS + part
    calls = [("s", place(1), json.dumps([["c1", "read", "{}"]]), None), ("s", place(2), json.dumps("c1"), '{"known_tokens":7}')]
    together = [("s", streamed.ROW.join(streamed.TEXT.join([str(r[1]), r[2] or "", r[3] or ""]) for r in reversed(calls)))]
    (out,) = taken(streamed._Calls(None), Handle(), together)
    assert out == taken(streamed._Calls(None), Handle(), calls)[0]
    assert [(r["place"], r["call_name"], r["message"]) for r in json.loads(out.rows)] == [(place(2), "read", {"known_tokens": 7})]
    n = len(steps.sum_names(CONFIG))
    values = {at: [[at + k] * n if k != 2 else [at] * n for k in range(4)] for at in range(1, 30)}
    comes = lambda at, **more: json.dumps({"values": values[at][0], "toolish": True, "is_read": False, "group_key": f"g{at % 3}"} | more)
    alone = [("s", place(at) + k, json.dumps(values[at][k]) if k else comes(at)) for at in values for k in range(4)]
    beside = [("s", streamed.ROW.join(f"{place(at)}{streamed.TEXT}{comes(at, cases=[x if x != values[at][0] else None for x in values[at][1:]])}" for at in values))]
    held = []
    for rows in (alone, beside):
        handle = Handle()
        assert taken(streamed._Steps(CONFIG, None), handle, rows) == []
        held.append(json.loads(handle.states["policy"][1]))
    assert held[0] == held[1] and any(held[0]["sums"])


@pytest.mark.parametrize("text", ["", "abc", "a" * 13, "名前 and more", "é" * 5, None])
def test_tokens_of_plain_and_wide_texts(spark, text):
    wide = sum(c in "名前" for c in text or "")
    (row,) = spark.createDataFrame([(text,)], "t string").select(tk.text_tokens(F.col("t")).alias("n")).collect()
    assert row.n == (3 * (len(text or "") - wide) + 8 * wide + 11) // 12


def test_a_started_stream_leaves_the_session_as_it_was(spark):
    class Writer:
        def start(self):
            return spark.conf.get(streamed.METHODS)

    before = spark.conf.get(streamed.METHODS)
    assert streamed.started(Writer(), spark) == "8000" and spark.conf.get(streamed.METHODS) == before


def test_a_folder_moves_whole(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/all/arrives=0")
    tables.moved(spark, f"{tmp_path}/all/arrives=0", f"{tmp_path}/in/0")
    tables.moved(spark, f"{tmp_path}/all/arrives=1", f"{tmp_path}/in/1")
    assert spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in").count() == 5
    assert not (tmp_path / "all/arrives=0").exists() and not (tmp_path / "in/1").exists()
