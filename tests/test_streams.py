"""Messages as a stream and audit rows appended once."""

from __future__ import annotations

from pyspark.sql import functions as F

from tests.scenes import frame, said, user
from threadloom.functions import tokens
from threadloom.sources import logs
from threadloom.streaming.sessions import append_audit


def test_messages_arrive_and_audit_rows_are_appended_once(spark, tmp_path):
    source, sink, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "cp"))
    for n, scene in enumerate(({"s": [user("hi"), said("yes")]}, {"t": [user("x" * 40)]}, {})):
        if scene:
            frame(spark, scene).coalesce(1).write.mode("append").json(source)
        metered = logs.message_stream(spark, source).select("session_id", "message_index", tokens.message_tokens().alias("n"))
        assert append_audit(metered.withColumn("action", F.lit("metric")), sink, checkpoint).awaitTermination(120)
        assert spark.read.json(sink).count() == (2, 3, 3)[n]
    rows = spark.read.json(sink).collect()
    assert {(r.session_id, r.message_index, r.n) for r in rows} == {("s", 0, 17), ("s", 1, 25), ("t", 0, 26)}
