"""First later overlapping reads against the plain rule."""

from __future__ import annotations

import json
import random
import time

from pyspark.sql import functions as F

from tests.scenes import call, frame, result
from threadloom.operators import items


def reads(ranges, path="a.py"):
    out = []
    for i, r in enumerate(ranges):
        out += [call("read", {"path": path, **r}, f"c{i}"), result("read", "x", f"c{i}")]
    return out


def plain(ranges):
    def span(r):
        if not r:
            return None
        first = r.get("offset", 1)
        return first, first + max(0, r["limit"] - 1) if "limit" in r else r.get("end_line", float("inf"))

    spans = [span(r) for r in ranges]
    out = []
    for i, a in enumerate(spans):
        later = (j for j in range(i + 1, len(spans)) if a is None or spans[j] is None or max(a[0], spans[j][0]) <= min(a[1], spans[j][1]))
        out.append(next((2 * j + 1 for j in later), None))
    return out


def superseded_by(spark, sessions):
    rows = items.superseded(items.with_calls(frame(spark, sessions))).where("role = 'toolResult'").select("session_id", "message_index", "superseded_by", "superseded_at")
    out = {}
    for r in rows.collect():
        assert r.superseded_by == r.superseded_at
        out.setdefault(r.session_id, {})[r.message_index] = r.superseded_by
    return {s: [by[i] for i in sorted(by)] for s, by in out.items()}


def test_random_ranges(spark):
    dice = random.Random(3)
    kinds = [lambda: {}, lambda: {"offset": dice.randint(0, 60), "limit": dice.randint(0, 25)}, lambda: {"offset": dice.randint(0, 60)}, lambda: {"end_line": dice.randint(0, 30)}, lambda: {"offset": dice.randint(0, 60) + 0.5, "end_line": dice.randint(0, 60)}, lambda: {"limit": 5}]
    ranges = {f"s{k}": [dice.choices(kinds, [1, 12, 2, 1, 2, 1])[0]() for _ in range(dice.randint(0, 60))] for k in range(25)}
    got = superseded_by(spark, {s: reads(r) for s, r in ranges.items() if r})
    assert got == {s: plain(r) for s, r in ranges.items() if r}


def test_many_parts_of_one_file(spark):
    """100,000 partial reads of one file in one session, none over the whole."""
    n = 100_000
    pair = F.array(
        F.struct((2 * F.col("id")).cast("int").alias("message_index"), F.lit("assistant").alias("role"), F.lit("call").alias("kind")),
        F.struct((2 * F.col("id") + 1).cast("int").alias("message_index"), F.lit("toolResult").alias("role"), F.lit("result").alias("kind")),
    )
    block = "named_struct('type', 'toolCall', 'text', null, 'thinking', null, 'id', cast(id as string), 'name', 'read', 'arguments_json', concat('{\"path\":\"a\",\"offset\":', id * 7919 % 1000003, ',\"limit\":12}'))"
    rows = spark.range(n).select("id", F.inline(pair)).select(
        F.lit("s").alias("session_id"), "message_index", "role", F.when(F.col("role") == "assistant", F.expr(f"array({block})")).alias("blocks"), F.when(F.col("role") == "toolResult", F.col("id").cast("string")).alias("tool_call_id"), F.lit("read").alias("tool_name")
    )
    from threadloom.schema import as_messages

    began = time.perf_counter()
    got = {r.message_index // 2: r.superseded_by for r in items.superseded(items.with_calls(as_messages(rows))).where("role = 'toolResult'").select("message_index", "superseded_by").collect()}
    assert time.perf_counter() - began < 240
    assert len(got) == n
    starts = [i * 7919 % 1000003 for i in range(n)]
    dice = random.Random(1)
    for i in dice.sample(range(n), 60):
        want = next((2 * j + 1 for j in range(i + 1, n) if abs(starts[i] - starts[j]) < 12), None)
        assert got[i] == want
    assert json.dumps(got[n - 1]) == "null"
