"""The pass at each model call: running sums against classification of every prefix, and the stream against the batch."""

from __future__ import annotations

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from tests.scenes import big, frame, result, run, said, used, user
from threadloom.operators import analysis, items, pins, prune, steps
from threadloom.plans import policy
from threadloom.plans.config import DEFAULTS, merged
from threadloom.schema import MESSAGES, PINS, as_messages
from threadloom.streaming import steps as streamed

CONFIG = merged(DEFAULTS, {"policy": {"reclaimableMin": 200}, "thresholds": {"prune": {"enter": 0.3, "exit": 0.2}, "checkpoint": {"enter": 0.5, "exit": 0.4}, "compact": {"enter": 0.6, "exit": 0.5}}, "cooldowns": {"pruneMs": 1000, "compactMs": 60_000}})


def scene(seed):
    dice = random.Random(seed)
    out = [user("Start. Keep the API")]
    for i in range(dice.randint(3, 22)):
        kind = dice.randrange(8)
        text = big(dice.choice("xy"), dice.randint(1, 60))
        if kind < 3:
            out += used("read", {"path": dice.choice(["a.py", "b.py"]), **dice.choice([{}, {"offset": dice.randint(0, 40), "limit": 20}])}, text, f"c{i}")
        elif kind == 3:
            out += used("bash", {"command": dice.choice(["pytest tests/a", "npm install", "git diff"])}, dice.choice(["3 failed", "10 passed", text]), f"c{i}", dice.random() < 0.3)
        elif kind == 4:
            out.append(run(dice.choice(["ls -la", "make all"]), text, dice.choice([0, 1])))
        elif kind == 5:
            out += used("grep", {"pattern": dice.choice("pq"), "path": "src"}, text, f"c{i}")
        elif kind == 6:
            out += [user(dice.choice(["go on", "never drop the table", "use a.py"])), said("done")]
        else:
            out.append(result("other", text))
    return out


@pytest.fixture(scope="module")
def made(spark):
    scenes = {f"s{k}": scene(k) for k in range(8)}
    messages = as_messages(frame(spark, scenes)).withColumn("message_index", 2 * F.col("message_index"))
    rows = [(s, n, 2 * i + 1, 20_000 * n, (9000 + 700 * n if k % 3 == 1 and n % 4 == 0 else None), 24_000, None, "any/model", n % 9 == 8, n % 3 != 0, 20_000 * n if n == 5 else None) for k, (s, m) in enumerate(scenes.items()) for n, i in enumerate(range(1, len(m), 2), 1)]
    calls = spark.createDataFrame(rows, steps.CALLS)
    marks = [(s, f"p{i}", kind, text, i, None, None, i != 3) for s in ("s1", "s2", "s5") for i, (kind, text) in enumerate([("constraint", "never drop the TABLE"), ("file", "a.py"), ("note", "not said by anyone"), ("note", "off"), ("note", "on\ndone")])]
    return messages.cache(), calls.cache(), spark.createDataFrame(marks, PINS).cache()


def rounded(row):
    return {k: round(v, 9) if isinstance(v, float) else v for k, v in row.asDict().items()}


def test_running_sums_are_those_of_every_prefix(made):
    messages, calls, given = made
    got = {(r.session_id, r.turn): r for r in steps.observed(messages, calls, given, CONFIG).collect()}
    assert len(got) == calls.count()
    for turn in (1, 3, 6, 9):
        at = calls.where(F.col("turn") == turn).select("session_id", F.col("message_index").alias("call_at"), "tokens")
        prefix = messages.join(at, "session_id").where("message_index < call_at").select(messages.columns).cache()
        acted = prune.actions(items.classify(prefix, given), *steps.bands(CONFIG)[0])
        usage = at.select("session_id", "tokens", F.lit(24_000).cast("long").alias("context_window"), F.lit(None).cast("long").alias("max_tokens"), F.lit(1.0).alias("ratio"))
        for r in analysis.analyze(acted, usage).collect():
            mine = got[r.session_id, turn]
            assert [mine[c] for c in ("raw_tokens", "usable_tokens", "reclaimable_tokens", "message_count")] == [r[c] for c in ("raw_tokens", "usable_tokens", "reclaimable_tokens", "message_count")]
            assert mine.quality == pytest.approx(r.quality)
            if not any(x.tokens for x in calls.where(F.col("session_id") == r.session_id).collect()):
                assert mine.pressure == pytest.approx(r.pressure)
        after = {r.session_id: r for r in prune.recomputed(acted, steps.AT, usage=usage.withColumn("tokens", F.lit(None).cast("long"))).collect()}
        n = {r.session_id: r.n for r in acted.where("kind <> 'keep'").groupBy("session_id").agg(F.count("*").alias("n")).collect()}
        lost = {r.session_id: r["count"] for r in pins.missing_pins(prefix, given).groupBy("session_id").count().collect()}
        for s in after:
            assert got[s, turn].clean_actions == n.get(s, 0)
            assert got[s, turn].pins_missing == lost.get(s, 0)
            if not any(x.tokens for x in calls.where(F.col("session_id") == s).collect()):
                assert got[s, turn].pressure_after_clean == pytest.approx(after[s].pressure)


def test_steps_prune_and_reinject(made):
    messages, calls, given = made
    rows = steps.context_steps(messages, calls, given, CONFIG).collect()
    assert len(rows) == calls.count() and {r.fast for r in rows} == {True, False}
    assert any(r.reinject for r in rows) and not any(r.reinject for r in rows if r.fast or not r.pins_missing)
    assert all(r.fast for r in rows if not (r.prune or r.checkpoint or r.compact or r.handoff or r.action == "handoff" or r.turn in range(5, 60)))
    assert sum(r.prune for r in rows) > 3
    found = steps.pruned_at(messages, messages.sparkSession.createDataFrame(rows, steps.STEPS).join(calls.select("session_id", "turn", "message_index"), ["session_id", "turn"]), given, CONFIG)
    by = {(r.session_id, r.turn): r.n for r in found.groupBy("session_id", "turn").agg(F.count("*").alias("n")).collect()}
    assert by == {(r.session_id, r.turn): (r.clean_actions if r.manual else r.prune_actions) for r in rows if r.prune}


def arrived(spark, tmp_path, messages, calls, given, ends=(), batches=3):
    """What a stream in several micro-batches gives, and its checkpoint."""
    source, sink, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "out", "cp"))
    whole = messages.unionByName(streamed.call_rows(calls))
    top = whole.agg(F.max("message_index")).first()[0] + 2
    for k in range(batches):
        low, high = top * k // batches, top * (k + 1) // batches
        whole.where(F.col("message_index").between(low, high - 1)).coalesce(2).write.mode("append").parquet(source)
        if k + 1 == batches and ends:
            as_messages(spark.createDataFrame([(s, top, streamed.END) for s in ends], "session_id string, message_index int, role string")).write.mode("append").parquet(source)
        stream = spark.readStream.schema(MESSAGES).parquet(source)
        query = streamed.step_stream(stream, given, CONFIG).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        assert query.awaitTermination(300)
    return spark.read.parquet(sink), checkpoint


def test_the_stream_is_the_batch(spark, made, tmp_path):
    messages, calls, given = made
    got, checkpoint = arrived(spark, tmp_path, messages, calls, given, ends=["s1", "s4"])
    key = lambda df: {(r.session_id, r.turn): rounded(r) for r in df.collect()}
    want = key(steps.context_steps(messages, calls, given, CONFIG))
    assert key(got) == want
    # ended sessions have no state left, the others that of the batch
    states = {r.session_id: policy.stored_state(r.state) for r in streamed.stream_states(spark, checkpoint).collect()}
    assert set(states) == {f"s{k}" for k in range(8)} - {"s1", "s4"}
    turns = steps.observed(messages, calls, given, CONFIG).collect()
    for s in states:
        state = policy.initial_state()
        for turn in sorted((r.asDict() for r in turns if r.session_id == s), key=lambda r: r["turn"]):
            state, _ = policy.step(state, turn, CONFIG)
        assert states[s] == policy.stored_state(policy.state_text(state))
    later = calls.groupBy("session_id").agg(F.max("turn").alias("turn"), F.max("message_index").alias("message_index"), F.max("now_ms").alias("now_ms")).select("session_id", (F.col("turn") + 1).alias("turn"), (F.col("message_index") + 2).alias("message_index"), (F.col("now_ms") + 20_000).alias("now_ms"), *(F.lit(None).cast(t).alias(c) for c, t in (f.split(" ") for f in steps.CALLS.split(", ")[4:])))
    assert steps.context_steps(messages, later, given, CONFIG, streamed.stream_states(spark, checkpoint)).count() == 8


class Store:
    """A map state that counts what is asked of it."""

    def __init__(self):
        self.held, self.asked = {}, 0

    def getValue(self, key):
        self.asked += 1
        return self.held.get(key)

    def updateValue(self, key, value):
        self.asked += 1
        self.held[key] = value


def test_pages_keep_every_entry_and_stay_small():
    store, extent, plain, dice = Store(), [1, 0], {}, random.Random(5)
    for batch in range(60):
        pages = streamed._Spread(store, extent)
        for _ in range(dice.choice([1, 90, 400])):
            key = f"k{dice.randint(0, 9000)}é"
            assert pages.get(key) == plain.get(key)
            plain[key] = [batch, dice.random()]
            pages.put(key, plain[key])
        pages.write()
        assert extent[1] == len(plain)
    last = streamed._Spread(store, extent)
    assert all(last.get(k) == v for k, v in plain.items()) and last.get("none") is None
    sizes = [len(json.loads(v[0])) for v in store.held.values()]
    assert sum(sizes) == len(plain) and max(sizes) < 4 * streamed.PAGE and extent[0] >= len(plain) / streamed.PAGE


def test_a_batch_asks_the_store_by_pages():
    store, extent = Store(), [1, 0]
    pages = streamed._Spread(store, extent)
    for i in range(50):
        pages.put(f"c{i}", i)
        assert pages.get(f"c{i}") == i
    pages.write()
    assert store.asked == 2
    pages = streamed._Pages(Store(), lambda at: int(at) // streamed.PAGE)
    for i in range(640):
        pages.put(str(i), i)
    pages.write()
    assert pages.state.asked == 20


class Handle:
    """A session's states, and how often they were asked."""

    def __init__(self):
        self.states, self.values = {}, 0

    def getMapState(self, name, *schema):
        return self.states.setdefault(name, Store())

    def getValueState(self, name, *schema):
        return Value(self, name)

    def asked(self):
        return self.values + sum(s.asked for s in self.states.values() if isinstance(s, Store))


class Value:
    def __init__(self, handle, name):
        self.handle, self.name = handle, name

    def get(self):
        self.handle.values += 1
        return self.handle.states.get(self.name)

    def update(self, value):
        self.handle.values += 1
        self.handle.states[self.name] = value


def taken(processor, handle, rows):
    """What a micro-batch of one session gives, packed."""
    processor.init(handle)
    return list(processor.handleInputRows(("s",), iter(rows), None))


def test_a_batch_of_a_session_asks_its_state_twice_and_gives_one_row():
    handle, n, place = Handle(), 50, lambda i: i * streamed.PARTS + streamed.COMES
    rows = [("s", place(2 * i), json.dumps([[f"c{i}", "read", "{}"]]), "{}") for i in range(n)] + [("s", place(2 * i + 1), json.dumps(f"c{i}"), "{}") for i in range(n)]
    (out,) = taken(streamed._Calls(None), handle, rows)
    found = json.loads(out.rows)
    assert [r["place"] for r in found] == [place(i) for i in range(2 * n)] and [r.get("call_name") for r in found] == [None, "read"] * n
    assert handle.asked() == 2


@pytest.mark.parametrize("keys", [5, 300])
def test_sums_follow_every_case_with_few_values_kept(keys):
    """Against all messages' values by case; what is kept does not grow with the messages."""
    dice, handle, names = random.Random(keys), Handle(), steps.sum_names(CONFIG)
    all_values, sup, spans, order, recent = {}, {}, {}, [], CONFIG["limits"]["recentWindow"]
    for batch in range(20):
        rows, before = [], handle.asked()
        for at in range(batch * 30, batch * 30 + 30):
            values = [[dice.randint(0, 9) for _ in names] for _ in range(4)]
            if dice.random() < 0.3:
                values[3] = values[2]
            group = dice.choice([None, *(f"g{k}" for k in range(keys))])
            read, full, low = group is not None and int(group[1:]) % 2 == 0, dice.random() < 0.2, float(dice.randint(0, 50))
            span = (full, low, dice.choice([low + 10, float("inf")]))
            for old in order:
                if group and spans[old][0] == group and not sup[old] and (not read or streamed._overlap(spans[old][1], span)):
                    sup[old] = True
            all_values[at], sup[at], spans[at] = values, False, (group, span)
            order.append(at)
            comes = {"values": values[0], "toolish": True, "is_read": read} | ({"group_key": group} if group else {}) | ({"full": full, "first": str(span[1]), "last": "Infinity" if span[2] == float("inf") else str(span[2])} if read else {})
            rows += [("s", at * streamed.PARTS + streamed.COMES + k, json.dumps(values[k] if k else comes)) for k in (3, 1, 2, 0)]
        assert taken(streamed._Steps(CONFIG, None), handle, rows) == []
        new = set(order[-recent:])
        want = [sum(x) for x in zip(*(all_values[at][sup[at] + 2 * (at not in new)] for at in order))]
        held = json.loads(handle.states["policy"][1])
        assert held["sums"] == want and len(held["recent"]) == recent
        if keys == 5:
            assert handle.asked() - before == 2 and len(held["first"]) <= keys


def test_idle_sessions_are_released(spark, made, tmp_path):
    messages, calls, given = made
    source, checkpoint = f"{tmp_path}/in", f"{tmp_path}/cp"
    messages.unionByName(streamed.call_rows(calls)).where("session_id in ('s0', 's3')").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(MESSAGES).parquet(source)
    query = streamed.step_stream(stream, None, CONFIG, idle_ms=5_000).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", checkpoint).trigger(processingTime="1 second").start()
    try:
        until, left = time.time() + 120, None
        while time.time() < until and left != 0:
            time.sleep(3)
            done = query.lastProgress
            left = done["stateOperators"][0]["numRowsTotal"] if done and done["batchId"] > 0 and done["stateOperators"] else None
    finally:
        query.stop()
    assert streamed.stream_states(spark, checkpoint).count() == 0
    assert spark.read.parquet(f"{tmp_path}/out").count() == calls.where("session_id in ('s0', 's3')").count()
