"""``context_steps`` over a stream of messages, and the state it keeps.

Two stateful operators stand one behind the other. The first remembers a
session's calls and gives results the call they answer; nothing else passes
through it, and of a result's text only what may still be looked at once the call is known. The second holds the
sums of ``steps.counted``: a message's values
for each case (superseded or not, recent or not) are computed before it as columns of one row,
and the state only turns a message from one case to another when a later one
supersedes it or pushes it out of the recent ones. It keeps values of those messages
alone that may still turn. A model call is a row of role CALL, a session's end one of role END.

What crosses between Spark and Python costs by the cell, and what comes back by
the column of each session: rows are a place and JSON texts, those of a session that stand
together are joined into one before they are shuffled, and what a
session gives in a micro-batch comes out as JSON arrays. Each state access is a message to
the state store, so a session and micro-batch make few.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Callable, Iterator
from itertools import chain, groupby
from operator import itemgetter
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from threadloom.functions import keys
from threadloom.functions import text as tx
from threadloom.functions import tokens as tk
from threadloom.functions.rows import held
from threadloom.operators import items, pins as pin, prune
from threadloom.operators.analysis import CLASSES, SYSTEM_RESERVE
from threadloom.operators.steps import AT, CALLS, STEPS, bands, planned, sum_names
from threadloom.plans.config import DEFAULTS, thresholds_for
from threadloom.plans.policy import state_text, step, stored_state
from threadloom.schema import MESSAGES, as_messages

CALL, END = "modelCall", "sessionEnd"
#: Entries of a page of state, about.
PAGE = 64
#: What a row is at its message index: a model call, a message as it comes (not superseded, recent), its other cases, a session's end. A row's place is its index times PARTS and this.
CALLED, COMES, SUPERSEDED, OLD, BOTH, ENDS, PARTS = 0, 1, 2, 3, 4, 5, 8
#: Between rows that are joined into one, and between a row's place and texts: no JSON text holds these characters as they are.
ROW, TEXT = "\x1e", "\x1f"
#: Characters of rows that go out as one, about.
CHUNK = 1 << 20
#: What of a message the second operator's columns are made from; what of a result goes through the first.
CARRIED = ("role", "tool_name", "is_error", "details_json", "command", "output", "exit_code", "cancelled", "custom_type", "content_text", "known_tokens", "pin_held")
ANSWERED = ("tool_name", "is_error", "details_json", "content_text", "known_tokens", "pin_held")
#: What a model call says of itself.
FACTS = tuple(f.split(" ")[0] for f in CALLS.split(", ")[3:])
METHODS = "spark.sql.codegen.hugeMethodLimit"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: What both operators take, joined, and give, as JSON arrays.
PACKED = "session_id string, rows string"


def call_rows(calls: DataFrame) -> DataFrame:
    """CALLS as rows of MESSAGES: what a stream of messages has between them."""
    facts = F.to_json(F.struct(*(f.split(" ")[0] for f in CALLS.split(", ") if not f.startswith(("session_id", "message_index")))))
    return as_messages(calls.select("session_id", "message_index", F.lit(CALL).alias("role"), F.col("now_ms").alias("ts_ms"), facts.alias("details_json")))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(session_id, rows): one row for each session of a batch."""
    for batch in batches:
        order = pc.sort_indices(batch.column(0))
        runs = pc.run_end_encode(batch.column(0).take(order))
        offsets = pa.concat_arrays([pa.array([0], pa.int32()), runs.run_ends.cast(pa.int32())])
        rows = pc.binary_join(pa.ListArray.from_arrays(offsets, batch.column(1).take(order)), ROW)
        yield pa.RecordBatch.from_arrays([runs.values, rows], ["session_id", "rows"])


def _together(rows: DataFrame) -> DataFrame:
    """(session_id, place, a text or more) as PACKED, for ``_parted``."""
    texts = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns[1:])
    return rows.select("session_id", F.concat_ws(TEXT, *texts).alias("rows")).mapInArrow(_joined, PACKED)


def _parted(row: tuple) -> Iterator[tuple]:
    """The rows that were joined into one; a row that was not, as it is."""
    if len(row) > 2:
        yield tuple(row)
        return
    for part in row[1].split(ROW):
        place, *texts = part.split(TEXT)
        yield (row[0], int(place), *(x or None for x in texts))


class _Lasting(StatefulProcessor):
    """Clears a session's state when its end comes or, with ``idle_ms``, when nothing has come for so long."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", "at long") if self.idle_ms else None
        self.begin(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        whole = sorted(chain.from_iterable(map(_parted, rows)), key=itemgetter(1))
        out, size = [], 0
        for text in self.take(key[0], whole):
            out.append(text)
            size += len(text)
            if size >= CHUNK:
                yield Row(session_id=key[0], rows=f"[{','.join(out)}]")
                out, size = [], 0
        if out:
            yield Row(session_id=key[0], rows=f"[{','.join(out)}]")
        if any(row[1] % PARTS == ENDS for row in whole):
            self.end()
        elif self.idle_ms:
            if self.timer.exists():
                self.handle.deleteTimer(self.timer.get()[0])
            at = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.end()
        return iter(())

    def end(self) -> None:
        if self.timer is not None and self.timer.exists():
            self.timer.clear()
        self.clear()

    def close(self) -> None:
        pass


def page_of(key: str, pages: int) -> int:
    """The page of a key among ``pages``; one page more moves keys of one page only, ``pages - top // 2`` in the terms here, to the new one."""
    top = 1 << (pages - 1).bit_length()
    at = zlib.crc32(key.encode()) % top
    return at if at < pages else at % (top // 2)


class _Pages:
    """A session's map state (page int -> entries as JSON) for one batch: a page is read when an entry of it is asked for and written once at the end, as each access is a message between Python and the state store."""

    def __init__(self, state, page: Callable[[str], int], first: dict | None = None):
        self.state, self.page, self.held, self.changed = state, page, {}, set()
        self.own = () if first is None else (0,)  # pages that the caller keeps
        if first is not None:
            self.held[0] = first

    def at(self, page: int) -> dict:
        if page not in self.held:
            found = self.state.getValue((page,))
            self.held[page] = json.loads(found[0]) if found else {}
        return self.held[page]

    def get(self, key: str):
        return self.at(self.page(key)).get(key)

    def put(self, key: str, value) -> bool:
        """Whether the key is a new one."""
        page = self.page(key)
        entries = self.at(page)
        new = key not in entries
        entries[key] = value
        self.changed.add(page)
        return new

    def write(self) -> None:
        for page in sorted(self.changed.difference(self.own)):
            self.state.updateValue((page,), (json.dumps(self.held[page]),))


class _Spread(_Pages):
    """Pages by a hash of the key, one more for each PAGE keys; ``extent`` is [pages, keys]. ``first``, if given, is the first page, which its caller keeps beside the extent: most sessions have no other."""

    def __init__(self, state, extent: list[int], first: dict | None = None):
        super().__init__(state, lambda key: page_of(key, extent[0]), first)
        self.extent = extent

    def put(self, key: str, value) -> bool:
        new = super().put(key, value)
        self.extent[1] += new
        while self.extent[1] > PAGE * self.extent[0]:
            pages = self.extent[0]
            old = pages - (1 << (pages.bit_length() - 1))
            entries = self.at(old)
            self.extent[0] += 1
            self.held[pages] = {k: v for k, v in entries.items() if self.page(k) == pages}
            self.held[old] = {k: v for k, v in entries.items() if self.page(k) == old}
            self.changed |= {old, pages}
        return new


def _unpacked(packed: DataFrame, fields: str) -> DataFrame:
    """The rows of PACKED, of which ``fields`` is the type."""
    options = {"mode": "FAILFAST", "maxStringLen": str(2**31 - 1)}
    return packed.select("session_id", F.inline(F.from_json("rows", f"array<struct<{fields}>>", options)))


def _place(part: Column | int) -> Column:
    return F.col("message_index").cast("long") * PARTS + part


class _Calls(_Lasting):
    """Gives a result the call that came before it under its id; of calls that share one, the last. A row without a message only tells its calls."""

    def begin(self, handle) -> None:
        self.extent = handle.getValueState("extent", "pages int, keys int, entries string")
        self.calls = handle.getMapState("calls", "page int", "entries string")

    def clear(self) -> None:
        self.extent.clear()
        self.calls.clear()

    def take(self, session, rows) -> Iterator[str]:
        pages, known, first = self.extent.get() or (1, 0, "{}")
        calls = _Spread(self.calls, [pages, known], json.loads(first))
        for _, place, link, message in rows:
            link = json.loads(link) if link else None
            call = calls.get(link) if isinstance(link, str) else None
            for call_id, name, text in link if isinstance(link, list) else ():
                calls.put(call_id, (name, text))
            if message is None:
                continue
            answers = f',"call_name":{json.dumps(call[0])},"call_arguments":{json.dumps(call[1])}' if call else ""
            yield f'{{"place":{place}{answers},"message":{message}}}'
        if calls.changed:
            calls.write()
            self.extent.update((*calls.extent, json.dumps(calls.held[0])))


def _overlap(a, b) -> bool:
    return a[0] or b[0] or max(a[1], b[1]) <= min(a[2], b[2])


def _change(a: list[int], b: list[int]) -> list[int] | None:
    """From values ``a`` to ``b``; None if they are equal."""
    return None if a == b else [y - x for x, y in zip(a, b)]


class _Steps(_Lasting):
    """Sums, policy and pins of a session. A message's other cases are given beside it, null where they are as it comes, or as rows of their own. ``recent`` holds the recent results' changes of their values, ``groups``, in pages, what a later message of a key supersedes and its change when it is no longer recent."""

    def __init__(self, config: dict, idle_ms: int | None):
        super().__init__(idle_ms)
        self.config, self.names = config, sum_names(config)
        self.recent, self.levels = config["limits"]["recentWindow"], sorted((b["pressureGte"] for b in config["prune"]["bands"]), reverse=True)
        self.bands = len(bands(config))
        self.limits = {}

    def begin(self, handle) -> None:
        self.policy = handle.getValueState("policy", "state string, sums string")
        self.groups = handle.getMapState("groups", "page int", "entries string")

    def clear(self) -> None:
        self.policy.clear()
        self.groups.clear()

    def take(self, session, rows) -> Iterator[str]:
        text, sums = self.policy.get() or (None, None)
        state = stored_state(text)
        held = json.loads(sums) if sums else {"sums": [0] * len(self.names), "recent": [], "ratios": [], "corpus": "", "groups": [1, 0], "first": {}}
        groups = _Spread(self.groups, held["groups"], held["first"])
        for at, part in groupby(rows, lambda r: r[1] // PARTS):
            cases = {place % PARTS: data for _, place, data in part}
            if CALLED in cases:  # a call may share its index with the message that follows it
                asked = json.loads(cases[CALLED])
                turn = self.turn(held, session, at, asked["facts"], asked["needles"])
                if turn["model"] not in self.limits:
                    self.limits[turn["model"]] = thresholds_for(self.config, turn["model"])
                state, plan = step(state, turn, self.config, self.limits[turn["model"]])
                row = planned(turn, plan)
                del row["session_id"]
                yield json.dumps(row)
            if COMES in cases:
                self.arrive(held, groups, at, cases)
        groups.write()
        held["first"] = groups.held[0]
        self.policy.update((state_text(state), json.dumps(held)))

    def add(self, held: dict, change: list[int] | None) -> None:
        if change:
            held["sums"] = [a + b for a, b in zip(held["sums"], change)]

    def supersede(self, held: dict, at: int, when_old: list[int] | None) -> None:
        """A message of a group is superseded; ``when_old`` is the change if it is not recent."""
        for item in held["recent"]:
            if item["at"] == at:
                self.add(held, item["superseded"])
                item["old"] = item["superseded_old"]
                return
        self.add(held, when_old)

    def arrive(self, held: dict[str, Any], groups: _Spread, at: int, cases: dict[int, str]) -> None:
        first = json.loads(cases[COMES])
        corpus, comes = first.get("corpus"), first["values"]
        if corpus:
            held["corpus"] = held["corpus"] + "\n" + corpus if held["corpus"] else corpus
        self.add(held, comes)
        if not first.get("toolish"):
            return
        beside = first.get("cases")
        superseded, old, both = (x or comes for x in beside) if beside else (json.loads(cases[c]) for c in (SUPERSEDED, OLD, BOTH))
        group, when_old = first.get("group_key"), _change(old, both)
        if group:
            known = groups.get(group) or []
            if first["is_read"]:
                mine = [first["full"], float(first["first"]), float(first["last"])]
                gone = [x for x in known if _overlap(x[2:], mine)]
                known = [x for x in known if not _overlap(x[2:], mine)] + [[at, when_old, *mine]]
            else:
                gone, known = known, [[at, when_old]]
            for x in gone:
                self.supersede(held, x[0], x[1])
            groups.put(group, known)
        held["recent"].append({"at": at, "old": _change(comes, old), "superseded": _change(comes, superseded), "superseded_old": _change(superseded, both)})
        if len(held["recent"]) > self.recent:
            self.add(held, held["recent"].pop(0)["old"])

    def turn(self, held: dict, session: str, at: int, facts: dict, needles: list[str]) -> dict:
        """What ``observed`` gives for a call, from the sums."""
        s = dict(zip(self.names, held["sums"]))
        raw, reported = s["raw_tokens"], facts.get("tokens")
        if reported and reported > 0 and raw > 0:
            held["ratios"] = [*held["ratios"], reported / raw][-20:]
        ratio = sum(held["ratios"]) / len(held["ratios"]) if held["ratios"] else 1.0
        total = lambda tokens: max(1, math.floor(tokens * ratio + 0.5) + SYSTEM_RESERVE)
        window, most = facts.get("context_window") or 200_000, facts.get("max_tokens") or 0
        usable = max(1024, window - (min(8192, most) if most > 0 else 8192) - 4096)
        pressure = lambda tokens: max(0.0, min(2.0, tokens / usable))
        tokens = reported if reported and reported > 0 else total(raw)
        p = pressure(tokens)
        classed = sum(s[f"{c}_tokens"] for c in CLASSES)
        band = next((k for k, level in enumerate(self.levels) if p >= level), self.bands - 1)
        lost = sum(1 for needle in needles if needle == "" or needle not in held["corpus"])
        return {"session_id": session, "message_index": at} | {f: facts.get(f) for f in FACTS} | {
            "turn": facts["turn"], "pressure": p, "quality": max(0.0, min(1.0, (s["critical_tokens"] + s["working_tokens"]) / classed)) if classed else 1.0,
            "raw_tokens": raw, "total_tokens": tokens, "usable_tokens": usable, "reclaimable_tokens": s["reclaimable_tokens"], "message_count": s["message_count"],
            "prune_actions": s[f"acts_{band}"], "pressure_after_prune": pressure(total(raw - s[f"saved_{band}"])), "clean_actions": s["acts_0"], "pressure_after_clean": pressure(total(raw - s["saved_0"])), "pins_missing": lost,
        }


def step_stream(messages: DataFrame, pins: DataFrame | None = None, config: dict | None = None, idle_ms: int | None = None) -> DataFrame:
    """A stream of MESSAGES, with rows of role CALL (``call_rows``) where a model is called and END where a session ends -> a stream of STEPS.

    A session's rows come in order from micro-batch to micro-batch. ``pins``, a
    table, holds for the whole stream. State goes with the END row, and with ``idle_ms`` also
    so long (in processing time) after a session's last row; the query must then run with a
    trigger that goes on. The session's state store must be RocksDB (``prepare``).
    A result finds the calls before it only.
    """
    config = config or DEFAULTS
    prepare(messages.sparkSession)
    mode = "processingTime" if idle_ms else "none"
    role = F.col("role")
    made = F.to_json(F.transform(F.filter(F.when(role == "assistant", F.col("blocks")), lambda b: (b["type"] == "toolCall") & (F.coalesce(b["id"], F.lit("")) != "")), lambda b: F.array(b["id"], F.coalesce(b["name"], F.lit("")), F.coalesce(b["arguments_json"], F.lit("{}")))))
    answering = F.coalesce((role == "toolResult") & (F.col("tool_call_id") != ""), F.lit(False))
    answers = F.to_json(F.array("tool_call_id"))
    link = F.when(answering, F.substring(answers, F.lit(2), F.length(answers) - 2)).otherwise(F.nullif(made, F.lit("[]")))  # a list of calls, or the id that is answered
    known = _with_pinned_texts(messages.withColumns({"known_tokens": tk.message_tokens(), "content_text": tk.message_text()}), pins)
    own = F.when(F.get_json_object("details_json", "$.engine") == items.ENGINE_ID, F.to_json(F.struct(F.lit(items.ENGINE_ID).alias("engine"))))
    # the text is looked at for a test's outcome and for a fold's lines
    seen = F.when((F.coalesce("tool_name", F.lit("bash")) == "bash") | (F.col("known_tokens") >= config["limits"]["oversizedTokens"]), F.col("content_text"))
    of_result = F.to_json(F.struct(*(F.col(c) if c not in ("details_json", "content_text") else {"details_json": own, "content_text": seen}[c].alias(c) for c in ANSWERED)))
    part = F.when(role == CALL, CALLED).when(role == END, ENDS).otherwise(COMES)
    linked = known.select("session_id", _place(part).alias("place"), link.alias("link"), F.when(answering, of_result).alias("message")).where(F.col("link").isNotNull() | (F.col("place") % PARTS == ENDS))
    called = _together(linked).groupBy("session_id").transformWithState(_Calls(idle_ms), PACKED, "append", mode)
    types = dict(f.split(" ", 1) for f in MESSAGES.split(", ")) | {"known_tokens": "long", "pin_held": "boolean"}
    found = _unpacked(called, f"place:bigint,call_name:string,call_arguments:string,message:struct<{','.join(f'{c}:{types[c]}' for c in ANSWERED)}>")
    found = found.select("session_id", F.floor(F.col("place") / PARTS).cast("int").alias("message_index"), F.lit("toolResult").alias("role"), "call_name", "call_arguments", "message.*")
    rows = known.where(~answering).select("session_id", "message_index", *CARRIED).unionByName(found, allowMissingColumns=True)
    rows = rows.withColumns({c: F.lit(None).cast(types[c]) for c in types if c not in rows.columns})
    stepped = _together(_cases(rows, pins, config)).groupBy("session_id").transformWithState(_Steps(config, idle_ms), PACKED, "append", mode)
    fields = [f.split(" ") for f in STEPS.split(", ")]
    return _unpacked(stepped, ",".join(f"{c}:{t}" for c, t in fields if c != "session_id")).select(*(c for c, _ in fields))


def _cases(rows: DataFrame, pins: DataFrame | None, config: dict) -> DataFrame:
    """Each message with what it adds to the sums in each case it may come to and the rest that the state needs, each model call with what it says and its session's pins."""
    role, toolish = F.col("role"), F.col("role").isin("toolResult", "bashExecution")
    key = F.when((role == "toolResult") & F.col("call_name").isNotNull(), keys.group_key(F.col("call_name")))
    rows = keys.with_arguments(rows).withColumn("group_key", key)
    is_read = F.col("group_key").isNotNull() & (F.col("call_name") == "read")
    rows = rows.withColumn("range", F.when(is_read, keys.read_range())).withColumn("is_read", F.coalesce(is_read, F.lit(False)))
    rows = _with_values(_with_pins(items.with_facts(rows, F.col("known_tokens")), pins), config)
    engine, kind = F.get_json_object("details_json", "$.engine"), F.get_json_object("details_json", "$.kind")
    own = F.coalesce(engine == items.ENGINE_ID, F.lit(False))
    # what a session without pins has said is not looked at
    corpus = F.when(F.col("needles").isNotNull() & (~own | F.coalesce(kind == "pins", F.lit(False))) & (role.isin("user", "assistant") | ((role == "custom") & own)), F.lower("item_text"))
    span = (F.col("range")[c].cast("string").alias(c) for c in ("first", "last"))  # JSON has no infinite numbers
    comes = F.to_json(F.struct("values", "cases", toolish.alias("toolish"), "group_key", "is_read", F.col("range.full").alias("full"), *span, corpus.alias("corpus")))
    asked = F.concat(F.lit('{"facts":'), F.coalesce("details_json", F.lit("{}")), F.lit(',"needles":'), F.coalesce("needles", F.lit("[]")), F.lit("}"))
    part = F.when(role == CALL, CALLED).when(role == END, ENDS).otherwise(COMES)
    return rows.select("session_id", _place(part).alias("place"), F.when(role == CALL, asked).when(role != END, comes).alias("data"))


def _with_values(rows: DataFrame, config: dict) -> DataFrame:
    """Rows of ``with_facts`` with values and cases: what ``counted`` gives for a message as it comes, in the order of ``sum_names``, and for a result what it gives if it is superseded, old or both, null where that is the same.

    A rule that comes to the same in several cases is metered once.
    """
    toolish, limits, tokens = F.col("role").isin("toolResult", "bashExecution"), bands(config), F.col("estimated_tokens")
    oversized, least = config["limits"]["oversizedTokens"], config["limits"]["stubMinTokens"]
    rows = prune.fold_sizes(rows, toolish & (tokens >= oversized), limits)
    in_file = F.coalesce(F.arrays_overlap(F.array("file"), "pin_files"), F.lit(False))
    fields = ("class", "tags", "reason", "pinned", "kind")
    of = lambda c: lambda name: c[name] if name in fields else F.col(name)
    copied = lambda c, *names: (c[n].alias(n) for n in names)

    def verdict(rule):
        pinned = ~F.col("engine_stub") & ((rule["files"] & in_file) | F.col("pin_held"))
        return F.struct(F.when(pinned, "critical").otherwise(rule["class"]).alias("class"), rule["tags"].alias("tags"), rule["reason"].alias("reason"), pinned.alias("pinned"))

    def planned_(c):
        c = {"class": c["class"], "tags": items.tags_of(c), "reason": c["reason"], "pinned": c["pinned"]}
        return F.struct(*copied(c, *c), prune.plan(0, of(c | {"kind": None})).alias("kind"))

    def metered(c):
        stub = F.when(c["kind"] == "stub", held(prune.level(prune.stub_text(F.col("source"), tokens, c["reason"])), tk.text_tokens))
        beside = F.when(c["kind"] != "keep", held(F.when(F.col("role") != "bashExecution", prune.level(prune.details(AT, of(c)))), prune.beside))
        return F.struct(*copied(c, *fields), stub.alias("stub"), beside.alias("beside"))

    def sums(cls, reclaimable, gains):
        by_class = (F.when(cls == name, tokens).otherwise(0) for name in CLASSES)
        return F.array(*(x.cast("long") for x in (tokens, *by_class, reclaimable, F.lit(1), *gains)))

    none = [F.lit(0)] * (2 * len(limits))

    def added(c):
        gains = [x for at_least, chars in limits for x in prune.gain(at_least, F.coalesce(c["stub"], f"folds.fold_{chars}"), c["beside"], of(c))]
        reclaimable = tk.reclaimable(least, of(c))
        return F.when(c["kind"] == "keep", sums(c["class"], reclaimable, none)).otherwise(sums(c["class"], reclaimable, gains))

    # a rule is written out for each case, as Spark compiles no function of an array's elements
    message = ~F.col("role").isin(CALL, END)
    rules = {f"rule_{k}": F.when(toolish if k else message, items.rule_of(oversized, F.lit(sup), F.lit(new), F.lit(False))) for k, (sup, new) in enumerate(((False, True), (True, True), (False, False), (True, False)))}
    rows = rows.withColumns(rules)
    ruled = F.when(toolish, F.array(*(verdict(F.col(c)) for c in rules))).when(message, F.array(verdict(F.col("rule_0"))))
    rows = rows.withColumn("verdicts", ruled).drop(*rules).withColumn("unlike", F.array_distinct("verdicts"))
    found = F.when(toolish, F.transform(F.transform(F.transform("unlike", planned_), metered), added)).otherwise(F.array(sums(F.get("verdicts", F.lit(0))["class"], F.lit(0), none)))
    first, at = F.get("verdicts", F.lit(0)), lambda k: F.get("verdicts", F.lit(k))
    other = lambda k: F.when(at(k) != first, F.get("found", F.array_position("unlike", at(k)).cast("int") - 1))
    rows = rows.withColumn("found", found)
    return rows.withColumns({"values": F.get("found", F.lit(0)), "cases": F.when(toolish, F.array(*map(other, (1, 2, 3))))}).drop("folds", "verdicts", "unlike", "found")


def _texts_pinned(pins: DataFrame) -> DataFrame:
    """(session_id, pin_texts): what active pins look for in a session's messages."""
    asked = F.nullif(F.lower(F.substring(tx.trim(F.col("content")), 1, 120)), F.lit(""))
    rows = pins.where(F.col("active") & F.col("type").isin("constraint", "requirement", "note", "command")).select("session_id", asked.alias("asked"))
    return rows.where(F.col("asked").isNotNull()).groupBy("session_id").agg(F.collect_set("asked").alias("pin_texts"))


def _with_pinned_texts(rows: DataFrame, pins: DataFrame | None) -> DataFrame:
    """Rows with pin_held: whether a pinned text is in the message. Where no pin looks for a text, messages are not joined with pins while they have theirs."""
    texts = None if pins is None else _texts_pinned(pins)
    if texts is None or texts.isEmpty():
        return rows.withColumn("pin_held", F.lit(False))
    low = F.lower("content_text")
    hit = F.exists("pin_texts", lambda p: F.contains(low, p))
    return rows.join(texts, "session_id", "left").withColumn("pin_held", F.coalesce(hit, F.lit(False))).drop("pin_texts")


def _with_pins(rows: DataFrame, pins: DataFrame | None) -> DataFrame:
    """Rows with pin_files and needles (what of its pins a session's texts must hold) from the session's pins, which a stream meets as a table."""
    if pins is None:
        return rows.withColumns({"pin_files": F.lit(None).cast("array<string>"), "needles": F.lit(None).cast("string")})
    asked = F.when((pin.needle() != "") | (F.col("type") != "file"), pin.needle())
    each = pins.where("active").groupBy("session_id").agg(F.collect_set(F.when(F.col("type") == "file", keys.normalized_path(F.col("content")))).alias("pin_files"), F.to_json(F.collect_list(asked)).alias("needles"))
    return rows.join(each, "session_id", "left")


def started(writer: DataStreamWriter, spark: SparkSession) -> StreamingQuery:
    """Starts a stream over ``step_stream`` with generated methods that the JVM still compiles (up to 8,000 bytes): longer ones, which Spark makes of these columns, it interprets. The session's setting stays as it was."""
    before = spark.conf.get(METHODS)
    spark.conf.set(METHODS, "8000")
    try:
        return writer.start()  # a stream keeps the settings of its start
    finally:
        spark.conf.set(METHODS, before)


def prepare(spark: SparkSession) -> None:
    """Stateful operators with several states need RocksDB as their store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def stream_states(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(session_id, state) of the sessions that a stream of ``step_stream`` keeps, as ``context_steps`` and ``fold_turns`` take them: what batch and stream share."""
    rows = spark.read.format("statestore").option("operatorId", 0).option("stateVarName", "policy").load(checkpoint)
    return rows.select(F.col("key.session_id").alias("session_id"), F.col("value.state").alias("state"))
