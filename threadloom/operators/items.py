"""From messages to classified items: call lookup, supersession, recency, the rules, pins.

Everything within a session runs on one shuffle by ``session_id``, which the
lookup of calls makes: windows whose partitions add a key to it reuse it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import keys
from threadloom.functions import text as tx
from threadloom.functions import tokens as tk
from threadloom.functions.rows import shares
from threadloom.operators.needles import holding
from threadloom.schema import ENGINE_ID


def with_calls(messages: DataFrame, parts: int | None = None) -> DataFrame:
    """``messages`` with call_name and call_arguments of the call each result answers; of calls that share an id, the last.

    A message stands beside a small row for each call it makes; calls and
    answers of one id meet in a window, on the one shuffle by session, into
    ``parts`` partitions, by default as many as the messages' ``shares``.
    """
    parts = parts or shares(messages)
    own = F.when((F.col("role") == "toolResult") & (F.coalesce("tool_call_id", F.lit("")) != ""), F.col("tool_call_id"))
    made = F.filter(F.when(F.col("role") == "assistant", F.col("blocks")), lambda b: (b["type"] == "toolCall") & (F.coalesce(b["id"], F.lit("")) != ""))
    call = lambda b, i: F.struct(b["id"].alias("id"), F.coalesce(b["name"], F.lit("")).alias("name"), F.coalesce(b["arguments_json"], F.lit("{}")).alias("arguments"), i.alias("pos"))
    none = F.struct(own.alias("id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"), F.lit(None).cast("int").alias("pos"))
    rows = messages.withColumn("c", F.explode(F.concat(F.array(none), F.coalesce(F.transform(made, call), F.array().cast("array<struct<id:string,name:string,arguments:string,pos:int>>")))))
    is_call = F.col("c.pos").isNotNull()
    rows = rows.withColumns({c: F.when(~is_call, F.col(c)) for c in messages.columns if c not in ("session_id", "message_index")})
    last = F.max_by(F.when(is_call, F.struct("c.name", "c.arguments")), F.when(is_call, F.struct("message_index", "c.pos"))).over(Window.partitionBy("session_id", "c.id"))
    rows = rows.repartition(parts, "session_id").withColumn("call", F.when(F.col("c.id").isNotNull(), last)).where(~is_call)
    return rows.select(*messages.columns, F.col("call.name").alias("call_name"), F.col("call.arguments").alias("call_arguments"))


#: A node of a dyadic tree as one number: its level times this, and its place in the level.
_LEVEL = 1 << 40


def _first_overlaps(rows: DataFrame, part: Column) -> DataFrame:
    """Adds hit: the first later row of the session, group_key and stretch whose range overlaps, both among rows of ``part``.

    Of two ranges that overlap, the first line of one lies in the other. Lines
    are numbered by the first lines of the stretch; a range is cut into few
    dyadic nodes, a line lies in one node of each level, and a window over each
    node finds the next line for a range and the next range for a line. n ranges
    make O(n log n) rows, which only hold keys.
    """
    carried = [c for c in rows.columns if c not in ("session_id", "message_index", "group_key", "stretch", "range")]
    sound = part & (F.col("range.first") <= F.col("range.last"))
    ends = F.array(F.struct(F.lit(0).alias("end"), F.when(sound, F.col("range.first")).alias("line")), F.struct(F.lit(1).alias("end"), F.col("range.last").alias("line")))
    rows = rows.withColumn("e", F.explode(F.when(sound, ends).otherwise(F.slice(ends, 1, 1))))
    rows = rows.withColumns({c: F.when(F.col("e.end") == 0, F.col(c)) for c in carried})
    lines = Window.partitionBy("session_id", "group_key", "stretch").orderBy("e.line")
    first = F.when(F.col("e.end") == 0, F.col("e.line"))
    rows = rows.withColumns({
        "rank": F.count(first).over(lines.rangeBetween(Window.unboundedPreceding, Window.currentRow)),
        "ranks": F.count(first).over(lines.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    })
    top = F.max(F.when(F.col("e.end") == 1, F.col("rank"))).over(Window.partitionBy("session_id", "message_index"))
    rows = rows.withColumn("top", top).where("e.end = 0").withColumn("levels", F.floor(F.log2("ranks")).cast("int") + 1)
    line = f"transform(sequence(0, levels), l -> l * {_LEVEL}L + shiftright(rank, l))"
    low, high = "shiftright(rank + shiftleft(1L, l) - 1, l)", "shiftright(top + 1, l)"
    span = f"filter(flatten(transform(sequence(0, levels), l -> array(if({low} < {high} and {low} % 2 = 1, l * {_LEVEL}L + {low}, null), if({low} < {high} and {high} % 2 = 1, l * {_LEVEL}L + {high} - 1, null)))), x -> x is not null)"
    entries = lambda nodes, side, asks: f"transform({nodes}, x -> struct({side} as side, x as node, {asks} as asks))"
    none = F.array(F.struct(F.lit(None).cast("int").alias("side"), F.lit(None).cast("long").alias("node"), F.lit(None).cast("boolean").alias("asks")))
    several = F.col("e.line").isNotNull() & (F.col("ranks") > 1)
    made = F.expr(f"concat({entries(line, 0, 'false')}, {entries(span, 0, 'true')}, {entries(line, 1, 'true')}, {entries(span, 1, 'false')})")
    rows = rows.withColumn("n", F.explode(F.when(several, F.concat(none, made)).otherwise(none)))
    rows = rows.withColumns({c: F.when(F.col("n.node").isNull(), F.col(c)) for c in carried})
    later = Window.partitionBy("session_id", "group_key", "stretch", "n.side", "n.node").orderBy(F.desc("message_index"), F.desc("n.asks")).rowsBetween(Window.unboundedPreceding, -1)
    found = F.when(F.col("n.asks"), F.last(F.when(~F.col("n.asks"), F.col("message_index")), ignorenulls=True).over(later))
    hit = F.min("found").over(Window.partitionBy("session_id", "message_index"))
    return rows.withColumn("found", found).withColumn("hit", hit).where("n.node is null").drop("e", "rank", "ranks", "top", "levels", "n", "found")


def superseded(rows: DataFrame) -> DataFrame:
    """Adds group_key, superseded_by (for reads the first later read of the path whose lines overlap, for others the last member of the group) and superseded_at (the first message that supersedes).

    A read of a whole file overlaps every other, so a part's overlap is looked
    for up to the next of those only.
    """
    key = F.when((F.col("role") == "toolResult") & F.col("call_name").isNotNull(), keys.group_key(F.col("call_name")))
    rows = keys.with_arguments(rows).withColumn("group_key", key)
    is_read = F.col("group_key").isNotNull() & (F.col("call_name") == "read")
    rows = rows.withColumn("range", F.when(is_read, keys.read_range()))
    back = Window.partitionBy("session_id", "group_key").orderBy(F.desc("message_index"))
    rows = rows.withColumns({
        "last": F.first("message_index").over(back),
        "next": F.lag("message_index").over(back),
        "stretch": F.sum(F.when(F.col("range.full"), 1).otherwise(0)).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "whole": F.last(F.when(F.col("range.full"), F.col("message_index")), ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    })
    rows = _first_overlaps(rows, is_read & ~F.col("range.full"))
    grouped = F.col("group_key").isNotNull()
    by = F.when(is_read & F.col("range.full"), F.col("next")).when(is_read, F.least("hit", "whole")).when(grouped & (F.col("message_index") < F.col("last")), F.col("last"))
    at = F.when(is_read, F.col("superseded_by")).when(grouped, F.col("next"))
    return rows.withColumn("superseded_by", by).withColumn("superseded_at", at).drop("range", "last", "next", "stretch", "whole", "hit")


def recency(rows: DataFrame, recent: int = tk.RECENT) -> DataFrame:
    """Adds is_recent (among the last results and runs) and is_latest_user."""
    toolish = F.col("role").isin("toolResult", "bashExecution")
    newest = Window.partitionBy("session_id", F.when(toolish, 1).otherwise(0)).orderBy(F.desc("message_index"))
    session = Window.partitionBy("session_id")
    latest = F.max(F.when(F.col("role") == "user", F.col("message_index"))).over(session)
    return rows.withColumn("is_recent", toolish & (F.row_number().over(newest) <= recent)).withColumn("is_latest_user", F.coalesce(F.col("message_index") == latest, F.lit(False)))


_TAG = "\x01"


def _rule(cls: str | Column, score: int | Column, tags: list, reason: str | Column, files: bool = False, by: bool = False) -> Column:
    """What a rule gives; absent tags are left out as they are joined."""
    lit = lambda x: F.lit(x) if isinstance(x, (str, int)) else x
    return F.struct(lit(cls).alias("class"), lit(score).cast("int").alias("importance"), F.concat_ws(_TAG, *map(lit, tags)).alias("tags"), lit(reason).alias("reason"), F.lit(files).alias("files"), F.lit(by).alias("by"))


def _toolish_rules(oversized: int, sup: Column, new: Column) -> Column:
    """The rules of results and runs, the first that holds; reasons are part of the audit's output (fixed values)."""
    name, cat, outcome = F.col("source"), F.col("category"), F.col("outcome")
    big, err = F.col("estimated_tokens") >= oversized, F.col("err")
    ov = F.when(big, "oversized")
    pick = lambda cond, a, b: F.when(cond, F.lit(a)).otherwise(F.lit(b))
    bash, noisy = name == "bash", cat.isin("install", "fetch", "build")
    rules = [
        ((name == "read") & sup, _rule("stale", pick(big, 15, 25), [name, "superseded-read"], "an older read of a file that was read again later", True, True)),
        (name == "read", _rule("working", pick(big, 60, 70), [name, "file-read", ov], "file content (latest read of this file)", True)),
        (name == "ls", _rule("disposable", pick(sup, 5, 10), [name, pick(sup, "duplicate", "listing")], "directory listing", True, True)),
        (name.isin("grep", "find") & sup, _rule("stale", 15, [name, "duplicate-search"], "earlier run of the same search (kept: latest only)", True, True)),
        (name.isin("grep", "find"), _rule(pick(new, "working", "stale"), pick(new, 40, 25), [name, "search", ov], pick(new, "recent search result", "older search result"), True)),
        (bash & noisy & ~err, _rule("disposable", pick(sup, 5, 10), [name, cat, "noise"], F.concat(cat, F.lit(" command succeeded; output is noise")))),
        (bash & noisy, _rule("working", 90, [name, cat, "active-failure"], "failing build/install output")),
        (bash & (cat == "test") & sup, _rule("stale", pick(outcome == "fail", 25, 20), [name, "test", pick(outcome == "fail", "superseded-failure", "superseded-pass")], pick(outcome == "fail", "older failing test run superseded by a later run of the same suite", "earlier passing test run superseded by a later run"), by=True)),
        (bash & (cat == "test") & (outcome == "fail"), _rule("working", 90, [name, "test", "active-failure", ov], "active failing test run (latest)")),
        (bash & (cat == "test") & (outcome == "pass"), _rule(pick(new & ~big, "working", "disposable"), pick(new & ~big, 30, 15), [name, "test", "pass"], "passing test run")),
        (bash & (cat == "gitdiff") & sup, _rule("stale", 20, [name, "old-diff"], "superseded by a later git diff", by=True)),
        (bash & (cat == "gitdiff"), _rule("working", pick(big, 75, 85), [name, "active-diff", ov], "current git diff (working set)")),
        (bash & (cat == "trivial") & ~err, _rule("disposable", 10, [name, "trivial"], "trivial command output (ls/pwd/git status/...)")),
        (bash & (cat == "trivial"), _rule("working", 40, [name, "trivial", "active-failure"], "trivial command failed")),
        (bash & err & sup, _rule("stale", 25, [name, "superseded-error"], "error output from an earlier identical command", by=True)),
        (bash & err, _rule("working", 90, [name, "active-failure", ov], "active failing command")),
        (bash & sup, _rule("stale", 15, [name, "duplicate-command"], "earlier identical successful command (kept: latest only)", by=True)),
        (bash & new, _rule("working", pick(big, 55, 60), [name, ov], "recent successful command output")),
        (bash & ~big, _rule("working", 35, [name, "old-output"], "older successful command output (small — kept)")),
        (bash, _rule("stale", 20, [name, "old-output", "oversized"], "older oversized command output")),
        (name.isin("edit", "write", "create"), _rule(pick(new, "working", "stale"), pick(new, 85, 35), [name, "file-mutation", F.when(new, "active-diff")], pick(new, "recent file modification", "earlier file modification"), True)),
        (err, _rule("working", 90, [name, "active-failure"], "tool error (active)")),
    ]
    out = F.when(*rules[0])
    for condition, rule in rules[1:]:
        out = out.when(condition, rule)
    return out.otherwise(_rule(pick(new, "working", "stale"), pick(new, 40, 20), [name, ov], pick(new, "recent tool result", "older tool result")))


def with_facts(rows: DataFrame, estimator: Column | None = None) -> DataFrame:
    """Adds what a message and its call say alone: estimated_tokens, item_text, source, command_text, category, outcome, err, file, engine_stub and type."""
    role, toolish = F.col("role"), F.col("role").isin("toolResult", "bashExecution")
    is_run = role == "bashExecution"
    source = F.when(is_run, "bash").when(toolish, F.coalesce("tool_name", "call_name", F.lit("unknown")))
    command = F.when(is_run, F.coalesce("command", F.lit(""))).otherwise(F.coalesce("a_command", F.lit("")))
    built_in = tk.message_tokens()
    rows = rows.withColumn("estimated_tokens", built_in if estimator is None else F.coalesce(estimator, built_in)).withColumn("item_text", tk.message_text()).withColumn("source", source).withColumn("command_text", command)
    rows = rows.withColumn("category", F.when(F.col("source") == "bash", tx.command_category(F.col("command_text"))))
    shown = F.when(is_run, F.coalesce("output", F.lit(""))).otherwise(F.col("item_text"))
    rows = rows.withColumn("outcome", F.when(F.col("category") == "test", tx.test_outcome(shown)))
    failed = F.when(is_run, F.coalesce("cancelled", F.lit(False)) | (F.coalesce("exit_code", F.lit(0)) != 0)).otherwise(F.coalesce("is_error", F.lit(False)))
    kind = F.create_map(*(F.lit(x) for pair in (("user", "user"), ("assistant", "assistant"), ("toolResult", "tool-result"), ("bashExecution", "bash"), ("branchSummary", "summary"), ("compactionSummary", "summary")) for x in pair))
    stub = F.coalesce(F.get_json_object("details_json", "$.engine") == ENGINE_ID, F.lit(False))
    return rows.withColumns({"err": failed, "file": keys.file_of(), "engine_stub": stub, "type": F.coalesce(F.try_element_at(kind, role), F.lit("custom"))})


def rule_of(oversized: int, sup: Column, new: Column, latest: Column) -> Column:
    """The first rule that holds for a row of ``with_facts`` if it is superseded (``sup``), among the recent results (``new``) or the latest user message: class, importance, tags in one text, reason, and whether its file and what supersedes it count."""
    role, toolish = F.col("role"), F.col("role").isin("toolResult", "bashExecution")
    called = F.coalesce(F.exists("blocks", lambda b: b["type"] == "toolCall"), F.lit(False))
    return (
        F.when(F.col("engine_stub"), _rule("disposable", 5, ["engine-stub"], "already pruned by the engine"))
        .when(role == "user", _rule("critical", 100, ["user", F.when(latest, "latest-user")], "user message"))
        .when(role == "assistant", _rule("working", 60, ["assistant", F.when(called, "tool-call").otherwise("reasoning")], "assistant message"))
        .when(role.isin("compactionSummary", "branchSummary"), _rule("critical", 80, ["summary"], "summary of earlier context"))
        .when(toolish, _toolish_rules(oversized, sup, new))
        .otherwise(_rule("working", 50, [F.coalesce("custom_type", F.lit("custom")), "custom"], "custom message"))
    )


def tags_of(rule: Column) -> Column:
    return F.split(rule["tags"], _TAG)


def judged(rows: DataFrame, oversized: int = tk.OVERSIZED) -> DataFrame:
    """Rows of ``with_facts`` with superseded_by, is_recent and is_latest_user, by the first rule that holds: class, importance, tags, reason, related_files; superseded_by stays where the rule has used it."""
    rows = rows.withColumn("rule", rule_of(oversized, F.col("superseded_by").isNotNull(), F.col("is_recent"), F.col("is_latest_user")))
    by = F.when(F.col("rule.by"), F.col("superseded_by"))
    files = F.when(F.col("rule.files") & F.col("file").isNotNull(), F.array("file")).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumns({"superseded_by": by, "class": F.col("rule.class"), "importance": tk.importance(F.col("rule.importance")), "tags": tags_of(F.col("rule")), "reason": F.col("rule.reason"), "related_files": files})
    return rows.drop("rule")


def classify(messages: DataFrame, pins: DataFrame | None = None, oversized: int = tk.OVERSIZED, recent: int = tk.RECENT, estimator: Column | None = None) -> DataFrame:
    """``messages`` with type, source, estimated_tokens, class, importance, tags, related_files, superseded_by, pinned, reason, engine_stub, item_text and command_text.

    ``estimator`` replaces the built-in token count where it is not null.
    """
    parts = shares(messages)
    rows = judged(with_facts(recency(superseded(with_calls(messages, parts)), recent), estimator), oversized)
    rows = rows.drop("file", "outcome", "is_latest_user", "superseded_at", "call_name", "call_arguments", "err", *(f"a_{n}" for n in keys.TEXTS + keys.NUMBERS))
    return pinned(rows, pins, messages.select("session_id", "message_index", F.lower(tk.message_text()).alias("text")), parts)


def pinned(items: DataFrame, pins: DataFrame | None, texts: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """Items that an active pin protects become critical.

    Pinned files are gathered per session and joined on it; pinned texts are
    looked for all at once in ``texts`` (session_id, message_index, text in
    lower case), by default those of the items, in ``parts`` partitions.
    """
    if pins is None:
        return items.withColumn("pinned", F.lit(False))
    active = pins.where("active")
    files = active.where("type = 'file'").groupBy("session_id").agg(F.collect_set(keys.normalized_path(F.col("content"))).alias("pin_files"))
    needles = active.where(F.col("type").isin("constraint", "requirement", "note", "command")).select("session_id", F.lower(F.substring(tx.trim(F.col("content")), 1, 120)).alias("needle"))
    if texts is None:
        texts = items.select("session_id", "message_index", F.lower("item_text").alias("text"))
    held = holding(texts, needles, parts).withColumn("held", F.lit(True))
    rows = items.join(files, "session_id", "left").join(held, ["session_id", "message_index"], "left")
    hit = ~F.col("engine_stub") & (F.coalesce(F.arrays_overlap("related_files", "pin_files"), F.lit(False)) | F.coalesce("held", F.lit(False)))
    rows = rows.withColumn("pinned", hit).withColumn("class", F.when(hit, "critical").otherwise(F.col("class")))
    rows = rows.withColumn("importance", F.when(F.col("pinned"), 100).otherwise(F.col("importance")))
    return rows.withColumn("tags", F.when(F.col("pinned"), F.array_append("tags", F.lit("pinned"))).otherwise(F.col("tags"))).drop("pin_files", "held")
