"""Checkpoints: what a session's text is reduced to, and which replies are valid."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import text as tx
from threadloom.functions import tokens as tk
from threadloom.functions.rows import once

MAX_TOOL, MAX_TOTAL, MAX_SUMMARY, MAX_ARGUMENTS, MAX_GOAL = 400, 120_000, 4000, 200, 2000


def _beginning(text: Column, most: int, mark: str) -> Column:
    """``text``, trimmed, or as much of it as ``most`` characters hold and a mark; what lies beyond is only looked at for anything but white space."""
    text = F.regexp_replace(text, rf"^{tx.SPACE}+", "")
    more = F.coalesce(F.substring(text, F.lit(most + 1), F.length(text)).rlike(f"[^{tx.SPACE[1:-1]}]"), F.lit(False))
    begin = F.substring(text, 1, most)
    return F.when(more, F.concat(begin, F.lit(mark))).otherwise(tx.trim(begin))


def _section(max_tool: int) -> Column:
    """What a row with its text as ``said`` gives."""
    role, said, shown = F.col("role"), tx.trim(F.col("said")), _beginning(F.col("said"), max_tool, " …[truncated]")
    line = lambda t: F.replace(t, F.lit("\n"), F.lit(" "))
    calls = F.transform(F.filter("blocks", lambda b: b["type"] == "toolCall"), lambda b: F.concat(F.lit("Tool "), F.coalesce(b["name"], F.lit("?")), F.lit(" "), F.substring(F.coalesce(b["arguments_json"], F.lit("{}")), 1, MAX_ARGUMENTS)))
    spoken = F.concat(F.when(said != "", F.array(F.concat(F.lit("Assistant: "), said))).otherwise(F.array().cast("array<string>")), F.coalesce(calls, F.array().cast("array<string>")))
    out, summary = _beginning(F.coalesce("output", F.lit("")), max_tool, " …"), tx.trim(F.coalesce("summary", F.lit("")))
    failed = F.when(F.coalesce("exit_code", F.lit(0)) != 0, F.concat(F.lit(" [exit "), F.col("exit_code").cast("string"), F.lit("]"))).otherwise("")
    return (
        F.when(role == "user", F.when(said != "", F.concat(F.lit("User: "), said)))
        .when(role == "assistant", F.when(F.size(spoken) > 0, F.array_join(spoken, "\n")))
        .when(role == "toolResult", F.when(shown != "", F.concat(F.lit("Result("), F.coalesce("tool_name", F.lit("tool")), F.when(F.coalesce("is_error", F.lit(False)), " [ERROR]").otherwise(""), F.lit("): "), line(shown))))
        .when(role == "bashExecution", F.concat(F.lit("Bash("), F.coalesce("command", F.lit("")), F.lit("): "), line(out), failed))
        .when(role == "compactionSummary", F.when(summary != "", F.concat(F.lit("[Earlier compaction summary]: "), F.substring(summary, 1, MAX_SUMMARY))))
    )


def serialized(messages: DataFrame, pins: DataFrame | None = None, max_tool: int = MAX_TOOL, max_total: int = MAX_TOTAL) -> DataFrame:
    """(session_id, text): the session by section; beyond ``max_total`` characters its goal, its active pins and as much of its end as fits.

    A section is gathered only if some of it is within ``max_total`` characters
    of the session's end, by a running length from there.
    """
    parts = once(once(messages, "said", tk.message_text()), "s", _section(max_tool))
    asked = F.when(F.col("role") == "user", F.nullif(tx.trim(F.col("said")), F.lit("")))
    behind = Window.partitionBy("session_id").orderBy(F.desc("message_index")).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("session_id", "message_index", "s", asked.alias("asked"), F.coalesce(F.sum(F.length("s") + 2).over(behind), F.lit(0)).alias("behind"))
    # what the end may take is never more than max_total, or 1000 if that is less
    within = F.col("s").isNotNull() & (F.col("behind") < max(max_total, 1000))
    rows = parts.groupBy("session_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(within, F.struct("message_index", "s")))), lambda x: x["s"]), "\n\n").alias("body"),
        (F.sum(F.length("s") + 2) - 2).alias("whole"),
        F.substring(F.min_by("asked", F.when(F.col("asked").isNotNull(), F.col("message_index"))), 1, MAX_GOAL).alias("goal"),
    )
    goal = F.when(F.col("goal").isNotNull(), F.concat(F.lit("User (Initial Goal): "), F.col("goal")))
    if pins is None:
        head = F.coalesce(goal, F.lit(""))
    else:
        listed = pins.where("active").groupBy("session_id").agg(F.concat(F.lit("Active Pins:\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("created_at", "id", "type", "content"))), lambda p: F.concat(F.lit("- ["), p["type"], F.lit("] "), p["content"])), "\n")).alias("pins"))
        rows = rows.join(listed, "session_id", "left")
        head = F.concat_ws("\n\n", goal, F.col("pins"))
    tail = F.greatest(F.lit(1000), max_total - F.when(head != "", F.length(head) + 4).otherwise(0))
    short = F.concat(F.when(head != "", F.concat(head, F.lit("\n\n[... earlier conversation truncated ...]\n\n"))).otherwise(""), F.right(F.col("body"), tail))
    return rows.select("session_id", F.when(F.coalesce("whole", F.lit(0)) <= max_total, F.col("body")).otherwise(short).alias("text"))


def extracted_json(reply: Column) -> Column:
    """The JSON text in a reply: inside its code fence if it has one, then from the first to the last brace; null unless it parses."""
    text = tx.trim(reply)
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    text = F.when(F.instr(text, "```") > 0, F.when(text.rlike(r"(?s)```(?:json)?\s*(.*?)```"), tx.trim(fenced)).otherwise(text)).otherwise(text)
    first, last = F.instr(text, "{"), F.length(text) - F.instr(F.reverse(text), "}") + 1
    inner = F.when((first > 0) & (F.instr(text, "}") > 0) & (last > first), F.substring(text, first, last - first + 1)).otherwise(text)
    return F.when(F.try_parse_json(inner).isNotNull(), inner)


# The fields of a checkpoint and the words that its states may be.
STRING_LISTS = ("requirements", "constraints", "files.inspected", "files.modified", "files.created", "files.deleted", "verification.passed", "verification.failed", "verification.pending", "next_actions")
TASK_STATES, DECISION_STATES, ISSUE_STATES = ("in_progress", "blocked", "done"), ("active", "superseded", "abandoned"), ("open", "resolved", "blocked")


def _kind(doc: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(doc, f"$.{path}", "variant"))


def _list_errors(doc: Column, path: str) -> Column:
    """Errors of a field that must be a list of strings, with the place of each bad element."""
    items = F.try_variant_get(doc, f"$.{path}", "array<variant>")
    bad = F.transform(items, lambda v, i: F.when(F.coalesce(F.schema_of_variant(v), F.lit("VOID")) != "STRING", F.concat(F.lit(f"{path}["), i.cast("string"), F.lit("] must be a string"))))
    return F.when(_kind(doc, path).startswith("ARRAY"), bad).otherwise(F.array(F.lit(f"{path} must be an array")))


def _object_errors(doc: Column, path: str, text: str, states: tuple[str, ...], required: bool) -> Column:
    """Errors of a field that must be a list of objects with a text and, if given, a known state."""
    items = F.try_variant_get(doc, f"$.{path}", "array<variant>")
    at = lambda i: F.concat(F.lit(f"{path}["), i.cast("string"), F.lit("]"))
    words = F.lit(" | ".join(states))

    def each(v, i):
        is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
        said = F.try_variant_get(v, f"$.{text}", "variant")
        has = F.coalesce((F.schema_of_variant(said) == "STRING") & (tx.trim(F.try_variant_get(v, f"$.{text}", "string")) != ""), F.lit(False))
        state = F.try_variant_get(v, "$.status", "variant")
        known = state.isNull() | F.coalesce((F.schema_of_variant(state) == "STRING") & F.try_variant_get(v, "$.status", "string").isin(*states), F.lit(False))
        reason = F.try_variant_get(v, "$.reason", "variant")
        good_reason = reason.isNull() | (F.schema_of_variant(reason) == "STRING") if text == "decision" else F.lit(True)
        return (
            F.when(~is_object, F.array(F.concat(at(i), F.lit(" must be an object"))))
            .when(~has, F.array(F.concat(at(i), F.lit(f".{text} must be a non-empty string"))))
            .otherwise(F.array(F.when(~good_reason, F.concat(at(i), F.lit(".reason must be a string"))), F.when(~known, F.concat(at(i), F.lit(".status must be one of "), words))))
        )

    of_items = F.flatten(F.transform(items, each))
    missing = F.array(F.lit(f"{path} must be an array")) if required else F.when(_kind(doc, path).isNull(), F.array().cast("array<string>")).otherwise(F.array(F.lit(f"{path} must be an array")))
    return F.when(F.coalesce(_kind(doc, path).startswith("ARRAY"), F.lit(False)), of_items).otherwise(missing)


#: A time with a date: ISO-8601 (a date alone, or with a time and perhaps a zone), or as in mail headers (day name and zone may lack).
ISO_DATE = r"^\s*([+-]\d{6}|\d{4})-\d{2}(-\d{2})?([T ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})?)?\s*$"
MAIL_DATE = r"(?i)^\s*((?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+)?(\d{1,2})\s+(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+(\d{4})(\s+\d{1,2}:\d{2}(:\d{2})?)?(\s*(gmt|utc|z|[+-]\d{4}))?\s*$"


def is_date(text: Column) -> Column:
    """Whether a text names a point in time: ISO_DATE or MAIL_DATE of a day and an hour that exist. A time of day alone does not."""
    day = F.regexp_replace(F.trim(text), "[,]", ".")
    iso = text.rlike(ISO_DATE) & F.try_to_timestamp(F.regexp_replace(F.regexp_replace(day, r"^(\d{4}-\d{2})$", "$1-01"), r"\s+(Z|[+-]\d{2}:?\d{2})$", "$1")).isNotNull()
    part = lambda k: F.regexp_extract(text, MAIL_DATE, k)
    hours = F.when(part(5) == "", F.lit(True)).otherwise(F.trim(part(5)).rlike(r"^([01]?\d|2[0-3]):[0-5]\d(:[0-5]\d)?$"))
    real = F.coalesce(F.when(text.rlike(MAIL_DATE), F.try_to_date(F.concat_ws(" ", F.lpad(part(2), 2, "0"), F.initcap(part(3)), part(4)), "dd MMM yyyy").isNotNull() & hours), F.lit(False))
    return F.coalesce(iso, F.lit(False)) | real


def checkpoint_errors(document: Column) -> Column:
    """array<string>: what is wrong with a checkpoint's JSON text; empty if it is valid."""
    doc = F.try_parse_json(document)
    version, created = F.try_variant_get(doc, "$.version", "variant"), F.try_variant_get(doc, "$.created_at", "variant")
    one = F.coalesce(F.schema_of_variant(version).isin("BIGINT", "DOUBLE") & (F.try_variant_get(doc, "$.version", "double") == 1), F.lit(False))
    dated = F.coalesce((F.schema_of_variant(created) == "STRING") & is_date(F.try_variant_get(doc, "$.created_at", "string")), F.lit(False))
    task = F.coalesce(_kind(doc, "task").startswith("OBJECT"), F.lit(False))
    goal = F.coalesce((_kind(doc, "task.goal") == "STRING") & (tx.trim(F.try_variant_get(doc, "$.task.goal", "string")) != ""), F.lit(False))
    phase = F.coalesce(_kind(doc, "task.phase"), F.lit("STRING")) == "STRING"
    status = _kind(doc, "task.status").isNull() | F.coalesce(F.try_variant_get(doc, "$.task.status", "string").isin(*TASK_STATES) & (_kind(doc, "task.status") == "STRING"), F.lit(False))
    single = F.array(
        F.when(version.isNotNull() & ~one, F.concat(F.lit("unsupported version "), F.to_json(version), F.lit(" (expected 1)"))),
        F.when(created.isNotNull() & ~dated, "created_at must be an ISO-8601 timestamp string"),
        F.when(~task, "task must be an object"),
        F.when(~goal, "task.goal is required and must be a non-empty string"),
        F.when(~phase, "task.phase must be a string"),
        F.when(~status, F.lit("task.status must be one of " + " | ".join(TASK_STATES))),
    )
    lists = [_list_errors(doc, p) for p in STRING_LISTS]
    objects = [_object_errors(doc, "issues", "description", ISSUE_STATES, False), _object_errors(doc, "decisions", "decision", DECISION_STATES, True)]
    found = F.filter(F.concat(single, *objects, *lists), lambda e: e.isNotNull())
    return F.when(F.coalesce(F.schema_of_variant(doc).startswith("OBJECT"), F.lit(False)), found).otherwise(F.array(F.lit("checkpoint must be a JSON object")))


def validated(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """``replies`` with json (extracted text), errors and ok; what is not ok goes to quarantine by a filter."""
    rows = once(replies, "json", extracted_json(F.col(reply)))
    rows = once(rows, "errors", checkpoint_errors(F.coalesce("json", F.lit("null"))))
    return rows.withColumn("ok", F.size("errors") == 0)


def constraints(checkpoints: DataFrame, pins: DataFrame) -> DataFrame:
    """(session_id, constraints): those of the checkpoint's JSON, then active constraint and requirement pins, each once."""
    own = checkpoints.select("session_id", F.coalesce(F.try_variant_get(F.try_parse_json("json"), "$.constraints", "array<string>"), F.array().cast("array<string>")).alias("own"))
    listed = pins.where("active and type in ('constraint', 'requirement')").groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("created_at", "id", "content"))), lambda p: p["content"]).alias("pinned"))
    none = F.array().cast("array<string>")
    return own.join(listed, "session_id", "full").select("session_id", F.array_distinct(F.concat(F.coalesce("own", none), F.coalesce("pinned", none))).alias("constraints"))


# The sentences and headings below are part of the prompts' format.
def handoff_prompts(checkpoints: DataFrame, pins: DataFrame, inputs: DataFrame | None = None) -> DataFrame:
    """(session_id, prompt): a document from which another session can go on.

    ``inputs`` (session_id, goal, git_diff) may give a goal that goes before the
    checkpoint's, and a summary of what is not committed.
    """
    rows = constraints(checkpoints, pins).join(checkpoints.select("session_id", "json"), "session_id", "left")
    if inputs is None:
        rows = rows.withColumns({c: F.lit(None).cast("string") for c in ("goal", "git_diff")})
    else:
        rows = rows.join(inputs.select("session_id", "goal", "git_diff"), "session_id", "left")
    rows = once(rows, "d", F.try_parse_json("json"))
    text = lambda p: F.try_variant_get("d", f"$.{p}", "string")
    many = lambda p, t="array<string>": F.coalesce(F.try_variant_get("d", f"$.{p}", t), F.array().cast(t))
    bullets = lambda items: F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")
    some = lambda items, before: F.when(F.size(items) > 0, F.concat(F.lit(before), bullets(items)))
    decisions = F.transform(many("decisions", "array<struct<decision:string,reason:string,status:string>>"), lambda x: F.concat(x["decision"], F.lit(" ("), F.coalesce(F.nullif(x["reason"], F.lit("")), F.lit("no reason recorded")), F.lit(") ["), F.coalesce(x["status"], F.lit("active")), F.lit("]")))
    issues = F.transform(many("issues", "array<struct<description:string,status:string>>"), lambda x: F.concat(F.lit("["), F.coalesce(x["status"], F.lit("open")), F.lit("] "), x["description"]))
    named = lambda k: F.transform(many(f"files.{k}"), lambda f: F.concat(F.lit(f"{k}: "), f))
    files = F.concat(*map(named, ("modified", "created", "deleted")))
    checks = F.filter(F.array(*(F.when(F.size(many(f"verification.{k}")) > 0, F.concat(F.lit(f"{k}: "), F.array_join(many(f"verification.{k}"), ", "))) for k in ("passed", "failed", "pending"))), lambda x: x.isNotNull())
    following = many("next_actions")
    rest = F.array_join(F.slice(following, 2, F.greatest(F.size(following), F.lit(1))), "; ")
    state = F.concat_ws(
        "\n\n", F.concat(F.lit("## Current state\nPhase: "), F.coalesce(text("task.phase"), F.lit("in_progress")), F.lit(" · Status: "), F.coalesce(text("task.status"), F.lit("in_progress"))),
        some(many("requirements"), "Requirements:\n"), some(decisions, "Decisions:\n"),
        F.concat(F.lit("## Modified files\n"), F.when(F.size(files) > 0, bullets(files)).otherwise("- (none recorded)")),
        F.when(F.size(many("files.inspected")) > 0, F.concat(F.lit("Inspected files: "), F.array_join(many("files.inspected"), ", "))),
        F.concat(F.lit("## Verification\n"), F.when(F.size(checks) > 0, bullets(checks)).otherwise("- (none recorded)")), some(issues, "## Open issues\n"),
    )
    prompt = F.concat_ws(
        "\n\n", F.lit("You are continuing an existing coding task. Continue directly from the state below; do not ask the user to repeat it."),
        F.concat(F.lit("## Goal\n"), F.coalesce("goal", text("task.goal"), F.lit("(no goal recorded — infer from the state below)"))), some(F.col("constraints"), "## Hard constraints\n"),
        F.when(F.col("d").isNull(), F.lit("## Current state\n(no checkpoint available — inspect the repository to reconstruct state)")).otherwise(state),
        F.concat(F.lit("## Current git diff (summary)\n"), F.nullif("git_diff", F.lit(""))),
        F.concat(F.lit("## Next action\n"), F.when(F.size(following) > 0, F.concat(F.get(following, F.lit(0)), F.lit(" (remaining: "), F.coalesce(F.nullif(rest, F.lit("")), F.lit("none")), F.lit(")"))).otherwise("(none recorded — propose the next step to the user)")),
        F.lit("Continue directly from this state."),
    )
    return rows.select("session_id", prompt.alias("prompt"))


# The sentences of the instructions.
def compact_instructions(checkpoints: DataFrame, pins: DataFrame, ineffective: Column | None = None) -> DataFrame:
    """(session_id, instructions) for a host's compaction."""
    rows = constraints(checkpoints, pins).join(checkpoints.select("session_id", F.try_variant_get(F.try_parse_json("json"), "$.next_actions[0]", "string").alias("next")), "session_id", "left")
    text = F.concat_ws(
        "\n", F.lit("Keep the recovery state intact: goal, explicit user constraints, current implementation state, files touched, verification status, and next actions."),
        F.when(F.size("constraints") > 0, F.concat(F.lit("Hard constraints: "), F.array_join("constraints", "; "), F.lit("."))),
        F.when(F.col("next").isNotNull(), F.concat(F.lit("Next action: "), F.col("next"), F.lit("."))),
        F.when(ineffective if ineffective is not None else F.lit(False), "Previous compaction did not effectively reduce context pressure; this summary should more aggressively discard tool output details."),
    )
    return rows.select("session_id", text.alias("instructions"))


#: Fixed value: the schema that a reply must have, as the prompt shows it.
SCHEMA = {
    "version": 1,
    "created_at": "<ISO-8601 timestamp>",
    "task": {"goal": "string", "phase": "string", "status": "|".join(TASK_STATES)},
    "requirements": ["string"],
    "constraints": ["string"],
    "decisions": [{"decision": "string", "reason": "string", "status": "|".join(DECISION_STATES)}],
    "files": {"inspected": ["string"], "modified": ["string"], "created": ["string"], "deleted": ["string"]},
    "verification": {"passed": ["string"], "failed": ["string"], "pending": ["string"]},
    "issues": [{"description": "string", "status": "|".join(ISSUE_STATES)}],
    "next_actions": ["string"],
}
#: Fixed value: what a model is told to make of a session.
SYSTEM_PROMPT = f"""You are a recovery-checkpoint generator for a coding agent session.
Produce a recovery checkpoint using exactly the JSON schema below.
Do not summarize in conversational style. No prose outside the JSON.

Preserve:
- explicit user constraints (verbatim where possible)
- unresolved issues
- implementation decisions and their reasons
- verification status (what passed, what failed, what is pending)
- next executable actions

Output ONLY a single JSON object matching this schema:
{json.dumps(SCHEMA, indent=2)}

Rules:
- Every field must be present (use empty arrays when nothing applies).
- task.goal must capture the user's current objective in one sentence.
- constraints must include every hard user constraint (e.g. 'do not modify X').
- next_actions must be concrete and executable, in order.
- Do not invent facts that are not supported by the conversation."""


def checkpoint_prompts(messages: DataFrame, pins: DataFrame | None = None) -> DataFrame:
    """(session_id, system, prompt): what a model is asked for a session's checkpoint; a session without text has no prompt."""
    rows = serialized(messages, pins)
    if pins is not None:
        shown = F.when(F.col("type") == "file", F.concat(F.lit("pinned file: "), F.col("content"))).otherwise(F.col("content"))
        hard = pins.where("active").groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("created_at", "id", shown.alias("shown")))), lambda p: p["shown"]), " | ").alias("hard"))
        rows = rows.join(hard, "session_id", "left")
    else:
        rows = rows.withColumn("hard", F.lit(None).cast("string"))
    asked = F.concat(
        F.lit("Generate the recovery checkpoint for this coding session."), F.coalesce(F.concat(F.lit("\nHard pins (must appear in constraints): "), F.nullif("hard", F.lit(""))), F.lit("")),
        F.lit("\n<conversation>\n"), F.col("text"), F.lit("\n</conversation>"),
    )
    return rows.select("session_id", F.lit(SYSTEM_PROMPT).alias("system"), F.when(tx.trim(F.col("text")) != "", asked).alias("prompt"))


def normalized(document: Column, created_at: Column) -> Column:
    """A valid checkpoint's JSON text rebuilt: the known fields in order, goals, decisions and issues trimmed, states defaulted, absent lists empty, ``created_at`` where it has none; whatever else it holds goes."""
    doc = F.try_parse_json(document)
    text = lambda v, path: tx.trim(F.try_variant_get(v, path, "string"))
    many = lambda path: F.coalesce(F.try_variant_get(doc, f"$.{path}", "array<string>"), F.array().cast("array<string>"))
    decision = lambda v: F.struct(text(v, "$.decision").alias("decision"), F.coalesce(F.try_variant_get(v, "$.reason", "string"), F.lit("")).alias("reason"), F.coalesce(F.try_variant_get(v, "$.status", "string"), F.lit(DECISION_STATES[0])).alias("status"))
    issue = lambda v: F.struct(text(v, "$.description").alias("description"), F.coalesce(F.try_variant_get(v, "$.status", "string"), F.lit(ISSUE_STATES[0])).alias("status"))
    group = lambda name, parts: F.struct(*(many(f"{name}.{x}").alias(x) for x in parts)).alias(name)
    typed = lambda rows, kind: rows.cast(f"array<struct<{kind}>>")
    return F.to_json(F.struct(
        F.lit(1).alias("version"), F.coalesce(F.try_variant_get(doc, "$.created_at", "string"), created_at).alias("created_at"),
        F.struct(text(doc, "$.task.goal").alias("goal"), F.coalesce(F.nullif(text(doc, "$.task.phase"), F.lit("")), F.lit("in_progress")).alias("phase"), F.coalesce(F.try_variant_get(doc, "$.task.status", "string"), F.lit(TASK_STATES[0])).alias("status")).alias("task"),
        many("requirements").alias("requirements"), many("constraints").alias("constraints"),
        F.coalesce(F.transform(F.try_variant_get(doc, "$.decisions", "array<variant>"), decision), typed(F.array(), "decision:string,reason:string,status:string")).alias("decisions"),
        group("files", ("inspected", "modified", "created", "deleted")), group("verification", ("passed", "failed", "pending")),
        F.coalesce(F.transform(F.try_variant_get(doc, "$.issues", "array<variant>"), issue), typed(F.array(), "description:string,status:string")).alias("issues"), many("next_actions").alias("next_actions"),
    ))


def generated(prompts: DataFrame, replies: DataFrame, created_at: str = "1970-01-01T00:00:00.000Z") -> DataFrame:
    """(session_id, ok, errors, checkpoint): the replies (session_id, reply, source, tokens_before) to ``prompts``, checked.

    A valid one comes out ``normalized`` with meta (session_id, tokens_before,
    source) in the place of any of its own, ``created_at`` where it says none;
    a session without a prompt or a reply fails and says why.
    """
    rows = validated(prompts.select("session_id", "prompt").join(replies.select("session_id", "reply", "source", "tokens_before"), "session_id", "left"))
    empty = F.col("prompt").isNull()
    ok = ~empty & F.col("ok")
    errors = F.when(empty, F.array(F.lit("empty conversation — nothing to checkpoint"))).otherwise(F.col("errors"))
    meta = F.to_json(F.struct("session_id", "tokens_before", "source"))
    rows = once(rows, "body", F.when(ok, normalized(F.col("json"), F.lit(created_at))))
    return rows.select("session_id", ok.alias("ok"), errors.alias("errors"), F.concat(F.expr("substring(body, 1, length(body) - 1)"), F.lit(',"meta":'), meta, F.lit("}")).alias("checkpoint"))
