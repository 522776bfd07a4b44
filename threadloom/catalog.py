"""Queries of the session engine by inventory key, with equivalent SQL.

Chat sessions come from ``conversations``, tool sessions from ``events``. The
tool sessions' window is CONTEXT_WINDOW tokens, so that they fill it to all
degrees. Ratios are rounded to six digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions import keys
from threadloom.functions import text as tx
from threadloom.functions import tokens as tk
from threadloom.operators import analysis, checkpoints, commands, items, pins, prune, reports, steps
from threadloom.plans import config, policy, rules
from threadloom.schema import MESSAGES, as_messages
from threadloom.sources import logs, tables, traces
from threadloom.streaming import steps as streamed
from threadloom.streaming.sessions import append_audit

CONTEXT_WINDOW, CHAT_WINDOW = 32_768, 16_384
AT = "2024-01-01T00:00:00.000Z"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# ---- the same sessions in SQL ----
CHAT = r"""
chat AS (
  SELECT CAST(conv_id AS VARCHAR) AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS message_index, role, coalesce(text, '') AS text,
    (3 * (length(coalesce(text, '')) - len(regexp_extract_all(coalesce(text, ''), '[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}\x{3000}-\x{303f}\x{ff00}-\x{ffee}]')))
      + 8 * (len(regexp_extract_all(coalesce(text, ''), '[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}\x{3000}-\x{303f}\x{ff00}-\x{ffee}\x{10000}-\x{10ffff}]'))) + 11) // 12
      + CASE role WHEN 'assistant' THEN 24 ELSE 16 END AS tokens
  FROM conversations
)"""
TRACE = r"""
ev AS (
  SELECT *, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events
), calls AS (
  SELECT CAST(user_id AS VARCHAR) AS session_id, seq, 2 * seq + 2 AS message_index, 'c' || event_id AS tool_call_id, k, event_type,
    CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'grep' WHEN 'signup' THEN 'edit' ELSE 'bash' END AS name,
    CASE WHEN event_type IN ('view', 'signup') THEN 'src/f' || (k % 7) || '.py' END AS path,
    CASE WHEN event_type = 'click' THEN 'p' || (k % 5) END AS pattern,
    CASE event_type WHEN 'purchase' THEN ['npm install', 'git diff', 'ls -la', 'python main.py', 'git status'][(k % 5 + 1)::INT] WHEN 'error' THEN 'pytest tests/t' || (k % 3) END AS command,
    CASE WHEN event_type = 'view' AND k % 2 = 1 THEN (k % 5) * 50 END AS off,
    event_type = 'error' AND k % 2 = 1 AS is_error,
    CASE WHEN event_type <> 'error' THEN 'ok' WHEN k % 2 = 1 THEN '3 failed, 7 passed' ELSE '10 passed' END || chr(10) || repeat('output line ' || k || chr(10), (floor(value) + 1)::INT) AS text
  FROM ev
), keyed AS (
  SELECT *, (3 * length(text) + 11) // 12 + 16 AS tokens,
    CASE name WHEN 'read' THEN 'read:' || path WHEN 'grep' THEN 'grep:' || pattern || '@src' WHEN 'bash' THEN CASE event_type WHEN 'error' THEN 'test:pytest:tests/t' || (k % 3) ELSE 'bash:' || command END END AS group_key,
    off IS NULL AS is_full, coalesce(off, 0) AS lo, coalesce(off + 59, 1000000000) AS hi
  FROM calls
)"""
RULED = TRACE + r""", later AS (
  SELECT a.session_id, a.message_index, min(b.message_index) AS by_read FROM keyed a JOIN keyed b
    ON a.session_id = b.session_id AND a.group_key = b.group_key AND a.name = 'read' AND b.name = 'read' AND b.message_index > a.message_index
    AND (a.is_full OR b.is_full OR (greatest(a.lo, b.lo) <= least(a.hi, b.hi)))
  GROUP BY ALL
), placed AS (
  SELECT keyed.*, row_number() OVER (PARTITION BY session_id ORDER BY message_index DESC) <= 8 AS fresh, tokens >= 1000 AS big,
    CASE WHEN name = 'read' THEN by_read WHEN group_key IS NOT NULL THEN nullif(max(message_index) OVER (PARTITION BY session_id, group_key), message_index) END AS sup
  FROM keyed LEFT JOIN later USING (session_id, message_index)
), ruled AS (
  SELECT *, CASE
      WHEN name = 'read' AND sup IS NOT NULL THEN 'R05' WHEN name = 'read' THEN 'R06'
      WHEN name = 'grep' AND sup IS NOT NULL THEN 'R08' WHEN name = 'grep' THEN 'R09'
      WHEN name = 'edit' THEN 'R26'
      WHEN command = 'npm install' THEN 'R10'
      WHEN event_type = 'error' AND sup IS NOT NULL THEN 'R12' WHEN event_type = 'error' AND is_error THEN 'R13' WHEN event_type = 'error' THEN 'R14'
      WHEN command = 'git diff' AND sup IS NOT NULL THEN 'R16' WHEN command = 'git diff' THEN 'R17'
      WHEN command IN ('ls -la', 'git status') THEN 'R18'
      WHEN sup IS NOT NULL THEN 'R22' WHEN fresh THEN 'R23' WHEN NOT big THEN 'R24' ELSE 'R25' END AS rule
  FROM placed
), classed AS (
  SELECT *,
    CASE WHEN rule IN ('R05', 'R08', 'R12', 'R16', 'R22', 'R25') THEN 'stale' WHEN rule IN ('R06', 'R13', 'R17', 'R23', 'R24') THEN 'working' WHEN rule IN ('R10', 'R18') THEN 'disposable'
      WHEN rule IN ('R09', 'R26') THEN CASE WHEN fresh THEN 'working' ELSE 'stale' END WHEN rule = 'R14' THEN CASE WHEN fresh AND NOT big THEN 'working' ELSE 'disposable' END END AS class,
    CASE rule WHEN 'R05' THEN CASE WHEN big THEN 15 ELSE 25 END WHEN 'R06' THEN CASE WHEN big THEN 60 ELSE 70 END WHEN 'R08' THEN 15 WHEN 'R09' THEN CASE WHEN fresh THEN 40 ELSE 25 END
      WHEN 'R10' THEN CASE WHEN sup IS NOT NULL THEN 5 ELSE 10 END WHEN 'R12' THEN CASE WHEN is_error THEN 25 ELSE 20 END WHEN 'R13' THEN 90 WHEN 'R14' THEN CASE WHEN fresh AND NOT big THEN 30 ELSE 15 END
      WHEN 'R16' THEN 20 WHEN 'R17' THEN CASE WHEN big THEN 75 ELSE 85 END WHEN 'R18' THEN 10 WHEN 'R22' THEN 15 WHEN 'R23' THEN CASE WHEN big THEN 55 ELSE 60 END WHEN 'R24' THEN 35 WHEN 'R25' THEN 20
      WHEN 'R26' THEN CASE WHEN fresh THEN 85 ELSE 35 END END AS importance,
    CASE rule WHEN 'R05' THEN 'an older read of a file that was read again later' WHEN 'R06' THEN 'file content (latest read of this file)' WHEN 'R08' THEN 'earlier run of the same search (kept: latest only)'
      WHEN 'R09' THEN CASE WHEN fresh THEN 'recent search result' ELSE 'older search result' END WHEN 'R10' THEN 'install command succeeded; output is noise'
      WHEN 'R12' THEN CASE WHEN is_error THEN 'older failing test run superseded by a later run of the same suite' ELSE 'earlier passing test run superseded by a later run' END
      WHEN 'R13' THEN 'active failing test run (latest)' WHEN 'R14' THEN 'passing test run' WHEN 'R16' THEN 'superseded by a later git diff' WHEN 'R17' THEN 'current git diff (working set)'
      WHEN 'R18' THEN 'trivial command output (ls/pwd/git status/...)' WHEN 'R22' THEN 'earlier identical successful command (kept: latest only)' WHEN 'R23' THEN 'recent successful command output'
      WHEN 'R24' THEN 'older successful command output (small — kept)' WHEN 'R25' THEN 'older oversized command output'
      WHEN 'R26' THEN CASE WHEN fresh THEN 'recent file modification' ELSE 'earlier file modification' END END AS reason,
    big AND (rule IN ('R06', 'R09', 'R13', 'R17', 'R23', 'R25')) AS oversized,
    CASE WHEN rule IN ('R05', 'R08', 'R12', 'R16', 'R22') THEN sup END AS superseded_by,
    CASE WHEN name IN ('read', 'edit') THEN path WHEN name = 'grep' THEN 'src' END AS file
  FROM ruled
), freed AS (
  SELECT *, CASE WHEN tokens < 50 THEN 0 WHEN class IN ('stale', 'disposable') THEN greatest(tokens - 80, 0) WHEN class = 'working' AND oversized THEN greatest(tokens - 260, 0) ELSE 0 END AS reclaimable FROM classed
), callers AS (
  SELECT session_id, message_index - 1 AS message_index, 24 + (3 * length(name) + 11) // 12 + 6 + (3 * length(
      CASE WHEN name = 'read' AND off IS NOT NULL THEN '{"path":"' || path || '","offset":' || off || ',"limit":60}' WHEN name IN ('read', 'edit') THEN '{"path":"' || path || '"}'
        WHEN name = 'grep' THEN '{"pattern":"' || pattern || '","path":"src"}' ELSE '{"command":"' || command || '"}' END) + 11) // 12 AS tokens FROM keyed
), everything AS (
  SELECT session_id, message_index, tokens, class, reclaimable FROM freed
  UNION ALL SELECT session_id, message_index, tokens, 'working', 0 FROM callers
  UNION ALL SELECT DISTINCT session_id, 0, (3 * 21 + 11) // 12 + 16, 'critical', 0 FROM keyed
), summed AS (
  SELECT session_id, sum(tokens)::BIGINT AS raw_tokens, coalesce(sum(tokens) FILTER (class = 'critical'), 0)::BIGINT AS critical_tokens, coalesce(sum(tokens) FILTER (class = 'working'), 0)::BIGINT AS working_tokens,
    coalesce(sum(tokens) FILTER (class = 'stale'), 0)::BIGINT AS stale_tokens, coalesce(sum(tokens) FILTER (class = 'disposable'), 0)::BIGINT AS disposable_tokens,
    sum(reclaimable)::BIGINT AS reclaimable_tokens, count(*) AS message_count FROM everything GROUP BY session_id
), analysed AS (
  SELECT *, raw_tokens + 4000 AS total_tokens, 20480::BIGINT AS usable_tokens, round(least(2.0, (raw_tokens + 4000) / 20480.0::DOUBLE), 6) AS pressure,
    round((critical_tokens + working_tokens) / raw_tokens::DOUBLE, 6) AS quality FROM summed
)"""


ARGUMENTS = """CASE WHEN name = 'read' AND off IS NOT NULL THEN '{"path":"' || path || '","offset":' || off || ',"limit":60}' WHEN name IN ('read', 'edit') THEN '{"path":"' || path || '"}'
        WHEN name = 'grep' THEN '{"pattern":"' || pattern || '","path":"src"}' ELSE '{"command":"' || command || '"}' END"""


def _k(n: str) -> str:
    """1.2K in SQL."""
    return f"CASE WHEN {n} >= 1000 THEN printf('%.1f', ({n} + CASE WHEN {n} % 1000 = 250 THEN 1 ELSE 0 END) / 1000.0::DOUBLE) || 'K' ELSE CAST({n} AS VARCHAR) END"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.chat_messages(_read(spark, sf_dir, "conversations"))


def _trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.tool_messages(_read(spark, sf_dir, "events"))


def _results(df: DataFrame) -> DataFrame:
    return df.where("role = 'toolResult'")


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.classify(_trace(spark, sf_dir))


def _analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.analyze(_classified(spark, sf_dir), window=CONTEXT_WINDOW)


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("pressure", "quality")})


def _pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pins for every chat session: a word that many hold, and a file none holds."""
    ids = _read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session_id")).distinct()
    each = F.array(*(F.struct(F.lit(i).alias("id"), F.lit(t).alias("type"), F.lit(c).alias("content"), F.lit(n).cast("long").alias("created_at")) for i, t, c, n in (("p1", "constraint", " The ", 1), ("p2", "file", "src/none.py", 2), ("p3", "note", "que", 3))))
    return ids.select("session_id", F.inline(each)).withColumn("active", F.lit(True))


def _query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


@_query("prj04_message_tokens", f"WITH {CHAT} SELECT session_id, message_index, role, CAST(tokens AS BIGINT) AS tokens FROM chat")
def _(spark, sf_dir):
    return _chat(spark, sf_dir).select("session_id", "message_index", "role", tk.message_tokens().alias("tokens"))


@_query(
    "prj06_fingerprints",
    f"""WITH {CHAT}, named AS (SELECT session_id, message_index, role || ':' || message_index || ':' || left(text, 200) AS s FROM chat), hashed AS (
  SELECT session_id, message_index, length(s) AS n, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(length(s) || chr(10) || s || chr(10), ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS h FROM named)
SELECT session_id, message_index::INT AS message_index, n || ':' || format('{{:x}}', h) AS id FROM hashed""",
)
def _(spark, sf_dir):
    return _chat(spark, sf_dir).select("session_id", "message_index", tk.fingerprint(F.concat(F.col("role"), F.lit(":"), F.col("message_index").cast("string"), F.lit(":"), F.substring(tk.message_text(), 1, 200))).alias("id"))


@_query(
    "agg02_class_tokens",
    f"""WITH {CHAT}, per AS (
  SELECT session_id, sum(tokens)::BIGINT AS raw_tokens, coalesce(sum(tokens) FILTER (role = 'user'), 0)::BIGINT AS critical_tokens, coalesce(sum(tokens) FILTER (role <> 'user'), 0)::BIGINT AS working_tokens, count(*) AS message_count
  FROM chat GROUP BY session_id)
SELECT session_id, raw_tokens, critical_tokens, working_tokens, raw_tokens + 4000 AS total_tokens, message_count, round(least(2.0, (raw_tokens + 4000) / 4096.0::DOUBLE), 6) AS pressure, 1.0::DOUBLE AS quality FROM per""",
)
def _(spark, sf_dir):
    found = analysis.analyze(items.classify(_chat(spark, sf_dir)), window=CHAT_WINDOW)
    return _rounded(found).select("session_id", "raw_tokens", "critical_tokens", "working_tokens", "total_tokens", "message_count", "pressure", "quality")


@_query("src04_last_user_text", f"WITH {CHAT} SELECT session_id, arg_max(text, message_index) AS text FROM chat WHERE role = 'user' GROUP BY session_id")
def _(spark, sf_dir):
    return analysis.last_user_text(_chat(spark, sf_dir))


@_query("win06_goals", rf"WITH {CHAT} SELECT session_id, left(arg_min(regexp_replace(text, '^\s+|\s+$', '', 'g'), message_index), 2000) AS goal FROM chat WHERE role = 'user' AND trim(text) <> '' GROUP BY session_id")
def _(spark, sf_dir):
    return analysis.goals(_chat(spark, sf_dir))


@_query("src02_tool_trace", f"WITH {TRACE} SELECT session_id, message_index::INT AS message_index, tool_call_id, name, is_error, text FROM keyed")
def _(spark, sf_dir):
    return _results(_trace(spark, sf_dir)).select("session_id", "message_index", "tool_call_id", F.col("tool_name").alias("name"), "is_error", tk.message_text().alias("text"))


@_query("jn01_call_lookup", f"WITH {TRACE} SELECT session_id, tool_call_id, message_index::INT AS message_index, name, path, pattern, command FROM keyed")
def _(spark, sf_dir):
    rows = _results(items.with_calls(_trace(spark, sf_dir)))
    path = F.when(F.col("call_name") != "grep", keys.argument(F.col("call_arguments"), "path"))
    return rows.select("session_id", "tool_call_id", "message_index", F.col("call_name").alias("name"), path.alias("path"), keys.argument(F.col("call_arguments"), "pattern").alias("pattern"), keys.argument(F.col("call_arguments"), "command").alias("command"))


@_query("cat09_group_keys", f"WITH {TRACE} SELECT session_id, message_index::INT AS message_index, group_key FROM keyed")
def _(spark, sf_dir):
    return _results(items.superseded(items.with_calls(_trace(spark, sf_dir)))).select("session_id", "message_index", "group_key")


@_query("win01_superseded_runs", f"WITH {RULED} SELECT session_id, message_index::INT AS message_index, sup::INT AS superseded_by FROM placed WHERE name <> 'read' AND sup IS NOT NULL")
def _(spark, sf_dir):
    rows = _results(items.superseded(items.with_calls(_trace(spark, sf_dir))))
    return rows.where("call_name <> 'read' and superseded_by is not null").select("session_id", "message_index", "superseded_by")


@_query("jn02_superseded_reads", f"WITH {RULED} SELECT session_id, message_index::INT AS message_index, sup::INT AS superseded_by FROM placed WHERE name = 'read' AND sup IS NOT NULL")
def _(spark, sf_dir):
    rows = _results(items.superseded(items.with_calls(_trace(spark, sf_dir))))
    return rows.where("call_name = 'read' and superseded_by is not null").select("session_id", "message_index", "superseded_by")


@_query("win02_recent_results", f"WITH {RULED} SELECT session_id, message_index::INT AS message_index FROM placed WHERE fresh")
def _(spark, sf_dir):
    return items.recency(_trace(spark, sf_dir)).where("is_recent").select("session_id", "message_index")


@_query(
    "cat01_command_categories",
    f"""WITH {TRACE} SELECT session_id, message_index::INT AS message_index, command,
  CASE WHEN command = 'npm install' THEN 'install' WHEN command LIKE 'pytest%' THEN 'test' WHEN command = 'git diff' THEN 'gitdiff' WHEN command IN ('ls -la', 'git status') THEN 'trivial' ELSE 'normal' END AS category,
  CASE WHEN regexp_matches(text, '(?i)\\d+\\s+failed\\b') THEN 'fail' WHEN regexp_matches(text, '(?i)\\d+\\s+passed\\b') THEN 'pass' ELSE 'unknown' END AS outcome
FROM keyed WHERE name = 'bash'""",
)
def _(spark, sf_dir):
    rows = _results(items.with_calls(_trace(spark, sf_dir))).where("call_name = 'bash'").withColumn("command", keys.argument(F.col("call_arguments"), "command"))
    return rows.select("session_id", "message_index", "command", tx.command_category(F.col("command")).alias("category"), tx.test_outcome(tk.message_text()).alias("outcome"))


@_query("r00_r29_classified", f"WITH {RULED} SELECT session_id, message_index::INT AS message_index, name AS source, tokens::BIGINT AS estimated_tokens, class, importance, reason, oversized, superseded_by::INT AS superseded_by, file FROM classed")
def _(spark, sf_dir):
    return _results(_classified(spark, sf_dir)).select("session_id", "message_index", "source", "estimated_tokens", "class", "importance", "reason", F.array_contains("tags", "oversized").alias("oversized"), "superseded_by", F.try_element_at("related_files", F.lit(1)).alias("file"))


@_query("agg03_session_analysis", f"WITH {RULED} SELECT session_id, raw_tokens, critical_tokens, working_tokens, stale_tokens, disposable_tokens, reclaimable_tokens, message_count, total_tokens, usable_tokens, pressure, quality FROM analysed")
def _(spark, sf_dir):
    return _rounded(_analysed(spark, sf_dir)).select("session_id", "raw_tokens", "critical_tokens", "working_tokens", "stale_tokens", "disposable_tokens", "reclaimable_tokens", "message_count", "total_tokens", "usable_tokens", "pressure", "quality")


@_query(
    "agg09_largest_consumers",
    f"""WITH {RULED}, labelled AS (
  SELECT session_id, name || coalesce(':' || file, '') || CASE WHEN rule IN ('R05', 'R08') THEN ' (old)' ELSE '' END AS label, sum(tokens)::BIGINT AS tokens, min(message_index) AS first FROM classed GROUP BY ALL)
SELECT session_id, rank::INT AS rank, label, tokens FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY tokens DESC, first) AS rank FROM labelled) WHERE rank <= 5""",
)
def _(spark, sf_dir):
    return analysis.largest_consumers(_classified(spark, sf_dir))


def _acted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prune.actions(_classified(spark, sf_dir))


STUBBED = RULED + r""", stubs AS (
  SELECT *, '[threadloom] ' || name || ' result pruned (~' || CASE WHEN tokens >= 1000 THEN printf('%.1f', (tokens + CASE WHEN tokens % 1000 = 250 THEN 1 ELSE 0 END) / 1000.0::DOUBLE) || 'K' ELSE tokens::VARCHAR END || ' tokens) — ' || reason
    || '. The original output is preserved in session history; re-run the command or re-read the file if you need it again.' AS stub FROM freed WHERE class IN ('stale', 'disposable') AND tokens >= 50
), acted AS (
  SELECT session_id, message_index, name AS tool, reason, tokens AS tokens_before, (3 * length(stub) + 11) // 12 + 24 AS tokens_after, stub FROM stubs WHERE (3 * length(stub) + 11) // 12 + 24 < tokens
)"""


@_query("rw02_stubs", f"WITH {STUBBED} SELECT session_id, message_index::INT AS message_index, tool, reason, tokens_before::BIGINT AS tokens_before, tokens_after::BIGINT AS tokens_after, stub FROM acted")
def _(spark, sf_dir):
    rows = _acted(spark, sf_dir).where("kind = 'stub'")
    return rows.select("session_id", "message_index", F.col("source").alias("tool"), "reason", F.col("estimated_tokens").alias("tokens_before"), F.col("new_tokens").alias("tokens_after"), F.col("replacement").alias("stub"))


@_query("agg10_stubs_by_reason", f"WITH {STUBBED}, per AS (SELECT session_id, reason, count(*) AS n, min(message_index) AS first FROM acted GROUP BY ALL) SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, first)::INT AS rank, reason, n FROM per")
def _(spark, sf_dir):
    return prune.actions_by_reason(_acted(spark, sf_dir).where("kind <> 'fold'"))


ACTED = STUBBED + r""", folds AS (
  SELECT *, string_split(text, chr(10)) AS lines, len(string_split(text, chr(10))) AS n FROM freed WHERE class = 'working' AND oversized AND tokens >= 50
), folded AS (
  SELECT *, CASE WHEN name = 'bash' AND n <= 18 OR name <> 'bash' AND n <= 63 THEN text
    WHEN name = 'bash' THEN '[bash output folded by threadloom — full output remains in session history]' || chr(10) || 'command: ' || command || chr(10) || chr(10) || '-- head --' || chr(10) || array_to_string(lines[1:8], chr(10))
      || chr(10) || chr(10) || '-- tail --' || chr(10) || array_to_string(lines[n - 5:n], chr(10)) || chr(10) || chr(10) || '(' || (n - 14) || ' lines folded)'
    ELSE left(array_to_string(lines[1:40], chr(10)) || chr(10) || chr(10) || '[threadloom … ' || (n - 60) || ' lines folded …]' || chr(10) || chr(10) || array_to_string(lines[n - 19:n], chr(10)), 4400) END AS whole FROM folds
), cut AS (
  SELECT *, CASE WHEN name = 'bash' AND n > 18 AND length(whole) > 2200 THEN left(whole, 2200) || chr(10) || '…[truncated]' ELSE whole END AS fold FROM folded
), acts AS (
  SELECT session_id, message_index, 'stub' AS kind, tool, reason, tokens_before, tokens_after, stub AS replacement FROM acted
  UNION ALL SELECT session_id, message_index, 'fold', name, reason, tokens, (3 * length(fold) + 11) // 12 + 24, fold FROM cut WHERE (3 * length(fold) + 11) // 12 + 24 < tokens
)"""
PRUNED = ACTED + rf""", results AS (
  SELECT f.session_id, f.message_index, 'toolResult' AS role, f.tool_call_id, coalesce(a.replacement, f.text) AS text, f.class, f.oversized,
    CASE WHEN a.kind IS NULL THEN f.tokens ELSE (3 * length(a.replacement) + 11) // 12 + 16 + least(256, (3 * length('{{"engine":"threadloom","kind":"' || a.kind || '","tool":"' || a.tool || '","reason":"' || a.reason || '","originalTokens":' || a.tokens_before || ',"at":"{AT}"}}') + 11) // 12) END AS tokens
  FROM freed f LEFT JOIN acts a USING (session_id, message_index)
), pruned AS (
  SELECT * FROM results
  UNION ALL SELECT k.session_id, k.message_index - 1, 'assistant', NULL, 'call:' || name || '(' || {ARGUMENTS} || ')', 'working', false, c.tokens FROM keyed k JOIN callers c ON k.session_id = c.session_id AND c.message_index = k.message_index - 1
  UNION ALL SELECT DISTINCT session_id, 0, 'user', NULL, 'work through the list', 'critical', false, (3 * 21 + 11) // 12 + 16 FROM keyed
)"""


@_query("rw01_prune_actions", f"WITH {ACTED} SELECT session_id, message_index::INT AS message_index, kind, tool, reason, tokens_before::BIGINT AS tokens_before, tokens_after::BIGINT AS tokens_after FROM acts")
def _(spark, sf_dir):
    return prune.action_rows(_acted(spark, sf_dir))


@_query("rw01_folds", f"WITH {ACTED} SELECT session_id, message_index::INT AS message_index, replacement AS fold FROM acts WHERE kind = 'fold'")
def _(spark, sf_dir):
    return _acted(spark, sf_dir).where("kind = 'fold'").select("session_id", "message_index", F.col("replacement").alias("fold"))


@_query("rw01_pruned_messages", f"WITH {PRUNED} SELECT session_id, message_index::INT AS message_index, role, tool_call_id, text, tokens::BIGINT AS tokens FROM pruned")
def _(spark, sf_dir):
    rows = prune.rewritten(_acted(spark, sf_dir), AT)
    return rows.select("session_id", "message_index", "role", "tool_call_id", tk.message_text().alias("text"), tk.message_tokens().alias("tokens"))


@_query("snk08_effective_messages", f"WITH {PRUNED} SELECT session_id, message_index::INT AS message_index, text FROM pruned SEMI JOIN acts USING (session_id)")
def _(spark, sf_dir):
    return prune.effective(_acted(spark, sf_dir), AT).select("session_id", "message_index", tk.message_text().alias("text"))


@_query("agg08_action_summary", f"WITH {ACTED} SELECT session_id, count(*) AS n_actions, sum(tokens_before - tokens_after)::BIGINT AS removed_tokens, sum(tokens_after)::BIGINT AS preserved_tokens FROM acts GROUP BY session_id")
def _(spark, sf_dir):
    return prune.action_summary(_acted(spark, sf_dir))


@_query(
    "agg07_recomputed",
    f"""WITH {PRUNED}, sums AS (
  SELECT session_id, sum(tokens)::BIGINT AS raw_tokens, coalesce(sum(tokens) FILTER (class IN ('critical', 'working')), 0) AS kept,
    coalesce(sum(CASE WHEN role <> 'toolResult' OR tokens < 50 THEN 0 WHEN class IN ('stale', 'disposable') THEN greatest(tokens - 80, 0) WHEN class = 'working' AND oversized THEN greatest(tokens - 260, 0) ELSE 0 END), 0)::BIGINT AS reclaimable_tokens
  FROM pruned GROUP BY session_id)
SELECT session_id, raw_tokens, raw_tokens + 4000 AS total_tokens, round(least(2.0, (raw_tokens + 4000) / 20480.0::DOUBLE), 6) AS pressure, round(kept / raw_tokens::DOUBLE, 6) AS quality, reclaimable_tokens FROM sums""",
)
def _(spark, sf_dir):
    return _rounded(prune.recomputed(_acted(spark, sf_dir), AT, window=CONTEXT_WINDOW)).select("session_id", "raw_tokens", "total_tokens", "pressure", "quality", "reclaimable_tokens")


@_query(
    "jn04_pinned_messages",
    f"WITH {CHAT} SELECT session_id, message_index::INT AS message_index, (contains(lower(text), 'the') OR contains(lower(text), 'que')) AS pinned, CASE WHEN contains(lower(text), 'the') OR contains(lower(text), 'que') OR role = 'user' THEN 'critical' ELSE 'working' END AS class FROM chat",
)
def _(spark, sf_dir):
    return items.classify(_chat(spark, sf_dir), _pins(spark, sf_dir)).select("session_id", "message_index", "pinned", "class")


@_query(
    "jn05_missing_pins",
    f"""WITH {CHAT}, corpus AS (SELECT session_id, lower(coalesce(string_agg(text, chr(10) ORDER BY message_index) FILTER (role IN ('user', 'assistant')), '')) AS c FROM chat GROUP BY session_id),
p(id, type, needle) AS (VALUES ('p1', 'constraint', 'the'), ('p2', 'file', 'src/none.py'), ('p3', 'note', 'que'))
SELECT session_id, id, type FROM corpus, p WHERE NOT contains(c, needle)""",
)
def _(spark, sf_dir):
    return pins.missing_pins(_chat(spark, sf_dir), _pins(spark, sf_dir)).select("session_id", "id", "type")


@_query(
    "rw06_pins_reinjected",
    f"""WITH {CHAT}, corpus AS (SELECT session_id, max(message_index) + 1 AS place, lower(coalesce(string_agg(text, chr(10) ORDER BY message_index) FILTER (role IN ('user', 'assistant')), '')) AS c FROM chat GROUP BY session_id),
p(id, line, needle) AS (VALUES (1, '- [constraint]  The ', 'the'), (2, '- [file] pinned file: src/none.py', 'src/none.py'), (3, '- [note] que', 'que'))
SELECT session_id, place::INT AS message_index, '[threadloom] Pinned context (must be respected across prune/compact/handoff):' || chr(10) || string_agg(line, chr(10) ORDER BY id) AS content_text FROM corpus, p WHERE NOT contains(c, needle) GROUP BY session_id, place""",
)
def _(spark, sf_dir):
    return pins.with_pins(_chat(spark, sf_dir), _pins(spark, sf_dir), 0).where("role = 'custom'").select("session_id", "message_index", "content_text")


@_query("cat11_pin_types", f"""WITH {CHAT} SELECT session_id, message_index::INT AS message_index, CASE
  WHEN regexp_matches(lower(text), '\\b(don''?t|do not|never|must not)\\b') THEN 'constraint' WHEN regexp_matches(lower(text), '\\b(should|must|require|requires)\\b') THEN 'requirement'
  WHEN regexp_matches(lower(text), '\\b(npm|pnpm|yarn|pip|uv|cargo|git|docker|make|pytest|jest)\\b') AND length(text) < 120 THEN 'command' ELSE 'note' END AS type FROM chat""")  # fmt: skip
def _(spark, sf_dir):
    return _chat(spark, sf_dir).select("session_id", "message_index", tx.pin_type(F.col("content_text")).alias("type"))


@_query(
    "str03_decisions",
    f"""WITH {RULED} SELECT session_id, CASE WHEN pressure < 0.55 AND quality > 0.6 THEN 'none' WHEN pressure >= 0.65 AND reclaimable_tokens >= 5000 THEN 'prune' WHEN pressure >= 0.8 THEN 'checkpoint' WHEN pressure >= 0.88 THEN 'compact' ELSE 'none' END AS action,
  CASE WHEN pressure < 0.55 THEN 'green' WHEN pressure < 0.7 THEN 'yellow' WHEN pressure < 0.82 THEN 'orange' WHEN pressure < 0.9 THEN 'red' ELSE 'critical' END AS band,
  (CASE WHEN pressure >= 0.88 THEN 20 WHEN pressure >= 0.8 THEN 30 ELSE 50 END)::INT AS stub_min FROM analysed""",
)
def _(spark, sf_dir):
    rows = config.with_thresholds(_rounded(_analysed(spark, sf_dir)).withColumn("model", F.lit("any/model")), config.DEFAULTS)
    action, _reason = policy.decided(F.lit(False))
    return rows.select("session_id", action.alias("action"), tx.band_label(F.col("pressure")).alias("band"), config.prune_band(config.DEFAULTS, F.col("pressure"))[0].alias("stub_min"))


@_query(
    "cat15_model_thresholds",
    """SELECT CAST(user_id AS VARCHAR) AS session_id, CASE WHEN user_id % 3 = 0 THEN 0.55::DOUBLE ELSE 0.65::DOUBLE END AS prune_enter, CASE WHEN user_id % 3 = 0 THEN 0.45::DOUBLE ELSE 0.55::DOUBLE END AS prune_exit,
  CASE WHEN user_id % 3 = 0 THEN 0.78::DOUBLE ELSE 0.88::DOUBLE END AS compact_enter, 0.94::DOUBLE AS handoff_enter FROM (SELECT DISTINCT user_id FROM events)""",
)
def _(spark, sf_dir):
    users = _read(spark, sf_dir, "events").select("user_id").distinct()
    rows = users.select(F.col("user_id").cast("string").alias("session_id"), F.when(F.col("user_id") % 3 == 0, "qwen-cloud/max").otherwise("other/qwen").alias("model"))
    return config.with_thresholds(rows, config.DEFAULTS).select("session_id", "prune_enter", "prune_exit", "compact_enter", "handoff_enter")


TURN_SQL = r"""
turns AS (
  SELECT CAST(user_id AS VARCHAR) AS session_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id))::INT AS turn, least(2.0, round(value / 50.0, 4)) AS pressure, event_id FROM events
)"""


def turn_series(events: DataFrame) -> DataFrame:
    """A series of turns per user: the pressure swings with the events' values."""
    from pyspark.sql import Window

    turn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    k = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0))
    pressure = F.least(F.lit(1.2), F.lit(0.4) + (k % 60) / 100.0)
    return events.select(
        F.col("user_id").cast("string").alias("session_id"), turn.alias("turn"), (turn * 20_000).cast("long").alias("now_ms"), pressure.alias("pressure"), F.lit(0.5).alias("quality"),
        (pressure * 20_480).cast("long").alias("total_tokens"), F.lit(20_480).cast("long").alias("usable_tokens"), (k * 100).alias("reclaimable_tokens"), (2 * turn).cast("int").alias("message_count"),
        F.when(k % 2 == 0, pressure - 0.2).alias("pressure_after_prune"), (F.col("event_type") == "signup").alias("compact_event"), (k % 3 != 0).alias("checkpoint_ok"), F.lit(None).cast("string").alias("model"),
    )


@_query("str10_policy_fold")
def _(spark, sf_dir):
    return policy.fold_turns(turn_series(_read(spark, sf_dir, "events")))


@_query(
    "win05_recent_actions",
    """WITH t AS (SELECT CAST(user_id AS VARCHAR) AS session_id, event_type AS action, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id))::INT AS turn FROM events)
SELECT session_id, action, turn, count(*) OVER (PARTITION BY session_id, action ORDER BY turn RANGE BETWEEN 9 PRECEDING AND 1 PRECEDING) AS n_before FROM t""",
)
def _(spark, sf_dir):
    from pyspark.sql import Window

    turn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return policy.recent_actions(_read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("action"), turn.alias("turn")))


@_query(
    "win04_calibration",
    """WITH t AS (SELECT CAST(user_id AS VARCHAR) AS session_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id))::INT AS turn, CASE WHEN event_id % 4 <> 0 THEN floor(value * 10) END AS reported FROM events),
s AS (SELECT *, CASE WHEN reported > 0 THEN reported / 100.0::DOUBLE END AS v, sum(CASE WHEN reported > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY turn) AS n FROM t)
SELECT session_id, turn, round(coalesce(avg(v) OVER (PARTITION BY session_id ORDER BY n RANGE BETWEEN 19 PRECEDING AND CURRENT ROW), 1.0), 6) AS ratio FROM s""",
)
def _(spark, sf_dir):
    from pyspark.sql import Window

    turn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    samples = _read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), turn.alias("turn"), F.when(F.col("event_id") % 4 != 0, F.floor(F.col("value") * 10)).alias("reported"), F.lit(100).alias("estimated"))
    return analysis.calibration(samples).select("session_id", "turn", F.round("ratio", 6).alias("ratio"))


@_query(
    "cp01_serialized_chats",
    rf"""WITH {CHAT} , s AS (SELECT session_id, message_index, CASE role WHEN 'user' THEN 'User: ' WHEN 'assistant' THEN 'Assistant: ' END || regexp_replace(text, '^\s+|\s+$', '', 'g') AS s FROM chat WHERE role IN ('user', 'assistant') AND regexp_replace(text, '^\s+|\s+$', '', 'g') <> '')
SELECT c.session_id, coalesce(string_agg(s, chr(10) || chr(10) ORDER BY s.message_index), '') AS text FROM (SELECT DISTINCT session_id FROM chat) c LEFT JOIN s USING (session_id) GROUP BY c.session_id""",
)
def _(spark, sf_dir):
    return checkpoints.serialized(_chat(spark, sf_dir))


SECTIONS = TRACE + rf""", sections AS (
  SELECT session_id, 0 AS message_index, 'User: work through the list' AS s FROM (SELECT DISTINCT session_id FROM keyed)
  UNION ALL SELECT session_id, message_index - 1, 'Assistant: call:' || name || '(' || {ARGUMENTS} || ')' || chr(10) || 'Tool ' || name || ' ' || left({ARGUMENTS}, 200) FROM keyed
  UNION ALL SELECT session_id, message_index, 'Result(' || name || CASE WHEN is_error THEN ' [ERROR]' ELSE '' END || '): ' || replace(CASE WHEN length(t) > 400 THEN left(t, 400) || ' …[truncated]' ELSE t END, chr(10), ' ') FROM (SELECT *, rtrim(text, chr(10) || ' ') AS t FROM keyed)
), bodies AS (SELECT session_id, string_agg(s, chr(10) || chr(10) ORDER BY message_index) AS body FROM sections GROUP BY session_id)"""
_HEAD = "User (Initial Goal): work through the list"


def _cut(most: int) -> str:
    """The body, or its end behind the goal, in SQL."""
    return f"CASE WHEN length(body) <= {most} THEN body ELSE '{_HEAD}' || chr(10) || chr(10) || '[... earlier conversation truncated ...]' || chr(10) || chr(10) || right(body, {max(1000, most - len(_HEAD) - 4)}) END"


@_query("cp01_serialized_tools", f"WITH {SECTIONS} SELECT session_id, {_cut(4000)} AS text FROM bodies")
def _(spark, sf_dir):
    return checkpoints.serialized(_trace(spark, sf_dir), max_total=4000)


@_query("cp01_serialized_whole", f"WITH {SECTIONS} SELECT session_id, {_cut(120_000)} AS text FROM bodies")
def _(spark, sf_dir):
    return checkpoints.serialized(_trace(spark, sf_dir))


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reply per chat session: raw, fenced, wrapped in prose or broken."""
    lists = '"requirements":[],"constraints":["keep it"],"decisions":[],"files":{"inspected":[],"modified":["a.py"],"created":[],"deleted":[]},"verification":{"passed":[],"failed":[],"pending":[]},"next_actions":["go on"]'
    ids = _read(spark, sf_dir, "conversations").select("conv_id").distinct()
    good = F.concat(F.lit('{"version":1,"task":{"goal":"g'), F.col("conv_id").cast("string"), F.lit('"},' + lists + "}"))
    return ids.select(
        F.col("conv_id").cast("string").alias("session_id"),
        F.when(F.col("conv_id") % 4 == 0, good).when(F.col("conv_id") % 4 == 1, F.concat(F.lit("```json\n"), good, F.lit("\n```")))
        .when(F.col("conv_id") % 4 == 2, F.concat(F.lit("Here it is: "), good, F.lit(" done"))).otherwise('{"version":2,"task":{"goal":" "}}').alias("reply"),
    )


@_query("cp03_validated", "SELECT DISTINCT CAST(conv_id AS VARCHAR) AS session_id, conv_id % 4 <> 3 AS ok, (CASE WHEN conv_id % 4 = 3 THEN 13 ELSE 0 END)::INT AS n_errors FROM conversations")
def _(spark, sf_dir):
    return checkpoints.validated(_replies(spark, sf_dir)).select("session_id", "ok", F.size("errors").alias("n_errors"))


@_query(
    "ho01_handoff_prompts",
    r"""WITH c AS (SELECT DISTINCT conv_id, conv_id % 4 <> 3 AS good FROM conversations)
SELECT CAST(conv_id AS VARCHAR) AS session_id, array_to_string([
  'You are continuing an existing coding task. Continue directly from the state below; do not ask the user to repeat it.', '',
  '## Goal', CASE WHEN good THEN 'g' || conv_id ELSE '(no goal recorded — infer from the state below)' END, '',
  '## Hard constraints', CASE WHEN good THEN '- keep it' || chr(10) ELSE '' END || '-  The ', '',
  '## Current state', CASE WHEN good THEN array_to_string(['Phase: in_progress · Status: in_progress', '', '## Modified files', '- modified: a.py', '', '## Verification', '- (none recorded)'], chr(10)) ELSE '(no checkpoint available — inspect the repository to reconstruct state)' END, '',
  '## Next action', CASE WHEN good THEN 'go on (remaining: none)' ELSE '(none recorded — propose the next step to the user)' END, '',
  'Continue directly from this state.'], chr(10)) AS prompt FROM c""",
)
def _(spark, sf_dir):
    return checkpoints.handoff_prompts(checkpoints.validated(_replies(spark, sf_dir)).where("ok"), _pins(spark, sf_dir))


@_query(
    "cp06_compact_instructions",
    r"""SELECT DISTINCT CAST(conv_id AS VARCHAR) AS session_id, 'Keep the recovery state intact: goal, explicit user constraints, current implementation state, files touched, verification status, and next actions.' || chr(10)
  || CASE WHEN conv_id % 4 <> 3 THEN 'Hard constraints: keep it;  The .' || chr(10) || 'Next action: go on.' ELSE 'Hard constraints:  The .' END AS instructions FROM conversations""",
)
def _(spark, sf_dir):
    return checkpoints.compact_instructions(checkpoints.validated(_replies(spark, sf_dir)).where("ok"), _pins(spark, sf_dir))


DECIDED = r"""judged AS (
  SELECT *, least(2.0, total_tokens / 20480.0::DOUBLE) AS p, (critical_tokens + working_tokens) / raw_tokens::DOUBLE AS q FROM analysed
), planned AS (
  SELECT *, CASE WHEN p < 0.55 AND q > 0.6 THEN 'none' WHEN p >= 0.65 AND reclaimable_tokens >= 5000 THEN 'prune' WHEN p >= 0.8 THEN 'checkpoint' WHEN p >= 0.88 THEN 'compact' ELSE 'none' END AS action, floor(p * 100 + 0.5)::INT || '%' AS shown FROM judged
)"""
_PERCENT = "printf('%.1f', floor({x} * 1000 + 0.5) / 10) || '%'"


@_query(
    "rp01_context_reports",
    f"""WITH {RULED}, {DECIDED}, labelled AS (
  SELECT session_id, name || coalesce(':' || file, '') || CASE WHEN rule IN ('R05', 'R08') THEN ' (old)' ELSE '' END AS label, sum(tokens)::BIGINT AS n, min(message_index) AS first FROM classed GROUP BY ALL
), top AS (
  SELECT session_id, string_agg(r || '. ' || label || '  ' || {_k('n')}, chr(10) ORDER BY r) AS lines FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, first) AS r FROM labelled) WHERE r <= 5 GROUP BY session_id)
SELECT session_id, array_to_string(list_filter([
  'Context Engine' || chr(10), 'Model:' || chr(10) || 'any/model' || chr(10), 'Window:', '20,480 usable' || chr(10), 'Estimated usage:', format('{{:,}}', total_tokens) || ' / 20,480  (' || {_PERCENT.format(x='p')} || ')',
  'Band: ' || CASE WHEN p < 0.55 THEN 'green' WHEN p < 0.7 THEN 'yellow' WHEN p < 0.82 THEN 'orange' WHEN p < 0.9 THEN 'red' ELSE 'critical' END || '  ·  Quality: ' || {_PERCENT.format(x='q')} || chr(10), 'Classification:',
  'critical     ' || {_k('critical_tokens')} || '   working    ' || {_k('working_tokens')}, 'stale        ' || {_k('stale_tokens')} || '   disposable ' || {_k('disposable_tokens')} || chr(10),
  'Largest consumers:' || chr(10) || lines || chr(10), 'Pins: 0', 'Compactions: 0', 'Checkpoint: none/stale' || chr(10), 'Recommendation: ' || upper(action),
  CASE WHEN reclaimable_tokens > 0 THEN 'Estimated reclaimable: ' || {_k('reclaimable_tokens')} || ' tokens' END,
  CASE action WHEN 'prune' THEN 'Reason: pressure ' || shown || ' with ~' || reclaimable_tokens || ' reclaimable tokens' WHEN 'checkpoint' THEN 'Reason: pressure ' || shown || ' and no fresh checkpoint' WHEN 'compact' THEN 'Reason: pressure ' || shown || ' past compact threshold' END
], lambda x: x IS NOT NULL), chr(10)) AS report FROM planned LEFT JOIN top USING (session_id)""",
)
def _(spark, sf_dir):
    rows = analysis.analyze_with_consumers(_classified(spark, sf_dir), window=CONTEXT_WINDOW)
    action, reason = policy.decided(F.lit(False))
    rows = config.with_thresholds(rows.withColumn("model", F.lit("any/model")), config.DEFAULTS)
    return reports.context_reports(rows.withColumns({"action": action, "reason": reason}))


@_query(
    "rp02_clean_reports",
    f"""WITH {ACTED}, why AS (SELECT session_id, string_agg('- ' || n || ' × ' || reason, chr(10) ORDER BY n DESC, first) AS lines FROM (SELECT session_id, reason, count(*) AS n, min(message_index) AS first FROM acts GROUP BY ALL) GROUP BY session_id
), saves AS (SELECT session_id, sum(tokens_before - tokens_after)::BIGINT AS saved, count(*) FILTER (kind = 'stub') AS stubs, count(*) FILTER (kind = 'fold') AS folds FROM acts GROUP BY session_id
), rows AS (SELECT session_id, total_tokens AS total, coalesce(saved, 0) AS saved, total_tokens - coalesce(saved, 0) AS rest, coalesce(stubs, 0) AS stubs, coalesce(folds, 0) AS folds, coalesce(lines, '- nothing to prune') AS lines FROM analysed LEFT JOIN saves USING (session_id) LEFT JOIN why USING (session_id))
SELECT session_id, array_to_string(['Context clean' || chr(10) || chr(10) || 'Before: ' || {_k('total')}, 'After:  ' || {_k('rest')}, 'Saved:  ' || {_k('saved')} || ' (' || {_PERCENT.format(x='(saved / total::DOUBLE)')} || ' of context)' || chr(10), 'Pruned:', lines,
  chr(10) || '(' || stubs || ' stubbed, ' || folds || ' folded — originals remain in session history)'], chr(10)) AS report FROM rows""",
)
def _(spark, sf_dir):
    return reports.clean_reports(_acted(spark, sf_dir), window=CONTEXT_WINDOW)


@_query("snk05_prune_log", f"WITH {ACTED} SELECT session_id, kind AS action, 'toolResult:' || message_index AS item_id, tool, 'auto' AS mode, tokens_before::BIGINT AS original_tokens, tokens_after::BIGINT AS replacement_tokens, reason FROM acts")
def _(spark, sf_dir):
    return logs.prune_log(_acted(spark, sf_dir), AT).drop("time", "tags")


@_query("snk05_prune_events", f"WITH {ACTED} SELECT a.session_id, 'prune' AS action, 'auto' AS mode, count(*) AS actions, any_value(total_tokens)::BIGINT AS tokens_before, (any_value(total_tokens) - sum(tokens_before - tokens_after))::BIGINT AS tokens_after, sum(tokens_before - tokens_after)::BIGINT AS saved FROM acts a JOIN analysed USING (session_id) GROUP BY a.session_id")
def _(spark, sf_dir):
    return commands.pass_events(_acted(spark, sf_dir), AT, window=CONTEXT_WINDOW).drop("time")


PIN_TYPE = """CASE WHEN regexp_matches(lower(t), '\\b(don''?t|do not|never|must not)\\b') THEN 'constraint' WHEN regexp_matches(lower(t), '\\b(should|must|require|requires)\\b') THEN 'requirement'
  WHEN regexp_matches(lower(t), '\\b(npm|pnpm|yarn|pip|uv|cargo|git|docker|make|pytest|jest)\\b') AND length(t) < 120 THEN 'command' ELSE 'note' END"""


@_query("cmd_pin_last", rf"WITH {CHAT}, last AS (SELECT session_id, regexp_replace(arg_max(text, message_index), '^\s+|\s+$', '', 'g') AS t FROM chat WHERE role = 'user' GROUP BY session_id) SELECT session_id, {PIN_TYPE} AS type, left(t, 500) AS content FROM last WHERE t <> ''")
def _(spark, sf_dir):
    return commands.pin_last(_chat(spark, sf_dir), 0).select("session_id", "type", "content")


@_query("cmd_pins", "SELECT DISTINCT CAST(conv_id AS VARCHAR) AS session_id, '✓ p1 [constraint]  The ' || chr(10) || '✓ p2 [file] src/none.py' || chr(10) || '✓ p3 [note] que' AS text FROM conversations")
def _(spark, sf_dir):
    return commands.pin_lists(_pins(spark, sf_dir))


@_query(
    "cp04_checkpoint_prompts",
    rf"""WITH {CHAT} , s AS (SELECT session_id, message_index, CASE role WHEN 'user' THEN 'User: ' WHEN 'assistant' THEN 'Assistant: ' END || regexp_replace(text, '^\s+|\s+$', '', 'g') AS s FROM chat WHERE role IN ('user', 'assistant') AND regexp_replace(text, '^\s+|\s+$', '', 'g') <> ''),
b AS (SELECT c.session_id, coalesce(string_agg(s, chr(10) || chr(10) ORDER BY s.message_index), '') AS text FROM (SELECT DISTINCT session_id FROM chat) c LEFT JOIN s USING (session_id) GROUP BY c.session_id)
SELECT session_id, CASE WHEN text <> '' THEN 'Generate the recovery checkpoint for this coding session.' || chr(10) || 'Hard pins (must appear in constraints):  The  | pinned file: src/none.py | que' || chr(10) || '<conversation>' || chr(10) || text || chr(10) || '</conversation>' END AS prompt FROM b""",
)
def _(spark, sf_dir):
    return checkpoints.checkpoint_prompts(_chat(spark, sf_dir), _pins(spark, sf_dir)).select("session_id", "prompt")


#: A reply with fields that no checkpoint has, a meta of its own, states left out, and texts with space around them.
_LOOSE = (
    '{"meta":{"by":"me"},"mood":"good","task":{"goal":" g', '\\n","extra":1},"requirements":[" r "],"constraints":["keep it"],"decisions":[{"decision":" use b ","why":"x"},{"decision":"c","reason":" r ","status":"abandoned"}],'
    '"files":{"inspected":[],"modified":["a.py"],"created":[],"deleted":[],"moved":["z"]},"verification":{"passed":[],"failed":[],"pending":[" t "]},"issues":[{"description":"slow "}],"next_actions":["go on"]}'
)


@_query(
    "cp05_generated_checkpoints",
    """SELECT DISTINCT CAST(conv_id AS VARCHAR) AS session_id, conv_id % 4 <> 3 OR conv_id % 8 = 7 AS ok,
  CASE WHEN conv_id % 8 = 7 THEN '{"version":1,"created_at":"2024-01-01T00:00:00.000Z","task":{"goal":"g' || conv_id || '","phase":"in_progress","status":"in_progress"},"requirements":[" r "],"constraints":["keep it"],"decisions":[{"decision":"use b","reason":"","status":"active"},{"decision":"c","reason":" r ","status":"abandoned"}],"files":{"inspected":[],"modified":["a.py"],"created":[],"deleted":[]},"verification":{"passed":[],"failed":[],"pending":[" t "]},"issues":[{"description":"slow","status":"open"}],"next_actions":["go on"],"meta":{"session_id":"'
  || conv_id || '","tokens_before":7,"source":"auto"}}'
  WHEN conv_id % 4 <> 3 THEN '{"version":1,"created_at":"2024-01-01T00:00:00.000Z","task":{"goal":"g' || conv_id || '","phase":"in_progress","status":"in_progress"},"requirements":[],"constraints":["keep it"],"decisions":[],"files":{"inspected":[],"modified":["a.py"],"created":[],"deleted":[]},"verification":{"passed":[],"failed":[],"pending":[]},"issues":[],"next_actions":["go on"],"meta":{"session_id":"'
  || conv_id || '","tokens_before":7,"source":"auto"}}' END AS checkpoint FROM conversations""",
)
def _(spark, sf_dir):
    loose = F.concat(F.lit(_LOOSE[0]), "session_id", F.lit(_LOOSE[1]))
    replies = _replies(spark, sf_dir).withColumns({"source": F.lit("auto"), "tokens_before": F.lit(7).cast("long")})
    replies = replies.withColumn("reply", F.when(F.col("session_id").cast("long") % 8 == 7, loose).otherwise(F.col("reply")))
    return checkpoints.generated(checkpoints.checkpoint_prompts(_chat(spark, sf_dir)), replies, AT).select("session_id", "ok", "checkpoint")


@_query(
    "snk07_turn_metrics",
    """WITH t AS (SELECT CAST(user_id AS VARCHAR) AS session_id, row_number() OVER w AS turn, event_id, count(*) FILTER (event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS compactions FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT session_id, 'metric' AS action, event_id AS context_tokens, compactions::INT AS compactions FROM t WHERE event_id % 3 <> 0""",
)
def _(spark, sf_dir):
    from pyspark.sql import Window

    events = _read(spark, sf_dir, "events")
    turn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    usage = events.select(F.col("user_id").cast("string").alias("session_id"), turn.alias("turn"), F.lit(AT).alias("time"), F.when(F.col("event_id") % 3 != 0, F.col("event_id")).alias("tokens"), F.lit(None).cast("double").alias("percent"))
    return logs.turn_metrics(usage, policy.fold_turns(turn_series(events))).select("session_id", "action", "context_tokens", "compactions")


# ---- the pass at each model call ----
_PLACED, _RULED, _CALLERS = (RULED.index(x) for x in (", placed AS (", ", ruled AS (", ", callers AS ("))
CALL_STEPS = RULED[:_PLACED] + r""", changes_at AS (
  SELECT keyed.*, tokens >= 1000 AS big, lead(message_index, 8) OVER (PARTITION BY session_id ORDER BY message_index) AS old_at,
    CASE WHEN name = 'read' THEN by_read WHEN group_key IS NOT NULL THEN lead(message_index) OVER (PARTITION BY session_id, group_key ORDER BY message_index) END AS sup_at
  FROM keyed LEFT JOIN later USING (session_id, message_index)
), pieces AS (
  SELECT *, unnest(list_sort(list_distinct(list_filter([message_index, sup_at, old_at], lambda x: x IS NOT NULL)))) AS since FROM changes_at
), placed AS (
  SELECT *, CASE WHEN sup_at <= since THEN sup_at END AS sup, old_at IS NULL OR since < old_at AS fresh, lead(since) OVER (PARTITION BY session_id, message_index ORDER BY since) AS until FROM pieces
)""" + RULED[_RULED:_CALLERS] + r""", callers AS (
  SELECT session_id, message_index - 1 AS message_index, 24 + (3 * length(name) + 11) // 12 + 6 + (3 * length(ARGUMENTS) + 11) // 12 AS tokens FROM keyed
), everything AS (
  SELECT session_id, since, until, tokens, CASE WHEN pinned THEN 'critical' ELSE class END AS class, CASE WHEN pinned THEN 0 ELSE reclaimable END AS reclaimable
  FROM (SELECT *, path = 'src/f3.py' AND CAST(session_id AS BIGINT) % 2 = 0 AS pinned FROM freed)
  UNION ALL SELECT session_id, message_index, NULL, tokens, 'working', 0 FROM callers
  UNION ALL SELECT DISTINCT session_id, 0, NULL, (3 * 21 + 11) // 12 + 16, 'critical', 0 FROM keyed
), asked AS (
  SELECT session_id, (seq + 1)::INT AS turn, 2 * seq + 1 AS at, CAST(session_id AS BIGINT) % 2 = 0 AND coalesce(min(CASE WHEN path = 'src/f3.py' THEN seq END) OVER (PARTITION BY session_id) >= seq, TRUE) AS missing FROM keyed
), summed AS (
  SELECT a.session_id, turn, any_value(missing) AS missing, sum(tokens) AS raw_tokens, coalesce(sum(tokens) FILTER (class IN ('critical', 'working')), 0) AS good, sum(reclaimable) AS reclaimable_tokens, count(*) AS message_count
  FROM asked a JOIN everything e ON e.session_id = a.session_id AND e.since < a.at AND (e.until IS NULL OR e.until >= a.at) GROUP BY a.session_id, turn
)
SELECT session_id, turn, raw_tokens::BIGINT AS raw_tokens, (raw_tokens + 4000)::BIGINT AS total_tokens, reclaimable_tokens::BIGINT AS reclaimable_tokens, message_count::INT AS message_count,
  floor(least(2.0, (raw_tokens + 4000) / 20480.0::DOUBLE) * 1000000)::BIGINT AS pressure_millionths, floor(good / raw_tokens::DOUBLE * 1000000)::BIGINT AS quality_millionths, missing::INT AS pins_missing FROM summed""".replace("ARGUMENTS", ARGUMENTS)


def _seen_at_calls(rows: DataFrame) -> DataFrame:
    whole = [F.floor(F.col(c) * 1_000_000).cast("long").alias(f"{c}_millionths") for c in ("pressure", "quality")]
    return rows.select("session_id", "turn", "raw_tokens", "total_tokens", "reclaimable_tokens", "message_count", *whole, "pins_missing")


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model call before each tool call of a trace, 20 seconds apart."""
    rows = traces.tool_events(_read(spark, sf_dir, "events"))
    known = {"turn": F.col("seq") + 1, "message_index": 2 * F.col("seq") + 1, "now_ms": (F.col("seq") + 1) * 20_000, "context_window": F.lit(CONTEXT_WINDOW), "model": F.lit("any/model")}
    return rows.select("session_id", *((known.get(c, F.lit(None)).cast(t)).alias(c) for c, t in (f.split(" ") for f in steps.CALLS.split(", ")[1:])))


def _trace_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pinned file for every second session."""
    users = _read(spark, sf_dir, "events").select("user_id").distinct().where("user_id % 2 = 0")
    return users.select(F.col("user_id").cast("string").alias("session_id"), F.lit("p1").alias("id"), F.lit("file").alias("type"), F.lit("src/f3.py").alias("content"), F.lit(1).cast("long").alias("created_at"), F.lit(True).alias("active"))


@_query("str10_observed_calls", f"WITH {CALL_STEPS}")
def _(spark, sf_dir):
    return _seen_at_calls(steps.observed(_trace(spark, sf_dir), _calls(spark, sf_dir), _trace_pins(spark, sf_dir)))


@_query("str10_context_steps")
def _(spark, sf_dir):
    return steps.context_steps(_trace(spark, sf_dir), _calls(spark, sf_dir), _trace_pins(spark, sf_dir))


def _streamed(spark: SparkSession, sf_dir: str, batches: int = 3) -> tuple[DataFrame, str]:
    """The traces as a stream of ``batches`` micro-batches, by place in the session; sessions of every third user end. What it gave, and its checkpoint."""
    root = logs.shared_folder(spark, "streamed")
    rows = _trace(spark, sf_dir).unionByName(streamed.call_rows(_calls(spark, sf_dir)))
    users = _read(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where("user_id % 3 = 0")
    ends = users.select(F.col("user_id").cast("string").alias("session_id"), (2 * F.col("n") + 1).cast("int").alias("message_index"), F.lit(streamed.END).alias("role"))
    whole = rows.unionByName(as_messages(ends))
    whole.withColumn("arrives", F.least(F.lit(batches - 1), F.floor(F.col("message_index") / 40)).cast("int")).write.partitionBy("arrives").parquet(f"{root}/all")
    found = None  # the plan is built once its folder exists
    for k in range(batches):
        tables.moved(spark, f"{root}/all/arrives={k}", f"{root}/in/{k}")
        found = found or streamed.step_stream(spark.readStream.schema(MESSAGES).option("recursiveFileLookup", "true").parquet(f"{root}/in"), _trace_pins(spark, sf_dir))
        writer = found.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
        streamed.started(writer, spark).awaitTermination()
    return spark.read.parquet(f"{root}/out"), f"{root}/checkpoint"


@_query("str10_streamed_steps", f"WITH {CALL_STEPS}")
def _(spark, sf_dir):
    return _seen_at_calls(_streamed(spark, sf_dir)[0])


@_query("src07_stream_states", "SELECT CAST(user_id AS VARCHAR) AS session_id, count(*) AS turns FROM events WHERE user_id % 3 <> 0 GROUP BY user_id")
def _(spark, sf_dir):
    states = streamed.stream_states(spark, _streamed(spark, sf_dir, 2)[1])
    return states.select("session_id", F.get_json_object("state", "$.turn").cast("long").alias("turns"))


@_query(
    "cat14_rule_table",
    """WITH models AS (SELECT DISTINCT user_id, 'm' || user_id AS model FROM events), hits AS (
  SELECT user_id, s_suppkey, 0.3 + (s_suppkey % 50) / 100.0 AS enter, row_number() OVER (PARTITION BY user_id ORDER BY length('m' || s_suppkey) DESC) AS r FROM models JOIN supplier ON starts_with(model, 'm' || s_suppkey)
), best AS (SELECT user_id, max(enter) FILTER (r = 1) AS enter, max(s_suppkey) FILTER (r = 1) AS rule FROM hits GROUP BY user_id)
SELECT CAST(models.user_id AS VARCHAR) AS session_id, round(coalesce(enter, 0.65)::DOUBLE, 4) AS prune_enter, round(CASE WHEN enter IS NULL THEN 0.55 WHEN rule % 2 = 0 THEN enter - 0.2 ELSE enter - 0.1 END::DOUBLE, 4) AS prune_exit, 0.88::DOUBLE AS compact_enter FROM models LEFT JOIN best USING (user_id)""",
)
def _(spark, sf_dir):
    """A rule for every supplier's number as the beginning of a model's name; every second one has an exit of its own."""
    key, enter = F.col("s_suppkey"), F.round(0.3 + (F.col("s_suppkey") % 50) / 100.0, 4)
    known = {"pattern": F.concat(F.lit("m"), key, F.lit("*")), "position": key, "prune_enter": enter, "prune_exit": F.when(key % 2 == 0, enter - 0.2), "prune_given": F.lit(True)}
    table = _read(spark, sf_dir, "supplier").select(*(known.get(c, F.lit(None)).cast(t).alias(c) for c, t in (f.split(" ") for f in rules.RULES.split(", "))))
    users = _read(spark, sf_dir, "events").select("user_id").distinct().select(F.col("user_id").cast("string").alias("session_id"), F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("model"))
    rows = rules.with_rules(users, table, config.merged(config.DEFAULTS, {"models": {}}))
    return rows.select("session_id", *(F.round(c, 4).alias(c) for c in ("prune_enter", "prune_exit", "compact_enter")))


@_query("snk02_state_table", "SELECT CAST(user_id AS VARCHAR) AS session_id, CAST(count(*) * (CASE WHEN user_id % 3 = 0 THEN 2 ELSE 1 END) AS VARCHAR) AS state FROM events GROUP BY user_id")
def _(spark, sf_dir):
    """States of all sessions, then newer ones of every third."""
    path = logs.shared_folder(spark, "states")
    per = _read(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    state = lambda rows, times: rows.select(F.col("user_id").cast("string").alias("session_id"), (F.col("n") * times).cast("string").alias("state"))
    tables.commit(state(per, 1), path)
    tables.commit(state(per.where("user_id % 3 = 0"), 2), path)
    return tables.current(spark, path)


@_query("src09_whole_files", "SELECT event_type, count(*) AS n, count(*) FILTER (props IS NOT NULL) AS with_props FROM events WHERE event_type <> 'click' GROUP BY event_type")
def _(spark, sf_dir):
    """Events as JSON lines in files by type; one of the clicks' lines is broken, so the clicks' file gives nothing."""
    path = logs.shared_folder(spark, "lines")
    events = _read(spark, sf_dir, "events")
    broken = (F.col("event_type") == "click") & (F.col("event_id") == F.min(F.when(F.col("event_type") == "click", F.col("event_id"))).over(Window.partitionBy("event_type")))
    line = F.when(broken, '{"broken').otherwise(F.to_json(F.struct("event_id", "event_type", "props")))
    events.select("event_type", line.alias("value")).withColumnRenamed("event_type", "kind").repartition("kind").write.partitionBy("kind").text(path)
    rows, _quarantined = logs.whole_files(spark, path, "event_id long, event_type string, props string")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("props").alias("with_props"))


@_query("prj04_guarded_estimator", f"WITH {CHAT} SELECT session_id, message_index::INT AS message_index, (CASE WHEN message_index % 3 = 1 THEN tokens ELSE length(text) + 5 END)::BIGINT AS tokens FROM chat")
def _(spark, sf_dir):
    """An estimator that raises on every third message, which alone falls back to the built-in count."""

    def estimate(row: dict) -> int:
        if row["message_index"] % 3 == 1:
            raise ValueError("no estimate")
        return len(row["content_text"]) + 5

    rows = items.classify(_chat(spark, sf_dir), estimator=tk.guarded(estimate, "message_index", "content_text"))
    return rows.select("session_id", "message_index", F.col("estimated_tokens").alias("tokens"))


# ---- logs, pins and commands over many sessions ----
def _purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, event_id, created_at) of purchases, which stand for checkpoints."""
    rows = _read(spark, sf_dir, "events").where("event_type = 'purchase'")
    return rows.select(F.col("user_id").cast("string").alias("session_id"), "event_id", F.lpad(F.col("event_id").cast("string"), 12, "0").alias("created_at"))


@_query("src06_compaction_counts", "SELECT CAST(user_id AS VARCHAR) AS session_id, count(*) FILTER (event_type = 'signup') AS compactions FROM events GROUP BY user_id")
def _(spark, sf_dir):
    entries = _read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), F.when(F.col("event_type") == "signup", "compaction").otherwise("message").alias("type"))
    return logs.compaction_counts(entries)


@_query("src08_latest_checkpoints", "SELECT CAST(user_id AS VARCHAR) AS session_id, count(*)::INT AS checkpoint_no, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def _(spark, sf_dir):
    number = F.row_number().over(Window.partitionBy("session_id").orderBy("event_id"))
    return logs.latest_checkpoints(_purchases(spark, sf_dir).withColumn("checkpoint_no", number)).select("session_id", "checkpoint_no", "event_id")


@_query(
    "snk04_numbered_checkpoints",
    """WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), have AS (SELECT user_id, count(*) AS last FROM p WHERE event_id % 2 = 0 GROUP BY user_id)
SELECT CAST(p.user_id AS VARCHAR) AS session_id, event_id, (coalesce(last, 0) + row_number() OVER (PARTITION BY p.user_id ORDER BY event_id))::INT AS checkpoint_no FROM p LEFT JOIN have ON p.user_id = have.user_id WHERE event_id % 2 = 1""",
)
def _(spark, sf_dir):
    rows = _purchases(spark, sf_dir)
    have = rows.where("event_id % 2 = 0").withColumn("checkpoint_no", F.row_number().over(Window.partitionBy("session_id").orderBy("event_id")))
    return logs.numbered(rows.where("event_id % 2 = 1"), have).select("session_id", "event_id", F.col("checkpoint_no").cast("int").alias("checkpoint_no"))


@_query("src05_snapshot_or_log", f"WITH {CHAT} SELECT session_id, message_index::INT AS message_index, CASE WHEN CAST(session_id AS BIGINT) % 2 = 0 THEN 'cached' ELSE text END AS text FROM chat")
def _(spark, sf_dir):
    log = _chat(spark, sf_dir)
    leaves = log.select("session_id", F.lit("now").alias("leaf_id")).distinct()
    snapshot = log.withColumns({"content_text": F.lit("cached"), "leaf_id": F.when(F.col("session_id").cast("long") % 2 == 0, "now").otherwise("then")})
    return logs.snapshot_or_log(snapshot, log, leaves).select("session_id", "message_index", F.col("content_text").alias("text"))


@_query(
    "pin01_added_pins",
    """SELECT CAST(conv_id AS VARCHAR) AS session_id, p.type, p.content FROM (SELECT DISTINCT conv_id FROM conversations),
  (VALUES ('constraint', ' The '), ('file', 'src/none.py'), ('note', 'que'), ('constraint', 'The'), ('note', 'new')) AS p(type, content)""",
)
def _(spark, sf_dir):
    have = _pins(spark, sf_dir)
    new = F.array(*(F.struct(F.lit(t).alias("type"), F.lit(c).alias("content")) for t, c in (("constraint", "The "), ("file", "SRC/none.py"), ("note", " que"), ("note", "  "), ("note", "new "), ("note", "new"))))
    fresh = have.select("session_id").distinct().select("session_id", F.inline(new)).withColumns({"id": F.lit("n"), "created_at": F.lit(9).cast("long"), "active": F.lit(True)})
    return pins.add_pins(have, fresh).select("session_id", "type", "content")


@_query("pin02_removed_pin", "SELECT CAST(conv_id AS VARCHAR) AS session_id, p.id FROM (SELECT DISTINCT conv_id FROM conversations), (VALUES ('p1'), ('p2'), ('p3')) AS p(id) WHERE NOT (conv_id = 1 AND p.id = 'p2')")
def _(spark, sf_dir):
    return pins.remove_pin(_pins(spark, sf_dir), "1", "p2").select("session_id", "id")


@_query(
    "cmd_pin_texts",
    rf"""WITH {CHAT}, texts AS (SELECT session_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM chat WHERE role = 'user'), typed AS (SELECT session_id, {PIN_TYPE} AS type, t AS content FROM texts WHERE t <> '')
SELECT session_id, type, content, 'pin-' || substr(sha256(session_id || chr(1) || type || chr(1) || content), 1, 8) AS id FROM typed""",
)
def _(spark, sf_dir):
    texts = _chat(spark, sf_dir).where("role = 'user'").select("session_id", F.col("content_text").alias("text"))
    return commands.pin_texts(texts, 0).select("session_id", "type", "content", "id")


@_query("cmd_pin_files", """WITH p AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS session_id, 'src/f' || (coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) % 7) || '.py' AS content FROM events WHERE event_type = 'signup')
SELECT session_id, content, 'pin-' || substr(sha256(session_id || chr(1) || 'file' || chr(1) || content), 1, 8) AS id FROM p""")  # fmt: skip
def _(spark, sf_dir):
    edits = traces.tool_events(_read(spark, sf_dir, "events")).where("name = 'edit'")
    paths = edits.select("session_id", F.concat(F.get_json_object("arguments_json", "$.path"), F.lit(" ")).alias("path")).distinct()
    return commands.pin_files(paths, 0).select("session_id", "content", "id")


@_query("cmd_clean", f"WITH {ACTED} SELECT session_id, 5::BIGINT AS clean_at_ms, any_value(total_tokens)::BIGINT AS tokens_before, greatest(0, any_value(total_tokens) - sum(tokens_before - tokens_after))::BIGINT AS tokens_after FROM acts JOIN analysed USING (session_id) GROUP BY session_id")
def _(spark, sf_dir):
    acted = _acted(spark, sf_dir)
    return commands.cleaned(acted, analysis.analyze(acted, window=CONTEXT_WINDOW), 5)


@_query(
    "flt07_history",
    """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS session_id, lpad(CAST(event_id AS VARCHAR), 12, '0') AS time, CASE event_type WHEN 'purchase' THEN 'stub' WHEN 'error' THEN 'metric' ELSE event_type END AS action FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id, action = 'stub' ORDER BY time DESC) AS r FROM e WHERE action <> 'metric') SELECT session_id, time, action FROM r WHERE r <= 3""",
)
def _(spark, sf_dir):
    kind = F.when(F.col("event_type") == "purchase", "stub").when(F.col("event_type") == "error", "metric").otherwise(F.col("event_type"))
    rows = _read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("time"), kind.alias("action"))
    return logs.history(rows.where("action = 'stub'"), rows.where("action <> 'stub'"), 3).select("session_id", "time", "action")


@_query("win03_latest_user", f"WITH {CHAT} SELECT session_id, max(message_index)::INT AS message_index FROM chat WHERE role = 'user' GROUP BY session_id")
def _(spark, sf_dir):
    return items.classify(_chat(spark, sf_dir)).where(F.array_contains("tags", "latest-user")).select("session_id", "message_index")


@_query("jn03_pinned_files", f"WITH {TRACE} SELECT session_id, message_index::INT AS message_index, 'critical' AS class FROM keyed WHERE path = 'src/f3.py' AND CAST(session_id AS BIGINT) % 2 = 0")
def _(spark, sf_dir):
    return items.classify(_trace(spark, sf_dir), _trace_pins(spark, sf_dir)).where("pinned").select("session_id", "message_index", "class")


@_query("str15_final_states", "SELECT CAST(user_id AS VARCHAR) AS session_id, count(*) AS turns, count(*) FILTER (event_type = 'signup') AS compactions FROM events GROUP BY user_id")
def _(spark, sf_dir):
    """States after half of the turns go on through the others."""
    turns = turn_series(_read(spark, sf_dir, "events"))
    ends = policy.final_states(turns.where("turn > 20"), states=policy.final_states(turns.where("turn <= 20")))
    return ends.select("session_id", *(F.get_json_object("state", f"$.{c}").cast("long").alias(n) for c, n in (("turn", "turns"), ("compactions", "compactions"))))


@_query("snk01_audit_rows", f"WITH {CHAT} SELECT session_id, message_index::BIGINT AS message_index, CAST(tokens AS BIGINT) AS tokens FROM chat")
def _(spark, sf_dir):
    """Chats that arrive in two parts, their messages metered and appended once each."""
    root = logs.shared_folder(spark, "audit")
    chats = _chat(spark, sf_dir)
    for part in (0, 1):
        chats.where(F.col("message_index") % 2 == part).write.mode("append").json(f"{root}/in")
        metered = logs.message_stream(spark, f"{root}/in").select("session_id", "message_index", tk.message_tokens().alias("tokens"))
        append_audit(metered, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema("session_id string, message_index long, tokens long").json(f"{root}/out")
