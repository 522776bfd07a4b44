"""The engine's commands as tables: many sessions at once, a row or a text for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import text as tx
from threadloom.functions.text import short_count
from threadloom.operators.analysis import class_sums, last_user_text, measured

LAST_CHARS, SHOWN_CHARS, EVENT_CHARS, HISTORY_ROWS = 500, 100, 160, 12


def pin_texts(texts: DataFrame, now_ms: int) -> DataFrame:
    """Pins, as ``add_pins`` takes them, of ``texts`` (session_id, text): the type follows from the text; blank ones make none."""
    rows = texts.withColumn("content", tx.trim(F.col("text"))).where("content <> ''")
    return _new_pins(rows.select("session_id", tx.pin_type(F.col("content")).alias("type"), "content"), now_ms)


def pin_last(messages: DataFrame, now_ms: int) -> DataFrame:
    """Pins of each session's last user message: its type from the whole text, its first LAST_CHARS characters as content."""
    rows = last_user_text(messages).withColumn("whole", tx.trim(F.col("text"))).where("whole <> ''")
    return _new_pins(rows.select("session_id", tx.pin_type(F.col("whole")).alias("type"), F.substring("whole", 1, LAST_CHARS).alias("content")), now_ms)


def pin_files(paths: DataFrame, now_ms: int) -> DataFrame:
    """Pins of ``paths`` (session_id, path)."""
    rows = paths.withColumn("content", tx.trim(F.col("path"))).where("content <> ''")
    return _new_pins(rows.select("session_id", F.lit("file").alias("type"), "content"), now_ms)


def _new_pins(rows: DataFrame, now_ms: int) -> DataFrame:
    key = F.concat_ws("\x01", "session_id", "type", "content")
    return rows.withColumns({"id": F.concat(F.lit("pin-"), F.substring(F.sha2(key, 256), 1, 8)), "created_at": F.lit(now_ms).cast("long"), "active": F.lit(True)})


def pin_lists(pins: DataFrame) -> DataFrame:
    """(session_id, text): a line for each pin, in order of making."""
    line = F.concat(F.when(F.col("active"), "✓ ").otherwise("✗ "), F.col("id"), F.lit(" ["), F.col("type"), F.lit("] "), F.substring("content", 1, SHOWN_CHARS), F.when(F.col("active"), "").otherwise(" (inactive)"))
    return pins.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("created_at", "id", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


def history_lists(log: DataFrame, events: DataFrame, n: int = HISTORY_ROWS) -> DataFrame:
    """(session_id, text): the last ``n`` rows of ``prune_log``, then the last ``n`` other events (session_id, time, action, data as JSON text; metrics left out), each in order of time."""

    def tail(rows: DataFrame, part: int) -> DataFrame:
        newest = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("time"), F.desc("line")))
        return rows.withColumn("back", newest).where(F.col("back") <= n).select("session_id", F.struct(F.lit(part).alias("part"), (-F.col("back")).alias("at"), "line").alias("x"))

    arrow = F.concat(short_count(F.coalesce("original_tokens", F.lit(0))), F.lit("→"), short_count(F.coalesce("replacement_tokens", F.lit(0))))
    pruned = log.select("session_id", "time", F.concat(F.lit("#"), F.coalesce("item_id", F.lit("?")), F.lit(" "), F.col("action"), F.lit(" "), F.coalesce("tool", F.lit("")), F.lit(" "), arrow, F.lit(" — "), F.col("reason")).alias("line"))
    other = events.where("action <> 'metric'").select("session_id", "time", F.concat(F.coalesce("time", F.lit("")), F.lit(" "), F.col("action"), F.lit(" "), F.substring(F.coalesce("data", F.lit("{}")), 1, EVENT_CHARS)).alias("line"))
    both = tail(pruned, 0).unionByName(tail(other, 1))
    return both.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("text"))


def cleaned(acted: DataFrame, analysis: DataFrame, now_ms: int) -> DataFrame:
    """(session_id, clean_at_ms, tokens_before, tokens_after): sessions that a manual clean arms, those with something to prune; ``clean_at_ms`` goes into the next turn of TURNS."""
    sums = acted.where("kind <> 'keep'").groupBy("session_id").agg(F.sum(F.col("estimated_tokens") - F.col("new_tokens")).alias("removed"))
    rows = sums.join(analysis.select("session_id", "total_tokens"), "session_id")
    return rows.select("session_id", F.lit(now_ms).cast("long").alias("clean_at_ms"), F.col("total_tokens").alias("tokens_before"), F.greatest(F.lit(0), F.col("total_tokens") - F.col("removed")).alias("tokens_after"))


def pass_events(acted: DataFrame, time: str, mode: str = "auto", window: int = 200_000) -> DataFrame:
    """The one event of each session's pruning pass, as ``prune_events`` has it, from one aggregation of what the pass has done."""
    removed = F.sum(F.when(F.col("kind") != "keep", F.col("estimated_tokens") - F.col("new_tokens")).otherwise(0)).alias("removed")
    per = acted.groupBy("session_id").agg(*class_sums(), F.count_if(F.col("kind") != "keep").alias("actions"), removed)
    rows = measured(per.where("actions > 0"), None, window).withColumn("tokens_after", F.greatest(F.lit(0), F.col("total_tokens") - F.col("removed")))
    return rows.select("session_id", F.lit(time).alias("time"), F.lit("prune").alias("action"), F.lit(mode).alias("mode"), "actions", F.col("total_tokens").alias("tokens_before"), "tokens_after", (F.col("total_tokens") - F.col("tokens_after")).alias("saved"))
