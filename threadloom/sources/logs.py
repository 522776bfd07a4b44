"""Session logs, state and checkpoints on any file system that Spark reads."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.schema import MESSAGES, PINS, as_messages


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``, which names a folder that all executors share; only a local session may leave it unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "/tmp/checkpoints"
    return f"{root.rstrip('/')}/threadloom/{name}-{uuid.uuid4().hex}"


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines, blank ones dropped. A broken line fails the read, or becomes a row of nulls if not ``strict``."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST" if strict else "PERMISSIVE"}).alias("r")).select("r.*")


def whole_files(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the JSON lines files at ``path`` that parse as a whole, and (file, bad_lines, lines) of those that do not, which give no row at all.

    Blank lines do not count. A line is bad if it is no JSON. Only the names of files with a bad line meet the rows again.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").where(F.trim("value") != "")
    none = F.trim("value") == "null"
    bad = F.try_parse_json("value").isNull() & ~none
    quarantined = lines.groupBy("file").agg(F.count_if(bad).alias("bad_lines"), F.count(F.lit(1)).alias("lines")).where("bad_lines > 0")
    good = lines.join(quarantined.select("file"), "file", "left_anti")
    return good.where(~none).select(F.from_json("value", schema).alias("r")).select("r.*"), quarantined


_BODY = ", ".join(f"{f.split(' ', 1)[0]}: {f.split(' ', 1)[1]}" for f in MESSAGES.split(", ") if f.split(" ")[0] not in ("session_id", "message_index"))
#: A session log's line; an entry's type says what it holds.
ENTRIES = f"session_id string, leaf_id string, entries array<struct<type: string, id: string, message: struct<{_BODY}>, summary: string, content_text: string, details_json: string, custom_type: string, ts_ms: long>>"


def entry_messages(logs: DataFrame) -> DataFrame:
    """Rows of ENTRIES as messages, in order: a message entry's own, summaries of compactions and branches, custom messages; other entries hold none."""
    each = logs.select("session_id", F.posexplode("entries").alias("pos", "e"))
    kind = F.col("e.type")
    role = F.when(kind == "message", F.col("e.message.role")).when(kind == "compaction", "compactionSummary").when(kind == "branch_summary", "branchSummary").when(kind == "custom_message", "custom")
    own = {f.split(" ")[0]: F.when(kind == "message", F.col(f"e.message.{f.split(' ')[0]}")) for f in MESSAGES.split(", ") if f.split(" ")[0] not in ("session_id", "message_index", "role")}
    custom = kind == "custom_message"
    own |= {
        "ts_ms": F.coalesce(own["ts_ms"], F.col("e.ts_ms")),
        "summary": F.coalesce(own["summary"], F.when(kind.isin("compaction", "branch_summary"), F.col("e.summary"))),
        **{c: F.coalesce(own[c], F.when(custom, F.col(f"e.{c}"))) for c in ("content_text", "details_json", "custom_type")},
    }
    rows = each.withColumn("role", role).where("role is not null")
    index = F.row_number().over(Window.partitionBy("session_id").orderBy("pos")) - 1
    return as_messages(rows.withColumns(own).withColumn("message_index", index))


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Messages of a log of ENTRIES lines (``{"session_id": ..., "entries": [...]}``), or of Parquet tables of MESSAGES."""
    if path.endswith(".parquet"):
        return as_messages(spark.read.parquet(path))
    return entry_messages(read_jsonl(spark, path, ENTRIES))


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, state) of JSON lines ``{"session_id": ..., "state": {...}}``, as ``fold_turns`` takes them; lines without a state are left out."""
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.get_json_object("value", "$.session_id").alias("session_id"), F.get_json_object("value", "$.state").alias("state"))
    return lines.where("session_id is not null and state is not null")


def message_stream(spark: SparkSession, path: str, schema: str = MESSAGES) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def snapshot_or_log(snapshot: DataFrame, log: DataFrame, leaves: DataFrame) -> DataFrame:
    """A session's cached messages where both its id and leaf (session_id, leaf_id) are current, else those of the log."""
    good = snapshot.join(leaves, ["session_id", "leaf_id"], "left_semi")
    rest = log.join(good.select("session_id").distinct(), "session_id", "left_anti")
    return as_messages(good).unionByName(as_messages(rest))


def compaction_counts(entries: DataFrame) -> DataFrame:
    """(session_id, compactions) of log entries (session_id, type, ...)."""
    return entries.groupBy("session_id").agg(F.count_if(F.col("type") == "compaction").alias("compactions"))


def read_pins(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, PINS, strict=False).where(F.col("id").isNotNull())


def latest_checkpoints(checkpoints: DataFrame) -> DataFrame:
    """The highest-numbered checkpoint of each session."""
    newest = Window.partitionBy("session_id").orderBy(F.desc("checkpoint_no"))
    return checkpoints.withColumn("r", F.row_number().over(newest)).where("r = 1").drop("r")


def numbered(new: DataFrame, have: DataFrame) -> DataFrame:
    """``new`` checkpoints with the numbers that follow a session's last one, in order of created_at."""
    last = have.groupBy("session_id").agg(F.max("checkpoint_no").alias("last"))
    order = Window.partitionBy("session_id").orderBy("created_at")
    return new.join(last, "session_id", "left").withColumn("checkpoint_no", F.coalesce("last", F.lit(0)) + F.row_number().over(order)).drop("last")


def history(prunes: DataFrame, events: DataFrame, n: int = 12) -> DataFrame:
    """The last ``n`` prune rows and the last ``n`` other events (metrics left out) of each session, by time."""
    newest = Window.partitionBy("session_id").orderBy(F.desc("time"))
    tail = lambda df: df.withColumn("r", F.row_number().over(newest)).where(F.col("r") <= n).drop("r")
    return tail(prunes).unionByName(tail(events.where("action <> 'metric'")), allowMissingColumns=True)


def prune_log(acted: DataFrame, time: str, mode: str = "auto") -> DataFrame:
    """An audit row for each item that a pruning pass replaced."""
    rows = acted.where("kind <> 'keep'")
    item = F.concat_ws(":", "role", F.col("message_index").cast("string"))
    return rows.select("session_id", F.lit(time).alias("time"), F.col("kind").alias("action"), item.alias("item_id"), F.col("source").alias("tool"), F.lit(mode).alias("mode"), F.col("estimated_tokens").alias("original_tokens"), F.col("new_tokens").alias("replacement_tokens"), "reason", "tags")


def prune_events(log: DataFrame, totals: DataFrame) -> DataFrame:
    """The one event of each session's pass in ``prune_log`` rows; ``totals`` (session_id, tokens_before, tokens_after) are those of the whole context."""
    per = log.groupBy("session_id", "time", "mode").agg(F.count(F.lit(1)).alias("actions")).join(totals, "session_id")
    return per.select("session_id", "time", F.lit("prune").alias("action"), "mode", "actions", "tokens_before", "tokens_after", (F.col("tokens_before") - F.col("tokens_after")).alias("saved"))


def turn_metrics(usage: DataFrame, plans: DataFrame) -> DataFrame:
    """A metric row for each turn of ``usage`` (session_id, turn, time, tokens, percent) whose tokens are known, with the counts of ``plans``."""
    known = usage.where("tokens is not null").join(plans.select("session_id", "turn", "compactions", "checkpoints"), ["session_id", "turn"])
    return known.select("session_id", "time", F.lit("metric").alias("action"), F.col("tokens").alias("context_tokens"), "percent", "compactions", "checkpoints")


#: Directories that ``write_latest`` spreads sessions over.
BUCKETS = 256


def write_latest(df: DataFrame, path: str) -> None:
    """State or pins, a row or more for each session, as plain Parquet: sessions of ``df`` replaced, others left. Only buckets of sessions in ``df`` are written anew. For one writer and no reader at a time; ``sources.tables`` has versions."""
    spark = df.sparkSession
    bucket = F.pmod(F.xxhash64("session_id"), F.lit(BUCKETS)).cast("int")
    new = df.withColumn("bucket", bucket)
    try:
        old = spark.read.parquet(path)
    except AnalysisException:  # nothing there yet
        old = None
    if old is not None:
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most BUCKETS
        rest = old.where(F.col("bucket").isin(touched)).join(df.select("session_id").distinct(), "session_id", "left_anti")
        # read before its files are replaced
        staged = f"{path.rstrip('/')}-staged-{uuid.uuid4().hex}"
        new.unionByName(rest, allowMissingColumns=True).write.parquet(staged)
        new = spark.read.parquet(staged)
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
