"""One record per session: tokens by class, pressure, quality, what could be freed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import tokens as tk

CLASSES = ("critical", "working", "stale", "disposable")
SYSTEM_RESERVE = 4000


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def class_sums(stub_min: int = 50) -> list[Column]:
    """Sums over classified items that ``measured`` needs, by name."""
    sums = [F.sum(F.when(F.col("class") == c, F.col("estimated_tokens")).otherwise(0)).alias(f"{c}_tokens") for c in CLASSES]
    return [F.sum("estimated_tokens").alias("raw_tokens"), *sums, F.sum(tk.reclaimable(stub_min)).alias("reclaimable_tokens"), F.count(F.lit(1)).alias("message_count")]


SUMS = ("raw_tokens", *(f"{c}_tokens" for c in CLASSES), "reclaimable_tokens", "message_count")


def measured(per: DataFrame, usage: DataFrame | None = None, window: int = 200_000) -> DataFrame:
    """Sums per session with total_tokens, usable_tokens, pressure and quality."""
    return metered(_with_usage(per, usage, window)).drop("tokens", "context_window", "max_tokens", "ratio")


def _with_usage(per: DataFrame, usage: DataFrame | None, window: int) -> DataFrame:
    if usage is not None:
        return per.join(usage.select("session_id", "tokens", "context_window", "max_tokens", "ratio"), "session_id", "left")
    return per.withColumns({"tokens": F.lit(None).cast("long"), "context_window": F.lit(window).cast("long"), "max_tokens": F.lit(None).cast("long"), "ratio": F.lit(1.0)})


def estimated_total(raw: Column) -> Column:
    """Tokens of a context whose messages have ``raw`` by estimate, under the calibration in ``ratio``."""
    return F.greatest(F.lit(1), F.floor(raw * F.coalesce("ratio", F.lit(1.0)) + 0.5).cast("long") + SYSTEM_RESERVE)


def metered(per: DataFrame) -> DataFrame:
    """Sums with tokens, context_window, max_tokens and ratio beside them: adds total_tokens, usable_tokens, pressure and quality."""
    per = per.withColumn("total_tokens", F.when(F.col("tokens") > 0, F.col("tokens")).otherwise(estimated_total(F.col("raw_tokens"))))
    per = per.withColumn("usable_tokens", tk.usable_tokens(F.col("context_window"), F.col("max_tokens")))
    classed = sum((F.col(f"{c}_tokens") for c in CLASSES), F.lit(0))
    quality = F.coalesce((F.col("critical_tokens") + F.col("working_tokens")) / F.nullif(classed, F.lit(0)), F.lit(1.0))
    return per.withColumn("pressure", clamp(F.col("total_tokens") / F.col("usable_tokens"), 0.0, 2.0)).withColumn("quality", clamp(quality, 0.0, 1.0))


def analyze(items: DataFrame, usage: DataFrame | None = None, window: int = 200_000, stub_min: int = 50) -> DataFrame:
    """(session_id, raw_tokens, tokens by class, total_tokens, usable_tokens, pressure, quality, reclaimable_tokens, message_count).

    ``usage`` (session_id, tokens, context_window, max_tokens, ratio) may give a
    session's reported tokens, its model's window and its calibration.
    """
    return measured(items.groupBy("session_id").agg(*class_sums(stub_min)), usage, window)


def calibration(samples: DataFrame, window: int = 20) -> DataFrame:
    """(session_id, turn, reported, estimated) with ratio: the mean of reported / estimated over the last ``window`` turns that have both, 1 before any."""
    good = (F.col("reported") > 0) & (F.col("estimated") > 0)
    n = F.sum(F.when(good, 1).otherwise(0)).over(Window.partitionBy("session_id").orderBy("turn"))
    rows = samples.withColumn("n", n)
    seen = Window.partitionBy("session_id").orderBy("n").rangeBetween(1 - window, 0)
    value = F.when(good, F.col("reported") / F.col("estimated"))
    return rows.withColumn("ratio", F.coalesce(F.avg(value).over(seen), F.lit(1.0))).drop("n")


def consumer_label() -> Column:
    """What a result counts as: its tool and file; null for other items."""
    label = F.concat(
        F.coalesce("source", F.lit("tool")),
        F.coalesce(F.concat(F.lit(":"), F.try_element_at("related_files", F.lit(1))), F.lit("")),
        F.when(F.arrays_overlap("tags", F.array(F.lit("superseded-read"), F.lit("duplicate-search"))), " (old)").otherwise(""),
    )
    return F.when(F.col("type").isin("tool-result", "bash"), label)


def largest_consumers(items: DataFrame, n: int = 5) -> DataFrame:
    """(session_id, rank, label, tokens): results by tool and file, most tokens first; ties by first seen."""
    sums = items.withColumn("label", consumer_label()).where("label is not null").groupBy("session_id", "label").agg(F.sum("estimated_tokens").alias("tokens"), F.min("message_index").alias("first"))
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("tokens"), "first"))
    return sums.withColumn("rank", rank).where(F.col("rank") <= n).select("session_id", "rank", "label", "tokens")


def analyze_with_consumers(items: DataFrame, window: int = 200_000, stub_min: int = 50, n: int = 5) -> DataFrame:
    """``analyze`` with top (array of rank, label, tokens): the largest consumers, from one pass over the items."""
    by = items.withColumn("label", consumer_label()).groupBy("session_id", "label").agg(*class_sums(stub_min), F.sum("estimated_tokens").alias("tokens"), F.min("message_index").alias("first"))
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("label").isNull(), F.desc("tokens"), "first"))
    top = F.when(F.col("label").isNotNull() & (F.col("rank") <= n), F.struct("rank", "label", "tokens"))
    per = by.withColumn("rank", rank).groupBy("session_id").agg(*(F.sum(c).alias(c) for c in SUMS), F.array_sort(F.collect_list(top)).alias("top"))
    return measured(per, None, window)


def last_user_text(messages: DataFrame) -> DataFrame:
    """(session_id, text) of the last user message."""
    users = messages.where(F.col("role") == "user").withColumn("text", tk.message_text())
    return users.groupBy("session_id").agg(F.max_by("text", "message_index").alias("text"))


def goals(messages: DataFrame) -> DataFrame:
    """(session_id, goal): the first user text that is not blank, at most 2000 characters."""
    from threadloom.functions.text import trim

    users = messages.where(F.col("role") == "user").withColumn("text", trim(tk.message_text())).where("text <> ''")
    return users.groupBy("session_id").agg(F.substring(F.min_by("text", "message_index"), 1, 2000).alias("goal"))
