"""Text reports, a row per session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import band_label, percent, short_count
from threadloom.operators.analysis import SUMS, class_sums, measured


def context_reports(rows: DataFrame) -> DataFrame:
    """(session_id, report) of ``analyze_with_consumers``; what stands in columns pins, compactions, checkpoint_fresh, action, reason, model (provider/id) and model_name is reported too."""
    known = {"pins": F.lit(0), "compactions": F.lit(0), "checkpoint_fresh": F.lit(False), "action": F.lit("none"), "reason": F.lit(""), "model": F.lit(None).cast("string"), "model_name": F.lit(None).cast("string")}
    rows = rows.withColumns({c: v for c, v in known.items() if c not in rows.columns})
    k, whole = short_count, lambda c: F.format_number(F.col(c), 0)
    lines = F.array_join(F.transform("top", lambda x: F.concat(x["rank"].cast("string"), F.lit(". "), x["label"], F.lit("  "), k(x["tokens"]))), "\n")
    action = F.coalesce("action", F.lit("none"))
    report = F.concat_ws(
        "\n", F.lit("Context Engine\n"), F.concat(F.lit("Model:\n"), F.col("model"), F.coalesce(F.concat(F.lit(" ("), F.nullif("model_name", F.lit("")), F.lit(")")), F.lit("")), F.lit("\n")), F.lit("Window:"), F.concat(whole("usable_tokens"), F.lit(" usable\n")), F.lit("Estimated usage:"),
        F.concat(whole("total_tokens"), F.lit(" / "), whole("usable_tokens"), F.lit("  ("), percent(F.col("pressure"), 1), F.lit(")")),
        F.concat(F.lit("Band: "), band_label(F.col("pressure")), F.lit("  ·  Quality: "), percent(F.col("quality"), 1), F.lit("\n")), F.lit("Classification:"),
        F.concat(F.lit("critical     "), k(F.col("critical_tokens")), F.lit("   working    "), k(F.col("working_tokens"))),
        F.concat(F.lit("stale        "), k(F.col("stale_tokens")), F.lit("   disposable "), k(F.col("disposable_tokens")), F.lit("\n")),
        F.when(F.size("top") > 0, F.concat(F.lit("Largest consumers:\n"), lines, F.lit("\n"))),
        F.concat(F.lit("Pins: "), F.coalesce("pins", F.lit(0)).cast("string")), F.concat(F.lit("Compactions: "), F.coalesce("compactions", F.lit(0)).cast("string")),
        F.concat(F.lit("Checkpoint: "), F.when(F.coalesce("checkpoint_fresh", F.lit(False)), "fresh").otherwise("none/stale"), F.lit("\n")), F.concat(F.lit("Recommendation: "), F.upper(action)),
        F.when(F.col("reclaimable_tokens") > 0, F.concat(F.lit("Estimated reclaimable: "), k(F.col("reclaimable_tokens")), F.lit(" tokens"))),
        F.when(action != "none", F.concat(F.lit("Reason: "), F.col("reason"))),
    )
    return rows.select("session_id", report.alias("report"))


def clean_reports(acted: DataFrame, window: int = 200_000) -> DataFrame:
    """(session_id, report) of what a pruning pass saved, from one pass over its rows."""
    done = F.col("kind") != "keep"
    by = acted.groupBy("session_id", F.when(done, F.col("reason")).alias("why")).agg(
        *class_sums(), F.sum(F.when(done, F.col("estimated_tokens") - F.col("new_tokens")).otherwise(0)).alias("saved"),
        F.count_if(F.col("kind") == "stub").alias("stubs"), F.count_if(F.col("kind") == "fold").alias("folds"), F.min("message_index").alias("first"),
    )
    line = F.when(F.col("why").isNotNull(), F.struct((-F.col("message_count")).alias("n"), "first", "why"))
    sums = (*SUMS, "saved", "stubs", "folds")
    per = by.groupBy("session_id").agg(*(F.sum(c).alias(c) for c in sums), F.array_sort(F.collect_list(line)).alias("reasons"))
    rows = measured(per, None, window)
    total, saved = F.col("total_tokens"), F.greatest(F.col("saved"), F.lit(0))
    why = F.array_join(F.transform("reasons", lambda x: F.concat(F.lit("- "), (-x["n"]).cast("string"), F.lit(" × "), x["why"])), "\n")
    report = F.concat_ws(
        "\n", F.concat(F.lit("Context clean\n\nBefore: "), short_count(total)), F.concat(F.lit("After:  "), short_count(total - saved)),
        F.concat(F.lit("Saved:  "), short_count(saved), F.lit(" ("), percent(saved / total, 1), F.lit(" of context)\n")), F.lit("Pruned:"), F.when(F.size("reasons") > 0, why).otherwise("- nothing to prune"),
        F.concat(F.lit("\n("), F.col("stubs").cast("string"), F.lit(" stubbed, "), F.col("folds").cast("string"), F.lit(" folded — originals remain in session history)")),
    )
    return rows.select("session_id", report.alias("report"))
