"""Pruning: low-value results become stubs or folds in place; nothing is dropped, roles and ids stay."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import text as tx
from threadloom.functions import tokens as tk
from threadloom.functions.rows import held, once
from threadloom.operators.analysis import analyze
from threadloom.schema import BLOCKS, ENGINE_ID, as_messages

# Lines and characters that a fold keeps.
HEAD, TAIL, NOTABLE, AROUND, NOTABLE_CHARS, COMMAND_CHARS = 8, 6, 15, 2, 160, 200
TEXT_HEAD, TEXT_TAIL = 40, 20
REPLACEMENT_COST = 24


def plan(stub_min: int | Column, of: Callable[[str], Column] = F.col) -> Column:
    """keep, stub or fold for a classified item, whose columns ``of`` gives."""
    cls, tags = of("class"), of("tags")
    keep = of("engine_stub") | of("pinned") | (cls == "critical") | ~of("type").isin("tool-result", "bash") | (of("estimated_tokens") < stub_min)
    fold = (cls == "working") & F.array_contains(tags, "oversized") & (F.array_contains(tags, "active-failure") | of("source").isin("bash", "read", "grep", "find"))
    return F.when(keep, "keep").when(cls.isin("stale", "disposable"), "stub").when(fold, "fold").otherwise("keep")


def stub_text(tool: Column, original: Column, reason: Column) -> Column:
    return F.concat(
        F.lit(f"[{ENGINE_ID}] "), tool, F.lit(" result pruned (~"), tx.short_count(original), F.lit(" tokens) — "), reason,
        F.lit(". The original output is preserved in session history; re-run the command or re-read the file if you need it again."),
    )


def fold_output(command: Column, output: Column, lines: Column, max_chars: int | Column) -> Column:
    """Head, notable lines (errors and what stands around them) and tail of a command's output; short outputs as they are. ``lines`` is the output's, as a column of its own."""
    n = F.size(lines)
    failing = F.filter(F.transform(lines, lambda x, i: F.when(tx.is_error_line(x), i)), lambda i: i.isNotNull())
    near = F.array_distinct(F.flatten(F.transform(failing, lambda i: F.sequence(F.greatest(i - AROUND, F.lit(0)), F.least(i + AROUND, n - 1)))))
    middle = F.filter(near, lambda i: (i >= HEAD) & (i < n - TAIL))
    shown = F.transform(middle, lambda i: F.substring(tx.trim(F.get(lines, i)), 1, NOTABLE_CHARS))
    notable = F.slice(F.filter(shown, lambda x: x != ""), 1, NOTABLE)
    short = F.when(F.length(command) > COMMAND_CHARS, F.concat(F.substring(command, 1, COMMAND_CHARS), F.lit("…"))).otherwise(command)
    folded = F.concat(
        F.lit(f"[bash output folded by {ENGINE_ID} — full output remains in session history]\ncommand: "), short,
        F.lit("\n\n-- head --\n"), F.array_join(F.slice(lines, 1, HEAD), "\n"),
        F.coalesce(F.concat(F.lit("\n\n-- notable lines --\n"), F.nullif(F.array_join(notable, "\n"), F.lit(""))), F.lit("")),
        F.lit("\n\n-- tail --\n"), F.array_join(F.slice(lines, -TAIL, TAIL), "\n"),
        F.lit("\n\n("), (n - HEAD - TAIL).cast("string"), F.lit(" lines folded)"),
    )
    return F.when(n <= HEAD + TAIL + 4, output).otherwise(folded)


def _cut(folded: Column, limit: Column) -> Column:
    return F.when(F.length(folded) > limit, F.concat(F.substring(folded, F.lit(1), limit), F.lit("\n…[truncated]"))).otherwise(folded)


def folded_text(text: Column, lines: Column) -> Column:
    """The first and last lines of a long text; a short one as it is."""
    n = F.size(lines)
    folded = F.concat(
        F.array_join(F.slice(lines, 1, TEXT_HEAD), "\n"), F.lit(f"\n\n[{ENGINE_ID} … "), (n - TEXT_HEAD - TEXT_TAIL).cast("string"),
        F.lit(" lines folded …]\n\n"), F.array_join(F.slice(lines, -TEXT_TAIL, TEXT_TAIL), "\n"),
    )
    return F.when(n <= TEXT_HEAD + TEXT_TAIL + 3, text).otherwise(folded)


def fold_text(text: Column, lines: Column, max_chars: Column) -> Column:
    """``folded_text``, cut at twice ``max_chars``."""
    return F.when(F.size(lines) <= TEXT_HEAD + TEXT_TAIL + 3, text).otherwise(F.substring(folded_text(text, lines), F.lit(1), max_chars * 2))


def actions(items: DataFrame, stub_min: int | Column = 50, max_chars: int | Column = 2200) -> DataFrame:
    """``items`` with kind (keep, stub, fold), replacement and new_tokens; a replacement that would not be smaller is a keep."""
    limit = F.lit(max_chars) if isinstance(max_chars, int) else max_chars
    rows = items.withColumn("kind", plan(stub_min))
    rows = once(rows, "lines", F.when(F.col("kind") == "fold", F.split("item_text", "\n")))
    run = (F.col("kind") == "fold") & (F.col("source") == "bash")
    rows = once(rows, "folded", F.when(run, fold_output(F.col("command_text"), F.col("item_text"), F.col("lines"), limit)))
    shorter = F.when(run, F.when(F.size("lines") <= HEAD + TAIL + 4, F.col("folded")).otherwise(_cut(F.col("folded"), limit))).otherwise(fold_text(F.col("item_text"), F.col("lines"), limit))
    stub = stub_text(F.col("source"), F.col("estimated_tokens"), F.col("reason"))
    rows = once(rows.drop("replacement"), "replacement", F.when(F.col("kind") == "stub", stub).when(F.col("kind") == "fold", shorter)).drop("lines", "folded")
    rows = once(rows, "cost", tk.text_tokens(F.col("replacement")) + REPLACEMENT_COST)
    worth = F.coalesce((F.col("kind") != "keep") & (F.col("cost") < F.col("estimated_tokens")), F.lit(False))
    new = {"kind": F.when(worth, F.col("kind")).otherwise("keep"), "replacement": F.when(worth, F.col("replacement")), "new_tokens": F.when(worth, F.col("cost")).otherwise(F.col("estimated_tokens"))}
    return rows.withColumns(new).drop("cost")


def details(at: str, of: Callable[[str], Column] = F.col) -> Column:
    """What pruning writes beside a replacement."""
    return F.to_json(F.struct(F.lit(ENGINE_ID).alias("engine"), of("kind").alias("kind"), of("source").alias("tool"), of("reason").alias("reason"), of("estimated_tokens").alias("originalTokens"), F.lit(at).alias("at")))


def level(text: Column) -> Column:
    """A dash weighs what any character does that is not wide: without it, texts are ASCII and no pattern looks through them."""
    return F.replace(text, F.lit("—"), F.lit("-"))


def beside(written: Column) -> Column:
    """Tokens of a replaced message beside its replacement, ``written`` being its details."""
    return F.when(F.col("role") == "bashExecution", tk.text_tokens(F.col("command")) + tk.BASH_TOKENS).otherwise(F.least(F.lit(tk.DETAILS_TOKENS).cast("long"), tk.text_tokens(written)) + tk.RESULT_TOKENS)


def fold_sizes(rows: DataFrame, may: Column, limits: list[tuple[int, int]]) -> DataFrame:
    """``rows`` with folds: the tokens of its fold as fold_c for each max_chars c of ``limits``, where it ``may`` be folded. A fold under several differs only in where it is cut, so it is made once."""
    run = F.col("source") == "bash"

    def sizes(lines, folded):
        n = F.size(lines)
        whole = F.when(run, n <= HEAD + TAIL + 4).otherwise(n <= TEXT_HEAD + TEXT_TAIL + 3)
        cut = lambda limit: F.when(whole, folded).when(run, _cut(folded, F.lit(limit))).otherwise(F.substring(folded, 1, 2 * limit))
        return F.struct(*(held(cut(c), tk.text_tokens).alias(f"fold_{c}") for c in dict.fromkeys(c for _, c in limits)))

    folded = lambda lines: F.when(run, fold_output(F.col("command_text"), F.col("item_text"), lines, 0)).otherwise(folded_text(F.col("item_text"), lines))
    found = held(F.split("item_text", "\n"), lambda lines: held(folded(lines), lambda text: sizes(lines, text)))
    return once(rows, "folds", F.when(may, found))


def gain(stub_min: int, tokens: Column, besides: Column, of: Callable[[str], Column] = F.col) -> tuple[Column, Column]:
    """What a replacement of so many tokens saves, and whether it is made."""
    worth = F.coalesce((of("kind") != "keep") & (of("estimated_tokens") >= stub_min) & (tokens + REPLACEMENT_COST < of("estimated_tokens")), F.lit(False))
    return F.when(worth, of("estimated_tokens") - tokens - besides).otherwise(0), worth.cast("long")


def savings(items: DataFrame, limits: list[tuple[int, int]], at: str) -> DataFrame:
    """``items`` with saved_k and acts_k for each (stub_min, max_chars): the tokens by which ``actions`` under it makes the message smaller, as it is written at ``at``, and whether it replaces it.

    A stub is the same under all limits and a fold differs only in where it is
    cut, so each is made once.
    """
    rows = fold_sizes(items.withColumn("kind", plan(0)), F.col("kind") == "fold", limits)
    rows = once(rows, "stub", F.when(F.col("kind") == "stub", level(stub_text(F.col("source"), F.col("estimated_tokens"), F.col("reason")))))
    rows = once(rows, "details", F.when((F.col("kind") != "keep") & (F.col("role") != "bashExecution"), level(details(at))))
    rows = once(rows, "made", F.when(F.col("kind") == "stub", F.struct(tk.text_tokens(F.col("stub")).alias("stub"), beside(F.col("details")).alias("beside"))).when(F.col("kind") == "fold", F.struct(F.lit(None).cast("long").alias("stub"), beside(F.col("details")).alias("beside"))))
    for k, (stub_min, c) in enumerate(limits):
        saved, acts = gain(stub_min, F.coalesce("made.stub", f"folds.fold_{c}"), F.col("made.beside"))
        rows = rows.withColumns({f"saved_{k}": saved, f"acts_{k}": acts})
    return rows.drop("kind", "stub", "details", "made", "folds")


def replaced(acted: DataFrame, at: str) -> DataFrame:
    """``acted`` with its messages' columns as pruning leaves them; ``at`` is the time written into what was replaced."""
    done = F.col("kind") != "keep"
    block = F.array(F.struct(F.lit("text").alias("type"), F.col("replacement").alias("text"), *(F.lit(None).cast("string").alias(c) for c in ("thinking", "id", "name", "arguments_json")))).cast(BLOCKS)
    run = F.col("role") == "bashExecution"
    rows = acted.withColumn("details_json", F.when(done, details(at)).otherwise(F.col("details_json")))
    rows = rows.withColumn("output", F.when(done & run, F.col("replacement")).otherwise(F.col("output")))
    rows = rows.withColumn("content_text", F.when(done & ~run, F.lit(None).cast("string")).otherwise(F.col("content_text")))
    return once(rows.withColumnRenamed("blocks", "before"), "blocks", F.when(done & ~run, block).otherwise(F.col("before"))).drop("before")


def rewritten(acted: DataFrame, at: str) -> DataFrame:
    """Messages after pruning, with the columns of MESSAGES."""
    return as_messages(replaced(acted, at))


def effective(acted: DataFrame, at: str) -> DataFrame:
    """``rewritten`` for the sessions that pruning changed; a host keeps its own messages for the others."""
    changed = F.max(F.when(F.col("kind") != "keep", 1).otherwise(0)).over(Window.partitionBy("session_id"))
    return rewritten(acted.withColumn("changed", changed).where("changed = 1"), at)


def action_rows(acted: DataFrame) -> DataFrame:
    """The audit's rows: one per replaced message."""
    return acted.where("kind <> 'keep'").select("session_id", "message_index", "kind", F.col("source").alias("tool"), "reason", F.col("estimated_tokens").alias("tokens_before"), F.col("new_tokens").alias("tokens_after"))


def action_summary(acted: DataFrame) -> DataFrame:
    """(session_id, n_actions, removed_tokens, preserved_tokens)."""
    return action_rows(acted).groupBy("session_id").agg(F.count(F.lit(1)).alias("n_actions"), F.sum(F.col("tokens_before") - F.col("tokens_after")).alias("removed_tokens"), F.sum("tokens_after").alias("preserved_tokens"))


def actions_by_reason(acted: DataFrame) -> DataFrame:
    """(session_id, rank, reason, n), most first; ties by first seen."""
    per = action_rows(acted).groupBy("session_id", "reason").agg(F.count(F.lit(1)).alias("n"), F.min("message_index").alias("first"))
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("n"), "first"))
    return per.withColumn("rank", rank).select("session_id", "rank", "reason", "n")


def recomputed(acted: DataFrame, at: str, **analysis) -> DataFrame:
    """The analysis of the rewritten messages under the same meter: their tokens anew, classes and tags as before."""
    return analyze(replaced(acted, at).withColumn("estimated_tokens", tk.message_tokens()), **analysis)
