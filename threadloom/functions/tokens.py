"""Token metering as column expressions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters of 1.5 to a token (others are 4), costs by kind.
CJK = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}\x{3000}-\x{303f}\x{ff00}-\x{ffee}]"
ASTRAL = r"[\x{10000}-\x{10ffff}]"
IMAGE_TOKENS, CALL_TOKENS, OTHER_BLOCK_TOKENS = 1600, 6, 32
RESULT_TOKENS, DETAILS_TOKENS, BASH_TOKENS, SUMMARY_TOKENS, ASSISTANT_TOKENS, MESSAGE_TOKENS = 16, 256, 24, 96, 24, 16
STUB_COST, FOLD_COST = 80, 260
OVERSIZED, RECENT = 1000, 8


def text_tokens(text: Column) -> Column:
    """ceil(other / 4 + cjk / 1.5) over UTF-16 units, exactly, in integers. Text without multi-byte characters needs no pattern."""
    length, octets = F.length(text).cast("long"), F.octet_length(text).cast("long")
    bmp, astral = F.regexp_count(text, F.lit(CJK)), F.regexp_count(text, F.lit(ASTRAL))
    wide = (3 * (length - bmp) + 8 * (bmp + astral) + 11) / 12
    plain = (3 * octets + 11) / 12
    return F.coalesce(F.floor(F.when(octets == length, plain).otherwise(wide)), F.lit(0)).cast("long")


def block_tokens(block: Column) -> Column:
    kind = block["type"]
    call = text_tokens(block["name"]) + CALL_TOKENS + text_tokens(block["arguments_json"])
    return (
        F.when(kind == "text", text_tokens(block["text"]))
        .when(kind == "thinking", text_tokens(F.coalesce(block["thinking"], block["text"])))
        .when(kind == "image", F.lit(IMAGE_TOKENS).cast("long"))
        .when(kind == "toolCall", call)
        .otherwise(F.when(block.isNull(), 0).otherwise(OTHER_BLOCK_TOKENS).cast("long"))
    )


def content_tokens(text: Column, blocks: Column) -> Column:
    of_blocks = F.aggregate(blocks, F.lit(0).cast("long"), lambda acc, b: acc + block_tokens(b))
    return F.coalesce(F.when(blocks.isNotNull(), of_blocks).otherwise(text_tokens(text)), F.lit(0).cast("long"))


def message_tokens() -> Column:
    """Tokens of a row of MESSAGES."""
    role, content = F.col("role"), content_tokens(F.col("content_text"), F.col("blocks"))
    details = F.when(F.col("details_json").isNotNull(), F.least(F.lit(DETAILS_TOKENS).cast("long"), text_tokens(F.col("details_json")))).otherwise(0)
    return (
        F.when(role == "toolResult", content + details + RESULT_TOKENS)
        .when(role == "bashExecution", text_tokens(F.col("command")) + text_tokens(F.col("output")) + BASH_TOKENS)
        .when(role.isin("compactionSummary", "branchSummary"), text_tokens(F.col("summary")) + SUMMARY_TOKENS)
        .when(role == "assistant", content + ASSISTANT_TOKENS)
        .otherwise(content + MESSAGE_TOKENS)
    )


def message_text() -> Column:
    """Text of a row of MESSAGES: its string, or its text, thinking and call blocks by line; empty for command runs and summaries."""

    def part(b):
        call = F.concat(F.lit("call:"), F.coalesce(b["name"], F.lit("")), F.lit("("), F.coalesce(b["arguments_json"], F.lit("{}")), F.lit(")"))
        return F.when(b["type"] == "text", b["text"]).when(b["type"] == "thinking", F.coalesce(b["thinking"], b["text"])).when(b["type"] == "toolCall", call)

    joined = F.array_join(F.filter(F.transform("blocks", part), lambda x: x.isNotNull()), "\n")
    return F.coalesce(F.when(F.col("blocks").isNotNull(), joined).otherwise(F.col("content_text")), F.lit(""))


def fingerprint(text: Column) -> Column:
    """FNV-1a (32 bits, over UTF-16 units) of length, first and, beyond 800 units, last 400 units, as length:hex."""
    step = lambda h, unit: (h.bitwiseXOR(unit) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF))
    written = lambda length, digest: F.concat(length.cast("string"), F.lit(":"), F.lower(F.hex(digest)))
    start = F.lit(0x811C9DC5).cast("long")
    bounded = F.concat(F.length(text).cast("string"), F.lit("\n"), F.substring(text, 1, 400), F.lit("\n"), F.when(F.length(text) > 800, F.right(text, F.lit(400))).otherwise(F.lit("")))
    plain = written(F.length(text), F.aggregate(F.split(bounded, ""), start, lambda h, c: step(h, F.ascii(c).cast("long"))))
    # characters of two units: all is counted and cut in their hexadecimal digits, four a unit
    units = F.hex(F.encode(text, "UTF-16BE"))
    n = F.floor(F.length(units) / 4)
    digits = lambda x: F.hex(F.encode(x, "UTF-16BE"))
    cut = F.concat(digits(F.concat(n.cast("string"), F.lit("\n"))), F.substring(units, 1, 1600), digits(F.lit("\n")), F.when(n > 800, F.right(units, F.lit(1600))).otherwise(F.lit("")))
    each = F.transform(F.sequence(F.lit(0), F.floor(F.length(cut) / 4).cast("int") - 1), lambda i: F.conv(F.substring(cut, i * 4 + 1, F.lit(4)), 16, 10).cast("long"))
    wide = written(n, F.aggregate(each, start, step))
    return F.when(F.length(text) == 0, F.lit("0:empty")).when(text.rlike(ASTRAL), wide).otherwise(plain)


def guarded(estimate: Callable[[dict], int], *columns: str) -> Column:
    """A row's tokens by ``estimate``, which gets the named columns as a dictionary; null for a row on which it raises or gives no number, so that ``classify`` falls back to its own count for that row alone. Batches go by Arrow."""

    @F.pandas_udf("long")
    def estimated(rows: pd.DataFrame) -> pd.Series:
        out = []
        for row in rows.to_dict("records"):
            try:
                value = estimate(row)
                out.append(int(value) if value is not None and value == value else None)
            except Exception:  # a faulty estimator must not stop the meter
                out.append(None)
        return pd.Series(out, dtype="Int64")

    return estimated(F.struct(*columns))


def reclaimable(least: int | Column, of: Callable[[str], Column] = F.col) -> Column:
    """Tokens that pruning a classified item frees; ``of`` gives its columns."""
    t, cls = of("estimated_tokens"), of("class")
    kept = of("engine_stub") | of("pinned") | (cls == "critical") | ~of("type").isin("tool-result", "bash") | (t < least)
    freed = F.when(cls.isin("stale", "disposable"), t - STUB_COST).when((cls == "working") & F.array_contains(of("tags"), "oversized"), t - FOLD_COST).otherwise(0)
    return F.when(kept, 0).otherwise(F.greatest(freed, F.lit(0))).cast("long")


def usable_tokens(window: Column, max_tokens: Column, output: int = 8192, safety: int = 4096) -> Column:
    reserve = F.when(F.coalesce(max_tokens, F.lit(0)) > 0, F.least(F.lit(output), max_tokens)).otherwise(output)
    return F.greatest(F.lit(1024), F.coalesce(window, F.lit(200_000)) - reserve - safety).cast("long")


def importance(base: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), base))
