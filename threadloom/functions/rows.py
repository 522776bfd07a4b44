"""Helpers on whole rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of messages that go to one task, and what a row of them weighs beside its texts: sorts hold its columns.
SHARE_BYTES, ROW_BYTES = 32 << 20, 1000


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a new column that is computed once a row: the optimizer would copy its expression to every place that reads it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def held(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, where ``once`` would carry every row through one more step for the sake of a few."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shares(messages: DataFrame) -> int:
    """Partitions for MESSAGES dealt by session, from one pass over the lengths of their texts: a task's memory then does not grow with the table.

    A number that is given outright is kept. Partitions that Spark merges are
    merged by their compressed size, of which repeated texts have little.
    """
    of_blocks = F.aggregate("blocks", F.lit(0).cast("long"), lambda n, b: n + sum((F.coalesce(F.octet_length(b[c]), F.lit(0)) for c in ("text", "thinking", "arguments_json")), F.lit(0)))
    texts = (F.coalesce(F.octet_length(c), F.lit(0)) for c in ("content_text", "output", "summary"))
    found = messages.agg(F.sum(sum(texts, F.lit(ROW_BYTES).cast("long")) + F.coalesce(of_blocks, F.lit(0))).alias("n")).first()["n"] or 0
    return max(int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-found // SHARE_BYTES))


def dealt(rows: DataFrame, parts: int | None) -> DataFrame:
    """``rows`` dealt by session, into ``parts`` partitions if that is given."""
    return rows.repartition(parts, "session_id") if parts else rows.repartition("session_id")
