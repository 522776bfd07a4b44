"""Joins in which one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that are salted at most: those with more than one row in so many of all.
HOT_KEYS = 1000


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], counts: DataFrame, weight: str, spread: list[str]) -> DataFrame:
    """``left`` joined with ``right``; ``counts``, a table that can be read again at no cost, has a row for each key, ``weight`` being its rows in ``left``.

    Keys that hold more than one in HOT_KEYS of all rows (so fewer than
    HOT_KEYS, which are broadcast) are dealt out by a hash of the columns
    ``spread``, over as many salts as shares of that size.
    """
    total = counts.agg(F.sum(weight)).first()[0] or 0
    share = max(1, total // HOT_KEYS)
    hot = F.broadcast(counts.where(F.col(weight) > share).select(*keys, F.ceil(F.col(weight) / share).cast("int").alias("salts")))
    salts = F.coalesce("salts", F.lit(1))
    dealt = left.join(hot, keys, "left").withColumn("salt", F.pmod(F.xxhash64(*spread), salts).cast("int")).drop("salts")
    copies = right.join(hot, keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return dealt.join(copies, [*keys, "salt"]).drop("salt")
