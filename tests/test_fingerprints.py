"""Fingerprints against the rule over UTF-16 units."""

from __future__ import annotations

import random
import struct

from pyspark.sql import functions as F

from threadloom.functions import tokens


def by_units(text):
    raw = text.encode("utf-16-be")
    units = list(struct.unpack(f">{len(raw) // 2}H", raw))
    if not units:
        return "0:empty"
    bounded = [*map(ord, f"{len(units)}\n"), *units[:400], ord("\n"), *(units[-400:] if len(units) > 800 else [])]
    h = 0x811C9DC5
    for u in bounded:
        h = (h ^ u) * 16777619 & 0xFFFFFFFF
    return f"{len(units)}:{h:x}"


def test_texts_of_all_widths(spark):
    dice = random.Random(4)
    texts = ["", "a", "é" * 900, "\U0001f600", "x" * 399 + "\U0001f600" * 500, "\U0001f600x" * 300]
    texts += ["".join(dice.choices(["a", "\n", "é", "語", "\U0001f680", "\U00020000"], dice.choice([[5, 1, 1, 1, 1, 1], [9, 1, 0, 0, 0, 0], [5, 1, 3, 3, 0, 0]]), k=dice.choice([3, 50, 401, 799, 801, 1500]))) for _ in range(40)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tokens.fingerprint(F.col("t")).alias("f")).collect()
    assert [r.f for r in got] == [by_units(t) for t in texts]
