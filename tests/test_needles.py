"""Pins of a session looked for at once, against plain containment."""

from __future__ import annotations

import random
import time

from tests.scenes import frame, result, said, user
from threadloom.operators import items, needles, pins
from threadloom.schema import PINS


def pin_frame(spark, rows):
    return spark.createDataFrame([(s, f"p{i}", kind, text, i, None, None, True) for i, (s, kind, text) in enumerate(rows)], PINS)


def test_against_contains(spark):
    dice = random.Random(2)
    text = lambda n: "".join(dice.choice("ab é\n") for _ in range(dice.randint(0, n)))
    texts = [(f"s{k % 5}", i, text(40)) for k in range(5) for i in range(30)]
    asked = [(f"s{dice.randrange(6)}", text(6)) for _ in range(80)]
    t, n = spark.createDataFrame(texts, "session_id string, message_index int, text string").repartition(3), spark.createDataFrame(asked, "session_id string, needle string")
    got = {(r.session_id, r.message_index) for r in needles.holding(t, n).collect()}
    assert got == {(s, i) for s, i, x in texts if any(s == q and w and w in x for q, w in asked)}
    whole, ends = {}, {}
    for s, i, x in texts:
        if x:
            whole[s] = whole[s] + "\n" + x if s in whole else x
            ends.setdefault(s, []).append((len(whole[s]), i))
    want = {(s, w, next(i for end, i in ends[s] if whole[s].index(w) + len(w) <= end)) for s, w in asked if w and w in whole.get(s, "")}
    assert {(r.session_id, r.needle, r.message_index) for r in needles.first_seen(t, n).collect()} == want


def test_ten_thousand_pins_of_one_session(spark):
    dice = random.Random(1)
    word = lambda: "".join(dice.choice("abcdefghij") for _ in range(12))
    asked = [("s", "note", word()) for _ in range(10_000)]
    said_ = [user(" ".join(word() for _ in range(2000)) + (asked[i][2] if i % 3 == 0 else "")) for i in range(300)]
    messages, marks = frame(spark, {"s": said_}), pin_frame(spark, asked)
    began = time.perf_counter()
    lost = {r.content for r in pins.missing_pins(messages, marks).collect()}
    assert time.perf_counter() - began < 60
    assert lost == {w for _, _, w in asked} - {asked[i][2] for i in range(0, 300, 3)}
    kept = {r.message_index for r in items.classify(messages, marks).where("pinned").collect()}
    assert kept == set(range(0, 300, 3))


def test_blank_and_repeated_pins(spark):
    messages = frame(spark, {"s": [user("Keep the API"), said("fine"), result("bash", "keep the api")], "t": [user("x")]})
    rows = [("s", "constraint", " keep THE api "), ("s", "constraint", "keep the API"), ("s", "note", " "), ("s", "file", ""), ("t", "file", "gone.py"), ("u", "note", "never said")]
    lost = pins.missing_pins(messages, pin_frame(spark, rows))
    assert lost.columns == [f.split(" ")[0] for f in PINS.split(", ")]
    assert sorted((r.session_id, r.content) for r in lost.collect()) == [("s", " "), ("t", "gone.py"), ("u", "never said")]
    assert pins.missing_pins(messages, pin_frame(spark, rows).limit(0)).count() == 0
