"""Many texts looked for at once: one automaton for each session's needles, fed its messages in order."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.rows import dealt


class _Session:
    """Needles of one session, and where they have been seen."""

    def __init__(self, name):
        self.name, self.needles, self.automaton = name, [], None

    def built(self):
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for needle in self.needles:
                self.automaton.add_word(needle, needle)
            self.automaton.make_automaton()
            self.walk, self.left = self.automaton.iter(""), set(self.needles)
            self.fresh = True
        return self.automaton


def _scan(joined: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            names, places, found = [], [], []
            for session, place, text in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or session != now.name:
                    now = _Session(session)
                if place is None:
                    now.needles.append(text)
                    continue
                if not now.needles or not text:
                    continue
                automaton = now.built()
                if not joined:
                    if next(automaton.iter(text), None) is not None:
                        names.append(session), places.append(place), found.append(None)
                    continue
                if not now.left:
                    continue
                now.walk.set(text if now.fresh else "\n" + text, False)
                now.fresh = False
                for _, needle in now.walk:
                    if needle in now.left:
                        now.left.discard(needle)
                        names.append(session), places.append(place), found.append(needle)
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(places, pa.int32()), pa.array(found, pa.string())], names=["session_id", "message_index", "needle"])

    return rows


def _found(texts: DataFrame, needles: DataFrame, joined: bool, parts: int | None) -> DataFrame:
    rows = texts.select("session_id", F.col("message_index").cast("int").alias("message_index"), "text")
    asked = needles.select("session_id", F.lit(None).cast("int").alias("message_index"), F.col("needle").alias("text")).where("text <> ''").distinct()
    placed = dealt(asked.unionByName(rows), parts).sortWithinPartitions("session_id", F.col("message_index").asc_nulls_first())
    return placed.mapInArrow(_scan(joined), "session_id string, message_index int, needle string")


def holding(texts: DataFrame, needles: DataFrame, parts: int | None = None) -> DataFrame:
    """(session_id, message_index) of the ``texts`` (session_id, message_index, text) that contain some of their session's ``needles`` (session_id, needle). Case counts; empty needles are in none."""
    return _found(texts, needles, False, parts).select("session_id", "message_index")


def first_seen(texts: DataFrame, needles: DataFrame, parts: int | None = None) -> DataFrame:
    """(session_id, needle, message_index): the first text, in order and joined by line ends, up to which each of a session's needles has been seen."""
    return _found(texts, needles, True, parts)
