"""Filter interaction audit: which of several filters removes what in every order.

Each text is judged once; what it fails is a bit mask. One filter asks whether
a smaller id holds the same text. For it, rows are routed by the xxhash of
their text to a partition that keeps, under each fingerprint, a chain of full
texts with the smallest id of each: a row whose id is not the smallest leaves
at once, so an entry never grows with its copies. Tasks do the same to their
own rows first and route one row a text. Masks are then counted in
one vector for each part (combineByKey), from which every order follows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Failure conditions of a text, from its bytes, code points and words (runs of bytes other than space and 0x09-0x0D).
Filters = dict[str, Callable[[bytes, int, list[bytes]], bool]]
_UPPER, _SIGNS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
FILTERS: Filters = {
    "A": lambda raw, chars, words: len(words) < 200,
    "B": lambda raw, chars, words: 100 * len(set(words)) < 50 * len(words),
    "C": lambda raw, chars, words: 100 * (len(raw) - len(raw.translate(None, _UPPER))) > 3 * chars,
    "D": lambda raw, chars, words: len(raw.translate(None, _SIGNS)) < len(raw),
}
#: The filter of exact copies, whose bit follows those of the others.
COPY = "E"
#: Bytes of text in the chains of a task that reads documents; full chains are routed and begun anew.
CHAIN_BYTES = 32 << 20
#: Bytes of text that a partition of routed texts holds, by the sum of all.
ROUTED_BYTES = 16 << 20


class Chains:
    """Under each fingerprint, a chain of [text, mask, smallest id, rows of that id by part]."""

    def __init__(self, copy: int):
        self.copy, self.chains, self.bytes = copy, {}, 0

    def add(self, print_: int, text: bytes, mask: int, doc_id: int, rows: dict[str, int]) -> Iterator[tuple[int, str, int]]:
        """Takes rows in; gives those (id, part, mask) that are known to be copies of a smaller id."""
        chain = self.chains.setdefault(print_, [])
        entry = next((e for e in chain if e[0] == text), None)
        if entry is None:
            chain.append([text, mask, doc_id, dict(rows)])
            self.bytes += len(text) + 200
            return
        if doc_id < entry[2]:
            (doc_id, rows), (entry[2], entry[3]) = (entry[2], entry[3]), (doc_id, dict(rows))
        elif doc_id == entry[2]:
            for part, n in rows.items():
                entry[3][part] = entry[3].get(part, 0) + n
            return
        for part, n in rows.items():
            yield from [(doc_id, part, mask | self.copy)] * n

    def heads(self) -> Iterator[tuple[int, bytes, int, int, dict[str, int]]]:
        for print_, chain in self.chains.items():
            for entry in chain:
                yield print_, *entry
        self.chains, self.bytes = {}, 0


def _away(doc_id: int | None) -> int:
    """The key of rows that are judged already: they spread by their id."""
    return xxhash.xxh64_intdigest(str(doc_id))


def _judged(filters: Filters, chain_bytes: int):
    def run(rows):
        chains = Chains(1 << len(filters))
        for doc_id, part, text in rows:
            raw = text.encode()
            words = raw.split()
            mask = sum(bool(fails(raw, len(text), words)) << bit for bit, fails in enumerate(filters.values()))
            del words
            if doc_id is None:
                yield _away(doc_id), (None, mask, doc_id, {part: 1})
                continue
            for other, of, found in chains.add(xxhash.xxh64_intdigest(raw), raw, mask, doc_id, {part: 1}):
                yield _away(other), (None, found, other, {of: 1})
            if chains.bytes > chain_bytes:
                yield from ((print_, entry) for print_, *entry in chains.heads())
        yield from ((print_, entry) for print_, *entry in chains.heads())

    return run


def _met(copy: int):
    def run(routed):
        chains = Chains(copy)
        for print_, (text, mask, doc_id, rows) in routed:
            if text is None:
                yield from ((doc_id, part, mask) for part, n in rows.items() for _ in range(n))
            else:
                yield from chains.add(print_, text, mask, doc_id, rows)
        for _, _, mask, doc_id, rows in chains.heads():
            yield from ((doc_id, part, mask) for part, n in rows.items() for _ in range(n))

    return run


def judged(docs: DataFrame, filters: Filters = FILTERS, part: str = "lang", chain_bytes: int = CHAIN_BYTES) -> DataFrame:
    """``docs`` (doc_id, text, part, ...) -> (doc_id, part, mask), a row for each input row.

    Bit i of ``mask`` says that the row fails the i-th filter, the last bit
    that its text is also that of a smaller id. Null text is empty (and equal
    to other empty texts); a null part is the empty string. Rows that repeat
    an id and text are no copies of each other. A row without an id is no copy
    and makes none. No rows: none. Other columns are ignored.
    """
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // ROUTED_BYTES))
    slim = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col(part).cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))).rdd
    met = slim.mapPartitions(_judged(filters, chain_bytes)).partitionBy(partitions, int).mapPartitions(_met(1 << len(filters)))
    return docs.sparkSession.createDataFrame(met, "doc_id long, part string, mask int", verifySchema=False)


def copies(docs: DataFrame) -> DataFrame:
    """(doc_id) of the rows whose whole text a smaller id also holds; rows as in ``judged``."""
    return judged(docs, {}, part="doc_id").where("mask = 1").select("doc_id")


def mask_counts(rows: DataFrame, n_filters: int):
    """RDD of (part, counts[mask, (all, good, toxic)]) of ``rows`` (part, mask, good, toxic)."""

    def one(row, counts=None):
        counts = np.zeros((1 << n_filters, 3), np.int64) if counts is None else counts
        counts[row[0]] += (1, row[1], row[2])
        return counts

    pairs = rows.select("part", "mask", F.col("good").cast("int"), F.col("toxic").cast("int")).rdd.map(lambda r: (r[0], (r[1], r[2], r[3])))
    return pairs.combineByKey(one, lambda counts, row: one(row, counts), lambda a, b: a + b)


def interactions(part: str, counts: np.ndarray, letters: str) -> list[tuple]:
    """Rows of every order and step: what a filter keeps, removes, would have removed, and alone removes."""
    masks = np.arange(len(counts))
    bit = {letter: 1 << i for i, letter in enumerate(letters)}
    orders = ["".join(p) for p in permutations(letters)]
    shapley, rows = dict.fromkeys(letters, 0), []
    for order in orders:
        before = 0
        for step, letter in enumerate(order, 1):
            fails, gone = masks & bit[letter] > 0, masks & before > 0
            removed, good, toxic = counts[fails & ~gone].sum(axis=0).tolist()
            before |= bit[letter]
            kept, redundant, alone = int(counts[masks & before == 0, 0].sum()), int(counts[fails & gone, 0].sum()), int(counts[bit[letter], 0])
            shapley[letter] += removed
            rows.append((part, order, step, kept, removed, redundant, alone, good, toxic))
    return [(*row, shapley[row[1][row[2] - 1]]) for row in rows]


def filter_audit(docs: DataFrame, labels: DataFrame, filters: Filters = FILTERS, part: str = "lang") -> DataFrame:
    """A row for each part of ``docs``, order of the filters (and COPY) and step.

    Rows of ``docs`` as in ``judged``; ``labels`` (doc_id, quality, toxic)
    may lack ids, repeat them (any 1 counts) or hold nulls (not 1). No rows: none.
    """
    letters = "".join(filters) + COPY
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    # rows without an id match no label; a number of their own keeps them from meeting in one task
    rows = judged(docs, filters, part).withColumn("named", F.col("doc_id").isNotNull()).withColumn("doc_id", F.coalesce("doc_id", F.monotonically_increasing_id()))
    labelled = rows.join(known.withColumn("named", F.lit(True)), ["doc_id", "named"], "left").select("part", "mask", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))
    out = mask_counts(labelled, len(letters)).flatMap(lambda pair: interactions(pair[0], pair[1], letters))
    numbers = ", ".join(f"{c} long" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
    return docs.sparkSession.createDataFrame(out, f"part string, filter_order string, step int, {numbers}", verifySchema=False)


SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), smallest AS (
  SELECT text, min(doc_id) AS least FROM texts GROUP BY text
), known AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), masks AS (
  SELECT part, good, toxic,
    CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN least < texts.doc_id THEN 16 ELSE 0 END AS mask
  FROM texts JOIN smallest USING (text) LEFT JOIN known ON texts.doc_id = known.doc_id
), counted AS (
  SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM masks GROUP BY part, mask
), letters(l, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), steps AS (
  SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), each AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (mask & (own | before) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (mask & own > 0 AND mask & before = 0), 0) AS removed,
    coalesce(sum(n) FILTER (mask & own > 0 AND mask & before > 0), 0) AS redundant,
    coalesce(sum(n) FILTER (mask = own), 0) AS unique_fails,
    coalesce(sum(good) FILTER (mask & own > 0 AND mask & before = 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (mask & own > 0 AND mask & before = 0), 0) AS toxic_lost
  FROM counted, steps GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM each
"""
