"""Language ID with language-bitmask n-gram filters.

One Bloom filter holds the n-grams of all languages, bit-sliced: each of its
positions keeps a bit per language, so the AND over an n-gram's positions is
the set of languages that contain it. A text's n-grams are looked up once; the
hits of each language are counted, corrected for the filter's false positives
(whose rate its fill gives), and the largest share decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm._store import lean
from threadloom.llm._words import raw, slices

#: Labelled documents fitted per language at most (in expectation), chosen by a hash of their id.
SAMPLE_DOCS = 3000
#: N-grams kept per language, the most frequent ones; an n-gram belongs to each
#: language in which it is at least RATIO times as frequent as anywhere.
PROFILE, MIN_COUNT, RATIO = 60_000, 3, 0.2
POSITIONS, HASHES = 1 << 20, 2
UNDETERMINED = "und"

_U = np.uint64
_FACTORS = [_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)]
_SHIFT = _U(64 - 20)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123, dtype=np.uint8)


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Four-byte n-grams of all texts, folded to lower-case letters and single spaces, and the ends of each text's."""
    padded = pc.binary_join_element_wise("", pc.fill_null(pc.utf8_lower(texts), ""), "", " ")
    buf, at = raw(padded)
    b = _FOLD[buf]
    n = len(b)
    if n < 4:
        return np.zeros(0, _U), np.zeros(len(at) - 1, np.int64)
    space = b == 32
    twice = space[1:] & space[:-1]
    good = ~(twice[:-2] | twice[1:-1] | twice[2:])
    wide = b.astype(np.uint32)
    grams = (wide[:-3] << 24) | (wide[1:-2] << 16) | (wide[2:-1] << 8) | wide[3:]
    ends = at[1:]
    begins = np.zeros(n + 1, bool)
    begins[ends[:-1]] = True
    crossing = begins[1 : n - 2] | begins[2 : n - 1] | begins[3:n]
    good &= ~crossing
    kept = np.flatnonzero(good)
    return grams[kept].astype(_U), np.searchsorted(kept, ends)


def _counts(batches):
    total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for lang in set(langs.tolist()):
            texts = batch.column(1).filter(pa.array(langs == lang))
            for start, stop in slices(texts, 1 << 23):
                grams, n = np.unique(_grams(texts.slice(start, stop - start))[0], return_counts=True)
                if lang in total:
                    both, where = np.unique(np.concatenate([total[lang][0], grams]), return_inverse=True)
                    n = np.bincount(where, np.concatenate([total[lang][1], n])).astype(np.int64)
                    grams = both
                total[lang] = grams, n
    for lang, (grams, n) in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


class Model:
    """The filter: ``table`` [position, byte of the language mask], the languages in code point order, and their false positive rates."""

    def __init__(self, langs: list[str], default: str, profiles: dict[str, np.ndarray]):
        self.langs, self.default = langs, default
        self.table = np.zeros((POSITIONS, (len(langs) + 7) // 8 or 1), np.uint8)
        for i, lang in enumerate(langs):
            for at in self.positions(profiles[lang]):
                self.table[at, i // 8] |= np.uint8(1 << i % 8)
        fill = [((self.table[:, i // 8] >> (i % 8)) & 1).mean() for i in range(len(langs))]
        self.false_rate = np.array(fill) ** HASHES

    @staticmethod
    def positions(grams):
        return [((grams.astype(_U) * f) >> _SHIFT).astype(np.int64) for f in _FACTORS[:HASHES]]

    def shares(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """By text: the corrected share of its n-grams in each language, and its number of n-grams."""
        grams, ends = _grams(texts)
        starts = np.concatenate([[0], ends[:-1]])
        size = ends - starts
        out = np.zeros((len(ends), len(self.langs)))
        at = self.positions(grams)
        for word in range(self.table.shape[1]):
            column = np.ascontiguousarray(self.table[:, word])
            mask = column[at[0]]
            for p in at[1:]:
                mask &= column[p]
            for i in range(8 * word, min(len(self.langs), 8 * word + 8)):
                hits = np.concatenate([[0], np.cumsum((mask >> (i % 8)) & 1, dtype=np.int64)])
                out[:, i] = hits[ends] - hits[starts]
        rate = self.false_rate
        corrected = (out - size[:, None] * rate) / np.maximum(1 - rate, 1e-9)
        return np.clip(corrected / np.maximum(size, 1)[:, None], 0, 1), size


def train(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit on ``labelled`` (doc_id, text, lang): at most about ``sample_docs`` rows per language, chosen by a hash of doc_id; at most PROFILE n-grams per language reach the driver, and the filter takes a megabyte for each eight languages; none is left out."""
    rows = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], UNDETERMINED, {})
    share = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample_docs / n))))
    drawn = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003 < share[F.col("lang")])
    counts = drawn.select("lang", "text").mapInArrow(lean(_counts), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rated = counts.join(F.broadcast(total), "lang").withColumn("rate", F.col("n") / F.col("total"))
    best = rated.withColumn("best", F.max("rate").over(Window.partitionBy("gram"))).where((F.col("n") >= MIN_COUNT) & (F.col("rate") >= RATIO * F.col("best")))
    kept = best.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= PROFILE)
    found = kept.groupBy("lang").agg(F.collect_list("gram").alias("grams")).collect()
    profiles = {lang: np.zeros(0, np.int64) for lang in sizes} | {r.lang: np.array(r.grams, np.int64) for r in found}
    return Model(sorted(sizes), max(sorted(sizes), key=sizes.get), profiles)


def _predictions(shared):
    def predictions(batches):
        model: Model = shared.value
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            for start, stop in slices(texts):
                n = stop - start
                if model.langs:
                    shares, size = model.shares(texts.slice(start, n))
                    best = shares.argmax(axis=1)
                    score = shares[np.arange(n), best]
                    langs = [model.langs[i] if s > 0 else model.default for i, s in zip(best, score)]
                else:
                    score, size, langs = np.zeros(n), np.zeros(n, np.int64), [UNDETERMINED] * n
                known = letters[start:stop]
                yield pa.RecordBatch.from_arrays([ids.slice(start, n), pa.array([x if k else UNDETERMINED for x, k in zip(langs, known)]), pa.array(np.where(known, score, 0.0)), pa.array(size)], names=["row", "lang_pred", "score", "n_grams"])

    return predictions


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (text, ...) -> (row struct of all its columns, lang_pred, score, n_grams), a row for each input row.

    Null text, or one without a letter: ``und``, score 0. A text whose n-grams
    are in no filter: the most frequent learned language, score 0. Ties: the
    first language in code point order. Without any labelled row: ``und``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(_predictions(shared)), f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double, n_grams long")


def fold(doc_id="doc_id", n: int = 4):
    """crc32 of the id as text, modulo ``n``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def identified(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, n_grams) for each row of ``docs`` (doc_id, text, lang, ...), learned from rows whose fold is not 2. A null doc_id is not held out and not learned from."""
    model = train(docs.where(fold() != 2))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(lean(_predictions(shared)), "row long, lang_pred string, score double, n_grams long")
    return out.select(F.col("row").alias("doc_id"), "lang_pred", "score", "n_grams").withColumn("held_out", F.coalesce(fold() == 2, F.lit(False))).select("doc_id", "held_out", "lang_pred", "score", "n_grams")
