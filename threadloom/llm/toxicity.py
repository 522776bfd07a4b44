"""Toxicity: a linear-chain conditional random field over words.

Learning, from a bounded sample of labelled documents: words and word
beginnings far more frequent in toxic documents become evidence (a log-odds);
words of toxic documents with evidence are the labelled tokens of the chain,
whose weights (bias, evidence, entering and staying in a toxic span) maximise
their likelihood; a logistic curve then maps a document's marginals to a score.

Scoring covers every word of every text. Words without evidence all have the
same transition matrix, so forward and backward passes step over a run of them
by a power of that matrix, in closed form: the marginals are those of the whole
chain. Documents never meet, so no key is hot.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm._store import dropped, lean, written
from threadloom.llm._words import Words, mix, slices

#: Labelled documents learned from at most (in expectation), chosen by a hash of their id.
SAMPLE_DOCS = 12_000
#: Evidence needs so many toxic documents and such a log-odds; the strongest ENTRIES are kept.
MIN_DOCS, MIN_ODDS, ENTRIES = 6, 3.0, 20_000
#: Lengths in bytes of the word beginnings that are features beside whole words.
BEGINNINGS = (3, 4, 5, 6, 7, 8)
_BITS = 18
_U = np.uint64
#: Words are runs of letters, digits and non-ASCII bytes.
_SEPARATORS = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def _features(words: Words):
    """(kind, hash of that feature for the words that have it, their positions)."""
    everything = np.arange(len(words.hash))
    yield mix(words.hash + _U(1)), everything
    size = words.end - words.start
    for n in BEGINNINGS:
        some = np.flatnonzero(size >= n)
        yield mix(words.between(words.start[some], words.start[some] + n) + _U(n)), some


def _words(texts: pa.Array) -> Words:
    return Words(pc.utf8_lower(texts), _SEPARATORS)


def _counts(batches):
    have, count = np.zeros(0, _U), np.zeros((0, 2), np.int64)
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(int)
        for start, stop in slices(batch.column(0)):
            words = _words(batch.column(0).slice(start, stop - start))
            keys, docs = zip(*((h, words.doc[at]) for h, at in _features(words)))
            keys, docs = np.concatenate(keys), np.concatenate(docs)
            order = np.lexsort((keys, docs))
            keys, docs = keys[order], docs[order]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
            keys, label = keys[new], toxic[start:stop][docs[new]]
            both, where = np.unique(np.concatenate([have, keys]), return_inverse=True)
            total = np.zeros((len(both), 2), np.int64)
            np.add.at(total, where[: len(have)], count)
            np.add.at(total, (where[len(have) :], label), 1)
            have, count = both, total
    yield pa.RecordBatch.from_arrays([pa.array(have.view(np.int64)), pa.array(count[:, 1]), pa.array(count[:, 0])], names=["feature", "n1", "n0"])


class Lexicon:
    """Evidence by feature; a word's is the largest of its features'."""

    def __init__(self, features: np.ndarray, odds: np.ndarray):
        order = np.argsort(features)
        self.features, self.odds = features[order], odds[order]
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[features >> _U(64 - _BITS)] = True

    def evidence(self, words: Words) -> np.ndarray:
        found = np.zeros(len(words.hash))
        if len(self.features):
            for keys, at in _features(words):
                maybe = np.flatnonzero(self.bits[keys >> _U(64 - _BITS)])
                where = np.minimum(np.searchsorted(self.features, keys[maybe]), len(self.features) - 1)
                odds = np.where(self.features[where] == keys[maybe], self.odds[where], 0.0)
                found[at[maybe]] = np.maximum(found[at[maybe]], odds)
        return found


def _chains(doc: np.ndarray, pos: np.ndarray, evidence: np.ndarray):
    """Evidence of each document padded to one array: gaps before it, values, which are there, documents."""
    docs, first, size = np.unique(doc, return_index=True, return_counts=True)
    row, col = np.repeat(np.arange(len(docs)), size), np.arange(len(doc)) - np.repeat(first, size)
    shape = len(docs), int(size.max(initial=0))
    gaps, values, there = np.zeros(shape), np.zeros(shape), np.zeros(shape, bool)
    before = np.concatenate([[-1], pos[:-1]])
    before[first] = -1
    gaps[row, col], values[row, col], there[row, col] = pos - before - 1, evidence, True
    return docs, row, col, gaps, values, there


class Chain:
    """Two states; weights (bias, evidence, enter, stay) score being in and moving to the toxic one."""

    def __init__(self, weights):
        self.weights = bias, evidence, enter, stay = tuple(float(w) for w in weights)
        self.step = np.array([[1.0, math.exp(enter)], [1.0, math.exp(stay)]])
        neutral = self.step * np.array([1.0, math.exp(bias)])
        mean, det = np.trace(neutral) / 2, np.linalg.det(neutral)
        root = math.sqrt(max(mean * mean - det, 1e-300))
        self.large, self.ratio = mean + root, (mean - root) / (mean + root)
        self.unit = neutral / self.large

    def over(self, gaps: np.ndarray) -> np.ndarray:
        """[row, 2, 2]: the neutral matrix to the power of each gap, over its larger eigenvalue's."""
        power = (np.sign(self.ratio) ** gaps * np.abs(self.ratio) ** gaps)[:, None, None]
        eye = np.eye(2)
        return ((self.unit - self.ratio * eye) - power * (self.unit - eye)) / (1 - self.ratio)

    def at(self, values: np.ndarray) -> np.ndarray:
        bias, evidence = self.weights[:2]
        here = np.ones((len(values), 2))
        here[:, 1] = np.exp(np.minimum(bias + evidence * values, 300))
        return self.step[None] * here[:, None, :]

    def forward(self, gaps, values, there):
        """Scaled forward vectors after each evidence word, and log Z up to the last (without the runs' common factor)."""
        n, length = gaps.shape
        alpha, log, out = np.tile([1.0, 0.0], (n, 1)), np.zeros(n), []
        for t in range(length):
            new = np.einsum("ni,nij->nj", np.einsum("ni,nij->nj", alpha, self.over(gaps[:, t])), self.at(values[:, t]))
            scale = new.sum(axis=1)
            alpha = np.where(there[:, t, None], new / scale[:, None], alpha)
            log += np.where(there[:, t], np.log(scale) + gaps[:, t] * math.log(self.large), 0)
            out.append(alpha)
        return out, log

    def marginals(self, gaps, values, there, tail):
        """Probability of the toxic state at each evidence word; ``tail``: words behind the last."""
        n, length = gaps.shape
        alphas, _ = self.forward(gaps, values, there)
        beta = np.einsum("nij,nj->ni", self.over(tail), np.ones((n, 2)))
        out = np.zeros((n, length))
        for t in range(length - 1, -1, -1):
            both = alphas[t] * beta
            out[:, t] = np.where(there[:, t], both[:, 1] / both.sum(axis=1), 0)
            back = np.einsum("nij,nj->ni", self.over(gaps[:, t]), np.einsum("nij,nj->ni", self.at(values[:, t]), beta))
            beta = np.where(there[:, t, None], back / back.sum(axis=1)[:, None], beta)
        return out

    def likelihood(self, gaps, values, there, tail, tagged) -> float:
        """Mean log-likelihood of chains whose evidence words are all toxic where ``tagged``, none otherwise (no other word is)."""
        bias, evidence, enter, stay = self.weights
        alphas, log = self.forward(gaps, values, there)
        last = alphas[-1] if alphas else np.tile([1.0, 0.0], (len(tail), 1))
        z = log + tail * math.log(self.large) + np.log(np.einsum("ni,nij->n", last, self.over(tail)))
        joined = np.zeros_like(there)
        joined[:, 1:] = there[:, 1:] & (gaps[:, 1:] == 0)
        score = np.where(tagged[:, None] & there, bias + evidence * values + np.where(joined, stay, enter), 0).sum(axis=1)
        return float((score - z).mean() - 1e-3 * np.square(self.weights).sum())


def _fit_chain(gaps, values, there, tail, tagged) -> Chain:
    """Gradient ascent with a growing and shrinking step; four weights need no more."""
    weights, rate = np.array([-4.0, 0.5, -2.0, 0.0]), 0.5
    best = Chain(weights).likelihood(gaps, values, there, tail, tagged)
    for _ in range(60):
        slope = np.array([Chain(weights + 1e-3 * e).likelihood(gaps, values, there, tail, tagged) - Chain(weights - 1e-3 * e).likelihood(gaps, values, there, tail, tagged) for e in np.eye(4)]) / 2e-3
        new = np.clip(weights + rate * slope, -12, 12)
        value = Chain(new).likelihood(gaps, values, there, tail, tagged)
        if value > best:
            if value - best < 1e-6:
                break
            weights, best, rate = new, value, rate * 1.5
        else:
            rate /= 3
    return Chain(weights)


def _fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    c, ridge = np.zeros(x.shape[1]), np.diag([1e-3] + [0.05] * (x.shape[1] - 1))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        c += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ c)
    return c


class Model:
    def __init__(self, lexicon: Lexicon, chain: Chain, curve: np.ndarray):
        self.lexicon, self.chain, self.curve = lexicon, chain, curve

    def scores(self, texts: pa.Array):
        """By text: the score; by word of a toxic marginal: (text, byte start, byte end)."""
        words = _words(texts)
        evidence = self.lexicon.evidence(words)
        some = np.flatnonzero(evidence)
        x = np.zeros((len(texts), 2))
        spans = np.zeros((0, 3), np.int64)
        if len(some):
            doc, pos = words.doc[some], some - words.first[words.doc[some]]
            docs, row, col, gaps, values, there = _chains(doc, pos, evidence[some])
            ends = np.zeros(len(docs), np.int64)
            np.maximum.at(ends, row, pos)
            p = self.chain.marginals(gaps, values, there, words.count[docs] - 1 - ends)
            x[docs] = np.stack([np.log1p(p.sum(axis=1)), p.max(axis=1)], axis=1)
            hot = some[p[row, col] >= 0.5]
            spans = np.stack([words.doc[hot], words.start[hot], words.end[hot]], axis=1)
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + x @ self.curve[1:], -30, 30))), spans, words


def _evidence_of(shared):
    def rows(batches):
        lexicon = shared.value
        for batch in batches:
            for start, stop in slices(batch.column(0)):
                words = _words(batch.column(0).slice(start, stop - start))
                evidence = lexicon.evidence(words)
                some = np.flatnonzero(evidence)
                n = np.bincount(words.doc[some], minlength=stop - start)
                at = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(v)) for v in ((some - words.first[words.doc[some]]).astype(np.int64), evidence[some])]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(start, stop - start), pa.array(words.count), *lists], names=["toxic", "n", "pos", "evidence"])

    return rows


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit on at most about ``sample_docs`` rows of ``labels`` (doc_id, toxic), chosen by a hash of doc_id, and their texts. Equal texts count once, as toxic if any of their labels is, so copies do not make evidence."""
    spark = docs.sparkSession
    labels = labels.where("doc_id is not null and toxic in (0, 1)").select(F.col("doc_id").alias("labelled"), "toxic")
    share = min(1.0, sample_docs / max(labels.count(), 1))
    drawn = labels.where(F.pmod(F.xxhash64("labelled"), F.lit(1_000_003)) / 1_000_003 < share).groupBy("labelled").agg(F.max("toxic").alias("toxic"))
    sample = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(drawn), F.col("doc_id") == F.col("labelled")).groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")
    sample = written(sample, "sample")
    try:
        sizes = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
        n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
        counts = sample.mapInArrow(lean(_counts), "feature long, n1 long, n0 long").groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
        odds = F.log((F.col("n1") + 0.5) / (n1 + 1)) - F.log((F.col("n0") + 0.5) / (n0 + 1))
        kept = counts.where(F.col("n1") >= MIN_DOCS).withColumn("odds", odds).where(F.col("odds") >= MIN_ODDS).orderBy(F.desc("odds"), "feature").limit(ENTRIES).collect()
        lexicon = Lexicon(np.array([r.feature for r in kept], np.int64).view(_U), np.array([r.odds for r in kept], float))
        rows = sample.mapInArrow(lean(_evidence_of(spark.sparkContext.broadcast(lexicon))), "toxic int, n long, pos array<long>, evidence array<double>").collect()
    finally:
        dropped(sample)
    size = np.array([len(r.pos) for r in rows])
    if not size.sum():
        rate = (n1 + 0.5) / (n1 + n0 + 1)
        return Model(lexicon, Chain([-4, 0.5, -2, 0]), np.array([math.log(rate / (1 - rate)), 0, 0]))
    doc = np.repeat(np.arange(len(rows)), size)
    pos, evidence = np.concatenate([r.pos for r in rows]).astype(np.int64), np.concatenate([r.evidence for r in rows])
    docs_, row, col, gaps, values, there = _chains(doc, pos, evidence)
    ends = np.zeros(len(docs_), np.int64)
    np.maximum.at(ends, row, pos)
    tail = np.array([rows[d].n for d in docs_]) - 1 - ends
    y = np.array([r.toxic for r in rows], float)
    chain = _fit_chain(gaps, values, there, tail, y[docs_] == 1)
    p = chain.marginals(gaps, values, there, tail)
    x = np.zeros((len(rows), 2))
    x[docs_] = np.stack([np.log1p(p.sum(axis=1)), p.max(axis=1)], axis=1)
    return Model(lexicon, chain, _fit_curve(x, y))


def _predict(shared):
    def rows(batches):
        model: Model = shared.value
        for batch in batches:
            for start, stop in slices(batch.column(1)):
                score, spans, words = model.scores(batch.column(1).slice(start, stop - start))
                out = [[] for _ in range(stop - start)]
                for doc, a, b in spans.tolist():
                    chars = lambda x, d=doc: len(words.buf[words.at[d] : x].tobytes().decode())
                    out[doc].append(f"{chars(a)}:{chars(b)}")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array([",".join(x) for x in out])], names=["doc_id", "score", "predicted", "spans"])

    return rows


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> (doc_id, score, predicted, spans), a row for each input row.

    ``spans`` lists the words of a toxic marginal of 0.5 or more as start:end
    in code points of the text (lower-casing here keeps their number). Null or empty texts get the score
    of a text without evidence. Rows that repeat a doc_id stay apart. No rows:
    none. Other columns are ignored.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(lean(_predict(docs.sparkSession.sparkContext.broadcast(model))), "doc_id long, score double, predicted int, spans string")


def toxic_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``scored`` with held_out: learned from labels whose crc32(doc_id as text) modulo 5 is not 0."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    out = scored(docs, train(docs, labels.where(fold != 0)))
    return out.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", "predicted", "spans")
