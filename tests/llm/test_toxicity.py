import random

import numpy as np
import pyarrow as pa

from threadloom.llm import toxicity as tx

SCHEMA = "doc_id long, text string, score string, labelled int"


def test_marginals_match_every_path():
    chain = tx.Chain([-2.0, 0.7, -1.0, 0.4])
    rng = np.random.default_rng(1)
    for _ in range(30):
        n = int(rng.integers(1, 9))
        e = np.where(rng.random(n) < 0.5, rng.random(n) * 5, 0)
        at = np.flatnonzero(e)
        if not len(at):
            continue
        weight, toxic = 0.0, np.zeros(n)
        for path in range(1 << n):
            states = [(path >> i) & 1 for i in range(n)]
            score, before = 0.0, 0
            for t, s in enumerate(states):
                score += s * (-2.0 + 0.7 * e[t] + (0.4 if before else -1.0))
                before = s
            weight += np.exp(score)
            toxic += np.exp(score) * np.array(states)
        _, _, _, gaps, values, there = tx._chains(np.zeros(len(at), int), at, e[at])
        got = chain.marginals(gaps, values, there, np.array([n - 1 - at[-1]]))[0]
        assert np.allclose(got, (toxic / weight)[at])
        _, log = chain.forward(gaps, values, there)


def corpus():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1200):
        text = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        toxic = int(rng.random() < 0.25)
        if toxic:
            for _ in range(rng.randint(1, 4)):
                text[rng.randrange(len(text))] = rng.choice(["Zorg!", "zorgling", "blarf,", "Ünrat"])
        rows.append((i, " ".join(text), "x", 0))
        labels.append((i, 1, toxic))
    return rows, labels


def test_held_out_accuracy_and_spans(spark):
    rows, labels = corpus()
    extra = [(5000, None, None, None), (5001, "", None, None), (None, "zorg zorg", None, None), (5002, "w1 " * 100_000 + "blarf", None, None)]
    docs = spark.createDataFrame(rows + extra, SCHEMA)
    marked = spark.createDataFrame(labels + [(5001, 0, None), (None, 0, 1), (3, 1, labels[3][2])], "doc_id long, quality int, toxic int")
    got = tx.toxic_documents(docs, marked).collect()
    assert len(got) == len(rows) + 4
    truth = {d: t for d, _, t in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 150 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    by_id = {r.doc_id: r for r in got}
    assert by_id[5002].spans == "300000:300005" and by_id[None].spans == "0:4,5:9"
    assert by_id[5000].score == by_id[5001].score and by_id[5000].spans == "" and not by_id[5000].predicted
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_without_rows_or_labels(spark):
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, toxic int")
    assert tx.toxic_documents(docs, labels).count() == 0
    (row,) = tx.toxic_documents(spark.createDataFrame([(1, "a b", "", 0)], SCHEMA), labels).collect()
    assert row.score == 0.5


def test_slices_do_not_matter():
    lexicon = tx.Lexicon(np.zeros(0, np.uint64), np.zeros(0))
    assert not lexicon.evidence(tx._words(pa.array(["a b", None, ""]))).any()


def test_documents_that_share_an_opening_all_count(spark):
    """One opening for all: toxic and clean documents are told apart; equal texts count once, as toxic if any is."""
    opening = "this shared line opens each and every document of one hot source: "
    rows, labels = [], []
    for i in range(200):
        toxic = i % 2
        rows.append((i, opening + f"word{i} " + ("zorg blarf" if toxic else "calm words")))
        labels.append((i, toxic))
    rows += [(900 + i, rows[1][1]) for i in range(20)]
    labels += [(900 + i, 0) for i in range(20)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = tx.train(docs, marks)
    score, _, _ = model.scores(pa.array(["so zorg blarf it is", "calm words it is", rows[1][1]]))
    assert score[0] > 0.5 > score[1] and score[2] > 0.5
