import random
import re

import numpy as np
import pyarrow as pa
from threadloom.llm import jaccard_join
from threadloom.llm._words import Words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    label = {d: d for d, _ in rows}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                lo, hi = sorted((find(a), find(b)))
                label[hi] = lo
    return sorted((d, len(s), find(d)) for d, s in sets)


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["Été", "ÀB", "x y"]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    common, rows = text(60), []
    for base in range(12):
        words = text(rng.randint(30, 150))
        for _ in range(rng.randint(1, 9)):
            copy = list(words)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append(" ".join(copy) if rng.random() < 0.8 else "\t ".join(copy).upper())
    rows += [" ".join(common + text(10)) for _ in range(15)] + [" ".join(text(15) + common) for _ in range(15)]
    rows += ["", None, " \n", "a", "A", "a b", "a b c d", "a b c d e", "A B C D E", "b a"] + rows[:5] + ["same words here now and then"] * 40
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_matches_brute_force(spark):
    rows = corpus(1)
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n int, token string")
    got = sorted(map(tuple, jaccard_join.similar_documents(docs).collect()))
    assert got == brute(rows)


def test_empty_null_and_repeated_ids(spark):
    schema = "doc_id long, text string"
    assert jaccard_join.similar_documents(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "other words are in this one"), (5, "Other words are in this one"), (9, "a b c d e f")]
    got = sorted(map(tuple, jaccard_join.similar_documents(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(None, 2, None), (3, 2, 3), (3, 2, 3), (5, 2, 3), (9, 2, 3)], key=str)


def test_runs_do_not_depend_on_batches():
    """Rows of shared tokens with first and previous row, the task's first and last token in any case, whatever the batches."""
    rng = np.random.default_rng(0)
    for width in (1, 5, 30, 400):
        token = np.sort(rng.integers(0, width, 300))
        cols = [token, np.arange(300), np.full(300, 7, np.int32), np.zeros(300, np.int32)]
        counts, first = np.bincount(token), np.searchsorted(token, token)
        want = [(i, None if first[i] == i else int(first[i]), None if first[i] == i else i - 1) for i in range(300) if counts[token[i]] > 1 or token[i] in (token[0], token[-1])]
        for size in (300, 1, 2, 3, 7, 50):
            batches = (pa.RecordBatch.from_arrays([pa.array(c[i : i + size]) for c in cols], names=list("abcd")) for i in range(0, 300, size))
            assert [(r["gid"], r["first_gid"], r["prev_gid"]) for b in jaccard_join._runs(batches) for r in b.to_pylist()] == want


def test_bitmaps_never_differ_more_than_sets():
    rng = np.random.default_rng(3)
    for n in (3, 500, 520, 1100, 5000):
        for share in (0.0, 0.05, 0.2, 1.0):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            b = np.concatenate([a[: int(len(a) * (1 - share))], rng.integers(0, 1 << 63, int(n * share * rng.random()) + 1, dtype=np.uint64)])
            different = len(np.setxor1d(a, b))
            sketches = [jaccard_join._parity(x, jaccard_join.sketch_bits(len(x))).tobytes() for x in (a, b)]
            rows = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([1 << 40]), *(pa.array([x], pa.binary()) for x in sketches)], names=["a", "b", "n", "l", "r"])
            (found,) = (r["differ"] for x in jaccard_join._sketched([rows]) for r in x.to_pylist())
            assert found <= different and (share > 0.2 or found >= 0.7 * different - 4)


def test_long_text_is_whole():
    text = " ".join(f"t{i}" for i in range(300_000))
    (found,) = Words(pa.array([text])).shingle_sets()
    assert len(found) == 299_996


def test_members_of_one_group_link_without_its_head(spark, monkeypatch):
    """Trios of one size, most with one prefix: the first links with neither other, those link; counters that all collide."""
    monkeypatch.setattr(jaccard_join, "shingle_counts", lambda docs: np.zeros(jaccard_join.COUNTERS, np.uint32))
    rows = []
    for trio in range(30):
        words = [f"t{trio}w{i}" for i in range(13)]
        rows += [" ".join(words[:11] + ["p", "q"]), " ".join(words), " ".join(words[:12] + ["r"])]
    rows = list(enumerate(rows))
    want = brute(rows)
    assert [c for _, _, c in want] == [x for t in range(30) for x in (3 * t, 3 * t + 1, 3 * t + 1)]
    got = sorted(map(tuple, jaccard_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == want


def test_filters_and_joins_of_ids_agree(spark, monkeypatch):
    """More documents to verify than the filter takes are joined instead, with the same result."""
    rows = corpus(2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard_join, "FILTER_IDS", 0)
    assert sorted(map(tuple, jaccard_join.similar_documents(docs).collect())) == brute(rows)


def test_words_on_which_polynomials_collide(spark):
    """The Thue-Morse word of 1,024 letters and its complement are two words; cases of letters are one."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    word, other = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    rows = [(1, word), (2, other), (3, word.upper()), (4, f"{word} x y z w"), (5, f"{other} x y z w")]
    got = {r.doc_id: r.component_id for r in jaccard_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}
