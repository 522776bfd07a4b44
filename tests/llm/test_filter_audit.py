import re
from itertools import permutations

import pytest

from threadloom.llm import filter_audit
from threadloom.llm.filter_audit import FILTERS, Chains

SCHEMA = "doc_id long, text string, lang string, mask string, part int, good int"


def plain(rows, labels):
    """Every row, order and step by hand."""
    smallest, known = {}, {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            smallest[text or ""] = min(smallest.get(text or "", doc_id), doc_id)
    for doc_id, quality, toxic in labels:
        good, bad = known.get(doc_id, (0, 0))
        known[doc_id] = max(good, int(quality == 1)), max(bad, int(toxic == 1))
    facts = {}
    for doc_id, text, lang, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = set()
        if len(words) < 200:
            fails.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text):
            fails.add("C")
        if re.search(r"[#$%&*|]", text):
            fails.add("D")
        if doc_id is not None and smallest[text] < doc_id:
            fails.add("E")
        facts.setdefault(lang or "", []).append((fails, *(known.get(doc_id, (0, 0)) if doc_id is not None else (0, 0))))
    out = {}
    for part, docs in facts.items():
        sums = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left, gone = docs, []
            for step, letter in enumerate(order, 1):
                removed = [d for d in left if letter in d[0]]
                left = [d for d in left if letter not in d[0]]
                redundant = sum(letter in d[0] for d in gone)
                gone = gone + removed
                sums[letter] += len(removed)
                alone = sum(d[0] == {letter} for d in docs)
                out[part, "".join(order), step] = [len(left), len(removed), redundant, alone, sum(d[1] for d in removed), sum(d[2] for d in removed)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(sums[order[step - 1]])
    return out


def fixture():
    long = " ".join(f"w{i}" for i in range(230))
    rows = [(i, [long, long + " x", "a b", "", None, "THE cat", "a " * 300, "A " * 250, f"only {i} #", "ünï　x y"][i % 10], ["en", "de", None, ""][i % 4], "m", 1, 2) for i in range(200)]
    rows += [(3, long, "en", None, None, None), (3, "a b", "en", None, None, None), (None, "a b", "en", None, None, None), (None, None, None, None, None, None), (-5, "a b", "fr", None, None, None)]
    rows += [(500 + i, "x y " * 20_000, "fr", None, None, None) for i in range(3)]
    labels = [(i, i % 3 % 2, int(i % 7 == 0)) for i in range(0, 200, 2)] + [(4, 1, None), (4, None, 1), (None, 1, 1), (10**6, 1, 1)]
    return rows, labels


def numbers(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


def test_every_order_against_plain_sets(spark):
    rows, labels = fixture()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = filter_audit.filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert numbers(got) == plain(rows, labels)


def test_full_chains_are_routed_and_begun_anew(spark):
    rows, _ = fixture()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(filter_audit.judged(docs, chain_bytes=100)) == key(filter_audit.judged(docs))


def test_copies_of_a_hot_text(spark):
    rows = [(i, "same" if i % 3 else f"own {i}", "en", None, None, None) for i in range(900)]
    got = filter_audit.copies(spark.createDataFrame(rows, SCHEMA).repartition(6))
    assert sorted(r.doc_id for r in got.collect()) == [i for i in range(900) if i % 3 and i > 1]


def test_chains_tell_texts_of_one_fingerprint_apart():
    chains = Chains(16)
    gone = [x for doc_id, text in [(5, b"a"), (4, b"b"), (2, b"a"), (9, b"b"), (2, b"a")] for x in chains.add(7, text, 0, doc_id, {"p": 1})]
    assert gone == [(5, "p", 16), (9, "p", 16)]
    assert sorted(chains.heads()) == [(7, b"a", 0, 2, {"p": 2}), (7, b"b", 0, 4, {"p": 1})]


def test_no_rows(spark):
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(docs, labels).count() == 0


@pytest.mark.parametrize("filters", [{}, {"X": FILTERS["A"]}])
def test_other_filters(spark, filters):
    rows, labels = fixture()
    got = filter_audit.filter_audit(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), filters)
    assert {r.filter_order for r in got.collect()} == ({"E"} if not filters else {"XE", "EX"})
