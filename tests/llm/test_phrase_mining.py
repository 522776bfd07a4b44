import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from threadloom.llm import phrase_mining
from threadloom.llm._words import Words

SCHEMA = "doc_id long, text string, lang string, path string, n int, a int"


def plain(rows, min_count, top, depth=5):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for m in range(1, depth + 1):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i : i + m])] += 1
    covered = set()
    for (lang, path), a in f.items():
        if a >= min_count:
            for part in {path[1:], path[:-1]}:
                if part and f[lang, part] == a:
                    covered.add((lang, part))
    out = {}
    for (lang, path), a in f.items():
        if len(path) > 1 and a >= min_count and (lang, path) not in covered:
            score, k = min((1000 * a * n[lang] // (f[lang, path[:k]] * f[lang, path[k:]]), k) for k in range(1, len(path)))
            out.setdefault(lang, []).append((-score, -a, " ".join(path).encode(), f[lang, path[:k]], f[lang, path[k:]]))
    return {(lang, i): (p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)}


def fixture(seed=1, size=400):
    dice = random.Random(seed)
    words = ["the", "The", "of", "a", "é", "b\x01", "b", "Ünï", "x-y", "thing", "wörd", "zz", "\x00q", "ab"]
    phrase = ["alpha beta gamma delta epsilon zeta", "the of the of the", "one two. three four", "New York, new york"]
    rows = [(i, "".join(dice.choice([*words, *phrase]) + dice.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "!", "\r\n"]) for _ in range(dice.randint(0, 60))), dice.choice(["en", "en", "de", None, ""]), "x", 1, 2) for i in range(size)]
    return rows + [(None, None, None, None, None, None), (5, "", "fr", None, None, None), (5, "the of " * 30_000, "en", None, None, None), (5, "the of " * 300, "en", None, None, None)]


def numbers(df):
    return {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


@pytest.mark.parametrize("min_count, top, range_nodes", [(10, 1000, 200_000), (3, 40, 50), (100, 5, 7)])
def test_against_plain_counts(spark, monkeypatch, min_count, top, range_nodes):
    rows = fixture()
    monkeypatch.setattr(phrase_mining, "BLOCK", 16)
    monkeypatch.setattr(phrase_mining, "SHARD_WORDS", 500)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = phrase_mining.top_collocations(docs, top=top, min_count=min_count, range_nodes=range_nodes)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert numbers(got) == plain(rows, min_count, top)


def test_pieces_and_blocks_cut_in_every_way():
    """Blocks cut at any boundaries merge to the nodes of one trie."""

    class Held:
        def __init__(self, value):
            self.value = value

    dice = random.Random(2)
    shards = []
    whole = Counter()
    for _ in range(3):
        shard = phrase_mining.Shard()
        ids, joined = [dice.randrange(5) for _ in range(300)], [dice.random() < 0.7 for _ in range(299)] + [False]
        shard.add(np.array(ids), [b"a", b"b", b"b c"[:1] + b"\x01", b"d", b"e"], np.array(joined))
        names = ["a", "b", "b\x01", "d", "e"]
        for i in range(300):
            for d in range(5):
                if d and not joined[i + d - 1]:
                    break
                whole[tuple(names[j] for j in ids[i : i + d + 1])] += 1
        shards.append(shard)
    for size in (2048, 3):
        phrase_mining.BLOCK, before = size, phrase_mining.BLOCK
        try:
            blocks = [b for s in shards for b in phrase_mining._blocks("en", s, 5)]
        finally:
            phrase_mining.BLOCK = before
        paths = sorted(whole)
        for bounds in ([], sorted({("en", dice.choice(paths)) for _ in range(9)}), [("a", ("z",)), ("en", ("b", "d", "a")), ("en", ("b", "d", "a", "e")), ("fr", ("a",))]):
            cut = [r for b in phrase_mining._cut(Held(bounds))([pa.RecordBatch.from_pylist(blocks, phrase_mining._BLOCK_SCHEMA)]) for r in b.to_pylist()]
            found = {}
            for r in {x["range"] for x in cut}:
                table = pa.Table.from_pylist([x for x in cut if x["range"] == r], phrase_mining._CUT_SCHEMA)
                for row in phrase_mining._merged(Held(bounds), 1, 100)((pa.scalar(r),), table).to_pylist():
                    assert tuple(row["path"]) not in found
                    found[tuple(row["path"])] = row["a"]
                    assert row["left"] == [whole[tuple(row["path"][:k])] for k in range(1, len(row["path"]))]
            assert found == whole


def test_words_of_one_hash_are_told_apart():
    words = Words(pa.array(["ab cd AB cd ef"], pa.large_string()))
    words.hash[:] = 7
    ids, names = phrase_mining.word_ids(words, np.arange(5))
    assert [names[i] for i in ids] == [b"ab", b"cd", b"ab", b"cd", b"ef"]


def test_products_beyond_64_bits(spark):
    """A score is exact where a * n passes 64 bits."""
    n, a = 10**12 + 39, 10**9 + 7
    out = spark.sql(f"select (cast({a} as decimal(38,0)) * cast({n} as decimal(38,0)) * 1000) div (cast({a} as decimal(38,0)) * cast({a + 3} as decimal(38,0))) as s").first().s
    assert out == 1000 * a * n // (a * (a + 3))


def test_no_rows_and_no_phrases(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert phrase_mining.top_collocations(docs).count() == 0
    assert phrase_mining.top_collocations(spark.createDataFrame([(1, "a b", "en", None, 1, 1)], SCHEMA)).count() == 0
