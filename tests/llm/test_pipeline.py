"""The five stages and the whole, against plain Python over small documents."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline as cp
from tests.llm.test_jaccard_join import brute, shingles
from tests.llm.test_language_id import SOUNDS
from tests.llm.test_mixing import reshared
from threadloom.llm import decontamination as dc

pytest.importorskip("public_tokenizers")
#: Extra columns with names that the stages use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, row string, rank int, copies int, component_id long, score double"
EXTRA = ("r", 1, 2, 3, 0.5)


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randint(2, 5))) for _ in range(n))


def corpus():
    rng = random.Random(6)
    items = [(i, text(rng, rng.choice(list(SOUNDS)), 14)) for i in range(5)]
    rows = []
    for i in range(240):
        lang = rng.choice(list(SOUNDS))
        body = text(rng, lang, rng.randint(10, 80))
        if i % 20 == 3:
            item = list(items[i % 5][1])
            item[len(item) // 2] = "#"
            body = f"{body} {''.join(item)} {body[:40]}"
        rows.append((i, body, lang, f"s{i % 4}" if i % 3 else "hot"))
    for i in range(240, 300):  # copies, some with a word more
        base = rows[rng.randrange(240)]
        rows.append((i, base[1] + (" " + text(rng, base[2], 1) if i % 2 else ""), base[2], f"s{i % 5}"))
    rows += [(300, None, "aa", "s0"), (301, "", None, None), (302, "12 34 %", "bb", "s1"), (303, "漢字 仮名 " * 10, None, "s1"), (304, text(rng, "aa", 3000), None, None), (None, rows[0][1] + " and more", "aa", "s2"), (5, rows[5][1], rows[5][2], rows[5][3])]
    return items, rows


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    items, rows = corpus()
    folder = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)
    docs.repartition(5).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(*x, "q") for x in items] + [(9, None, "q"), (10, "", "q")], "item_id long, text string, doc_id string").write.parquet(f"{folder}/benchmark.parquet")
    return items, rows, docs, str(folder)


def near_copies(rows):
    """Rows left: of each group the smallest id, of rows that repeat it the one of the smallest text hash; rows without id."""
    label = {d: c for d, _, c in brute([(r[0], r[1]) for r in rows if r[0] is not None])}
    out = {}
    for r in rows:
        if r[0] is not None and label[r[0]] == r[0]:
            key = hashlib.sha256((r[1] or "").encode()).hexdigest()
            if r[0] not in out or key < out[r[0]][0]:
                out[r[0]] = key, r
    return [r for _, r in out.values()] + [r for r in rows if r[0] is None]


def clean(rows, items):
    found = lambda t: any(dc.search(i.lower().encode(), (t or "").lower().encode(), dc.edits_allowed(len(i.encode())))[0] <= dc.edits_allowed(len(i.encode())) for _, i in items)
    return [r for r in rows if not found(r[1])]


def mixed(rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + size(r[1])
    targets = reshared(sizes)
    out, before = [], {}
    for r in rows:
        rate = targets[r[3]] / sizes[r[3]] if sizes[r[3]] else 0.0
        digest = hashlib.md5((r[1] or "").encode()).hexdigest()
        draw = int(hashlib.md5(f"mix:{'null' if r[0] is None else r[0]}:{digest}".encode()).hexdigest()[:8], 16) / 2**32
        # rows equal in id, source and text share a draw: what the first n + 1 take less what the first n do
        same = r[0], r[3], digest
        n = before[same] = before.get(same, -1) + 1
        out += [r] * (math.ceil((n + 1) * rate - draw) - math.ceil(n * rate - draw))
    return out


def key(r):
    return tuple(map(str, r[:4]))


def same(df, rows):
    assert df.columns == [c.split(" ")[0] for c in SCHEMA.split(", ")]
    got = df.collect()
    assert all(tuple(r)[4:] == EXTRA for r in got)
    assert sorted(map(key, map(tuple, got))) == sorted(map(key, rows))


def test_each_stage(spark, given):
    items, rows, docs, folder = given
    kept = [r for r in rows if r[0] not in (300, 301, 302, 303)]
    same(cp.language(spark, docs, folder), kept)
    same(cp.near_duplicates(spark, docs, folder), near_copies(rows))
    same(cp.without_benchmark(spark, docs, folder), clean(rows, items))
    same(cp.mixed(spark, docs, folder), mixed(rows))
    assert len(near_copies(rows)) < len(rows) - 50 and 10 <= len(rows) - len(clean(rows, items)) <= 40


def test_the_whole(spark, given):
    from tokenizers import Tokenizer

    from threadloom.llm.registry import default_tokenizer

    items, rows, _, folder = given
    kept = [r for r in rows if r[0] not in (300, 301, 302, 303)]
    left = mixed(clean(near_copies(kept), items))
    ids = {r[1]: [*Tokenizer.from_file(default_tokenizer()).encode(r[1], add_special_tokens=False).ids, 2] for r in left}
    got = cp.run(spark, folder).collect()
    want = [(r[0], len(ids[r[1]]), zlib.crc32(np.array(ids[r[1]], "<u4").tobytes())) for r in left]
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    by_start = sorted(got, key=lambda r: r.start)
    assert [r.start for r in by_start] == np.concatenate([[0], np.cumsum([r.n_tokens for r in by_start])[:-1]]).tolist()
    order = [-1 if r.doc_id is None else r.doc_id for r in by_start]
    assert order == sorted(order) and len({r.doc_id for r in got}) > 150
    assert sum(len(shingles(r[1])) for r in left) > 0


def test_stages_without_rows(spark, given):
    _, _, docs, folder = given
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs.limit(0), folder)
        assert out.columns == docs.columns and out.count() == 0
    assert cp.tokens(spark, docs.limit(0), folder).count() == 0


def test_stages_with_nulls_everywhere(spark, given):
    _, _, docs, folder = given
    empty = spark.createDataFrame([(None,) * 9, (None,) * 9, (1, None, None, None, None, None, None, None, None)], SCHEMA)
    assert [stage(spark, empty, folder).count() for _, stage in cp.STAGES] == [0, 3, 3, 0, 3]


def test_names_of_the_stages():
    assert [n for n, _ in cp.STAGES] == ["language ID", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "token-ID output"]
