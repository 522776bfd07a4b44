import random

import numpy as np
from threadloom.llm import decontamination as dc


def distance(item, text):
    """Least edits of ``item`` to a passage of ``text``, by the plain recurrence."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def made(seed=0):
    rng = random.Random(seed)
    syllables = ["the", "re", "ing", "on", "é", "a", "st", "of ", " ", ", ", "qu", "ti"]
    text = lambda n: "".join(rng.choice(syllables) for _ in range(n))
    items = [(i, text(rng.randint(25, 70))) for i in range(12)]
    docs = []
    for i in range(150):
        body = text(rng.randint(20, 200))
        if i % 2:
            passage = list(rng.choice(items)[1])
            for _ in range(rng.choice([0, 0, 1, 3, 6, 10, 14])):
                k = rng.randrange(len(passage))
                passage[k] = rng.choice(["", "z", passage[k] + "y"])
            body = body[:40] + ("".join(passage).upper() if i % 3 else "".join(passage)) + body[40:]
        docs.append((i, body))
    return items, docs


def test_exact_search():
    rng = random.Random(4)
    for _ in range(300):
        item, text = (bytes(rng.choice(b"abc") for _ in range(rng.randint(1, n))) for n in (12, 40))
        best, _ = dc.search(item, text, len(item))
        assert best == distance(item, text)


def test_recall_against_brute_force(spark):
    items, docs = made()
    want = set()
    for d, text in docs:
        for i, item in items:
            a, b = item.lower().encode(), text.lower().encode()
            if distance(a, b) <= dc.edits_allowed(len(a)):
                want.add((d, i))
    rows = [(d, t, "x", 0) for d, t in docs] + [(900, None, "", 0), (901, "", "", 0), (None, items[0][1], "", 0), (902, "long " * 100_000 + items[1][1], "", 0), (3, docs[3][1], "", 0)]
    found = dc.contaminated(spark.createDataFrame(rows, "doc_id long, text string, item_id string, edits int"), spark.createDataFrame([(i, t, 1) for i, t in items] + [(50, None, 1), (51, "", 1), (52, "tinyzz", 1)], "item_id long, text string, doc_id int"))
    pairs = {(r.doc_id, r.item_id) for r in found.collect()}
    assert pairs - {(None, 0), (902, 1)} <= want and len(pairs & want) >= 0.99 * len(want) > 30
    assert {(None, 0), (902, 1)} <= pairs


def test_documents_are_dropped_whole(spark):
    items, docs = made()
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    bad = {r.doc_id for r in dc.contaminated(df, bench).collect()}
    left = dc.decontaminated(df, bench)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == {d for d, _ in docs} - bad
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.decontaminated(df, none).count() == len(docs) and dc.contaminated(df.limit(0), bench).count() == 0


def test_long_items_near_the_limit_are_found():
    """Mixed edits up to the limit in items of several lengths: every copy is found."""
    import pyarrow as pa

    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    for n, copies in ((300, 60), (1200, 20), (4000, 5)):
        item = word(n)
        items, texts = dc.Items([(1, item)]), []
        for _ in range(copies):
            passage = list(item)
            for at in rng.sample(range(n), dc.edits_allowed(n)):  # each a deletion, insertion or substitution
                passage[at] = rng.choice(["", "0", passage[at] + "1"])
            texts.append(word(200) + "".join(passage) + word(200))
        assert {m[0] for m in items.matches(pa.array(texts))} == set(range(copies))


def test_rows_are_dropped_by_their_own_text(spark):
    item = "a benchmark passage that no clean row holds"
    docs = spark.createDataFrame([(None, f"see {item} here"), (1, f"{item}."), (1, "clean"), (None, "clean too"), (2, None)], "doc_id long, text string")
    left = dc.decontaminated(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert sorted(map(tuple, left), key=str) == sorted([(1, "clean"), (None, "clean too"), (2, None)], key=str)


def test_recall_of_the_tables_at_the_limit():
    """Copies with all edits allowed, over lengths that have tables: at least 0.99 are found, as brute force has them."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    chars = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz    ", np.uint8)
    found = wanted = with_tables = 0
    for n in (12, 21, 31, 45, 81, 120, 200, 394):
        items = [bytes(rng.choice(chars, n)) for _ in range(5)]
        block = dc.Items([(k, t.decode()) for k, t in enumerate(items)])
        with_tables += sum(x is not None for x in block.tables)
        texts = []
        for k in range(100):
            row = np.frombuffer(items[k % 5], np.uint8)
            passage = dc._edited(row, rng).tobytes().rstrip(b"\0")
            texts.append((bytes(rng.choice(chars, 60)) + passage + bytes(rng.choice(chars, 60))).decode())
        pairs = {(d, i) for d, i, _, _ in block.matches(pa.array(texts))}
        want = {(d, d % 5) for d, t in enumerate(texts) if dc.search(items[d % 5], t.encode(), dc.edits_allowed(n))[0] <= dc.edits_allowed(n)}
        assert all(dc.search(items[i], texts[d].encode(), n)[0] <= dc.edits_allowed(n) for d, i in pairs)
        found, wanted = found + len(pairs & want), wanted + len(want)
    assert with_tables >= 20 and wanted > 500 and found >= 0.99 * wanted


def test_short_items():
    """Items of any length have more pieces than edits; those under ten bytes are found as they are."""
    import pyarrow as pa

    assert all(n // dc.seed_bytes(n) > dc.edits_allowed(n) for n in range(1, 3000))
    items = dc.Items([(1, "q"), (2, "ab cd"), (3, "twelve bytes"), (4, "İx stands here")])
    got = {m[:3] for m in items.matches(pa.array(["abQ", "xab cdx", "twelve bites", "nothing", "so İX stands her", None]))}
    assert got == {(0, 0, 0), (1, 1, 0), (2, 2, 1), (4, 3, 1)}


def test_many_items_are_prepared_in_tasks(spark):
    """10,000 items of 100 to 1,000 bytes; what tasks make is what one place makes."""
    import time

    rng = np.random.default_rng(6)
    chars = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz    ", np.uint8)
    rows = [(i, bytes(rng.choice(chars, int(rng.integers(100, 1000)))).decode()) for i in range(10_000)]
    bench = spark.createDataFrame(rows, "item_id long, text string").repartition(4)
    began = time.perf_counter()
    blocks = [b.value for b in dc._blocks(bench)]
    assert time.perf_counter() - began < 60
    assert sorted(i for b in blocks for i in b.ids) == list(range(10_000))
    few = [rows[3], (70, None), (71, ""), rows[5]]
    again = next(dc._blocks(spark.createDataFrame(few, "item_id long, text string"))).value
    here = dc.Items([r for r in few if r[1]])
    assert (again.ids, again.texts, again.sampled, again.each, again.own) == (here.ids, here.texts, here.sampled, here.each, here.own)
