import random
import shutil
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threadloom.llm import token_store as ts

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def reference(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def texts():
    rng = random.Random(3)
    glue = [" ", "  ", "\n", " \n", "\t", ". ", ", ", "'s ", " 're", " ", "!! ", "  \n ", "\x1c ", "\x85"]
    words = ["the", "It", "Ça", "naïve", "123", "foo_bar", "<|endoftext|>", "日本", "🙂", "don't", "a,b", "x...", "((y", "é.,", "#$%"]
    out = ["".join(rng.choice(words) + rng.choice(glue) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    return out + ["", " ", "   ", "a ", " a", "word " * 6000, out[0], out[0]]


def test_pieces_encode_as_whole_texts():
    found = ["foo_.", "see _this_. and foo_, bar__!! x_ .", "a <|endoftext|> b", "<|endoftext|>", *texts()]
    want = reference(found)
    assert ts.encoded(found, PATH) == want
    assert want[0] == [21943, 44807] and 50256 in want[2] and want[3] == [50256]


def test_every_pair_of_neighbours_encodes_as_in_the_library():
    """Each character beside each other one, alone, between words and behind a space."""
    marks = [chr(i) for i in range(128)] + list("\x85\xa0\u1680\u2003\u2028\u202f\u205f\u3000éßΩ日🙂²½٣\u0301ǅ") + ["'s", "'ll", "  ", "\n\n", " \n"]
    found = [x + y for x in marks for y in marks]
    found = [f"a{p}b c{p}" for p in found] + [f" {p}1 {p}x" for p in found] + found
    assert ts.encoded(found, PATH) == reference(found)


def test_small_tables_and_long_texts(monkeypatch):
    """A table that forgets all the time, places that collide and sections of one long text change nothing."""
    from threadloom.llm import _pieces

    monkeypatch.setattr(_pieces, "PLACES_BITS", 5)
    monkeypatch.setattr(_pieces, "STORED_IDS", 300)
    monkeypatch.setattr(_pieces, "SLICE_BYTES", 1000)
    one = _pieces.Encoder(PATH)
    found = texts() + ["x" * 5000, " ".join(texts())]
    for _ in range(2):
        ids, sizes = one.encode(pa.array(found))
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == reference(found)


def test_other_tokenizers_get_whole_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    found = ["Hello  world", "", "a <|endoftext|> b's"]
    assert ts.encoded(found, path) == [e.ids for e in Tokenizer.from_file(path).encode_batch(found, add_special_tokens=False)]


def test_tree_in_order():
    """The tree built leaf by leaf is that built level by level."""
    for n in range(20):
        leaves = [bytes([i]) for i in range(n)]
        level = leaves or [ts._digest(b"")]
        while len(level) > 1:
            level = [ts._digest(b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        assert ts.merkle(leaves) == level[0]


def test_crc_of_parts():
    rng = np.random.default_rng(0)
    for _ in range(20):
        parts = [rng.bytes(int(rng.integers(0, 90))) for _ in range(5)]
        after = np.array([sum(map(len, parts[i + 1 :])) for i in range(5)])
        whole = ts.crc_followed_by(np.array([zlib.crc32(p) for p in parts]), after)
        assert int(np.bitwise_xor.reduce(whole)) == zlib.crc32(b"".join(parts))


def test_cuts_follow_content():
    ids = np.random.default_rng(1).integers(0, 50257, 60_000).astype(ts.WIDTH)
    ends = ts.cuts(ids)
    assert ends[-1] == len(ids) and max(np.diff([0, *ends])) <= ts.MAX_IDS
    moved = [e - 100 for e in ts.cuts(np.concatenate([ids[:100][::-1], ids]))]
    assert len(set(ends) & set(moved)) > 0.9 * len(ends)


def test_round_trip(spark, tmp_path):
    found = texts()
    rows = [(i, t, 0, "p") for i, t in enumerate(found)] + [(None, None, 1, "q"), (5, found[5], 2, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part int, root string").repartition(5)
    path = f"file://{tmp_path}/s"
    ts.write_store(docs, path, PATH)
    want, start = [], 0
    for r, ids in sorted(zip(rows, reference([r[1] or "" for r in rows])), key=lambda x: -1 if x[0][0] is None else x[0][0]):
        ids = [*ids, ts.END_ID]
        want.append((r[0], start, ids))
        start += len(ids)
    got = ts.read_digests(spark, path).collect()
    key = lambda x: (x[1])
    assert sorted([(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got], key=key) == [(d, s, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, s, i in want]
    assert sorted([(r.doc_id, r.start, r.ids) for r in ts.read_ids(spark, path).collect()], key=key) == want
    chunks = ts._stored(spark, path).where("kind = 'chunk'")
    assert chunks.count() == chunks.select("key").distinct().count()
    assert spark.read.parquet(f"{path}/manifest").agg({"n_tokens": "sum"}).first()[0] == start


def test_no_documents(spark):
    assert ts.stored_digests(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_damage_is_found(spark, tmp_path):
    """A changed chunk, recipe or manifest, or a lost recipe, fails the read."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i * j}" for j in range(400))) for i in range(20)], "doc_id long, text string")
    path = f"file://{tmp_path}/s"
    ts.write_store(docs, path, PATH)
    assert ts.read_digests(spark, path).count() == 20

    def damaged(part, change):
        copy = f"{tmp_path}/{part}-{len(list(tmp_path.iterdir()))}"
        shutil.copytree(tmp_path / "s", copy)
        rows = spark.read.parquet(f"{tmp_path}/s/{part}")
        change(rows).write.mode("overwrite").parquet(f"{copy}/{part}")
        with pytest.raises(Exception, match="damaged|missing|manifest"):
            ts.read_digests(spark, f"file://{copy}").collect()

    damaged("recipes", lambda r: r.withColumn("keys", F.reverse("keys")))
    damaged("recipes", lambda r: r.where("doc_id <> 7"))
    damaged("manifest", lambda r: r.withColumn("root", F.encode(F.lit("x"), "utf-8")))
    damaged("store/kind=chunk", lambda r: r.withColumn("payload", F.reverse(F.col("payload").cast("string")).cast("binary")))
    damaged("store/kind=chunk", lambda r: r.limit(3))
