"""Token-ID output: a content-addressed store of id chunks.

A rolling hash over the ids of a document cuts them into chunks, so equal
passages give equal chunks wherever they stand. Each distinct chunk is stored
once under its BLAKE2 hash; a document is a recipe of chunk hashes with their
Merkle root, and a manifest holds, for each part of the recipes, the Merkle
root over their roots. Reading verifies all three: chunks against their hashes,
recipes against their roots, the recipes of a part against the manifest.

    store/kind=chunk    key, n, payload (little-endian ids of ``WIDTH`` bytes)
    recipes/            part, doc_id, local_start, n_tokens, keys, sizes, root; in ascending doc_id order
    manifest/           part, n_docs, n_tokens, root

Texts are read and tokenised once. The payloads cross one shuffle, on their
hash, after each task has dropped its own repeats, so a passage that a third
of all documents hold arrives once per task.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.llm._pieces import encoder
from threadloom.llm._store import lean, saved, shared_path
from threadloom.llm._words import slices

END_ID = 2
WIDTH = "<u2"
#: Chunks hold 16 to 4096 ids, 16 + 2**CUT_BITS on average.
MIN_IDS, MAX_IDS, CUT_BITS = 16, 4096, 9
#: Bytes of text whose ids one pass holds; longer texts go alone.
SLICE = 1 << 20

_GEAR = np.random.default_rng(7).integers(0, 1 << 63, 1 << 16, dtype=np.uint64)


def encoded(texts: list[str], path: str, added_tokens: bool = True) -> list[list[int]]:
    """Ids of each text without an end id."""
    ids, sizes = encoder(path).encode(pa.array(texts, pa.string()), added_tokens)
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] if len(texts) else []


def _marks(ids: np.ndarray) -> np.ndarray:
    """Where a chunk may end: after ids whose window of 16 has a rolling hash with CUT_BITS leading zeros."""
    rolled = _GEAR[ids]
    for k in (1, 2, 4, 8):  # sums over 2, 4, 8, 16 ids
        longer = rolled.copy()
        longer[k:] += rolled[:-k] << np.uint64(k)
        rolled = longer
    return np.flatnonzero(rolled >> np.uint64(64 - CUT_BITS) == 0) + 1


def _ends(marks: list[int], n: int) -> list[int]:
    ends, last = [], 0
    for at in marks:
        while at - last > MAX_IDS:
            last += MAX_IDS
            ends.append(last)
        if at - last >= MIN_IDS:
            ends.append(at)
            last = at
    while n - last > MAX_IDS:
        last += MAX_IDS
        ends.append(last)
    if n > last:
        ends.append(n)
    return ends


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one document."""
    return _ends(_marks(ids).tolist(), len(ids))


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


class Tree:
    """A Merkle tree over leaves that come one by one, in memory of its height: pairs make nodes, an odd node moves up as it is."""

    def __init__(self):
        self.n, self.peaks = 0, []

    def add(self, leaf: bytes) -> None:
        self.n += 1
        left, node = self.n, leaf
        while left % 2 == 0:
            node = _digest(self.peaks.pop() + node)
            left //= 2
        self.peaks.append(node)

    def root(self) -> bytes:
        if not self.peaks:
            return _digest(b"")
        *rest, node = self.peaks
        for peak in reversed(rest):
            node = _digest(peak + node)
        return node


def merkle(leaves: list[bytes]) -> bytes:
    """Root of the tree over ``leaves``."""
    tree = Tree()
    for leaf in leaves:
        tree.add(leaf)
    return tree.root()


_STORE = "kind string, place binary, key binary, n int, payload binary, doc_id long, keys array<binary>, sizes array<int>"
_FIELDS = pa.schema([("kind", pa.string()), ("place", pa.binary()), ("key", pa.binary()), ("n", pa.int32()), ("payload", pa.binary()), ("doc_id", pa.int64()), ("keys", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int32()))])


def _chunker(path: str, end_id: int, added_tokens: bool):
    def chunks(batches):
        if encoder(path).width != WIDTH:
            raise ValueError("ids are stored in two bytes, this vocabulary needs more")
        seen: set[bytes] = set()
        row = 0
        for batch in batches:
            for start, stop in slices(batch.column(1), SLICE):
                doc_ids = batch.column(0).slice(start, stop - start).to_pylist()
                ids, sizes = encoder(path).encode(batch.column(1).slice(start, stop - start), added_tokens)
                ids = np.insert(ids, np.cumsum(sizes), end_id).astype(WIDTH)
                ends = np.cumsum(sizes + 1)
                # a window that reaches into the document before ends no chunk: none is shorter than a window
                marks = _marks(ids)
                data, bounds = ids.tobytes(), np.searchsorted(marks, ends, "right").tolist()
                rows, first, lo = [], 0, 0
                for doc_id, end, hi in zip(doc_ids, ends.tolist(), bounds):
                    last, keys, lengths = 0, [], []
                    for at in _ends((marks[lo:hi] - first).tolist(), end - first):
                        part = data[2 * (first + last) : 2 * (first + at)]
                        key = _digest(part)
                        keys.append(key)
                        lengths.append(at - last)
                        last = at
                        if key not in seen:
                            seen.add(key)
                            rows.append(("chunk", key, key, lengths[-1], part, None, None, None))
                    root = merkle(keys)
                    # recipes of one root, as of copies, go to places of their own
                    rows.append(("recipe", _digest(root + row.to_bytes(8, "little")), root, last, None, doc_id, keys, lengths))
                    row, first, lo = row + 1, end, hi
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _FIELDS)], schema=_FIELDS)

    return lean(chunks, "tokens")


def _once(batches):
    """Chunks that other tasks made too are kept once; equal keys meet in one task."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for kind, key in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            keep.append(kind != "chunk" or key not in seen)
            if kind == "chunk":
                seen.add(key)
        yield batch.filter(pa.array(keep, pa.bool_()))


_RECIPE = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("keys", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int32())), ("root", pa.binary())])


def _placed(batches):
    """Recipes of one part in order, each with the ids before it in the part."""
    at = 0
    for batch in batches:
        n = batch.column(2).cast(pa.int64()).to_numpy()
        starts = at + np.cumsum(n) - n
        at += int(n.sum())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(starts), pa.array(n), batch.column(3), batch.column(4), batch.column(5)], schema=_RECIPE)


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, added_tokens: bool = True) -> None:
    """Write ``docs`` (doc_id, text, ...) below ``path``.

    ``added_tokens``: added tokens of the tokenizer's file that stand in a text
    are tokens, as in the library's plain call; otherwise they are text. Null
    or empty text is the end id alone. Null doc_ids come first, rows that
    repeat a doc_id stand side by side, in order of their content. No rows
    make an empty store. Other columns, whatever their names, are not stored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(_chunker(tokenizer, end_id, added_tokens), _STORE)
    saved(rows.repartition("place").mapInArrow(_once, _STORE).drop("place"), f"{path}/store", compression="zstd", partitionBy="kind")
    stored = _stored(spark, path).where("kind = 'recipe'").select("doc_id", "n", "keys", "sizes", F.col("key").alias("root"))
    placed = stored.repartitionByRange("doc_id", "root").sortWithinPartitions("doc_id", "root").select(F.spark_partition_id().alias("part"), "doc_id", "n", "keys", "sizes", "root")
    saved(placed.mapInArrow(_placed, "part int, doc_id long, local_start long, n_tokens long, keys array<binary>, sizes array<int>, root binary"), f"{path}/recipes")
    saved(_parts(_recipes(spark, path)), f"{path}/manifest")


_PART = "part int, n_docs long, n_tokens long, root binary"


def _totals(batches):
    """A row for each part of rows sorted by part and place: its documents, their ids, the root over their roots."""
    part, tree, total = None, Tree(), 0
    done = lambda: pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([tree.n]), pa.array([total]), pa.array([tree.root()], pa.binary())], names=["part", "n_docs", "n_tokens", "root"])
    for batch in batches:
        for p, n, root in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2))):
            if p != part:
                if part is not None:
                    yield done()
                part, tree, total = p, Tree(), 0
            tree.add(root)
            total += n
    if part is not None:
        yield done()


def _parts(recipes: DataFrame) -> DataFrame:
    """What the manifest says of these recipes."""
    return recipes.select("part", "n_tokens", "root", "local_start").repartition("part").sortWithinPartitions("part", "local_start").mapInArrow(_totals, _PART)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("key binary, n int, payload binary, doc_id long, keys array<binary>, sizes array<int>, kind string").parquet(f"{path}/store")


_RECIPES = "part int, doc_id long, local_start long, n_tokens long, keys array<binary>, sizes array<int>, root binary"


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_RECIPES).parquet(f"{path}/recipes")


def _rooted(batches):
    """Recipes as read: their chunk hashes must have the root they are stored with."""
    for batch in batches:
        for keys, root in zip(batch.column(4).to_pylist(), batch.column(6).to_pylist()):
            if merkle(keys) != root:
                raise ValueError(f"recipe {root.hex()} is damaged")
        yield batch


def _checked(batches):
    """Chunks as read: their content must have the hash they are stored under."""
    for batch in batches:
        sums = []
        for key, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if _digest(payload) != key:
                raise ValueError(f"chunk {key.hex()} is damaged")
            sums.append(zlib.crc32(np.frombuffer(payload, WIDTH).astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.int64())], names=["key", "crc"])


_POLY = np.uint32(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials over two elements, modulo that of CRC-32, bits reflected."""
    out = np.zeros(np.broadcast(a, b).shape, np.uint32)
    for k in range(31, -1, -1):
        out ^= np.where((a >> np.uint32(k)) & np.uint32(1), b, np.uint32(0))
        b = np.where(b & np.uint32(1), (b >> np.uint32(1)) ^ _POLY, b >> np.uint32(1)).astype(np.uint32)
    return out


def crc_followed_by(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What data of these CRC-32 add to that of a text in which so many bytes follow them."""
    power = np.array([1 << 30], np.uint32)  # x
    for _ in range(3):
        power = _times(power, power)  # x**8: one byte
    factor, left = np.full(len(crc), 1 << 31, np.uint32), n_bytes.astype(np.int64).copy()
    while left.any():
        factor = np.where(left & 1, _times(factor, power), factor).astype(np.uint32)
        power, left = _times(power, power), left >> 1
    return _times(crc.astype(np.uint32), factor)


def _shifted(batches):
    for batch in batches:
        crc, after = (batch.column(i).to_numpy() for i in (2, 3))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(crc_followed_by(crc, after).astype(np.int64)), batch.column(4)], names=["part", "local_start", "crc", "n"])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Verified recipes with ``start``: the ids of all parts before, then of all documents before in the part. The window runs over one row per part."""
    recipes = _recipes(spark, path).mapInArrow(_rooted, _RECIPES)
    said = spark.read.schema(_PART).parquet(f"{path}/manifest").withColumnsRenamed({"n_docs": "docs", "n_tokens": "tokens", "root": "said"})
    found = _parts(_recipes(spark, path)).join(said, "part", "full")
    same = F.coalesce((F.col("root") == F.col("said")) & (F.col("n_docs") == F.col("docs")) & (F.col("n_tokens") == F.col("tokens")), F.lit(False))
    total = F.when(same, F.col("n_tokens")).otherwise(F.raise_error(F.lit("a part of the recipes is not as the manifest has it")).cast("long"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = found.select("part", total.alias("total")).select("part", F.coalesce(F.sum("total").over(order), F.lit(0)).alias("offset"))
    return recipes.join(offsets, "part").withColumn("start", F.col("offset") + F.col("local_start"))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """From the files: (doc_id, start, n_tokens, ids_crc32, root), a row for each document. A missing or damaged chunk, recipe or manifest fails the read.

    Chunks are read, checked and summed once; documents combine their chunks'
    sums, so no ids are shuffled.
    """
    recipes = _lines(spark, path)
    piece = recipes.select("part", "local_start", "n_tokens", F.explode(F.arrays_zip("keys", "sizes", F.transform("keys", lambda _, i: i).alias("i"))).alias("x"), "sizes")
    after = F.aggregate(F.slice("sizes", F.col("x.i") + 2, F.greatest(F.size("sizes") - F.col("x.i") - 1, F.lit(0))), F.lit(0).cast("long"), lambda acc, n: acc + n) * 4
    pieces = piece.select("part", "local_start", F.col("x.keys").alias("key"), after.alias("after"), F.col("x.sizes").alias("n"))
    chunks = _stored(spark, path).where("kind = 'chunk'").select("key", "payload").mapInArrow(_checked, "key binary, crc long")
    found = pieces.join(chunks, "key", "left").select("part", "local_start", F.coalesce("crc", F.raise_error(F.lit("a chunk is missing")).cast("long")).alias("crc"), "after", "n")
    sums = found.mapInArrow(_shifted, "part int, local_start long, crc long, n int").groupBy("part", "local_start").agg(F.bit_xor("crc").alias("ids_crc32"), F.sum("n").alias("read"))
    whole = recipes.join(sums, ["part", "local_start"])
    n = F.when(F.col("read") == F.col("n_tokens"), F.col("read")).otherwise(F.raise_error(F.lit("a recipe is damaged")).cast("long"))
    return whole.select("doc_id", "start", n.alias("n_tokens"), "ids_crc32", F.hex("root").alias("root"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids array<int>): documents rebuilt from their chunks."""
    recipes = _lines(spark, path)
    pieces = recipes.select("part", "local_start", "doc_id", "start", F.posexplode("keys").alias("i", "key"))
    chunks = _stored(spark, path).where("kind = 'chunk'").select("key", "payload")
    whole = pieces.join(chunks, "key").groupBy("part", "local_start", "doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("i", "payload"))).alias("all"))

    def ids(batches):
        for batch in batches:
            out = [np.frombuffer(b"".join(x["payload"] for x in row), WIDTH).astype(np.int32) for row in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "start", "ids"])

    return whole.select("doc_id", "start", "all").mapInArrow(ids, "doc_id long, start long, ids array<int>")


def stored_digests(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """``docs`` written to a store in the shared folder, and read back as ``read_digests`` does."""
    path = shared_path(docs.sparkSession, "tokens")
    write_store(docs, path, tokenizer, end_id)
    return read_digests(docs.sparkSession, path)
