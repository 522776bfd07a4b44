"""N-gram Jaccard join: grouped prefix filtering over word shingles.

Two documents link when 100 * |A & B| >= 80 * |A | B| for their sets of
distinct five-word shingles. A set ordered by (approximate document count,
hash) shares an element of its first n - ceil(0.8 n) + 1 with every set it
links to, so only those prefixes are shuffled. Documents of equal size and
prefix form one group; groups, not documents, meet in the postings, and the
members of a group in one posting of its own.

All pairs of a large group of near copies are never made. A first round takes
each posting's neighbour and its smallest member, a second one neighbours in
an arbitrary order that are not connected yet; of those, each set is checked
against the likeliest FIRST and NEXT ones. What the links found connect needs
no more checks. The last round takes every remaining candidate pair between
different components, so the result is that of the full join.

Before whole texts meet, parity bitmaps do: bit i says whether an odd number
of a set's elements hash to i. Each element in which two sets differ changes
one bit, so two sets differ in at least as many elements as their bitmaps in
bits, and linked sets differ in at most (n_a + n_b) / 9. A bitmap of SIGNATURE
bits goes with the postings; one of at least four bits for each element of the
set (``sketch``) checks what passes it. The bounds lose nothing.

Any fixed order of elements gives the right result. The document counts that
put common passages last come from one row of counters of a fixed size
(``COUNTERS``), filled from every document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm._graph import components
from threadloom.llm._hot import salted_join
from threadloom.llm._store import dropped, lean, written
from threadloom.llm._words import Words, mix, slices

#: Counters for shingle frequencies: 4 bytes each, broadcast once (4 MB).
COUNTERS = 1 << 20
_CHUNK = 1 << 14
#: Bits of the filter of documents to verify (8 MB reach the driver); more documents than FILTER_IDS are joined instead.
FILTER_BITS, FILTER_IDS = 1 << 26, 1 << 23
#: Bits of a set's first bitmap, as 64-bit words; neighbours that the second round looks at.
SIGNATURE, AROUND, PASSED = 512, 16, 2
#: Pairs that the first and the second round check for each set.
FIRST, NEXT = 1, 2
_WORDS = [f"s{i}" for i in range(SIGNATURE // 64)]
_U = np.uint64
_SHIFT = _U(64 - 20)


def prefix_length(n):
    return n - (4 * n + 4) // 5 + 1


def _chunks(batches):
    counts = np.zeros(COUNTERS, np.uint32)
    pending, size = [], 0
    for batch in batches:
        texts = batch.column(0)
        for start, stop in slices(texts):
            for found in Words(texts.slice(start, stop - start)).shingle_sets():
                pending.append((found >> _SHIFT).astype(np.int64))
                size += len(found)
            if size > COUNTERS:
                counts += np.bincount(np.concatenate(pending), minlength=COUNTERS).astype(np.uint32)
                pending, size = [], 0
    if size:
        counts += np.bincount(np.concatenate(pending), minlength=COUNTERS).astype(np.uint32)
    parts = counts.reshape(-1, _CHUNK)
    used = np.flatnonzero(parts.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([parts[i].tobytes() for i in used], pa.binary())], names=["chunk", "counts"])


def _summed(chunks):
    for batch in chunks:
        total: dict[int, np.ndarray] = {}
        for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            total[k] = total.get(k, 0) + np.frombuffer(v, np.uint32).astype(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.minimum(v, 0xFFFFFFFF).astype(np.uint32).tobytes() for v in total.values()], pa.binary())], names=["chunk", "counts"])


def shingle_counts(docs: DataFrame) -> np.ndarray:
    """Documents by counter; COUNTERS values whatever the size of ``docs``."""
    parts = docs.select("text").mapInArrow(lean(_chunks), "chunk int, counts binary").repartition("chunk").mapInArrow(_summed, "chunk int, counts binary").collect()
    counts = np.zeros(COUNTERS, np.uint64)
    for part in parts:
        counts[part.chunk * _CHUNK : (part.chunk + 1) * _CHUNK] += np.frombuffer(part.counts, np.uint32)
    return np.minimum(counts, 0xFFFFFFFF).astype(np.uint32)


def _signed(x):
    return np.asarray(x, np.uint64).view(np.int64)


def _parity(found: np.ndarray, bits: int) -> np.ndarray:
    """Bytes of the bitmap of ``bits`` (a power of two), folded from its double and so on."""
    return np.packbits((np.bincount((found & _U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little")


def sketch_bits(n: int) -> int:
    """The power of two that is at least four times ``n``, and at least SIGNATURE."""
    return max(SIGNATURE, 1 << (4 * int(n) - 1).bit_length()) if n else SIGNATURE


def _rows(counts):
    def rows(batches):
        order = counts.value
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for start, stop in slices(texts):
                n, cid, gid, prefix, words, sketch = [], [], [], [], [], []
                for found in Words(texts.slice(start, stop - start)).shingle_sets():
                    size = len(found)
                    ranked = found[np.lexsort((found, order[(found >> _SHIFT).astype(np.int64)]))][: prefix_length(size) if size else 0]
                    n.append(size)
                    cid.append(mix(found + _U(size)).sum(dtype=np.uint64))
                    gid.append(mix(ranked * _U(2) + _U(1)).sum(dtype=np.uint64))
                    words.append(_parity(found, SIGNATURE).view(np.int64))
                    sketch.append(_parity(found, sketch_bits(size)).tobytes())
                    prefix.append(ranked.tobytes())
                words = np.array(words).reshape(len(n), -1)
                yield pa.RecordBatch.from_arrays([ids.slice(start, stop - start), pa.array(n, pa.int64()), pa.array(_signed(cid)), pa.array(_signed(gid)), pa.array(prefix, pa.binary()), *(pa.array(np.ascontiguousarray(words[:, i])) for i in range(len(_WORDS))), pa.array(sketch, pa.binary())], names=["doc_id", "n", "cid", "gk", "prefix", *_WORDS, "sketch"])

    return rows


def _postings(batches):
    for batch in batches:
        ids, n = (batch.column(i).to_numpy() for i in (0, 1))
        tokens = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64)
        size = prefix_length(n)
        ends = np.cumsum(size)
        pos = np.arange(len(tokens)) - np.repeat(ends - size, size)
        yield pa.RecordBatch.from_arrays([pa.array(_signed(tokens)), pa.array(np.repeat(ids, size)), pa.array(np.repeat(n, size).astype(np.int32)), pa.array(pos.astype(np.int32))], names=["token", "gid", "n", "pos"])


_SHARED = "token long, gid long, n int, pos int, first_gid long, first_n int, first_pos int, prev_gid long, prev_n int, prev_pos int"


def _shared_rows(cols, firsts, prevs, head, out):
    arrays = [pa.array(c[out], kind) for c, kind in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))]
    for group in (firsts, prevs):
        arrays += [pa.array(c[out], kind, mask=head[out]) for c, kind in zip(group, (pa.int64(), pa.int32(), pa.int32()))]
    return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in _SHARED.split(", ")])


def _runs(batches):
    """From rows sorted by token: those of a token with more rows, each with the token's first row and the one before it.

    A token of many rows may reach into other tasks, so a task's first and last
    token come out even if they have one row here.
    """
    held = begin = None  # the last row, still to come out; its token's first row and the row before it, if any
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy() for i in range(4)]
        if held is None:
            begin = cols[0][0]
        else:
            cols = [np.concatenate([h, c]) for h, c in zip(held[0], cols)]
        token, size = cols[0], len(cols[0])
        head, again = np.ones(size, bool), token[1:] == token[:-1]
        head[1:] = ~again
        run = np.maximum.accumulate(np.where(head, np.arange(size), 0))
        firsts, prevs = [c[run] for c in cols[1:]], [np.concatenate([c[:1], c[:-1]]) for c in cols[1:]]
        if held is not None and held[2] is not None:
            head[0] = False
            for first, prev, f, p in zip(firsts, prevs, *held[1:]):
                first[run == 0] = f
                prev[0] = p
        keep = ~head | (token == begin)
        keep[:-1] |= again
        yield _shared_rows(cols, firsts, prevs, head, np.flatnonzero(keep[:-1]))
        held = [c[-1:] for c in cols], [f[-1] for f in firsts], None if head[-1] else [p[-1] for p in prevs]
    if held is not None:
        yield _shared_rows(held[0], *([np.array([x]) for x in (values or held[1])] for values in held[1:]), np.array([held[2] is None]), np.array([0]))


def _differ(a: str, b: str):
    """Bits in which bitmaps a.s0.. and b.s0.. differ."""
    return sum((F.bit_count(F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}"))) for w in _WORDS), F.lit(0))


def _alike(a: str, b: str):
    """Whether the bitmaps leave it open that the sets link."""
    return _differ(a, b) * 9 <= F.col(f"{a}.n") + F.col(f"{b}.n")


def _sketched(batches):
    """From rows (a, b, n of both, sketches of a and b): the pairs that their sketches leave open, with the bits in which those differ."""
    for batch in batches:
        n, differ = batch.column(2).to_numpy(), np.zeros(batch.num_rows, np.int64)
        for i, (x, y) in enumerate(zip(batch.column(3), batch.column(4))):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            while len(x) != len(y):  # the longer one, folded, is that of half its bits
                longer = x if len(x) > len(y) else y
                folded = longer[: len(longer) // 2] ^ longer[len(longer) // 2 :]
                x, y = (folded, y) if longer is x else (x, folded)
            differ[i] = np.bitwise_count(x ^ y).sum()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(differ)], names=["a", "b", "differ"]).filter(pa.array(differ * 9 <= n))


def _open(pairs: DataFrame, bitmaps: DataFrame, sketches: DataFrame) -> DataFrame:
    """(a, b, differ), written, of the pairs (a, b) that their bitmaps leave open: those of all sets first, then sketches of the sets that are left."""
    alike = pairs.join(bitmaps.alias("x"), F.col("a") == F.col("x.node")).join(bitmaps.alias("y"), F.col("b") == F.col("y.node")).where(_alike("x", "y")).select("a", "b")
    alike = written(alike, "alike")
    if alike.isEmpty():
        return alike.withColumn("differ", F.lit(0).cast("long"))
    some = _of(alike, sketches.select("node", "n", "sketch"), "node long, n long, sketch binary")
    left, right = (some.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}")) for side in "ab")
    rows = alike.join(left, "a").join(right, "b").select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n"), "sketch_a", "sketch_b")
    # an id that repeats with other texts has more rows and sketches
    found = written(rows.mapInArrow(lean(_sketched), "a long, b long, differ long").groupBy("a", "b").agg(F.min("differ").alias("differ")), "open")
    dropped(alike, some)
    return found


def _likeliest(found: DataFrame, most: int) -> DataFrame:
    """Of the pairs that ``_open`` leaves, those of the fewest different bits for each b."""
    rank = F.row_number().over(Window.partitionBy("b").orderBy("differ", "a"))
    return found.withColumn("rank", rank).where(F.col("rank") <= most).select("a", "b")


def _can_meet(n, pos, other_n, other_pos):
    """Whether these prefix positions are among those of which two linked sets share one: the first n - overlap + 1 of either."""
    least = F.ceil((F.col(n) + F.col(other_n)).cast("long") * 4 / 9)
    return (F.col(pos) <= F.col(n) - least) & (F.col(other_pos) <= F.col(other_n) - least)


def _neighbours(batches):
    """From rows sorted by token: pairs of near rows of one token that are not connected and may link, at most PASSED for each row."""
    for batch in batches:
        token, node, component, n = (batch.column(i).to_numpy() for i in range(4))
        words = [batch.column(4 + i).to_numpy() for i in range(len(_WORDS))]
        passed = np.zeros(len(token), np.int64)
        a, b = [], []
        for k in range(1, min(AROUND, len(token) - 1) + 1):
            at = np.flatnonzero((token[k:] == token[:-k]) & (component[k:] != component[:-k]) & (passed[k:] < PASSED)) + k
            differ = sum((np.bitwise_count(w[at] ^ w[at - k]).astype(np.int64) for w in words), np.zeros(len(at), np.int64))
            at = at[differ * 9 <= n[at] + n[at - k]]
            passed[at] += 1
            a.append(np.minimum(node[at], node[at - k]))
            b.append(np.maximum(node[at], node[at - k]))
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def _wanted(bits):
    def wanted(batches):
        for batch in batches:
            ids = batch.column(0).fill_null(-1).to_numpy()
            keep = np.flatnonzero(np.unpackbits(bits.value, bitorder="little")[ids % _PRIME].astype(bool))
            if len(keep):
                yield batch.take(pa.array(keep))

    return wanted


_PRIME = 67108859  # the largest below FILTER_BITS


def _linked(batches):
    """From rows (a, b, text of a, text of b): the pairs whose sets link."""
    for batch in batches:
        keep = []
        for start, stop in slices(batch.column(2)):
            left, right = (Words(batch.column(i).slice(start, stop - start)).shingle_sets() for i in (2, 3))
            for x, y in zip(left, right):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and 180 * both >= 80 * (len(x) + len(y)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _id_bits(ids: DataFrame) -> np.ndarray:
    """A bit for each id; FILTER_BITS of them whatever their number."""
    at = F.pmod("node", F.lit(_PRIME)) + 1  # these bitmaps count from one
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for part in ids.groupBy(F.bitmap_bucket_number(at).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect():
        bits[(part.k - 1) * 4096 : part.k * 4096] = np.frombuffer(part.bits, np.uint8)
    return bits


def _of(pairs: DataFrame, table: DataFrame, schema: str) -> DataFrame:
    """``table`` (node, ...), written, without most of the rows that no pair (a, b) of a written table needs: a filter of fixed size looks at the ids where they stand."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    table = table.where("node is not null")
    if 2 * pairs.count() <= FILTER_IDS:
        some = table.mapInArrow(lean(_wanted(pairs.sparkSession.sparkContext.broadcast(_id_bits(ids)))), schema)
    else:
        some = table.join(ids.distinct(), "node", "left_semi")
    return written(some, "some")


def checked(pairs: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) of ``pairs`` whose whole sets link, written. Only texts that some pair needs are shuffled, a group's head as often as its pairs fill tasks; texts are smaller than sets."""
    if pairs.isEmpty():
        return written(pairs.select("a", "b"), name)
    texts = _of(pairs, docs.select(F.col("doc_id").alias("node"), "text"), "node long, text string")
    # each b has few pairs, an a may have those of a large group
    counts = written(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("pairs")), "counts")
    right = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    both = salted_join(right, texts.select(F.col("node").alias("a"), F.col("text").alias("ta")).join(counts.select("a"), "a", "left_semi"), ["a"], counts, "pairs", ["b"])
    found = both.select("a", "b", "ta", "tb").mapInArrow(lean(_linked), "a long, b long").distinct()
    found = written(found, name)
    dropped(texts, counts)
    return found


def similar_documents(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id long, text string, ...) -> (doc_id, n_shingles, component_id), a row for each input row.

    Null or empty text: an empty set, linked with nothing, its own component.
    Null doc_id: counted, component null (linked with nothing). Rows that
    repeat a doc_id count as one document and link if any of their texts do.
    Ties never matter: a component's id is its smallest doc_id. No rows: none.
    Other columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = spark.sparkContext.broadcast(shingle_counts(docs))
    prefixes = written(docs.mapInArrow(lean(_rows(counts)), "doc_id long, n long, cid long, gk long, prefix binary, " + ", ".join(f"{w} long" for w in _WORDS) + ", sketch binary"), "prefixes")
    rows = written(prefixes.select("doc_id", "n", "cid"), "rows")
    full = prefixes.where("doc_id is not null and n > 0")
    sketches = written(full.select(F.col("doc_id").alias("node"), "n", "sketch"), "sketches")
    classes = full.groupBy("n", "cid").agg(F.min("doc_id").alias("node"), *(F.min(w).alias(w) for w in ("gk", *_WORDS)))
    groups = classes.groupBy("n", "gk").agg(F.min("node").alias("gid"))
    members = written(classes.join(groups, ["n", "gk"]).select("n", "cid", "node", "gid", *_WORDS), "classes")

    heads = full.select("doc_id", "n", "cid", "prefix").join(members.where("node = gid").select(F.col("node").alias("doc_id"), "n", "cid"), ["doc_id", "n", "cid"], "left_semi")
    postings = heads.select("doc_id", "n", "prefix").mapInArrow(_postings, "token long, gid long, n int, pos int")
    # ranges of (token, gid), so that a token that many sets hold fills as many tasks as it needs
    shared = written(postings.repartitionByRange("token", "gid").sortWithinPartitions("token", "gid").mapInArrow(_runs, _SHARED), "postings")
    dropped(prefixes)

    bitmaps = members.select("node", "n", *_WORDS)
    # members of one group share its whole prefix, whether or not another group posts a token of it: they meet under a token of their own
    within = members.groupBy("gid", "n").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1").select(F.xxhash64("gid", "n").alias("token"), "gid", F.col("n").cast("int").alias("n"), F.lit(0).alias("pos"))

    def pairs(side):
        some = shared.where(F.col(f"{side}_gid").isNotNull() & (F.col(f"{side}_gid") != F.col("gid")) & _can_meet("n", "pos", f"{side}_n", f"{side}_pos"))
        return some.select(F.least("gid", f"{side}_gid").alias("a"), F.greatest("gid", f"{side}_gid").alias("b"))

    near = pairs("first").unionByName(pairs("prev")).unionByName(members.where("node <> gid").select(F.col("gid").alias("a"), F.col("node").alias("b"))).distinct()
    opened = _open(near, bitmaps, sketches)
    near = written(_likeliest(opened, FIRST), "near")
    dropped(opened)
    links = checked(near, docs, "links")

    def apart(joined):
        """Postings of the tokens that these components do not hold together, a row for each class."""
        known = members.join(joined, "node", "left").select("gid", "node", F.coalesce("component", "node").alias("component"))
        rows = shared.select("token", "gid", "n", "pos").unionByName(within).join(known, "gid")
        mixed = rows.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token")
        left = rows.join(mixed, "token", "left_semi").select("token", "node", "component", "n", "pos")
        return written(left.join(bitmaps.drop("n"), "node").select("token", "node", "component", "n", *_WORDS, "pos"), "apart")

    def grown(joined, links):
        """Components of what ``joined`` holds together and these links connect."""
        if links.isEmpty():
            return joined
        out = components(joined.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(links))
        dropped(joined)
        return out

    joined = components(links)
    left = apart(joined)
    by_hash = left.withColumn("order", F.xxhash64("node", "token")).repartitionByRange("token", "order").sortWithinPartitions("token", "order")
    nearer = by_hash.select("token", "node", "component", "n", *_WORDS).mapInArrow(_neighbours, "a long, b long").distinct()
    opened = _open(nearer, bitmaps, sketches)
    nearer = written(_likeliest(opened, NEXT).join(near, ["a", "b"], "left_anti"), "nearer")
    dropped(opened)
    more = checked(nearer, docs, "more-links")

    if not more.isEmpty():
        joined = grown(joined, more)
        dropped(left)
        left = apart(joined)
    meet = (F.col("a.token") == F.col("b.token")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.component") != F.col("b.component")) & _can_meet("a.n", "a.pos", "b.n", "b.pos") & _alike("a", "b")
    rest = left.alias("a").join(left.alias("b"), meet).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()
    rest = _open(rest.join(near.unionByName(nearer), ["a", "b"], "left_anti"), bitmaps, sketches)
    dropped(left, shared, sketches)
    last = checked(rest.select("a", "b"), docs, "last-links")
    # rows that repeat a doc_id with another text tie their classes together
    ties = rows.where("doc_id is not null and n > 0").join(members, ["n", "cid"]).where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct()
    ties = ties.join(members.select(F.col("node").alias("a")).distinct(), "a", "left_semi")
    final = grown(joined, last.unionByName(ties))
    by_class = members.join(final, "node", "left").select("n", "cid", F.coalesce("component", "node").alias("component"))
    out = rows.join(by_class, ["n", "cid"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    out = written(out, "documents")
    dropped(rows, members, near, nearer, rest, links, more, last, final)
    return out
