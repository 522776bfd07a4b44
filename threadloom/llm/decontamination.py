"""Benchmark decontamination: near copies of benchmark items inside documents.

An item is in a document if some passage of the document is within
floor(RATE * bytes) edits of it, both in lower case, counted in UTF-8 bytes.

1. An item is cut into pieces, more of them than edits. In such a passage at
   most one piece is lost per edit, and the others stand within that many
   places of one diagonal; item-sized windows are opened only where so many
   pieces do. This loses none.
2. CGK random walks embed windows and items, so that few edits become few
   mismatches. Samples of positions of the embeddings are compared in as many
   tables as reach RECALL for copies with all edits allowed; the mismatch rates
   of such copies are measured for each length when the items are read. Where
   MOST_TABLES do not reach it, or an item is longer than LONGEST_WALK, its
   windows skip this step.
3. What is left is verified by an exact bit-parallel edit distance over the
   whole windows, neighbouring ones as one.

Documents never meet each other, so no key can be hot. Benchmark items are
broadcast in blocks of at most BLOCK_BYTES of text.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm._store import dropped, lean, written
from threadloom.llm._words import raw, slices

#: Edits for each byte of an item, and bytes of a piece; short items that this gives too few pieces have pieces of SHORT_SEED bytes.
RATE, SEED, SHORT_SEED = 0.1, 8, 5
#: Share of the copies at the limit that meet their item in some table; walks, sizes of a table's sample to choose from, tables at most, copies measured.
RECALL, WALKS, SAMPLED, MOST_TABLES, COPIES = 0.999, 4, (6, 4, 3, 2), 64, 48
#: Longest item that is embedded: walks take 3 KB for each byte of it. Bytes of a class of lengths.
LONGEST_WALK, CLASS = 4096, 32
BLOCK_BYTES = 8 << 20
#: Bytes of text searched at once, and windows embedded at once.
SLICE, WINDOWS = 4 << 20, 512

_U = np.uint64
_BITS = 20
_FACTOR = _U(0x9E3779B97F4A7C15)


def edits_allowed(n: int, rate: float = RATE) -> int:
    return int(rate * n)


def seed_bytes(n: int) -> int:
    """Bytes of the pieces of an item of ``n`` bytes: of those there are more than edits."""
    if n < SEED:
        return max(n, 1)
    return SEED if n // SEED > edits_allowed(n) else SHORT_SEED


def search(item: bytes, text: bytes, most: int) -> tuple[int, int]:
    """Least edits of ``item`` to any passage of ``text`` and the passage's end; (most + 1, -1) if more than ``most``."""
    n = len(item)
    if not n:
        return 0, 0
    masks: dict[int, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score = full, 0, n
    best, at = most + 1, -1
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        x = eq | down
        d0 = (((eq & up) + up) ^ up) | x
        inc = down | (full & ~(d0 | up))
        dec = up & d0
        if inc & top:
            score += 1
        elif dec & top:
            score -= 1
        inc <<= 1
        dec <<= 1
        up = full & (dec | (full & ~(d0 | inc)))
        down = inc & d0 & full
        if score < best:
            best, at = score, j + 1
    return best, at


def _lower(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts)


@lru_cache(maxsize=1)
def _steps() -> np.ndarray:
    """[walk, step, byte]: whether a walk goes on after this byte at this step."""
    return np.random.default_rng(20240310).integers(0, 2, (WALKS, 3 * LONGEST_WALK, 256), dtype=np.uint8)


def embedded(rows: np.ndarray) -> np.ndarray:
    """[walk, step, row]: CGK embeddings of rows of bytes, zeros behind their ends; three steps a byte."""
    count, n = rows.shape
    flat = np.concatenate([rows, np.zeros((count, 3 * n + 1 - n), np.uint8)], axis=1).reshape(-1)
    base = np.arange(count) * (3 * n + 1)
    out = np.zeros((WALKS, 3 * n, count), np.uint8)
    for walk in range(WALKS):
        go, at = _steps()[walk], base.copy()
        for j in range(3 * n):
            c = flat[at]
            out[walk, j] = c
            at += go[j][c]
    return out


def _edited(item: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A copy with all edits allowed, as substitutions, insertions and deletions at random places, cut or filled to the item's length."""
    out = item.tolist()
    for _ in range(edits_allowed(len(item))):
        at, kind = int(rng.integers(len(out))), int(rng.integers(3))
        if kind == 0:
            out[at] = int(rng.integers(97, 123))
        elif kind == 1:
            out.insert(at, int(rng.integers(97, 123)))
        elif len(out) > 1:
            del out[at]
    out = (out + [0] * len(item))[: len(item)]
    return np.array(out, np.uint8)


def tables_for(item: bytes) -> tuple[int, int]:
    """(bytes of a sample, tables in each walk) that bring copies of this item at the limit together with probability RECALL; (0, 0) if none of those allowed do."""
    rng = np.random.default_rng(len(item))
    row = np.frombuffer(item, np.uint8)
    walked = embedded(np.stack([row, *(_edited(row, rng) for _ in range(COPIES))]))
    same = (walked[:, :, 1:] == walked[:, :, :1]).mean(axis=1)  # [walk, copy]
    for sampled in SAMPLED:
        miss = 1 - same**sampled
        for each in range(1, MOST_TABLES // WALKS + 1):
            if 1 - (miss**each).prod(axis=0).mean() >= RECALL:
                return sampled, each
    return 0, 0


class Seeds:
    """Pieces of one size of some items, and where enough of an item's stand together."""

    def __init__(self, size: int, data: np.ndarray, start: np.ndarray, length: np.ndarray, items: np.ndarray):
        """``data`` holds the bytes of all items, one after the other; ``items`` are those cut into pieces of ``size``."""
        pieces = length[items] // size
        item = np.repeat(items, pieces)
        offset = (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * size
        seed = np.zeros(len(item), _U)
        for k in range(size):
            seed = (seed << _U(8)) | data[start[item] + offset + k]
        order = np.lexsort((offset, item, seed))
        self.size = size
        self.seed, self.item, self.offset = seed[order], item[order], offset[order]
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[(self.seed * _FACTOR) >> _U(64 - _BITS)] = True

    def near(self, buf: np.ndarray, at: np.ndarray, edits: np.ndarray, needed: np.ndarray, longest: int) -> np.ndarray:
        """(text, item, window start), sorted, where enough pieces of the item stand near one diagonal."""
        none = np.zeros((0, 3), np.int64)
        if len(buf) < self.size:
            return none
        w = np.zeros(len(buf) - self.size + 1, _U)
        for k in range(self.size):
            w = (w << _U(8)) | buf[k : k + len(w)]
        hit = np.flatnonzero(self.bits[(w * _FACTOR) >> _U(64 - _BITS)])
        lo, hi = np.searchsorted(self.seed, w[hit], "left"), np.searchsorted(self.seed, w[hit], "right")
        n = hi - lo
        hit, which = np.repeat(hit, n), np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        doc = np.searchsorted(at, hit, "right") - 1
        inside = hit + self.size <= at[doc + 1]
        hit, which, doc = hit[inside], which[inside], doc[inside]
        item, diagonal = self.item[which], hit - self.offset[which]
        group = doc * len(edits) + item
        order = np.lexsort((diagonal, group))
        group, item, doc, diagonal = group[order], item[order], doc[order], diagonal[order]
        other = np.arange(len(order)) + needed[item] - 1
        inside = other < len(order)
        other = np.minimum(other, len(order) - 1)
        near = np.flatnonzero(inside & (group[other] == group) & (diagonal[other] - diagonal <= edits[item])) if len(order) else none[:, 0]
        return np.unique(np.stack([doc[near], item[near], diagonal[near]], axis=1), axis=0) if len(near) else none


@lru_cache(maxsize=4096)
def _positions(n: int, each: int, sampled: int) -> np.ndarray:
    """[walk, table, sample] places of an embedding of ``n`` bytes that its tables read."""
    return np.random.default_rng([7, n]).integers(0, 3 * n, (WALKS, each, sampled))


def _measured(batches):
    """Tables that items of a length need, from one of them: rows (class, text, ...) -> (class, sampled, each)."""
    for batch in batches:
        found = [tables_for(_lower(batch.column(1).slice(i, 1))[0].as_py().encode()) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.int32()), pa.array([x for _, x in found], pa.int32())], names=["class", "sampled", "each"])


def _embedded_items(batches):
    """Rows (item_id, text in lower case, sampled, each), items of about one length together -> with ``own``, the item's bytes where its tables read its embeddings."""
    for batch in batches:
        texts = [t.encode() for t in batch.column(1).to_pylist()]
        sampled, each = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        own: list[bytes] = [b""] * len(texts)
        some = [i for i, x in enumerate(sampled) if x]
        for k in range(0, len(some), WINDOWS):
            part = some[k : k + WINDOWS]
            rows = np.zeros((len(part), max(len(texts[i]) for i in part)), np.uint8)
            for row, i in zip(rows, part):
                row[: len(texts[i])] = np.frombuffer(texts[i], np.uint8)
            walked = embedded(rows)
            for column, i in enumerate(part):
                at = _positions(len(texts[i]), each[i], sampled[i])
                own[i] = np.take_along_axis(walked[:, :, column], at.reshape(WALKS, -1), 1).tobytes()
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.binary())], names=["item_id", "text", "sampled", "each", "own"])


def _has_class(n: int) -> bool:
    return SEED < n <= LONGEST_WALK and edits_allowed(n) > 0


class Items:
    """Seeds and embeddings of one block of benchmark items (id, text); ``rows`` are those of ``prepared``, else they are made here."""

    def __init__(self, items: list[tuple[int, str]] = (), rows: pa.Table | None = None):
        if rows is None:
            rows = _prepared_here(items)
        self.ids, self.texts = rows["item_id"].to_pylist(), [t.encode() for t in rows["text"].to_pylist()]
        self.own, self.sampled, self.each = (rows[c].to_pylist() for c in ("own", "sampled", "each"))
        self.size = np.array([len(t) for t in self.texts], np.int64)
        self.edits = np.array([edits_allowed(n) for n in self.size.tolist()], np.int64)
        piece = np.array([seed_bytes(n) for n in self.size.tolist()], np.int64)
        self.needed = self.size // np.maximum(piece, 1) - self.edits
        data, start = np.frombuffer(b"".join(self.texts), np.uint8), np.cumsum(self.size) - self.size
        self.seeds = [Seeds(int(s), data, start, self.size, np.flatnonzero(piece == s)) for s in np.unique(piece)]
        self.longest = int(self.size.max(initial=0))
        self.walked = np.array(self.sampled, np.int64) > 0

    @property
    def tables(self) -> list[tuple | None]:
        """By item: its tables, or None if its windows skip them."""
        return [self.table(i) if self.walked[i] else None for i in range(len(self.ids))]

    def table(self, item: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions [walk, table, sample] of an item's tables and its own bytes there."""
        at = _positions(int(self.size[item]), self.each[item], self.sampled[item])
        return at, np.frombuffer(self.own[item], np.uint8).reshape(at.shape)

    def meet(self, item: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Which windows (bytes, zeros behind the item's size) meet their item in some table."""
        walked = embedded(rows)
        met = np.zeros(len(rows), bool)
        for i in np.unique(item).tolist():
            at, own = self.table(i)
            mine = np.flatnonzero(item == i)
            for walk in range(WALKS):
                met[mine] |= (walked[walk][at[walk]][:, :, mine] == own[walk][:, :, None]).all(axis=1).any(axis=0)
        return met

    def candidates(self, buf: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(text, item, window start), sorted, of the windows to verify."""
        found = [s.near(buf, at, self.edits, self.needed, self.longest) for s in self.seeds]
        found = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        keep = np.ones(len(found), bool)
        size = self.size[found[:, 1]]
        gated = np.flatnonzero(self.walked[found[:, 1]])
        gated = gated[np.lexsort((found[gated, 1], size[gated]))]
        for k in range(0, len(gated), WINDOWS):
            some = gated[k : k + WINDOWS]
            n = np.arange(size[some].max())
            where = found[some, 2][:, None] + n
            inside = (n < size[some][:, None]) & (where >= at[found[some, 0]][:, None]) & (where < at[found[some, 0] + 1][:, None])
            keep[some] = self.meet(found[some, 1], np.where(inside, buf[np.clip(where, 0, len(buf) - 1)], 0).astype(np.uint8))
        found = found[keep]
        return found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]

    def matches(self, texts: pa.Array) -> list[tuple[int, int, int, int]]:
        """(text, item, edits, code point at which the best passage ends), one for each pair found."""
        buf, at = raw(_lower(texts))
        found = self.candidates(buf, at)
        if not len(found):
            return []
        doc, item, start = found.T
        # windows of one text and item that overlap are read as one
        size = self.size[item]
        new = np.ones(len(found), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] > size[1:])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(found)) - 1
        out: dict[tuple[int, int], tuple[int, int]] = {}
        for d, i, begin, end in zip(doc[first].tolist(), item[first].tolist(), start[first].tolist(), start[last].tolist()):
            text, k = self.texts[i], int(self.edits[i])
            lo, hi = max(begin - k, int(at[d])), min(end + len(text) + k, int(at[d + 1]))
            edits, stop = search(text, buf[lo:hi].tobytes(), k)
            if edits <= k and edits < out.get((d, i), (k + 1,))[0]:
                out[d, i] = edits, len(buf[int(at[d]) : lo + stop].tobytes().decode(errors="ignore"))
        return [(d, i, edits, stop) for (d, i), (edits, stop) in out.items()]


def _search(shared):
    def rows(batches):
        items: Items = shared.value
        for batch in batches:
            for start, stop in slices(batch.column(1), SLICE):
                found = items.matches(batch.column(1).slice(start, stop - start))
                if found:
                    doc, item, edits, end = zip(*found)
                    ids = batch.column(0).slice(start, stop - start).take(pa.array(doc, pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([items.ids[i] for i in item], pa.int64()), pa.array(edits, pa.int64()), pa.array(end, pa.int64())], names=["doc_id", "item_id", "edits", "passage_end"])

    return rows


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits, passage_end): every benchmark item found in a document, once with its best passage.

    ``docs`` (doc_id, text, ...), ``benchmark`` (item_id, text, ...). Null or
    empty texts hold and are nothing; items of under ten bytes must occur
    unedited. Equal items, and rows that repeat a doc_id, are reported each.
    passage_end counts code points of the text (lower-casing here keeps their
    number). Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    out = None
    for shared in _blocks(benchmark):
        found = rows.mapInArrow(lean(_search(shared)), "doc_id long, item_id long, edits long, passage_end long")
        out = found if out is None else out.unionByName(found)
    return out


_PREPARED = "item_id long, text string, sampled int, each int, own binary"


def _prepared_here(items: list[tuple[int, str]]) -> pa.Table:
    """What ``prepared`` gives, of a few items and without Spark."""
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in items], pa.int64()), pa.array([t for _, t in items], pa.string())], names=["item_id", "text"])
    lowered = pa.Table.from_batches(_lowered([batch])).filter(pc.greater(pc.field("size"), 0))
    first: dict[int, str] = {}
    for text, n in zip(lowered["text"].to_pylist(), lowered["size"].to_pylist()):
        if _has_class(n):
            first.setdefault(-(-n // CLASS), text)
    known = {k: tables_for(t.encode()) for k, t in first.items()}
    found = [known[-(-n // CLASS)] if _has_class(n) else (0, 0) for n in lowered["size"].to_pylist()]
    rows = lowered.select(["item_id", "text"]).append_column("sampled", pa.array([x for x, _ in found], pa.int32())).append_column("each", pa.array([x for _, x in found], pa.int32()))
    return pa.Table.from_batches(_embedded_items(rows.combine_chunks().to_batches() or [pa.RecordBatch.from_pylist([], rows.schema)]))


def prepared(benchmark: DataFrame) -> DataFrame:
    """(item_id, text, sampled, each, own), written: the items of ``benchmark`` that have text, in lower case, with what their tables need.

    Tables are measured for each class of lengths, on the item of the smallest
    hash, and items are embedded with others of about their length, all in
    tasks. ``sampled`` is 0 for items that skip the tables.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("length(text) > 0")
    lowered = items.mapInArrow(_lowered, "item_id long, text string, size int")
    klass = F.when((F.col("size") > SEED) & (F.col("size") <= LONGEST_WALK) & (F.floor(F.col("size") * RATE) > 0), F.ceil(F.col("size") / CLASS).cast("int"))
    lowered = written(lowered.withColumn("class", klass), "items")
    one = lowered.where("class is not null").groupBy("class").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    tables = one.repartition("class").mapInArrow(lean(_measured), "class int, sampled int, each int")
    rows = lowered.join(F.broadcast(tables), "class", "left").select("item_id", "text", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("sampled", "each")), "size")
    placed = rows.repartitionByRange("size").sortWithinPartitions("size").drop("size")
    out = written(placed.mapInArrow(lean(_embedded_items), _PREPARED), "prepared")
    dropped(lowered)
    return out


def _lowered(batches):
    for batch in batches:
        texts = _lower(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), texts, pc.binary_length(texts).cast(pa.int32())], names=["item_id", "text", "size"])


def _blocks(benchmark: DataFrame):
    """The items of ``benchmark``, broadcast in blocks of at most about BLOCK_BYTES of text; one block without any."""
    items = prepared(benchmark)
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_BYTES))
    try:
        for block in range(blocks):
            mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").toArrow()
            yield benchmark.sparkSession.sparkContext.broadcast(Items(rows=mine))
    finally:
        dropped(items)


def _clean(shared, column: int):
    def rows(batches):
        items: Items = shared.value
        for batch in batches:
            texts = pc.fill_null(batch.column(column).cast(pa.string()), "")
            keep = np.ones(len(texts), bool)
            for start, stop in slices(texts, SLICE):
                keep[[start + m[0] for m in items.matches(texts.slice(start, stop - start))]] = False
            yield batch.filter(pa.array(keep))

    return rows


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item; all columns, other rows as they are, whatever their ids."""
    column = [c.lower() for c in docs.columns].index("text")
    out = docs
    for shared in _blocks(benchmark):
        out = out.mapInArrow(lean(_clean(shared, column)), docs.schema)
    return out
