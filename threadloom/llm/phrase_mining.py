"""Phrase collocations from depth-limited count tries.

Two passes count hashes of words, then of pairs of frequent words; a bitmap of
what is frequent (which may hold more, never less) ends runs of words that no
frequent phrase can cross. In the third pass each shard counts all
phrases of its runs in a trie of limited depth, written sorted, in blocks of
consecutive nodes. Blocks are cut at common boundaries into prefix ranges; the
runs of a range are merged k ways, and one walk over the merged trie gives each
node the counts above it, its left parts. Suffix links, a salted join on the
phrase without its first words, give the right parts.

A boundary is a whole path, so a word that begins a third of all phrases still
spreads over many ranges; nodes above a boundary are copied into its range.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.llm._hot import salted_join
from threadloom.llm._store import dropped, lean, written
from threadloom.llm._words import Words, mix, slices

DEPTH, MIN_COUNT, TOP = 5, 100, 2000
#: A phrase goes if a longer one around it is so frequent, in percent of it.
COVERED = 100
#: log2 of the most bits of a bitmap, and bits for each frequent hash.
MOST_BITS, BITS_EACH = 28, 16
#: Words of a shard's trie, nodes of a block, nodes of a prefix range (of all shards), ranges at most.
SHARD_WORDS, BLOCK, RANGE_NODES, MOST_RANGES = 1 << 20, 2048, 200_000, 4096
#: Characters of a boundary's words: a beginning of a word bounds as well.
BOUNDARY_CHARS = 64

_U = np.uint64
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_SEPARATORS, _BREAK = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[[*_BREAKS]] = True
_SEPARATORS[[*_BREAKS, *b" \t"]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
Path = tuple[str, ...]


class Bitmap:
    """Two bits a hash among 2**bits."""

    def __init__(self, bits: int, data: np.ndarray):
        self.bits, self.data = bits, data

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at in (hashes >> _U(64 - self.bits), hashes & _U((1 << self.bits) - 1)):
            out &= (self.data[at >> _U(3)] >> (at & _U(7)).astype(np.uint8)) & 1 == 1
        return out


def bitmap(hashes: DataFrame, bits: int) -> Bitmap:
    """Of a table of ``h``: set in tasks, so that at most 2**bits bits reach the driver."""
    places = hashes.select(F.explode(F.array(F.shiftrightunsigned("h", 64 - bits), F.col("h").bitwiseAND((1 << bits) - 1))).alias("at"))
    rows = places.groupBy(F.bitmap_bucket_number(F.col("at") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("at") + 1)).alias("bits"))
    data = np.zeros(max(1, (1 << bits) // 8), np.uint8)
    for bucket, part in rows.collect():
        piece = np.frombuffer(bytes(part), np.uint8)
        start = (bucket - 1) * 4096
        data[start : start + len(piece)] = piece[: len(data) - start]
    return Bitmap(bits, data)


def _bits(n: int) -> int:
    return min(MOST_BITS, max(15, (BITS_EACH * n).bit_length()))


class Pieces:
    """Words of some texts with their language; ``joined``: the next word is in the same piece."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        words = Words(texts, _SEPARATORS)
        codes = langs.dictionary_encode()
        self.langs = codes.dictionary.to_pylist()
        salts = np.array([xxhash.xxh64_intdigest(lang) for lang in self.langs], np.uint64)
        self.words, self.lang = words, codes.indices.to_numpy(zero_copy_only=False)[words.doc]
        self.hash = mix(words.hash + salts[self.lang]) if len(words.hash) else words.hash
        breaks = np.zeros(len(words.buf) + 1, np.int64)
        np.cumsum(_BREAK[words.buf], out=breaks[1:])
        self.joined = np.zeros(len(words.hash), bool)
        self.joined[:-1] = (breaks[words.end[:-1]] == breaks[words.start[1:]]) & (words.doc[1:] == words.doc[:-1])

    def pairs(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places whose word and next are among ``some`` and in one piece, and their pair's hash."""
        at = np.flatnonzero(some[:-1] & some[1:] & self.joined[:-1]) if len(some) else np.zeros(0, np.int64)
        return at, mix(self.hash[at] * _U(3) + self.hash[at + 1] if len(at) else np.zeros(0, _U))


def _each_slice(batches) -> Iterator[Pieces]:
    for batch in batches:
        for start, stop in slices(batch.column(1)):
            yield Pieces(batch.column(0).slice(start, stop - start), batch.column(1).slice(start, stop - start))


def _hash_rows(hashes: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(hashes), 1 << 16):
        part = slice(i, i + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.nulls(len(hashes[part]), pa.string()), pa.array(hashes[part].view(np.int64)), pa.array(n[part])], names=["lang", "h", "n"])


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    hashes, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(hashes, kind="stable")
    hashes, n = hashes[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
    return hashes[first], np.add.reduceat(n, first) if len(first) else n


def _counted(found, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Rows of summed counts of an iterator of hashes, given out whenever ``most`` have gathered."""
    parts, size = [], 0
    for hashes in found:
        parts.append(np.unique(hashes, return_counts=True))
        size += len(parts[-1][0])
        if size > most:
            parts = [_summed(parts)]
            size = len(parts[0][0])
            if size > most // 2:
                yield from _hash_rows(*parts[0])
                parts, size = [], 0
    if parts:
        yield from _hash_rows(*_summed(parts))


def _word_counts(batches):
    totals: dict[str, int] = {}

    def hashes():
        for p in _each_slice(batches):
            for lang, n in zip(p.langs, np.bincount(p.lang, minlength=len(p.langs)).tolist()):
                totals[lang] = totals.get(lang, 0) + n
            yield p.hash

    yield from _counted(hashes())
    yield pa.RecordBatch.from_arrays([pa.array(totals.keys(), pa.string()), pa.array([0] * len(totals), pa.int64()), pa.array(totals.values(), pa.int64())], names=["lang", "h", "n"])


def _pair_counts(shared):
    def rows(batches):
        frequent = shared.value
        yield from _counted(p.pairs(frequent.has(p.hash))[1] for p in _each_slice(batches))

    return rows


def word_ids(words: Words, some: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Ids of the words at ``some`` and the lower-cased word of each id; equal hashes are compared byte by byte."""
    if not len(some):
        return np.zeros(0, np.int64), []
    _, first, ids = np.unique(words.hash[some], return_index=True, return_inverse=True)
    start, size = words.start[some], words.end[some] - words.start[some]
    like = first[ids]
    buf = _LOWER[words.buf]
    same = bool((size == size[like]).all())
    if same:
        offset = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        same = bool((buf[np.repeat(start, size) + offset] == buf[np.repeat(start[like], size) + offset]).all())
    if same:
        return ids, [buf[start[i] : start[i] + size[i]].tobytes() for i in first]
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(buf[a : a + n].tobytes(), len(known)) for a, n in zip(start.tolist(), size.tolist())])
    return ids, list(known)


class Shard:
    """Runs of one language, kept as word ids; ``trie`` counts all their phrases."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.ids: list[np.ndarray] = []
        self.joined: list[np.ndarray] = []
        self.size = 0

    def add(self, ids: np.ndarray, names: list[bytes], joined: np.ndarray) -> None:
        own = np.array([self.known.setdefault(w, len(self.known)) for w in names], np.int32)
        self.ids.append(own[ids])
        self.joined.append(joined)
        self.size += len(ids)

    def trie(self, depth: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Words in order, and by node in preorder: depth, last word, count."""
        names = sorted(self.known)
        rank = np.zeros(len(names), np.int32)
        rank[[self.known[w] for w in names]] = np.arange(1, len(names) + 1, dtype=np.int32)
        ids, joined = rank[np.concatenate(self.ids)], np.concatenate(self.joined)
        at = np.flatnonzero(joined)
        paths = np.zeros((len(at), depth), np.int32)
        going = np.ones(len(at), bool)
        for d in range(depth):
            paths[going, d] = ids[at[going] + d]
            if d + 1 < depth:
                going[going] = joined[at[going] + d]
        paths = paths[np.lexsort(paths.T[::-1])]
        singles = np.bincount(ids, minlength=len(names) + 1)
        nodes, counts = [np.zeros((len(names), depth), np.int32)], [singles[1:]]
        nodes[0][:, 0] = np.arange(1, len(names) + 1)
        differs = np.zeros(len(at), bool)
        differs[:1] = True
        for d in range(1, depth + 1):
            differs[1:] |= paths[1:, d - 1] != paths[:-1, d - 1]
            if d > 1 and len(at):
                first = np.flatnonzero(differs)
                n = np.diff(np.append(first, len(at)))
                there = paths[first, d - 1] > 0
                node = paths[first[there]].copy()
                node[:, d:] = 0
                nodes.append(node)
                counts.append(n[there])
        nodes, counts = np.concatenate(nodes), np.concatenate(counts)
        order = np.lexsort(nodes.T[::-1])
        nodes, counts = nodes[order], counts[order]
        deep = (nodes > 0).sum(axis=1)
        return [w.decode() for w in names], deep, nodes[np.arange(len(nodes)), deep - 1] - 1, counts


_BLOCK = "lang string, first array<string>, depth array<tinyint>, word array<string>, n array<long>"


def _blocks(lang: str, shard: Shard, depth: int) -> Iterator[dict]:
    names, deep, last, n = shard.trie(depth)
    path: list[str] = []
    for start in range(0, len(deep), BLOCK):
        stop = min(start + BLOCK, len(deep))
        words = [names[i] for i in last[start:stop].tolist()]
        depths = deep[start:stop].tolist()
        first = None
        for d, w in zip(depths, words):
            path[d - 1 :] = [w]
            first = first or list(path)
        yield {"lang": lang, "first": first, "depth": depths, "word": words, "n": n[start:stop].tolist()}


def _arrow(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


_BLOCK_SCHEMA = pa.schema([("lang", pa.string()), ("first", pa.list_(pa.string())), ("depth", pa.list_(pa.int8())), ("word", pa.list_(pa.string())), ("n", pa.list_(pa.int64()))])
_CUT_SCHEMA = pa.schema([("range", pa.int32()), *_BLOCK_SCHEMA])


def _tries(words_shared, pairs_shared, depth: int):
    def rows(batches):
        frequent, pairs = words_shared.value, pairs_shared.value
        shards: dict[str, Shard] = {}
        for p in _each_slice(batches):
            some = frequent.has(p.hash)
            at, hashes = p.pairs(some)
            joined = np.zeros(len(some), bool)
            joined[at[pairs.has(hashes)]] = True
            for code, lang in enumerate(p.langs):
                own = np.flatnonzero(some & (p.lang == code))
                if len(own):
                    shards.setdefault(lang, Shard()).add(*word_ids(p.words, own), joined[own])
            if sum(s.size for s in shards.values()) > SHARD_WORDS:
                for lang in list(shards):
                    for block in _blocks(lang, shards.pop(lang), depth):
                        yield _arrow(_BLOCK_SCHEMA, [block])
        for lang in list(shards):
            for block in _blocks(lang, shards.pop(lang), depth):
                yield _arrow(_BLOCK_SCHEMA, [block])

    return rows


def _paths(block: dict) -> Iterator[tuple[Path, int]]:
    path: list[str] = block["first"][:]
    for d, w, n in zip(block["depth"], block["word"], block["n"]):
        path[d - 1 :] = [w]
        yield tuple(path), n


def boundaries(tries: DataFrame, range_nodes: int) -> list[tuple[str, Path]]:
    """Paths that cut the nodes of all blocks into ranges of about ``range_nodes``, from a sample of the blocks' first paths; fewer than MOST_RANGES."""
    blocks, nodes = tries.agg(F.count(F.lit(1)), F.sum(F.size("depth"))).first()
    ranges = min(MOST_RANGES, -(-(nodes or 0) // range_nodes))
    if ranges < 2:
        return []
    share = min(1.0, 20 * ranges / blocks)
    short = F.transform("first", lambda w: F.substring(w, 1, BOUNDARY_CHARS))
    drawn = tries.where(F.pmod(F.xxhash64("lang", "first", "n"), F.lit(1_000_003)) / 1_000_003 < share).select("lang", short.alias("first")).collect()
    starts = sorted((r.lang, tuple(r.first)) for r in drawn)
    return sorted({starts[i * len(starts) // ranges] for i in range(1, ranges)}) if starts else []


def _cut(shared):
    def rows(batches):
        bounds: list[tuple[str, Path]] = shared.value
        above: dict[tuple[str, Path], list[int]] = {}
        for i, (lang, path) in enumerate(bounds, 1):
            for d in range(1, len(path)):
                above.setdefault((lang, path[:d]), []).append(i)
        spine = sorted(above)
        for batch in batches:
            for block in batch.to_pylist():
                lang = block["lang"]
                nodes = None
                low = bisect_right(bounds, (lang, tuple(block["first"])))
                if bounds:
                    *_, (last, _) = nodes = list(_paths(block))
                    for key in spine[bisect_left(spine, (lang, nodes[0][0])) : bisect_right(spine, (lang, last))]:
                        if (i := bisect_left(nodes, (key[1],))) < len(nodes) and nodes[i][0] == key[1]:
                            yield _arrow(_CUT_SCHEMA, [{"range": r, "lang": lang, "first": list(key[1]), "depth": [len(key[1])], "word": [key[1][-1]], "n": [nodes[i][1]]} for r in above[key]])
                while bounds and low < len(bounds) and bounds[low] <= (lang, last):
                    stop = bisect_left(nodes, (bounds[low][1],)) if bounds[low][0] == lang else len(nodes)
                    if stop:
                        head, nodes = nodes[:stop], nodes[stop:]
                        yield _arrow(_CUT_SCHEMA, [{"range": low, **_block_of(lang, head)}])
                    low += 1
                if nodes is None:
                    yield _arrow(_CUT_SCHEMA, [{"range": low, **block}])
                elif nodes:
                    yield _arrow(_CUT_SCHEMA, [{"range": low, **_block_of(lang, nodes)}])

    return rows


def _block_of(lang: str, nodes: list[tuple[Path, int]]) -> dict:
    return {"lang": lang, "first": list(nodes[0][0]), "depth": [len(p) for p, _ in nodes], "word": [p[-1] for p, _ in nodes], "n": [n for _, n in nodes]}


_NODE = "lang string, path array<string>, a long, left array<long>, covers boolean"
_NODE_SCHEMA = pa.schema([("lang", pa.string()), ("path", pa.list_(pa.string())), ("a", pa.int64()), ("left", pa.list_(pa.int64())), ("covers", pa.bool_())])


def _merged(bounds_shared, min_count: int, covered: int):
    """Merge the sorted runs of a range; a walk over the merged trie keeps the counts above each node."""

    def rows(key, table):
        bounds = bounds_shared.value
        low = bounds[key[0].as_py() - 1] if key[0].as_py() else None
        runs: dict[str, list] = {}
        for block in table.select(_BLOCK_SCHEMA.names).to_pylist():
            runs.setdefault(block["lang"], []).append(_paths(block))
        out = []
        for lang in sorted(runs):
            above: list[int] = []
            path, n = None, 0

            def node():
                above[len(path) - 1 :] = [n]
                own = low is None or (lang, path) >= low  # not a copy of one above the range
                if own and n >= min_count:
                    out.append({"lang": lang, "path": list(path), "a": n, "left": above[:-1], "covers": len(path) > 1 and 100 * n >= covered * above[-2]})

            for new, more in heapq.merge(*runs.pop(lang)):
                if new == path:
                    n += more
                else:
                    if path is not None:
                        node()
                    path, n = new, more
            node()
        return pa.Table.from_pylist(out, _NODE_SCHEMA)

    return rows


def phrase_nodes(docs: DataFrame, min_count: int = MIN_COUNT, depth: int = DEPTH, covered: int = COVERED, lang: str = "lang", range_nodes: int = RANGE_NODES) -> tuple[DataFrame, DataFrame]:
    """Written tables (lang, path, a, left, covers) of all phrases of up to ``depth`` words and ``min_count`` occurrences or more, and (lang, n) of all words."""
    spark: SparkSession = docs.sparkSession
    share = spark.sparkContext.broadcast
    slim = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counts = slim.mapInArrow(lean(_word_counts), "lang string, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("n"))
    words = written(counts.where((F.col("n") >= min_count) | F.col("lang").isNotNull()), "words")
    totals = written(words.where("lang is not null").select("lang", "n"), "totals")
    frequent = words.where("lang is null")
    of_words = share(bitmap(frequent, _bits(frequent.count())))
    pairs = written(slim.mapInArrow(lean(_pair_counts(of_words)), "lang string, h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count), "pairs")
    of_pairs = share(bitmap(pairs, _bits(pairs.count())))
    tries = written(slim.mapInArrow(lean(_tries(of_words, of_pairs, depth)), _BLOCK), "tries")
    bounds = share(boundaries(tries, range_nodes))
    nodes = written(tries.mapInArrow(_cut(bounds), f"range int, {_BLOCK}").groupBy("range").applyInArrow(_merged(bounds, min_count, covered), _NODE), "nodes")
    dropped(words, pairs, tries)
    return nodes, totals


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, depth: int = DEPTH, covered: int = COVERED, lang: str = "lang", range_nodes: int = RANGE_NODES) -> DataFrame:
    """``docs`` (text, lang, ...) -> (lang, phrase, words, a, l, r, n, k, score) of every phrase of 2 to ``depth`` words with ``min_count`` occurrences or more that no longer one covers.

    a, l and r count the phrase, its first k words and the rest, n all words
    of the language; the score is floor(1000 a n / (l r)), by the cut k that
    makes it least (the smallest such k). A longer phrase around it covers it
    with ``covered`` percent of its occurrences. Null text is empty, a null
    lang is ``und``; repeated rows count each. Texts without words, and no
    rows, give none. Other columns are ignored.
    """
    nodes, totals = phrase_nodes(docs, min_count, depth, covered, lang, range_nodes)
    long = nodes.where("size(path) > 1")
    # suffix links: what is left of a path without its first k words
    links = long.select("lang", "path", "a", F.explode(F.sequence(F.lit(1), F.size("path") - 1)).alias("k")).withColumn("rest", F.expr("slice(path, k + 1, size(path) - k)"))
    uses = written(links.groupBy("lang", "rest").agg(F.count(F.lit(1)).alias("uses")), "uses")
    parts = nodes.select("lang", F.col("path").alias("rest"), F.col("a").alias("r"))
    linked = written(salted_join(links, parts, ["lang", "rest"], uses, "uses", ["path"]), "links")
    rights = linked.groupBy("lang", "path").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "r"))), lambda x: x["r"]).alias("right"))
    by_suffix = linked.where((F.col("k") == 1) & (100 * F.col("a") >= covered * F.col("r"))).select("lang", F.col("rest").alias("path"))
    by_prefix = long.where("covers").select("lang", F.expr("slice(path, 1, size(path) - 1)").alias("path"))
    free = long.join(by_suffix.unionByName(by_prefix).distinct(), ["lang", "path"], "left_anti").join(rights, ["lang", "path"]).join(totals, "lang")
    wide = "cast({} as decimal(38, 0))".format
    score = f"({wide('a')} * {wide('n')} * 1000) div ({wide('element_at(left, k)')} * {wide('element_at(right, k)')})"
    cut = F.expr(f"array_min(transform(sequence(1, size(path) - 1), k -> struct({score} as score, k as k, element_at(left, k) as l, element_at(right, k) as r)))")
    out = free.withColumn("cut", cut).select("lang", F.array_join("path", " ").alias("phrase"), F.col("path").alias("words"), "a", "cut.l", "cut.r", "n", "cut.k", "cut.score")
    out = written(out, "collocations")
    dropped(nodes, totals, uses, linked)
    return out


def top_collocations(docs: DataFrame, top: int = TOP, **options) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` of ``collocations`` in each language, by score, then a, both descending, then the phrase's bytes."""
    found = collocations(docs, **options)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of shares of a language first, so that none is ranked in one task whole
    share = F.pmod(F.xxhash64("phrase"), F.lit(1 + found.count() // 100_000)).alias("share")
    best = found.select("*", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w))::HUGEINT AS n FROM words GROUP BY lang
), each AS (
  SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE len(w) >= m
), nodes AS (
  SELECT lang, w[i:i + m - 1] AS path, m, count(*)::HUGEINT AS a FROM each GROUP BY lang, path, m HAVING count(*) >= 100
), covered AS (
  SELECT s.lang, s.path FROM nodes x JOIN nodes s ON s.lang = x.lang AND s.path = x.path[1:x.m - 1] WHERE x.m > 1 AND 100 * x.a >= 100 * s.a
  UNION
  SELECT s.lang, s.path FROM nodes x JOIN nodes s ON s.lang = x.lang AND s.path = x.path[2:x.m] WHERE x.m > 1 AND 100 * x.a >= 100 * s.a
), cuts AS (
  SELECT lang, path, a, m, unnest(range(1, m)) AS k FROM nodes ANTI JOIN covered USING (lang, path) WHERE m > 1
), scored AS (
  SELECT c.lang, c.path, c.a, x.a AS l, y.a AS r, n, (1000 * c.a * n) // (x.a * y.a) AS score,
    row_number() OVER (PARTITION BY c.lang, c.path ORDER BY (1000 * c.a * n) // (x.a * y.a), k) AS way
  FROM cuts c JOIN nodes x ON x.lang = c.lang AND x.path = c.path[1:k] JOIN nodes y ON y.lang = c.lang AND y.path = c.path[k + 1:c.m] JOIN totals ON totals.lang = c.lang
), ranked AS (
  SELECT *, array_to_string(path, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(path, ' ')) AS rank FROM scored WHERE way = 1
)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
