"""Embedding near-dedup with randomised-rotation binary codes.

A random rotation turns a unit vector into its signs (a point of the cube
close to it) and the correction factor <signs / sqrt(D), vector>. For another
vector, <signs / sqrt(D), rotated> / factor estimates the inner product without
bias. A vector's code has the signs and factors of ROTATIONS rotations; the
mean of their estimates is off by at most EPSILON standard errors but for a
chance of about 1e-9. The other vector takes a byte a component, rounded with a
fixed dither; what that can change is added to the bound. Only pairs whose upper
confidence bound reaches the threshold are computed again, in double
precision from the whole vectors, and only that decides.

Pairs to estimate come from tables over other rotations' signs: ``bits`` signs
are a bucket, and there are as many tables as bring a pair at the threshold
together but for a chance of MISS. Equal vectors are one class. Buckets are cut
into tiles of BLOCK x BLOCK vectors, so a bucket that holds a third of all rows
becomes many tasks. Codes alone go to the tiles; the vectors follow only to
tiles where pairs stay open. A tile gives counts and its local components, not
pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm._graph import components
from threadloom.llm._hot import salted_join
from threadloom.llm._store import dropped, lean, written

THRESHOLD, MISS, EPSILON, BLOCK, ROTATIONS = 0.98, 1e-9, 6.0, 256, 4
#: Tiles of at most so many vectors are worked on together, pair by pair.
SMALL = 24
_rotations: dict[tuple[int, int], np.ndarray] = {}


def rotation(dim: int, rows: int, seed: int) -> np.ndarray:
    """``rows`` directions: stacked random rotations of the space, the same wherever they are made."""
    key = dim, seed
    if key not in _rotations or len(_rotations[key]) < rows:
        rng = np.random.default_rng([seed, dim])
        _rotations[key] = np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0].T for _ in range(-(-rows // dim))])
    return _rotations[key][:rows]


def tables_needed(bits: int, threshold: float = THRESHOLD, miss: float = MISS) -> int:
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(miss) / math.log1p(-meet))


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision and without overflow on the way."""
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _dither(dim: int) -> np.ndarray:
    return np.random.default_rng([3, dim]).random(dim)


def encoded(unit: np.ndarray):
    """Of unit vectors: signs (packed), correction factors, bytes of the vector as first rotated, and what one of them stands for."""
    dim = unit.shape[1]
    turned = unit @ rotation(dim, dim * ROTATIONS, 1).T
    factors = np.abs(turned).reshape(len(unit), ROTATIONS, dim).sum(axis=2) / math.sqrt(dim)
    first = turned[:, :dim]
    step = np.abs(first).max(axis=1) / 126
    small = np.floor(first / step[:, None] + _dither(dim)).astype(np.int8)
    return np.packbits(turned > 0, axis=1), factors, small, step


def _sides_of_estimate(code, factors, small, step, dim: int):
    """Rows whose inner products are the estimates: of the code's side and of the other; then each side's part of the bound on its error."""
    turns = rotation(dim, dim * ROTATIONS, 1)
    signs = (np.unpackbits(code, axis=1, count=dim * ROTATIONS) * 2.0 - 1.0).reshape(-1, ROTATIONS, dim) / factors[:, :, None]
    near = ((small + 0.5 - _dither(dim)) * step[:, None]) @ turns[:dim]  # the vectors but for rounding
    spread = np.sqrt((np.maximum(1 - factors**2, 0) / factors**2).sum(axis=1)) / ROTATIONS * EPSILON / math.sqrt(max(dim - 1, 1))
    return signs.reshape(len(code), -1) / (math.sqrt(dim) * ROTATIONS), near @ turns.T, spread + 1e-12, (1 / factors).mean(axis=1), math.sqrt(dim) / 2 * step


def upper_bounds(code, factors, small, step, dim: int) -> np.ndarray:
    """[i, j]: what the inner product of vectors i and j is at most, from the code of i and the bytes of j."""
    signs, turned, spread, scale, rounding = _sides_of_estimate(code, factors, small, step, dim)
    return signs @ turned.T + spread[:, None] + scale[:, None] * rounding[None, :]


def _coder(bits: int, tables: int):
    def codes(batches):
        for batch in batches:
            vectors = [np.array(v, np.float32) for v in batch.column(2).to_pylist()]
            n = len(vectors)
            code, factors, small, step, buckets = [b""] * n, [b""] * n, [b""] * n, [0.0] * n, [None] * n
            sizes = np.array([len(v) for v in vectors], np.int32)
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                unit = _unit(np.stack([vectors[i] for i in rows]))
                parts = encoded(unit)
                signs = (unit @ rotation(dim, bits * tables, 2).T > 0).reshape(len(rows), tables, bits)
                ids = (signs << np.arange(bits)).sum(axis=2).astype(np.int32)
                for k, i in enumerate(rows):
                    code[i], factors[i], small[i], step[i], buckets[i] = parts[0][k].tobytes(), parts[1][k].tobytes(), parts[2][k].tobytes(), float(parts[3][k]), ids[k]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes), pa.array(code, pa.binary()), pa.array(factors, pa.binary()), pa.array(small, pa.binary()), pa.array(step, pa.float64()), pa.array(buckets, pa.list_(pa.int32()))],
                names=["class", "label", "dim", "code", "factors", "small", "step", "buckets"],
            )

    return codes


_TILE = ("label", "dim", "table", "bucket", "i", "j")


def _pairs_in(tile: np.ndarray, half: np.ndarray, score) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of the pairs that tiles hold and ``score`` keeps. Rows of one tile are neighbours; in a tile of two blocks only pairs across count.

    ``score(rows, i, j)``: for the rows of a stretch, whether its pairs (i, j) stay; i and j None: all of them, as a matrix.
    """
    size = np.bincount(tile)
    start = np.cumsum(size) - size
    out_i, out_j = [], []
    small = np.flatnonzero(size[tile] <= SMALL)
    for k in range(1, min(SMALL, len(small))):
        same = tile[small[k:]] == tile[small[:-k]]
        across = (half[small[k:]] == 2) | (half[small[k:]] != half[small[:-k]])
        at = np.flatnonzero(same & across)
        if not len(at):
            if not same.any():
                break
            continue
        i, j = small[at], small[at + k]
        keep = score(None, i, j)
        out_i.append(i[keep])
        out_j.append(j[keep])
    for t in np.flatnonzero(size > SMALL):
        rows = np.arange(start[t], start[t] + size[t])
        near = score(rows, None, None)
        near = np.triu(near, 1) if half[rows[0]] == 2 else near & (half[rows] == 0)[:, None] & (half[rows] == 1)[None, :]
        i, j = np.nonzero(near)
        out_i.append(rows[i])
        out_j.append(rows[j])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_i]), np.concatenate([none, *out_j])


def _open(cols: dict, tile: np.ndarray, dim: int, threshold: float):
    """The rows of tiles that have a pair whose upper bound reaches the threshold."""
    code, small, factors = cols["code"], cols["small"].view(np.int8), cols["factors"].view(np.float64)
    signs, turned, spread, scale, rounding = _sides_of_estimate(code, factors, small, cols["step"], dim)

    def score(rows, i, j):
        if rows is not None:
            return signs[rows] @ turned[rows].T + spread[rows][:, None] + scale[rows][:, None] * rounding[rows][None, :] >= threshold
        return np.einsum("ij,ij->i", signs[i], turned[j]) + spread[i] + scale[i] * rounding[j] >= threshold

    some = np.unique(np.concatenate(_pairs_in(tile, cols["half"], score)))
    return [cols[k][some] for k in (*_TILE, "half", "class")]


def _linked(cols: dict, tile: np.ndarray, dim: int, threshold: float):
    """(class, node, links, root) of vectors that link in their tile, exactly; a pair counts in the first table that brings it together."""
    unit = _unit(cols["embedding"])

    def score(rows, i, j):
        return unit[rows] @ unit[rows].T >= threshold - 1e-9 if rows is not None else np.einsum("ij,ij->i", unit[i], unit[j]) >= threshold

    i, j = _pairs_in(tile, cols["half"], score)
    exact = np.einsum("ij,ij->i", unit[i], unit[j]) >= threshold
    i, j = i[exact], j[exact]
    buckets = cols["buckets"]
    earlier = np.arange(buckets.shape[1])[None, :] < cols["table"][i][:, None]
    first = ~((buckets[i] == buckets[j]) & earlier).any(axis=1)
    i, j = i[first], j[first]
    node, m = cols["node"], cols["m"]
    links = np.bincount(i, m[j], len(node)) + np.bincount(j, m[i], len(node))
    root = node.copy()
    while len(i):
        before = root.copy()
        np.minimum.at(root, i, before[j])
        np.minimum.at(root, j, before[i])
        if (root == before).all():
            break
    some = np.flatnonzero(links)
    return [cols["class"][some], node[some], links[some].astype(np.int64), root[some]]


def _arrays(batch: pa.RecordBatch, columns) -> dict:
    """Columns of rows of one dimension as arrays: numbers by row, bytes and lists as rows of a matrix."""
    out = {}
    for k, c in zip(columns, batch.columns):
        if pa.types.is_binary(c.type):
            ends = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
            c = np.frombuffer(c.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(c), -1).copy()
        elif pa.types.is_list(c.type):
            c = c.flatten().to_numpy().reshape(len(c), -1)
        else:
            c = c.to_numpy()
        out[k] = c
    return out


def _tiles(columns, names, types, work, threshold):
    """``work`` on the tiles of rows sorted by tile; a tile that may go on in the next batch waits for it."""

    def done(cols):
        keys = np.stack([cols[k].astype(np.int64) for k in _TILE])
        tile = np.concatenate([[0], np.cumsum((keys[:, 1:] != keys[:, :-1]).any(axis=0))])
        found = work(cols, tile, int(cols["dim"][0]), threshold)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, types)], names=names)

    def tiles(batches):
        held = None
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for part in np.split(np.arange(batch.num_rows), np.flatnonzero(dims[1:] != dims[:-1]) + 1):
                if not len(part):
                    continue
                cols = _arrays(batch.slice(int(part[0]), len(part)), columns)
                if held is not None and held["dim"][0] == cols["dim"][0]:
                    cols = {k: np.concatenate([held[k], v]) for k, v in cols.items()}
                elif held is not None:
                    yield done(held)
                keys = np.stack([cols[k].astype(np.int64) for k in _TILE])
                last = np.flatnonzero((keys != keys[:, -1:]).any(axis=0))
                cut = int(last[-1]) + 1 if len(last) else 0
                if cut:
                    yield done({k: v[:cut] for k, v in cols.items()})
                held = {k: v[cut:] for k, v in cols.items()}
        if held is not None:
            yield done(held)

    return tiles


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``vectors`` (vec_id long, embedding array<float>, label, ...) -> (vec_id, n_links, component_id, kept), a row for each input row.

    Vectors link if their labels are equal and their cosine in double precision
    is at least ``threshold``. Null, empty or zero vectors, those with null or
    non-finite components, and rows without label or vec_id link with nothing:
    0 links, their own component, kept. Vectors of different length never
    link. Rows that repeat a vec_id are vectors of their own, each with its own
    links, but one node: they share the component. No rows: none. Other columns
    are ignored.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"), F.col("label").cast("long").alias("label"))
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    valid = F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False)) & F.col("vec_id").isNotNull() & F.col("label").isNotNull()
    rows = rows.withColumn("valid", valid)
    grouped = rows.where("valid").groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("m"))
    classes = written(grouped.withColumn("class", F.monotonically_increasing_id()), "classes")
    # a vector that a third of all rows hold is dealt out in both joins of rows with their class
    keyed = written(salted_join(rows.where("valid").select("vec_id", "label", "embedding"), classes, ["label", "embedding"], classes, "m", ["vec_id"]).select("vec_id", "class", "node"), "keyed")
    bits = min(30, max(8, math.ceil(math.log2(max(classes.count(), 2)))))
    tables = tables_needed(bits, threshold)
    codes = "class long, label long, dim int, code binary, factors binary, small binary, step double, buckets array<int>"
    coded = written(classes.select("class", "label", "embedding").mapInArrow(lean(_coder(bits, tables)), codes), "codes")

    keys = ["label", "dim", "table", "bucket"]
    spots = coded.select("class", "label", "dim", F.posexplode("buckets").alias("table", "bucket"))
    shared = spots.groupBy(*keys).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    spots = spots.join(shared, keys).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    spots = spots.withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    half = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1)
    spots = spots.select("class", *keys, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), half.alias("half"))

    def worked(tiles, columns, work, names, types, schema, name):
        placed = tiles.select(*columns).repartition(*_TILE).sortWithinPartitions(*_TILE)
        return written(placed.mapInArrow(lean(_tiles(columns, names, types, work, threshold)), schema), name)

    int_, long_ = pa.int32(), pa.int64()
    open_ = worked(
        spots.join(coded.select("class", "code", "factors", "small", "step"), "class"), (*_TILE, "half", "class", "code", "factors", "small", "step"), _open,
        [*_TILE, "half", "class"], [long_, int_, int_, int_, int_, int_, int_, long_], "label long, dim int, table int, bucket int, i int, j int, half int, class long", "open",
    )
    whole = open_.join(classes.select("class", "node", "m", "embedding"), "class").join(coded.select("class", "buckets"), "class")
    found = worked(
        whole, (*_TILE, "half", "class", "node", "m", "embedding", "buckets"), _linked,
        ["class", "node", "links", "root"], [long_] * 4, "class long, node long, links long, root long", "links",
    )
    # a vec_id of several classes ties them together
    ties = keyed.groupBy("vec_id").agg(F.min("node").alias("a"), F.max("node").alias("other")).where("a <> other").select("vec_id", "a")
    ties = keyed.join(ties, "vec_id").select("a", F.col("node").alias("b")).distinct()
    joined = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(ties))
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    by_class = classes.join(links, "class", "left").join(joined, "node", "left").select("class", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    good = salted_join(keyed, by_class, ["class"], classes, "m", ["vec_id"]).select("vec_id", "n_links", "component_id")
    bad = rows.where("not valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = written(good.unionByName(bad).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))), "vectors")
    dropped(classes, keyed, coded, open_, found, joined)
    return out
