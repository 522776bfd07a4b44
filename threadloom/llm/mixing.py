"""Mixing sources to target weights, in DataFrame operations only.

Tokens per source are summed, each source gets a target and so a repetition
rate, and a document is emitted floor(rate) times plus once more if a hash of
its id and text falls below the rate's fraction. Rows that are equal in both
share one draw, which their numbers spread evenly over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm._hot import salted_join
from threadloom.llm._store import dropped, written

WEIGHTS = (5, 2, 1)
#: The mix's words as a multiple of all words, and a source's as one of its own.
SHARE, CAP = 1.5, 2.0
SEED = "mix"
#: Source rows that are broadcast at most (about 100 bytes each); more are joined by a shuffle.
BROADCAST_SOURCES = 50_000


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _draw(seed: str) -> Column:
    """A number in [0, 1) that depends on the document's id and text alone."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("digest"))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def _digest() -> Column:
    return F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _in_order(rows: DataFrame, order: list[Column], sums: dict[str, Column], name: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with each of ``sums`` over all rows before in ``order``, and the written table that this reads.

    Ranges of the order are partitions; sums within one are a window, and what
    lies before it comes from one row for each partition. So no task sees all rows.
    """
    placed = written(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), name)
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("part").agg(*(F.sum(c).alias(k) for k, c in sums.items()))
    parts = parts.select("part", *(F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"{k}_part") for k in sums))
    found = placed.withColumns({k: F.coalesce(F.sum(c).over(inside), F.lit(0)) for k, c in sums.items()}).join(F.broadcast(parts), "part")
    return found.withColumns({k: F.col(k) + F.col(f"{k}_part") for k in sums}).drop("part", *(f"{k}_part" for k in sums)), placed


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, size) -> (source, source_size, rows, target, rate), written.

    A target is least(cap * size, level * weight) with the one level at which
    all targets sum to share * all sizes: where the resharing of what stands
    above a cap ends. In order of cap / weight, the level that would hold if
    exactly the sources before were capped is largest at the right place. Only
    the sum of all sizes, that of all weights and the level reach the driver.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    ranked, made = _in_order(sources, [F.col("source").asc_nulls_last()], {"rank": F.lit(1)}, "ranked")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    top = ranked.withColumn("weight", weight).withColumn("top", F.lit(cap) * F.col("source_size")).withColumn("place", F.col("top") / F.col("weight"))
    placed, put = _in_order(top, [F.col("place"), F.col("rank")], {"before": F.col("top"), "lighter": F.col("weight")}, "placed")
    levels = written(placed, "levels")
    dropped(put, made)
    words, heavy = levels.agg(F.sum("source_size"), F.sum("weight")).first()
    level = levels.agg(F.max((F.lit(share * (words or 0)) - F.col("before")) / (F.lit(heavy or 0.0) - F.col("lighter")))).first()[0]
    target = F.least("top", F.lit(level or 0.0) * F.col("weight"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    out = written(levels.withColumn("target", target).select("source", "source_size", "rows", "target", rate.alias("rate")), "targets")
    dropped(levels)
    return out


def _with_rates(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """``rows`` (source, doc_id, ...) with their source's size, target and rate. The targets are broadcast only if their count proves them small; else both are shuffled, hot sources salted."""
    if targets.count() <= BROADCAST_SOURCES:
        known = F.broadcast(targets.drop("rows").withColumnRenamed("source", "target_source"))
        return rows.join(known, F.col("source").eqNullSafe(F.col("target_source"))).drop("target_source")
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))
    known = targets.withColumn("key", key).drop("source")
    return salted_join(rows.withColumn("key", key), known.drop("rows"), ["key"], known, "rows", ["doc_id"]).drop("key")


#: Rows of one document that are equal in these share a draw.
_SAME = ["doc_id", "source", "digest"]


def _numbered(rows: DataFrame, sizes: DataFrame, name: str) -> DataFrame:
    """``rows`` with ``number``, from 0, among rows equal in _SAME, which ``sizes`` counts.

    Only rows that are not alone are numbered. They are written with the
    partition they come from, numbered within it, and what other partitions hold
    before them comes from one row for each group and partition: so a
    group of a third of all rows meets nowhere.
    """
    repeated = written(sizes.groupBy(*_SAME).agg(F.count(F.lit(1)).alias("same")).where("same > 1").drop("same"), "repeated")
    if repeated.isEmpty():
        dropped(repeated)
        return rows.withColumn("number", F.lit(0).cast("long"))
    like = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in _SAME]
    on = like("r", "d")
    alone = rows.alias("r").join(repeated.alias("d"), on, "left_anti")
    several = written(rows.alias("r").join(repeated.alias("d"), on, "left_semi").withColumn("part", F.spark_partition_id()), name)
    parts = several.groupBy(*_SAME, "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*_SAME).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("before", before).drop("n")
    inside = several.withColumn("number", F.row_number().over(Window.partitionBy(*_SAME, "part").orderBy(F.lit(0))) - 1)
    found = inside.alias("r").join(parts.alias("d"), [*like("r", "d"), F.col("r.part") == F.col("d.part")])
    found = found.select(*(F.col(f"r.{c}") for c in rows.columns), (F.col("number") + F.col("before")).alias("number"))
    return alone.withColumn("number", F.lit(0).cast("long")).unionByName(found)


def _copies(seed: str) -> Column:
    """Copies of a row: floor(rate) and one more if the draw is below the rate's fraction; of equal rows, what their first ``number`` + 1 take less what their first ``number`` do."""
    taken = lambda n: F.ceil(n * F.col("rate") - _draw(seed))
    return (taken(F.col("number") + 1) - taken(F.col("number"))).cast("long")


def _sizes(docs: DataFrame) -> DataFrame:
    return written(docs.select("doc_id", "source", _size().alias("size"), _digest().alias("digest")), "sizes")


def plan(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) -> (doc_id, size, source_size, target, copies, taken), a row for each input row.

    Null or empty text has size 0. A null source is a source, ranked last; a
    source without words has target 0 and is not taken. Rows that repeat a
    doc_id (or have none) draw by their texts; rows equal in id, source and
    text share one draw, so that together they take their number times the
    rate, to one copy. No rows: none. Other columns, whatever their names, are
    ignored.
    """
    sizes = _sizes(docs)
    rows = _numbered(sizes, sizes, "repeated-sizes")
    rated = _with_rates(rows, source_targets(sizes))
    return rated.withColumn("copies", _copies(seed)).select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mixed documents: ``docs`` with all its columns, each row as often as ``plan`` takes it (of rows equal in id, source and text, as many as it takes of them)."""
    sizes = _sizes(docs)
    targets = source_targets(sizes)
    rows = docs.select("doc_id", "source", _digest().alias("digest"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = _numbered(rows, sizes, "repeated-rows")
    dropped(sizes)
    rated = _with_rates(rows, targets).withColumn("copies", _copies(seed))
    return rated.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(text, '')) AS digest,
    row_number() OVER (PARTITION BY doc_id, source, coalesce(text, '')) - 1 AS number FROM documents
), ranked AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rk FROM sized GROUP BY source
), tops AS (
  SELECT *, CASE (rk - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS top FROM ranked
), levels AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
    - coalesce(sum(top) OVER (ORDER BY top / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY top / weight, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM tops
), targets AS (
  SELECT source, source_size, least(top, max(level) OVER () * weight) AS target FROM levels
), rated AS (
  SELECT doc_id, size, source_size, target, number, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || digest), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS draw
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
), taken AS (
  SELECT *, CAST(ceil((number + 1) * rate - draw) - ceil(number * rate - draw) AS BIGINT) AS copies FROM rated
)
SELECT doc_id, size, source_size, target, CAST(copies AS BIGINT) AS copies, CAST(copies * size AS BIGINT) AS taken FROM taken
"""
