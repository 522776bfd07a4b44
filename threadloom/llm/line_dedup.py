"""Line dedup by distinct-site spread.

A line's sites are sketched (HyperLogLog) under the line's hash; sketches merge
as Spark aggregates. Lines whose estimate is near the threshold are counted
exactly; then lines over many sites are removed from all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm._hot import salted_join
from threadloom.llm._store import dropped, written

#: A line under at least so many sites is boilerplate.
MIN_SITES = 5
#: log2 of a sketch's registers, and how far from the threshold an estimate decides alone (three standard errors at 2**8 registers are under 0.2).
LOG_K, MARGIN = 8, 0.25


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))


def _each_line(rows: DataFrame) -> DataFrame:
    """(row, row2, site, pos, h, g): the lines of each row that are not blank. Two hashes stand for a line."""
    lines = rows.select("row", "row2", "site", F.posexplode(_lines(F.col("text"))).alias("pos", "line")).withColumn("line", _trimmed(F.col("line"))).where("line <> ''")
    return lines.select("row", "row2", F.coalesce("site", F.lit("\0")).alias("site"), "pos", F.xxhash64("line").alias("h"), F.hash("line").alias("g"))


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES, margin: float = MARGIN) -> DataFrame:
    """(site, h, g) -> (h, g, n_sites, n) of the lines under at least ``min_sites`` distinct sites, ``n`` of them in all.

    Each task sketches the sites of its lines; what is shuffled are sketches,
    one for each line and task, and they merge. Only lines whose estimate is
    near the threshold are read again and have their sites counted exactly.
    """
    sketched = written(lines.groupBy("h", "g").agg(F.hll_sketch_agg("site", F.lit(LOG_K)).alias("sites"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites).select("h", "g", F.hll_sketch_estimate("sites").cast("double").alias("about"), "n"), "sketched")
    sure = sketched.where(F.col("about") > min_sites * (1 + margin)).select("h", "g", F.round("about").cast("long").alias("n_sites"), "n")
    near = written(sketched.where(F.col("about").between(min_sites * (1 - margin), min_sites * (1 + margin))).select("h", "g", "n"), "near")
    pairs = salted_join(lines.select("h", "g", "site"), near, ["h", "g"], near, "n", ["site"]).groupBy("h", "g", "n", "site").agg(F.count(F.lit(1)).alias("rows"))
    exact = pairs.groupBy("h", "g", "n").agg(F.count(F.lit(1)).alias("n_sites")).where(F.col("n_sites") >= min_sites)
    out = written(sure.unionByName(exact), "spread")
    dropped(sketched, near)
    return out


def without_spread_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` (doc_id, text, site, ...) -> (doc_id, text, n_lines, n_removed), a row for each input row: its text without cross-site boilerplate lines.

    Lines end at \\n and are compared without white space around them; blank
    lines are never removed, and other lines keep theirs. Null text stays null,
    with no line; a null site is a site. Rows that repeat a doc_id stay apart.
    No rows: none. Other columns, whatever their names, are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(site).cast("string").alias("site"))
    # two hashes stand for a row: rows that are equal in all three columns lose the same lines
    keyed = rows.withColumn("row", F.xxhash64("doc_id", "site", "text")).withColumn("row2", F.hash("text", "doc_id", "site"))
    lines = _each_line(keyed)
    spread = spread_lines(lines, min_sites)
    hits = salted_join(lines.drop("site"), spread.select("h", "g"), ["h", "g"], spread, "n", ["row"]).groupBy("row", "row2").agg(F.collect_set("pos").alias("drop"))
    hit = keyed.join(hits, ["row", "row2"], "left")
    every = _lines(F.col("text"))
    kept = F.filter(every, lambda line, i: ~F.coalesce(F.array_contains("drop", i), F.lit(False)))
    blank_free = F.size(F.filter(every, lambda line: _trimmed(line) != ""))
    return hit.select("doc_id", F.when(F.col("text").isNotNull(), F.array_join(kept, "\n")).alias("text"), blank_free.cast("long").alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_removed"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, source, i AS pos, l.lines[i] AS raw,
    regexp_replace(l.lines[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line
  FROM (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents) l, unnest(range(1, len(l.lines) + 1)) AS u(i)
), spread AS (
  SELECT line FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT coalesce(source, chr(0))) >= 5
), judged AS (
  SELECT lines.*, (spread.line IS NOT NULL) AS bad FROM lines LEFT JOIN spread USING (line)
)
SELECT doc_id, count(*) FILTER (line <> '') AS n_lines, count(*) FILTER (bad) AS n_removed,
  sha256(coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT bad), '')) AS text_sha256
FROM judged GROUP BY doc_id
"""
