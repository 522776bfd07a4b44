"""Secret scans with corpus-wide ownership frequency.

Each text is scanned once: the base patterns give the contract's spans, and
high-entropy tokens elsewhere are further candidates. Candidate values are
hashed and counted by distinct repositories and owners over the whole corpus.
A value under many owners, or in many repositories of one, is a widely copied
example; one that few hold and that looks live is owner-specific. Further
candidates become spans only if they are owner-specific, so the corpus decides
what is added.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm._hot import salted_join
from threadloom.llm._store import dropped, lean, written

KINDS = ("assign", "access", "hex", "entropy")
#: A value under more owners or in more repositories than this is an example that was copied.
MAX_OWNERS, MAX_REPOSITORIES = 2, 10
#: Bits a character of a further candidate, and of any value that looks live.
MIN_ENTROPY, LIVE_ENTROPY, MIN_TOKEN = 3.5, 2.5, 20

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so those of 16 and more are what is left of all runs
_TOKEN = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_TOKEN},}}")
#: Any text with a span of some kind matches this (a linear-time automaton reads it).
_MAYBE = r"""(?i:password|passwd|secret|token|api_?key)["']? *[:=]|AKIA[A-Z0-9]{14}|[0-9a-f]{16}|[A-Za-z0-9+/_=-]{20}"""


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, rank of the kind, end, value) of the base patterns, in order."""
    found = [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(found)


def _entropy(value: str) -> float:
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def further_spans(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Tokens outside ``taken`` of three character classes and high entropy. Tokens and spans both come by start and are walked once."""
    found, i, reach = [], 0, 0
    for m in _TOKEN.finditer(text):
        while i < len(taken) and taken[i][0] < m.end():
            reach = max(reach, taken[i][2])
            i += 1
        value = m[0]
        if reach > m.start() or not any(c.isdigit() for c in value) or value.lower() == value or value.upper() == value or _entropy(value) < MIN_ENTROPY:
            continue
        found.append((m.start(), 3, m.end(), value))
    return found


_SPAN = "array<struct<start:int,kind:int,end:int,hash:string,live:boolean>>"
_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("hash", pa.string()), ("live", pa.bool_())]))


def _scan(batches):
    for batch in batches:
        texts = batch.column(2)
        maybe = pc.fill_null(pc.match_substring_regex(texts, _MAYBE), False).to_numpy(zero_copy_only=False)
        spans: list[list] = [[] for _ in range(len(texts))]
        for i in maybe.nonzero()[0].tolist():
            text = texts[i].as_py()
            base = base_spans(text)
            for start, kind, end, value in base + further_spans(text, base):
                spans[i].append({"start": start, "kind": kind, "end": end, "hash": hashlib.sha256(value.encode(errors="surrogatepass")).hexdigest(), "live": _entropy(value) >= LIVE_ENTROPY})
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(spans, _TYPE)], names=["doc_id", "owner", "repository", "spans"])


def scanned(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """(row, doc_id, owner, repository, spans) with all candidates, written once; ``row`` tells rows that repeat an id apart."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(owner).cast("string").alias("owner"), F.col("text").cast("string").alias("text"), F.col(repository).cast("string").alias("repository"))
    return written(slim.mapInArrow(lean(_scan), f"doc_id long, owner string, repository string, spans {_SPAN}").withColumn("row", F.monotonically_increasing_id()), "spans")


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_found, n_owners, n_repositories) of every candidate value. Owners and repositories are made distinct in partial sums first, so a value that a third of all rows hold meets as one row per task and owner. A null owner is an owner."""
    each = found.select(F.explode("spans").alias("s"), "owner", "repository").select("s.hash", F.coalesce("owner", F.lit("\0")).alias("owner"), F.coalesce("repository", F.lit("\0")).alias("repository"))
    by_repo = each.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("r"))
    return by_owner.groupBy("hash").agg(F.sum("n").alias("n_found"), F.count(F.lit(1)).alias("n_owners"), F.sum("r").alias("n_repositories"))


def secrets(docs: DataFrame, owner: str = "source", repository: str = "doc_id", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base, spans, n_owner_specific, n_copied), a row for each row of ``docs`` (doc_id, text, owner, repository, ...).

    ``base`` and ``spans`` are arrays of (start, kind, end, hash, live), by
    start, then kind; offsets count code points, the end is exclusive. Null or empty
    text has none. Rows that repeat a doc_id stay apart. ``spans`` are the base
    spans and the owner-specific high-entropy tokens. A value is copied if it
    is under more than ``max_owners`` owners or in more than
    ``max_repositories`` repositories; n_copied counts such spans,
    n_owner_specific the others that look live. No rows: none. Other columns
    are ignored.
    """
    found = scanned(docs, owner, repository)
    each = found.where("size(spans) > 0").select("row", F.explode("spans").alias("s"))
    owned = written(ownership(found).select(F.col("hash").alias("value"), "n_found", ((F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories)).alias("specific")), "owned")
    judged = salted_join(each.withColumn("value", F.col("s.hash")), owned, ["value"], owned, "n_found", ["row"])
    judged = judged.where("s.kind < 3 or specific").groupBy("row").agg(F.array_sort(F.collect_list("s")).alias("all"), F.count_if(F.expr("specific and s.live")).alias("n_owner_specific"), F.count_if(~F.col("specific")).alias("n_copied"))
    spans = F.coalesce("all", F.array().cast(_SPAN))
    base = F.filter(spans, lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    out = found.drop("spans").join(judged, "row", "left").select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), base.alias("base"), spans.alias("spans"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_owner_specific", "n_copied")))
    out = written(out, "secrets")
    dropped(found, owned)
    return out


def written_out(spans):
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")
