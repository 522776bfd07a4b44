"""Thresholds by model from a table of rules: any number of them, joined by the literal beginning of their patterns."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.plans.config import THRESHOLD_COLUMNS, _PAIRS, _number, _share, handoff_threshold

#: A rule's pattern, its place (of equals the earlier one wins) and what it sets; k_given says that it says anything of k.
RULES = "pattern string, position int, " + ", ".join(f"{k}_enter double, {k}_exit double, {k}_given boolean" for k in _PAIRS) + ", handoff_enter double, reclaimable_min double"


def rule_rows(models: dict[str, Any], base_handoff: dict) -> list[dict]:
    """A configuration's ``models`` as rows of RULES."""
    rows = []
    for position, (pattern, over) in enumerate(models.items()):
        row: dict[str, Any] = {"pattern": pattern, "position": position}
        for k in _PAIRS:
            value = over.get(k)
            pair = value if isinstance(value, dict) else {"enter": value}
            row |= {f"{k}_{e}": float(pair[e]) if _share(pair.get(e)) else None for e in ("enter", "exit")}
            row[f"{k}_given"] = isinstance(value, dict) or _share(value)
        handoff = over.get("handoff")
        row["handoff_enter"] = float(handoff_threshold(handoff, base_handoff)[0]["enter"]) if handoff is not None else None
        least = over.get("reclaimableMin")
        row["reclaimable_min"] = float(least) if _number(least) and least >= 0 else None
        rows.append(row)
    return rows


def rule_table(spark: SparkSession, config: dict) -> DataFrame:
    names = [f.split(" ")[0] for f in RULES.split(", ")]
    rows = rule_rows(config.get("models") or {}, config["thresholds"]["handoff"])
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], RULES)


def _prepared(rules: DataFrame) -> DataFrame:
    """Rules with their literal beginning, their regular expression and their rank: exact names, then the longest beginning, then the longest pattern, a lone * last."""
    pattern = F.col("pattern")
    wild = F.regexp_instr(pattern, F.lit("[*?]"))
    start = F.when(wild > 0, F.substring(pattern, F.lit(1), wild - 1)).otherwise(pattern)
    regex = F.concat(F.lit("^"), F.replace(F.replace(F.regexp_replace(pattern, r"([^A-Za-z0-9*?_])", r"\\$1"), F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit(r"\z"))
    kind = F.when(wild == 0, 3).when(pattern == "*", 1).otherwise(2)
    rank = F.struct(kind.alias("kind"), F.length(start).alias("start"), F.length(pattern).alias("length"), (-F.col("position")).alias("position"))
    return rules.withColumns({"start": start, "regex": regex, "wild": wild > 0, "rank": rank})


def with_rules(rows: DataFrame, rules: DataFrame, config: dict, model: str = "model") -> DataFrame:
    """``rows`` with THRESHOLD_COLUMNS of each one's model, as ``with_thresholds`` gives them, from a table RULES.

    Each distinct model meets the rules at the beginnings of its name, so a
    rule is looked at only by models that begin as it does; of those that match, the most
    specific one that says something decides each field.
    """
    made = _prepared(rules)
    models = rows.select(F.col(model).alias("m")).where("m is not null").distinct()
    begun = models.select("m", F.explode(F.transform(F.sequence(F.lit(0), F.length("m")), lambda n: F.substring(F.col("m"), F.lit(1), n))).alias("start"))
    hits = begun.join(made, "start").where(F.when(F.col("wild"), F.expr("m rlike regex")).otherwise(F.col("m") == F.col("pattern")))
    said = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("rank"))).alias(c)
    last = lambda k: F.max_by(F.struct(F.col(f"{k}_exit").alias("exit")), F.when(F.coalesce(F.col(f"{k}_given"), F.lit(False)), F.col("rank"))).alias(f"{k}_last")
    best = hits.groupBy("m").agg(*(said(f"{k}_enter") for k in _PAIRS), *(last(k) for k in _PAIRS), said("handoff_enter"), said("reclaimable_min"))
    base = config["thresholds"]
    cols: dict[str, Column] = {}
    for k in _PAIRS:
        enter = F.coalesce(f"{k}_enter", F.lit(float(base[k]["enter"])))
        cols[f"{k}_enter"] = enter
        derived = F.greatest(F.lit(0.0), F.round(enter - 0.1, 4))
        cols[f"{k}_exit"] = F.when(F.col(f"{k}_last").isNull(), F.lit(float(base[k]["exit"]))).otherwise(F.coalesce(F.col(f"{k}_last.exit"), derived))
    cols["handoff_enter"] = F.coalesce("handoff_enter", F.lit(float(base["handoff"]["enter"])))
    cols["reclaimable_min"] = F.coalesce("reclaimable_min", F.lit(float(config["policy"]["reclaimableMin"])))
    joined = rows.join(best, F.col(model) == F.col("m"), "left")
    return joined.select(*(rows[c] for c in rows.columns), *(cols[c].alias(c) for c in THRESHOLD_COLUMNS))
