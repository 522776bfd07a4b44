"""Configuration: defaults, layered files, sanitising, and thresholds by model."""

from __future__ import annotations

import copy
import json
import math
import os
import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The defaults of every setting.
DEFAULTS: dict[str, Any] = {
    "enabled": True,
    "auto": {"prune": True, "checkpoint": True, "compact": True},
    "handoff": {"mode": "suggest"},
    "thresholds": {"prune": {"enter": 0.65, "exit": 0.55}, "checkpoint": {"enter": 0.80, "exit": 0.70}, "compact": {"enter": 0.88, "exit": 0.78}, "handoff": {"enter": 0.94}},
    "policy": {"reclaimableMin": 5000, "maxActionsPer10Turns": 3, "adaptiveThresholds": True},
    "checkpoint": {"freshMs": 600_000, "staleTokens": 20_000, "staleMessages": 30, "model": None, "maxPerSession": 20, "backoffMs": [30_000, 60_000, 120_000], "maxFailStreak": 3},
    "prune": {"bands": [{"pressureGte": 0.88, "stubMinTokens": 20, "foldMaxChars": 1200}, {"pressureGte": 0.80, "stubMinTokens": 30, "foldMaxChars": 1600}, {"pressureGte": 0.0, "stubMinTokens": 50, "foldMaxChars": 2200}]},
    "pressure": {"green": 0.55, "yellow": 0.7, "orange": 0.82, "red": 0.9},
    "limits": {"oversizedTokens": 1000, "recentWindow": 8, "stubMinTokens": 50, "foldMaxChars": 2200},
    "reserves": {"output": 8192, "safety": 4096, "system": 4000},
    "cooldowns": {"pruneMs": 15_000, "compactMs": 300_000, "checkpointFreshMs": 600_000},
    "models": {"qwen*": {"prune": {"enter": 0.55, "exit": 0.45}, "compact": {"enter": 0.78, "exit": 0.68}}},
}
_PAIRS = ("prune", "checkpoint", "compact")


def merged(base: Any, over: Any) -> Any:
    """``over`` on ``base``: objects key by key, anything else replaced; None leaves the base."""
    if over is None:
        return copy.deepcopy(base)
    if isinstance(base, dict) and isinstance(over, dict):
        return {k: merged(base.get(k), over.get(k)) for k in [*base, *(k for k in over if k not in base)]}
    return copy.deepcopy(over)


def _number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and not math.isnan(x)


def _share(x: Any) -> bool:
    return _number(x) and 0 <= x <= 2


def threshold_pair(value: Any, default: dict) -> tuple[dict, str | None]:
    """(enter, exit) of a setting, and whether it was migrated or sanitised. A missing exit lies 0.1 below enter."""
    below = lambda enter: max(0, round(enter - 0.1, 4))
    if _share(value):
        return {"enter": value, "exit": below(value)}, "migrated"
    if isinstance(value, dict):
        enter = value["enter"] if _share(value.get("enter")) else default["enter"]
        bad = not _number(value.get("enter")) or value.get("exit") is not None and not _number(value["exit"])
        return {"enter": enter, "exit": value["exit"] if _share(value.get("exit")) else below(enter)}, "sanitized" if bad else None
    return dict(default), "sanitized"


def handoff_threshold(value: Any, default: dict) -> tuple[dict, str | None]:
    if _share(value):
        return {"enter": value}, "migrated"
    if isinstance(value, dict) and _share(value.get("enter")):
        return {"enter": value["enter"]}, None
    return dict(default), "sanitized"


def sanitized(raw: Any) -> tuple[dict, list[dict]]:
    """A usable configuration from any input, and events that say what was changed."""
    config, events = merged(DEFAULTS, raw if isinstance(raw, dict) else {}), []
    given = raw.get("thresholds") if isinstance(raw, dict) and isinstance(raw.get("thresholds"), dict) else {}
    found = {k: threshold_pair(given.get(k), DEFAULTS["thresholds"][k]) for k in _PAIRS} | {"handoff": handoff_threshold(given.get("handoff"), DEFAULTS["thresholds"]["handoff"])}
    config["thresholds"] = {k: v for k, (v, _) in found.items()}
    notes = {note for _, note in found.values()}
    if "migrated" in notes:
        events.append({"action": "config_migrated", "thresholds": config["thresholds"]})
    if "sanitized" in notes:
        events.append({"action": "config_sanitized", "reason": "invalid_threshold_value"})
    at_least = lambda low: lambda x: _number(x) and x >= low
    rules = [
        ("policy", "reclaimableMin", at_least(0)),
        ("policy", "maxActionsPer10Turns", at_least(1)),
        ("checkpoint", "backoffMs", lambda x: isinstance(x, list) and all(_number(v) and v > 0 for v in x)),
        ("checkpoint", "maxFailStreak", at_least(1)),
        ("checkpoint", "maxPerSession", at_least(1)),
        ("prune", "bands", lambda x: isinstance(x, list) and len(x) > 0),
    ]
    for section, key, good in rules:
        if not isinstance(config.get(section), dict):
            config[section] = copy.deepcopy(DEFAULTS[section])
        if not good(config[section].get(key)):
            fallback = copy.deepcopy(DEFAULTS[section][key])
            events.append({"action": "config_sanitized", "field": f"{section}.{key}", "fallback": fallback})
            config[section][key] = fallback
    return config, events


def loaded(spark: SparkSession, *paths: str) -> dict:
    """Defaults under the JSON files at ``paths``, later ones on top; files that are missing or broken count as absent."""
    raw: dict = {}
    for path in paths:
        try:
            text = spark.read.text(path, wholetext=True).first()
            value = json.loads(text[0]) if text else None
        except Exception:  # a bad file must not stop the engine
            value = None
        if isinstance(value, dict):
            raw = merged(raw, value)
    return sanitized(raw)[0]


#: Names a configuration file over all others.
CONFIG_VARIABLE = "THREADLOOM_CONFIG"


def layered(spark: SparkSession, user: str | None = None, project: str | None = None) -> dict:
    """Defaults, then the user's file, the project's, and the one that the environment names."""
    return loaded(spark, *(p for p in (user, project, os.environ.get(CONFIG_VARIABLE)) if p))


def glob_pattern(pattern: str) -> str:
    """A regular expression for a whole model name: * stands for anything, ? for one character; case counts."""
    return "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern) + r"\Z"


def specificity(pattern: str) -> tuple[int, int, int]:
    """Exact names first, then the longest literal beginning, then the longest pattern; a lone * last."""
    wild = re.search(r"[*?]", pattern)
    if wild is None:
        return 3, len(pattern), len(pattern)
    return (1 if pattern == "*" else 2), wild.start() if pattern != "*" else 0, len(pattern)


def model_rules(config: dict) -> list[tuple[str, dict]]:
    """Patterns and overrides, the least specific first; of equals the later one first, so that the earlier one wins."""
    return sorted(reversed(list((config.get("models") or {}).items())), key=lambda kv: specificity(kv[0]))


def thresholds_for(config: dict, model: str | None) -> dict:
    """Thresholds and reclaimableMin for "provider/id": each matching rule's fields in turn, the most specific last."""
    out = copy.deepcopy(config["thresholds"]) | {"reclaimableMin": config["policy"]["reclaimableMin"]}
    for pattern, over in model_rules(config) if model else []:
        if pattern == model or re.match(glob_pattern(pattern), model):
            for k in _PAIRS:
                if over.get(k) is not None:
                    out[k] = threshold_pair(over[k], out[k])[0]
            if over.get("handoff") is not None:
                out["handoff"] = handoff_threshold(over["handoff"], out["handoff"])[0]
            if _number(over.get("reclaimableMin")) and over["reclaimableMin"] >= 0:
                out["reclaimableMin"] = over["reclaimableMin"]
    return out


THRESHOLD_COLUMNS = ("prune_enter", "prune_exit", "checkpoint_enter", "checkpoint_exit", "compact_enter", "compact_exit", "handoff_enter", "reclaimable_min")


def with_thresholds(rows: DataFrame, config: dict, model: str = "model") -> DataFrame:
    """``rows`` with the thresholds of each one's model: a CASE per field over the rules, which are a driver-side setting and few."""
    rules = [(p, glob_pattern(p), o) for p, o in model_rules(config)]
    base = config["thresholds"]
    cols = {f"{k}_{e}": F.lit(float(base[k][e])) for k in _PAIRS for e in ("enter", "exit")} | {"handoff_enter": F.lit(float(base["handoff"]["enter"])), "reclaimable_min": F.lit(float(config["policy"]["reclaimableMin"]))}
    for pattern, regex, over in rules:
        hit = F.coalesce((F.col(model) == pattern) | F.col(model).rlike(regex.replace(r"\Z", r"\z")), F.lit(False))
        new: dict = {}
        for k in _PAIRS:
            if over.get(k) is not None:
                value = over[k]
                enter = value if _share(value) else value.get("enter") if isinstance(value, dict) and _share(value.get("enter")) else None
                exit_ = value.get("exit") if isinstance(value, dict) and _share(value.get("exit")) else None
                new[f"{k}_enter"] = F.lit(float(enter)) if enter is not None else cols[f"{k}_enter"]
                new[f"{k}_exit"] = F.lit(float(exit_)) if exit_ is not None else F.greatest(F.lit(0.0), F.round(new[f"{k}_enter"] - 0.1, 4)) if enter is not None or isinstance(value, dict) else cols[f"{k}_exit"]
        if over.get("handoff") is not None:
            new["handoff_enter"] = F.lit(float(handoff_threshold(over["handoff"], base["handoff"])[0]["enter"]))
        if _number(over.get("reclaimableMin")) and over["reclaimableMin"] >= 0:
            new["reclaimable_min"] = F.lit(float(over["reclaimableMin"]))
        cols |= {k: F.when(hit, v).otherwise(cols[k]) for k, v in new.items()}
    return rows.withColumns(cols)


def prune_band(config: dict, pressure, manual: bool = False):
    """(stub_min, max_chars) columns of the first band that a pressure reaches; manual: of the most aggressive."""
    bands = sorted(config["prune"]["bands"], key=lambda b: -b["pressureGte"])
    if manual:
        return F.lit(bands[0]["stubMinTokens"]), F.lit(bands[0]["foldMaxChars"])
    out = []
    for key in ("stubMinTokens", "foldMaxChars"):
        col = F.when(pressure >= bands[0]["pressureGte"], bands[0][key])
        for b in bands[1:]:
            col = col.when(pressure >= b["pressureGte"], b[key])
        out.append(col.otherwise(config["limits"][key]))
    return tuple(out)
