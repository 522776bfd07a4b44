"""Configuration: layers, sanitising, migration, globs; by model in Python and as columns."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from threadloom.plans import config as cfg


def enter(config, model, key="prune"):
    return cfg.thresholds_for(config, model)[key]["enter"]


def test_flat_thresholds_become_pairs():
    config, events = cfg.sanitized({"thresholds": {"prune": 0.60, "checkpoint": 0.75, "compact": 0.85, "handoff": 0.92}})
    t = config["thresholds"]
    assert (t["prune"], t["checkpoint"], t["compact"], t["handoff"]) == ({"enter": 0.6, "exit": 0.5}, {"enter": 0.75, "exit": 0.65}, {"enter": 0.85, "exit": 0.75}, {"enter": 0.92})
    assert [e["action"] for e in events if "thresholds" in e] == ["config_migrated"]


def test_bad_values_fall_back():
    config, events = cfg.sanitized({"thresholds": {"prune": "high", "compact": {"enter": 9}, "checkpoint": {"enter": 0.7}}, "policy": {"reclaimableMin": -1, "maxActionsPer10Turns": 0}, "checkpoint": {"backoffMs": ["x"], "maxFailStreak": 0, "maxPerSession": None}, "prune": {"bands": []}})
    d = cfg.DEFAULTS
    assert config["thresholds"]["prune"] == d["thresholds"]["prune"] and config["thresholds"]["compact"]["enter"] == d["thresholds"]["compact"]["enter"]
    assert config["thresholds"]["checkpoint"] == {"enter": 0.7, "exit": 0.6}
    assert config["policy"]["reclaimableMin"] == 5000 and config["policy"]["maxActionsPer10Turns"] == 3 and config["checkpoint"]["backoffMs"] == [30_000, 60_000, 120_000] and config["prune"]["bands"] == d["prune"]["bands"]
    fields = {e.get("field") for e in events}
    assert {"policy.reclaimableMin", "policy.maxActionsPer10Turns", "checkpoint.backoffMs", "checkpoint.maxFailStreak", "prune.bands"} <= fields
    for raw in (None, 7, [], {"policy": 3, "thresholds": []}):
        assert cfg.sanitized(raw)[0]["thresholds"] == d["thresholds"]
    assert d == json.loads(json.dumps(d))  # nothing above has changed it


def test_layers(spark, tmp_path, monkeypatch):
    write = lambda name, text: (tmp_path / name).write_text(text) and f"file://{tmp_path}/{name}"
    user, project, env = write("u.json", '{"enabled": false, "policy": {"reclaimableMin": 1, "x": 1}}'), write("p.json", '{"policy": {"reclaimableMin": 2}}'), write("e.json", '{"pressure": {"green": 0.5}}')
    broken = write("b.json", "{nope")
    monkeypatch.delenv(cfg.CONFIG_VARIABLE, raising=False)
    config = cfg.layered(spark, user, project)
    assert config["enabled"] is False and config["policy"]["reclaimableMin"] == 2 and config["policy"]["x"] == 1 and config["pressure"]["green"] == 0.55
    monkeypatch.setenv(cfg.CONFIG_VARIABLE, env)
    assert cfg.layered(spark, user, project)["pressure"] == cfg.DEFAULTS["pressure"] | {"green": 0.5}
    assert cfg.layered(spark, broken, f"file://{tmp_path}/missing.json")["policy"] == cfg.DEFAULTS["policy"]


def test_the_most_specific_pattern_wins():
    config, _ = cfg.sanitized({"models": {"*": {"prune": 0.5}, "qwen*": {"prune": 0.6}, "qwen/qwen3-coder": {"prune": 0.7}, "gpt-?/x": {"prune": 0.3, "compact": 0.7}, "q?en/*": {"checkpoint": 0.4}}})
    assert enter(config, "qwen/qwen3-coder") == 0.7 and enter(config, "qwen/qwen2") == 0.6 and enter(config, "other/x") == 0.5
    assert enter(config, "gpt-4/x") == 0.3 and enter(config, "gpt-4/x", "compact") == 0.7 and enter(config, "gpt-44/x") == 0.5
    assert enter(config, "QWEN/x") == 0.5, "case counts"
    assert enter(config, "qwen/x", "checkpoint") == 0.4 and enter(config, None) == 0.65
    assert enter(config, "a.b/x") == 0.5 and cfg.specificity("openai/gpt-4o") > cfg.specificity("openai/*") > cfg.specificity("*")
    assert [p for p, _ in cfg.model_rules({"models": {"*": {}, "a/b": {}, "a/*": {}}})] == ["*", "a/*", "a/b"]


def test_least_reclaimable_by_model():
    config, _ = cfg.sanitized({"models": {"qwen*": {"reclaimableMin": 1234}, "bad": {"reclaimableMin": -4}}})
    assert [cfg.thresholds_for(config, m)["reclaimableMin"] for m in ("qwen/a", "other/b", None, "bad")] == [1234, 5000, 5000, 5000]


def test_columns_agree(spark):
    config, _ = cfg.sanitized({"models": {"*": {"prune": 0.5}, "qwen*": {"prune": {"enter": 0.6}, "handoff": 0.9}, "q?en/x.y": {"compact": {"enter": 0.7, "exit": 0.1}, "reclaimableMin": 9}}})
    models = ["qwen/x.y", "qwen/xzy", "Qwen/x.y", "other", None]
    rows = cfg.with_thresholds(spark.createDataFrame([(m,) for m in models], "model string"), config).collect()
    for r in rows:
        t = cfg.thresholds_for(config, r.model)
        want = {f"{k}_{e}": t[k][e] for k in ("prune", "checkpoint", "compact") for e in ("enter", "exit")} | {"handoff_enter": t["handoff"]["enter"], "reclaimable_min": t["reclaimableMin"]}
        assert {c: r[c] for c in want} == want, r.model


def test_bands_of_pruning(spark):
    rows = spark.createDataFrame([(0.3,), (0.8,), (0.88,), (0.95,)], "p double").select(*(c.alias(n) for c, n in zip(cfg.prune_band(cfg.DEFAULTS, F.col("p")), "ab"))).collect()
    assert [tuple(r) for r in rows] == [(50, 2200), (30, 1600), (20, 1200), (20, 1200)]
    manual = spark.range(1).select(*(c.alias(n) for c, n in zip(cfg.prune_band(cfg.DEFAULTS, F.lit(0.1), manual=True), "ab"))).first()
    assert tuple(manual) == (20, 1200)
