import pytest

from threadloom.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, row int, copies int"


def reshared(sizes):
    """Targets by repeated resharing of what stands above a cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(2 * sizes[s] for s in capped)
        out = {s: 2.0 * sizes[s] for s in capped} | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if out[s] > 2 * sizes[s]}
        if not above:
            return out
        capped |= above


def docs_of(spark):
    rows = [(i, "w " * (1 + i % 40), f"s{i % 7}" if i % 3 else "s0", "x", 1, 2) for i in range(600)]
    rows += [(None, "a b", None, None, None, None), (9007, None, None, None, None, None), (9008, "", "empty", None, None, None), (601, "x " * 5000, "s6", None, None, None)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_targets_and_copies(spark):
    rows, docs = docs_of(spark)
    sizes = {}
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + len((r[1] or "").split())
    want, source = reshared(sizes), {r[0]: r[2] for r in rows}
    got = mixing.plan(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id not in (None, 9007):
            assert r.target == pytest.approx(want[source[r.doc_id]])
        assert r.copies in (0, 1, 2) and r.taken == r.copies * r.size <= 2 * r.size
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.plan(docs.repartition(3)).collect()), key=str)
    emitted = mixing.mix(docs)
    assert emitted.columns == docs.columns and emitted.count() == sum(r.copies for r in got)


def test_without_rows_or_words(spark):
    assert mixing.plan(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    (row,) = mixing.plan(spark.createDataFrame([(1, " ", "a", None, None, None)], SCHEMA)).collect()
    assert (row.size, row.taken, row.target) == (0, 0, 0.0)


def test_plans_hold_no_python(spark):
    _, docs = docs_of(spark)
    for df in (mixing.plan(docs), mixing.mix(docs)):
        assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()


def test_many_sources_over_many_ranges(spark, monkeypatch):
    """Thousands of sources in several ranges, joined by a shuffle, get the targets that repeated resharing gives."""
    rows = [(i, "w " * (1 + i * 7919 % 50), f"host{i % 3001}" if i % 4 else "host0") for i in range(9000)] + [(9001, "a b c", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want, broadcast = reshared(sizes), {r.doc_id: tuple(r) for r in mixing.plan(docs).collect()}
    assert all(r[3] == pytest.approx(want[rows[i if i < 9000 else -1][2]]) for i, r in broadcast.items())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    monkeypatch.setattr("threadloom.llm._hot.HOT_KEYS", 10)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert {r.doc_id: tuple(r) for r in mixing.plan(docs).collect()} == broadcast
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_rows_of_one_id_and_equal_rows(spark):
    """One id on 1,000 rows, and 900 rows that are equal, each take what their source is given."""
    rows = [(7, f"word {i}", "a", None, None, None) for i in range(1000)] + [(9, "x y z", "b", None, None, None)] * 900
    rows += [(None, None, "c", None, None, None)] * 50 + [(i, "p q", "d", None, None, None) for i in range(10_000, 11_200)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = mixing.plan(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        x = by.setdefault((r.source_size, r.target), [0])
        x[0] += r.taken
        assert 0 <= r.copies <= 2
    for (size, target), (taken,) in by.items():
        assert abs(taken - target) <= max(6, 0.06 * target)
    equal = [r for r in got if r.doc_id == 9]
    assert abs(sum(r.taken for r in equal) - equal[0].target) <= 3
    mixed = mixing.mix(docs.repartition(3)).collect()
    assert sum(r.doc_id == 9 for r in mixed) == sum(r.copies for r in equal)
    assert sum(r.doc_id == 7 for r in mixed) == sum(r.copies for r in got if r.doc_id == 7)
