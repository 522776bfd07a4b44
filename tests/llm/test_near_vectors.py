import numpy as np

from threadloom.llm import near_vectors as nv

SCHEMA = "vec_id long, embedding array<float>, label int, node long, m string"


def brute(rows):
    good = [(i, np.array(v, np.float32).astype(float), g) for i, v, g in rows if v and g is not None and i is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, label = {i: 0 for i, _, _ in rows}, {i: i for i, _, _ in rows}
    find = lambda x: x if label[x] == x else find(label[x])
    for k, (a, x, g) in enumerate(good):
        for b, y, h in good[:k]:
            if g == h and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98:
                links[a] += 1
                links[b] += 1
                lo, hi = sorted((find(a), find(b)))
                label[hi] = lo
    return sorted((i, links[i], find(i), find(i) == i) for i in links)


def test_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for label in range(3):
        for _ in range(12):
            base = rng.standard_normal(24)
            for _ in range(rng.integers(1, 7)):
                rows.append([*(base + rng.standard_normal(24) * rng.choice([0, 0.1, 0.18, 0.4]))] + [label])
    hot = rng.standard_normal(24)
    rows += [[*(hot + 0.12 * rng.standard_normal(24)), 1] for _ in range(300)] + [[*hot, 1]] * 30 + [[*hot, 2]] * 3
    rows = [(i, [float(np.float32(x)) for x in r[:-1]], int(r[-1])) for i, r in enumerate(rows)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * 24, 1), (n + 3, [float("nan")] * 24, 1), (n + 4, [1.0, None], 1), (n + 5, rows[0][1], None), (n + 6, [float("inf")] + [0.0] * 23, 1), (n + 7, [1e-30] * 24, 1), (n + 8, [1e30] * 24, 1)]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], SCHEMA)
    assert sorted(map(tuple, nv.near_vectors(df).collect())) == brute(rows)


def test_estimates_are_unbiased_and_bounds_hold():
    rng = np.random.default_rng(0)
    dim, n = 64, 400
    v = nv._unit(rng.standard_normal((n, dim)) + 0.6)
    code, factors, small, step = nv.encoded(v)
    above = nv.upper_bounds(code, factors, small, step, dim)
    off = ~np.eye(n, dtype=bool)
    assert (above >= v @ v.T)[off].all()
    spread = np.sqrt((1 / factors**2 - 1).sum(axis=1)) / nv.ROTATIONS * nv.EPSILON / np.sqrt(dim - 1)
    rounding = (1 / factors).mean(axis=1)[:, None] * np.sqrt(dim) / 2 * step[None, :]
    error = (above - spread[:, None] - rounding - v @ v.T)[off]
    assert abs(error.mean()) < 0.003 and error.std() * nv.EPSILON < 1.5 * spread.mean() and spread.mean() < 0.6 / np.sqrt(nv.ROTATIONS)


def test_ids_that_repeat(spark):
    """Vectors of one id count their own links and share its component."""
    x, y, far = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    near = [1.0, 0.05, 0.0]
    rows = [(5, x, 1), (5, y, 1), (6, x, 1), (7, near, 1), (8, [0.05, 1.0, 0.0], 1), (9, far, 1), (3, far, 2), (5, far, 1)]
    df = spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA)
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in nv.near_vectors(df).collect())
    assert got == sorted([(5, 2, 5), (5, 1, 5), (6, 2, 5), (7, 2, 5), (8, 1, 5), (9, 1, 5), (3, 0, 3), (5, 1, 5)])


def test_no_rows(spark):
    assert nv.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_vector_on_a_third_of_the_rows(spark):
    """Copies of one vector spread over tasks and all link to each other."""
    from threadloom.llm import near_vectors as nv

    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in (np.ones(16) if i % 3 == 0 else rng.standard_normal(16))], i % 2) for i in range(1800)]
    got = {r.vec_id: r for r in nv.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label long").repartition(6)).collect()}
    assert len(got) == 1800
    for i in range(0, 1800, 3):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (299, i % 2 * 3, i == i % 2 * 3)
