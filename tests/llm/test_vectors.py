"""Whitening and nearest neighbours against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidemark.llm import neighbours, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x long, uid long, n string, component int, vector string"


@pytest.fixture
def table(spark):
    return lambda rows: spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, 2, 3, "n", 4, "v") for i, v in rows], SCHEMA).repartition(3)


def kept(rows, zero=True):
    size = max((len(v) for _, v in rows if v is not None), default=0)
    out = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v is not None and len(v) == size and None not in v]
    return [(i, v) for i, v in out if len(v) and np.isfinite(v).all() and (zero or v.any())]


def numpy_whitening(rows, most=16):
    good = kept(rows)
    x = [tuple(int(c) + 1_000_000 for c in np.floor(64 * v)) for _, v in good]
    fit = np.array(sorted(set(x)), object)
    n, sums = len(fit), fit.sum(0)
    centred = (fit - sums / n).astype(float)
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values)[:most]
    return n, [(i, sum((n * c - s) ** 2 for c, s in zip(y, sums, strict=True)), (np.array(y, float) - (sums / n).astype(float)) @ vectors[:, order] / np.sqrt(values[order])) for (i, _), y in zip(good, x, strict=True)], values[order] / np.trace(v)


def check_whitening(got, rows, most=16):
    n, wanted, shares = numpy_whitening(rows, most)
    by = {}
    for r in got:
        by.setdefault((str(r.vec_id), r.deviation), []).append(r)
        assert r.n == n and 0 <= r.identity_error < 1e-9
    assert len(got) == len(wanted) * len(shares)
    signs = {}
    for i, deviation, white in wanted:
        found = by[str(i), deviation]
        for k, w in enumerate(white, 1):
            mine = [r for r in found if r.component == k]
            assert all(abs(r.explained / shares[k - 1] - 1) < 1e-9 for r in mine)
            if abs(w) > 1e-3:
                sign = signs.setdefault(k, np.sign(mine[0].whitened * w))
                assert all(abs(r.whitened - sign * w) < 1e-8 for r in mine)


def test_whitening(table):
    random = np.random.default_rng(3)
    rows = [(k, v) for k, v in enumerate(random.normal(0, 1, (80, 6)) * [5, 4, 3, 2, 1, 0.5])]
    rows += [(5, rows[5][1]), (None, rows[7][1]), (7, rows[7][1])] * 30  # copies weigh nothing
    rows += [(900, None), (901, []), (902, [1, 2, None, 4, 5, 6]), (903, [float("nan")] * 6), (904, [float("inf")] + [0] * 5), (905, [1, 2]), (906, [0] * 6)]
    check_whitening(whitening.whiten(table(rows)).collect(), rows)
    check_whitening(whitening.whiten(table(rows), components=2).collect(), rows, 2)


def test_whitening_of_wide_vectors(table, monkeypatch):
    random = np.random.default_rng(4)
    rows = [(k, v) for k, v in enumerate(random.normal(0, 1, (60, 24)) * np.linspace(3, 1, 24))]
    monkeypatch.setattr(whitening, "MAX_SUMS", 50)  # several scans
    check_whitening(whitening.whiten(table(rows)).collect(), rows)


def test_whitening_without_spread(table):
    assert whitening.whiten(table([])).collect() == []
    assert whitening.whiten(table([(1, None), (2, [])])).collect() == []
    assert whitening.whiten(table([(1, [1, 2]), (2, [1, 2])])).collect() == []
    line = whitening.whiten(table([(k, [k, 2 * k, 0]) for k in range(9)])).collect()
    assert {r.component for r in line} == {1} and len(line) == 9 and all(abs(r.explained - 1) < 1e-12 for r in line)
    huge = whitening.whiten(table([(1, [1e37, 0]), (2, [-1e37, 1]), (3, [0, 5])])).collect()
    assert {(r.vec_id, r.deviation) for r in huge} == {(1, None), (2, None), (3, 331776)} and all(np.isfinite(r.whitened) for r in huge)


def brute_nearest(rows, is_query, k):
    good, out = kept(rows, zero=False), []
    for a, (i, v) in enumerate(good):
        if i is None or not is_query(i):
            continue
        near = []
        for b, (j, w) in enumerate(good):
            if a != b:
                total = 0.0
                for x, y in zip(v.tolist(), w.tolist(), strict=True):
                    total += (x - y) * (x - y)
                near.append((total**0.5, j is None, j or 0))
        out += [(i, n, None if none else j, d) for n, (d, none, j) in enumerate(sorted(near)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("block", "strip"), [(32768, 64), (3, 2)])
def test_nearest(table, monkeypatch, block, strip):
    monkeypatch.setattr(neighbours, "TILE_QUERIES", 4)
    random = np.random.default_rng(6)
    rows = [(k, v) for k, v in enumerate(random.normal(0, 1, (150, 8)))]
    rows += [(k, rows[20][1]) for k in range(200, 260)]  # one vector, many ids
    rows += [(k, rows[30][1] + random.normal(0, 1e-4, 8)) for k in range(300, 360)]  # too near for eight bits
    rows += [(20, rows[20][1]), (40, rows[3][1]), (None, rows[20][1]), (None, rows[4][1]), (-10, rows[5][1] * 1e30), (-20, rows[5][1] * 1e-30)]
    rows += [(900, None), (910, []), (920, [0] * 8), (930, [None] * 8), (940, [float("nan")] * 8), (950, [1, 2]), (960, [-0.0] * 8)]
    got = neighbours.nearest(table(rows), F.pmod("vec_id", F.lit(10)) == 0, 4, query_block=block, strip_rows=strip).collect()
    assert sorted(map(tuple, got), key=str) == brute_nearest(rows, lambda i: i % 10 == 0, 4)


def test_nearest_of_few(table):
    near = lambda rows: sorted(map(tuple, neighbours.nearest(table(rows), F.pmod("vec_id", F.lit(10)) == 0, 5).collect()), key=str)
    assert near([]) == [] and near([(0, [1.0])]) == [] and near([(1, [1.0]), (2, [2.0])]) == []
    assert near([(0, [1.0]), (1, [3.0]), (0, [1.0])]) == [(0, 1, 0, 0.0), (0, 1, 0, 0.0), (0, 2, 1, 2.0), (0, 2, 1, 2.0)]


def test_copies_are_limited_ahead(table):
    plan = neighbours.nearest(table([(k, [1.0, k % 3]) for k in range(50)]), F.pmod("vec_id", F.lit(10)) == 0)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_bounds_hold():
    random = np.random.default_rng(8)
    x, y = random.normal(0, 1, (50, 2100)), random.normal(0, 3, (60, 2100))
    a, sa, na, la = neighbours.quantise(x)
    b, sb, nb, lb = neighbours.quantise(y)
    products = neighbours.tile_products(a, b)
    assert (products == a.astype(np.int64) @ b.astype(np.int64).T).all()
    near = np.sqrt(na[:, None] + nb - 2 * sa[:, None] * sb * products)
    true = np.sqrt(((x[:, None] - y) ** 2).sum(2))
    assert (np.abs(near - true) <= la[:, None] + lb).all()
