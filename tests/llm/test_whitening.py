"""Whitening against the covariance's eigenvectors, with exact integers for counts and deviations."""

import math

import numpy as np
import pytest
from colloquy.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, n string, component string, x string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "was", "here", "x") for i, v in rows], SCHEMA)


def wanted(rows):
    """Kept rows with x, and the distinct vectors."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(v) for _, v in kept), default=0)
    kept = [(i, tuple(math.floor(64 * float(np.float32(c))) + 1000000 for c in v) + (1000000,) * (width - len(v))) for i, v in kept]
    return kept, sorted({x for _, x in kept})


def check(spark, rows, directions, **options):
    kept, distinct = wanted(rows)
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    x = np.array(distinct, float) - np.array([s / n for s in sums])
    values, vectors = np.linalg.eigh(x.T @ x / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    found = W.whitened(frame(spark, rows), **options).collect()
    assert len(found) == directions * len(kept)
    for r in found:
        row = dict(kept)[r.vec_id]
        c = r.component - 1
        assert (r.n, r.deviation) == (n, sum((n * v - s) ** 2 for v, s in zip(row, sums)))
        assert r.explained == pytest.approx(values[c] / values.sum(), rel=1e-9) and r.identity_error < 1e-9
        plain = (np.array(row) - np.array([s / n for s in sums])) @ vectors[:, c] / math.sqrt(values[c])
        assert abs(r.whitened) == pytest.approx(abs(plain), abs=1e-7)
    for c in range(directions):
        seen = {kept_x: next(r.whitened for r in found if r.vec_id == i and r.component == c + 1) for i, kept_x in kept}
        plain = x @ vectors[:, c] / math.sqrt(values[c])
        assert abs(np.dot([seen[d] for d in distinct], plain) / n) == pytest.approx(1, abs=1e-9)


@pytest.fixture
def rows():
    rng = np.random.default_rng(8)
    base = rng.normal(size=(120, 6)) * [5, 3, 2, 1, 0.5, 0.3]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(200 + i, rows[0][1]) for i in range(60)]
    return rows + [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (303, [float("inf")] + [0.0] * 5), (304, [-0.0] * 6)]


def test_whitening(spark, rows):
    check(spark, rows, 6)
    check(spark, rows, 2, components=2)


def test_messages_are_added_in_strips_and_rounds(spark, rows, monkeypatch):
    monkeypatch.setattr(W, "STRIP", 4)
    monkeypatch.setattr(W, "FAN_IN", 2)
    kept, distinct = wanted(rows)
    made = spark.createDataFrame([(list(d),) for d in distinct], "x array<long>").repartition(7)
    centre = W.centre_of(made, 6)
    x = np.array(distinct) - centre.whole - centre.rest
    assert centre.n == len(distinct) and centre.sums == [sum(c) for c in zip(*distinct)]
    assert np.allclose(W.gram_of(made, 6, centre, np.eye(6)), x.T @ x, rtol=1e-12)


def test_columns_that_are_constant_or_depend_on_others_give_no_component(spark):
    rng = np.random.default_rng(9)
    a = rng.integers(-300, 300, (80, 2))
    rows = [(i, [float(p) / 64, float(q) / 64, float(p + q) / 64, 2.0]) for i, (p, q) in enumerate(a)]
    check(spark, rows, 2)


def test_badly_scaled_rows(spark):
    rng = np.random.default_rng(10)
    a = rng.normal(size=(200, 1)) * 1000
    rows = [(i, [float(v + w) for v, w in zip([p, p, p], rng.normal(size=3) * [0.1, 0.2, 0.4])]) for i, (p,) in enumerate(a)]
    check(spark, rows, 3)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_that_varies_gives_no_rows(spark, rows):
    assert W.whitened(frame(spark, rows)).collect() == []


def test_shorter_vectors_are_filled_up_and_large_entries_kept(spark):
    check(spark, [(1, [1.0, 2.0, 3.0]), (2, [1.0]), (3, [0.5, -1.0]), (4, []), (5, [3.0, 0.0, 1.0])], 3)
    big = W.whitened(frame(spark, [(1, [1e12]), (2, [-1e12]), (3, [3.0])])).collect()
    assert [r.deviation for r in sorted(big, key=lambda r: r.vec_id)][:2] == [None, None]
