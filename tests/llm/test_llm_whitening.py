"""Whitening against whole-number covariances of plain Python and numpy's eigenvectors."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from graphloom.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, x string, n int, dim int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [(k, [rng.gauss(0, 0.1 * (j + 1)) for j in range(10)], "x", 1, 2) for k in range(300)]
    out += [(400 + k, [0.25 * k, -0.5 * k, 1.0], None, None, None) for k in range(9)]  # one line: a single component
    out += [(500, [1.0] * 5, None, None, None), (501, [], None, None, None), (502, None, None, None, None)]
    out += [(503, [1.0, None], "", 1, 1), (504, [math.nan] * 10, "", 1, 1), (505, [math.inf, 0.0], "", 1, 1), (506, [1e30, 0.0], "", 1, 1)]
    return out + [(None, out[0][1], "x", 1, 2), out[1], out[1]]


def whole(v):
    return [math.floor(1024 * float(np.float32(c))) + 100000 for c in v]


def test_whitened(spark, rows):
    got = W.whitened(spark.createDataFrame(rows, SCHEMA)).collect()
    for dim, components in ((10, 8), (3, 1)):
        own = [(i, whole(v)) for i, v, *_ in rows if v is not None and len(v) == dim and all(c is not None and abs(c) < 1e9 for c in v)]
        n = len(own)
        sums = [sum(x[j] for _, x in own) for j in range(dim)]
        cov = [[sum(Fraction(a[i]) * a[j] for _, a in own) / n - Fraction(sums[i]) * sums[j] / n**2 for j in range(dim)] for i in range(dim)]
        values, vectors = np.linalg.eigh(np.array(cov, float))
        found = [r for r in got if r.n == n]
        assert len(found) == n * components
        for c in range(components):
            e, v = values[-1 - c], vectors[:, -1 - c]
            plain = sorted((float((np.array(x) - np.array(sums) / n) @ v / math.sqrt(e)), sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))) for _, x in own)
            mine = [r for r in found if r.component == c + 1]
            sign = 1 if np.allclose(sorted(r.whitened for r in mine), [p[0] for p in plain], atol=1e-8) else -1
            assert np.allclose(sorted(sign * r.whitened for r in mine), [p[0] for p in plain], atol=1e-8)
            assert sorted(r.deviation for r in mine) == sorted(p[1] for p in plain)
            assert all(math.isclose(r.explained, e / float(sum(cov[k][k] for k in range(dim))), rel_tol=1e-9) for r in mine)
        assert max(r.identity_error for r in found) < 1e-9 and len({r.identity_error for r in found}) == 1
    assert len(got) == 8 * 303 + 9


def test_scatter_is_exact(spark):
    rng = random.Random(1)
    rows = [[rng.randrange(-(1 << 61), 1 << 61) for _ in range(4)] for _ in range(37)]
    n, sums, products = W.scatter(spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "vec_id long, x array<long>"))[4]
    assert (n, sums) == (37, [sum(r[j] for r in rows) for j in range(4)])
    assert products == [[sum(r[i] * r[j] for r in rows) for j in range(4)] for i in range(4)]


def test_deviations_beyond_longs():
    f = W.Fit(3, [30, 3], np.ones(2), np.eye(2), 2.0)
    assert W.deviations(np.array([[10, 1], [11, 1]]), f) == [0, 9]
    assert W.deviations(np.array([[10 + (1 << 40), 1], [10, 1 - (1 << 29)]]), f) == [None, 9 << 58] if 9 << 58 < W.LONG else [None, None]


def test_none(spark):
    assert W.whitened(spark.createDataFrame([], SCHEMA)).count() == 0
    assert W.whitened(spark.createDataFrame([(1, [0.5, 1.0], "", 1, 1)] * 3, SCHEMA)).count() == 0
