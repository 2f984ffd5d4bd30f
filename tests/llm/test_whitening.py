"""Whitening against numpy's eigenvectors and exact integers."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from atril.llm import queries, whitening

COLUMNS = "vec_id long, embedding array<float>, label int, z string, n long, component string"


def integers(rows):
    good = [(i, x) for i, x in rows if x is not None and all(c is not None and np.isfinite(c) for c in x)]
    return [i for i, _ in good], np.array([[int(np.floor(1024 * float(c))) + 100000 for c in x] for _, x in good], dtype=np.int64)


def check(got, rows, components=8):
    ids, x = integers(rows)
    n, s = len(x), x.sum(axis=0)
    centred = (n * x - s) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    kept = min(components, x.shape[1])
    deviation = [sum(int(m) ** 2 for m in row) for row in n * x.astype(object) - s]
    assert len(got) == n * kept and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1
    want = sorted(zip(ids, deviation, strict=True), key=repr)
    for k in range(1, kept + 1):
        part = sorted((r for r in got if r.component == k), key=lambda r: repr((r.vec_id, int(r.deviation))))
        assert [(r.vec_id, int(r.deviation)) for r in part] == want
        assert abs(part[0].explained - e[k - 1] / e.sum()) <= 1e-9
        if e[k - 1] <= 1e-9 * e[0]:
            continue
        order = sorted(range(n), key=lambda j: repr((ids[j], deviation[j])))
        z = np.array([r.whitened for r in part])
        right = (centred @ v[:, k - 1] / np.sqrt(e[k - 1]))[order]
        assert min(np.abs(z - right).max(), np.abs(z + right).max()) < 1e-8
    assert got[0].identity_error < 1e-9


def test_whiten(spark):
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(12, 12)) * np.linspace(3, 0.01, 12)
    rows = [(i, (rng.normal(size=12) @ mix).astype(np.float32).tolist()) for i in range(500)]
    rows += [(900, None), (901, [None] * 12), (902, [float("nan")] * 12), (903, [float("inf")] * 12), (None, rows[3][1]), rows[5], rows[5], (904, [0.0] * 12)]
    df = spark.createDataFrame([(*r, 1, "z", 2, "c") for r in rows], COLUMNS).repartition(70)  # two levels of merging
    check(whitening.whiten(df).collect(), rows)
    odd = df.unionByName(spark.createDataFrame([(7, [1.0, 2.0], 1, "z", 2, "c"), (8, [], 1, "z", 2, "c")], COLUMNS))
    check(whitening.whiten(odd).collect(), rows)  # other lengths are left out


def test_whiten_small_and_flat(spark):
    frame = lambda rows: spark.createDataFrame([(i, x, 1, "z", 2, "c") for i, x in rows], COLUMNS)
    assert whitening.whiten(frame([])).count() == 0
    assert whitening.whiten(frame([(1, None), (2, [])])).count() == 0
    got = whitening.whiten(frame([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(got) == 4 and {(r.whitened, r.deviation, r.explained, r.identity_error) for r in got} == {(None, 0, 0.0, None)}
    rows = [(i, [float(i), 2.0 * i, 5.0]) for i in range(9)]  # one direction only
    check(whitening.whiten(frame(rows)).collect(), rows)
    assert {r.whitened for r in whitening.whiten(frame(rows)).where("component > 1").collect()} == {None}
    huge = whitening.whiten(frame([(1, [1e9, 0.0]), (2, [-1e9, 1.0]), (3, [3e38, 2.0])])).collect()
    assert len(huge) == 6 and all(r.deviation > 0 for r in huge)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 20), st.integers(1, 40), st.integers(0, 4), st.integers(0, 10**6))
def test_directions(d, m, kind, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(m, d))
    if kind == 1:
        x *= 10.0 ** rng.integers(-9, 3, size=d)
    if kind == 2:
        x = np.round(x)
    if kind == 3:
        x = 3 * np.eye(d)
    if kind == 4:
        x[:, ::2] = 0
    sigma, v = whitening.directions(np.linalg.qr(np.vstack([x, np.zeros((d, d))]), "r"), 8)
    want = np.zeros(d)
    found = np.linalg.svd(x, compute_uv=False)
    want[: min(len(found), d)] = found[:d]
    top = max(want[0], 1e-300)
    assert np.abs(sigma - want).max() <= 1e-13 * top
    v = v[:, v.any(axis=0)]
    assert np.abs(v.T @ v - np.eye(v.shape[1])).max(initial=0) < 1e-11
    assert np.abs(x.T @ x @ v - v * sigma[: v.shape[1]] ** 2).max(initial=0) <= 1e-12 * top**2


def test_small_values_keep_their_digits():
    """Entries falling over 30 orders: the product of the values is that of the diagonal, to relative accuracy."""
    a = 10.0 ** -np.arange(0, 31, 2)
    sigma = whitening.dqds(a, 0.5 * a[:-1])
    assert np.prod(sigma / a) == pytest.approx(1, rel=1e-12)


def test_query(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{sf}/embeddings.parquet'").fetchall()
    got = queries.op13_whitening(spark, sf)
    assert dict(got.dtypes)["deviation"] == "bigint" and dict(got.dtypes)["component"] == "int"
    check(got.collect(), rows)
