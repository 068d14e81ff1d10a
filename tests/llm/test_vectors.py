"""Hard negatives and whitening against plain versions on small tables."""

import itertools
import math

import compare
import numpy as np
import pytest
from conftest import SF

from haulcomp.llm import common
from haulcomp.llm import hardnegatives as H
from haulcomp.llm import whitening as W

DDL = "vec_id bigint, embedding array<float>, label int, q string, n string, low string, x string"
NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    return spark.createDataFrame([(i, v, y, "a", "b", "c", "d") for i, v, y in rows], DDL)


def some(n, d=5, seed=0, labels=3):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0.2, 0.5, d)], int(rng.integers(labels))) for i in range(n)]
    rows += [(i, rows[3][1], 1) for i in range(n, n + 30)]  # repeated vectors: ties
    rows += [(100, rows[5][1], 2), (100, rows[6][1], 0), (None, rows[7][1], 1), (None, rows[7][1], 2), (200, rows[8][1], None)]
    rows += [(900, None, 1), (901, [], 1), (902, [1.0, None, 0.0, 0.0, 0.0][:d], 1), (903, [NAN] * d, 1), (904, [INF] + [0.0] * (d - 1), 0)]
    return rows + [(1000, [0.0] * d, 0), (1100, [0.0] * d, 9), (14, [0.0] * d, 9)]


def usable(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


def plain_negatives(rows, every):
    kept = []
    for i, v, y in rows:
        if y is not None and usable(v):
            kept.append((i, [math.floor(256 * x) for x in v], (y + 1) % 10 if i is not None and i % 7 == 0 else y))
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for a, (i, q, y) in enumerate(kept):
        if i is None or i % every:
            continue
        scored = [(sum(p * r for p, r in zip(q, q2)), i2, y2 == y) for b, (i2, q2, y2) in enumerate(kept) if b != a]
        for ps, pid, _ in sorted((x for x in scored if x[2]), key=order)[:5]:
            inside = sorted((x for x in scored if not x[2] and 80 * ps <= 100 * x[0] <= 100 * ps), key=order)[:5]
            out += [(i, pid, rank, nid, ps, ns) for rank, (ns, nid, _) in enumerate(inside, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("block", "group"), [(4, 3), (16, 256), (1024, 256)])
def test_hard_negatives(spark, block, group):
    rows = some(200)
    df = H.mine(table(spark, rows), every=10, block=block, group=group).drop("p")
    cols = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = plain_negatives(rows, 10)
    assert len(want) > 200
    assert sorted(map(tuple, df.select(cols).collect()), key=str) == want


def test_bounds_hold_and_skip_blocks(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1, (12, 8))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 12] + rng.normal(0, 0.02, 8)], i % 3) for i in range(1200)]
    cand = H.candidates(table(spark, rows))
    blocks = H.write_blocks(cand, 8, 50)
    groups, zones = H.anchor_groups(blocks, 8, 100, 5), H.zone_groups(blocks)
    chosen = H.choose_blocks(groups, zones, 8).collect()
    read = sum(len(r.who) // 4 for r in chosen)
    own_label = sum(len(g.ids) for g in groups.collect() for b in blocks.collect() if b.label == g.label)
    assert 0 < read < own_label / 2
    for b in blocks.collect():
        q = np.frombuffer(b.entries, np.int32).reshape(-1, 8)
        a = rng.integers(-300, 300, (4, 8))
        lo, hi = H.bounds(a, np.frombuffer(b.low, np.int32)[None], np.frombuffer(b.high, np.int32)[None])
        assert ((a @ q.T >= lo) & (a @ q.T <= hi)).all()


@pytest.mark.parametrize(("d", "bits"), [(2, 1), (2, 4), (3, 2), (4, 2)])
def test_the_curve_goes_from_cell_to_neighbour(d, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=d)))
    keys = H.hilbert_keys(cells, bits)
    assert len(set(keys)) == len(cells)
    path = cells[sorted(range(len(cells)), key=lambda i: keys[i])]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_vectors_that_do_not_fit_are_refused(spark):
    for v in ([1.0, 2.0, 3.0], [1e9, 0.0]):
        bad = table(spark, [(0, [1.0, 2.0], 1), (1, v, 1)])
        with pytest.raises(ValueError):
            H.mine(bad)
        with pytest.raises(ValueError):
            W.fit(W.integers(bad))


def test_no_vectors(spark):
    for df in (table(spark, []), table(spark, [(0, None, 1), (100, [NAN], 2)])):
        assert H.mine(df).count() == 0
        assert W.fit(W.integers(df)) is None
    lonely = table(spark, [(0, [1.0], 1), (100, [1.0], 2)])
    assert H.mine(lonely).count() == 0


def plain_whitening(rows):
    kept = [(i, v) for i, v, _ in rows if usable(v)]
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in kept], np.int64)
    n, s = len(x), x.sum(axis=0)
    y = (n * x - s) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    return [i for i, _ in kept], n, ((n * x - s) ** 2).sum(axis=1), y, values[::-1], vectors[:, ::-1]


def test_whitening(spark):
    rows = some(300, 5, 3)
    ids, n, deviation, y, values, vectors = plain_whitening(rows)
    frame = W.integers(table(spark, rows))
    model = W.fit(frame)
    assert model.n == n
    np.testing.assert_allclose(model.values, values, rtol=1e-12)
    np.testing.assert_allclose(np.abs((model.vectors * vectors).sum(axis=0)), 1, rtol=1e-12)
    got = W.whiten(frame, model, 3).toPandas()
    assert len(got) == 3 * n and W.identity_error(frame, model, 3) < 1e-12
    for k in range(3):
        one = got[got.component == k + 1]
        ref = y @ vectors[:, k] / math.sqrt(values[k])
        ref = ref * np.sign(ref @ (y @ model.vectors[:, k]))
        left = sorted(zip([-1 if i is None else i for i in ids], np.round(ref, 9), deviation.tolist()))
        right = sorted(zip(one.vec_id.fillna(-1).astype(int), np.round(one.whitened, 9), one.deviation))
        np.testing.assert_allclose(np.array(left, float), np.array(right, float), atol=2e-9)
        np.testing.assert_allclose(one.explained, values[k] / values.sum(), rtol=1e-12)


def test_whitening_leaves_out_directions_without_spread(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 50, (80, 2)) / 64
    rows = [(i, [float(x), float(y), float(x + y), 1.0], 0) for i, (x, y) in enumerate(a)]
    frame = W.integers(table(spark, rows))
    model = W.fit(frame)
    assert len(model.values) == 2
    assert W.identity_error(frame, model) < 1e-9
    assert W.whiten(frame, model).count() == 160
    same = W.integers(table(spark, [(i, [0.5, 0.25], 0) for i in range(9)]))
    assert W.whiten(same, W.fit(same)).count() == 0
    assert W.identity_error(same, W.fit(same)) == 0.0


def test_small_eigenvalues_are_accurate():
    rng = np.random.default_rng(4)
    scale = 10.0 ** -np.arange(0, 12, 2)
    b = rng.normal(size=(6, 6))
    a = scale[:, None] * (b @ b.T) * scale
    order, low = W.pivoted_cholesky(a)
    g = W.jacobi(low)
    got = np.sort((g * g).sum(axis=0))[::-1]
    # One-sided rotations of the transposed factor have the same singular values.
    want = np.linalg.svd(scale[:, None] * b, compute_uv=False) ** 2
    np.testing.assert_allclose(got, want, rtol=1e-9)
    np.testing.assert_allclose((low @ low.T), a[np.ix_(order, order)], rtol=1e-12)


def test_deviation_is_exact_for_large_sums():
    model = W.Whitening(3_000_000, [3_000_000 * 5 + 1, 7], np.zeros(0), np.zeros((2, 0)), 0.0)
    x = np.array([[1005, 2], [5, 0]])
    assert model.deviation(x).tolist() == [(3_000_000 * a - 15_000_001) ** 2 + (3_000_000 * b - 7) ** 2 for a, b in x.tolist()]
    with pytest.raises(OverflowError):
        model.deviation(np.array([[100_000_000, 0]]))


def test_hard_negatives_equal_their_sql(spark):
    assert compare.check(spark, compare.connect(SF), "op12_hard_negatives", SF) is None


def test_whitening_query(spark):
    got = W.op13_whitening(spark, SF).toPandas()
    n = common.table(spark, SF, "embeddings").count()
    assert len(got) == 32 * n and (got.identity_error <= 1e-4).all() and (got.n == n).all()
