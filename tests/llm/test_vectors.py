"""Hard negatives and whitening against brute force."""

import math

import numpy as np
import pytest

from ebbtide.llm import hard_negatives, whitening
from tests.llm.helpers import saved

SCHEMA = "vec_id long, embedding array<float>, label int, score double, x string, place long"


def vectors(spark, rows):
    return saved(spark.createDataFrame([(*r, 1.0, "x", 5) for r in rows], SCHEMA))


def brute_mined(rows, anchor, k=5, m=3, least=50, most=95):
    good = [(i, v, np.floor(256 * np.array(e, dtype=np.float32).astype(float)).astype(int), y) for i, (v, e, y) in enumerate(rows)
            if y is not None and e is not None and all(c is not None and math.isfinite(c) for c in e)]
    out = []
    last = lambda v: (v is None, v or 0)
    for i, v, x, y in good:
        if v is None or not anchor(v):
            continue
        scored = [(-int(x @ z), last(w), j, w, t) for j, w, z, t in good if j != i and len(z) == len(x)]
        for p in sorted(s for s in scored if s[4] == y)[:k]:
            inside = sorted(s for s in scored if s[4] != y and -least * p[0] <= -100 * s[0] <= -most * p[0])
            out += [(v, p[3], r, s[3], -p[0], -s[0]) for r, s in enumerate(inside[:m], 1)]
    return sorted(out, key=str)


def mined(df, anchor):
    return sorted((tuple(r) for r in hard_negatives.mine(df, anchor).collect()), key=str)


@pytest.mark.parametrize("blocks", [(1024, 16384, 2048), (7, 40, 13)])
def test_mined_rows_equal_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", blocks[0])
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", blocks[1])
    monkeypatch.setattr(hard_negatives, "LEAST_ROWS", blocks[1])
    monkeypatch.setattr(hard_negatives, "SLICE", blocks[2])
    rng = np.random.default_rng(3)
    # A third of the rows has one label; clustered, repeated, null, odd and shorter vectors; repeated ids.
    centres = rng.normal(size=(4, 16)).repeat(4, axis=1)[:, :18]
    rows = []
    for i in range(400):
        e = (centres[i % 4] + rng.normal(size=18) * (0.05 if i % 2 else 1)).tolist()
        rows.append((i, e, 0 if i % 3 == 0 else int(rng.integers(1, 4))))
    rows += [(10, rows[10][1], 0), (10, rows[10][1], 0), (None, rows[20][1], 1), (None, rows[20][1], 0), (500, None, 1),
             (510, [], 2), (511, [], 2), (520, [1.0] * 17 + [None], 2), (530, [float("nan")] * 18, 0), (540, [float("inf")] * 18, 0),
             (550, rows[0][1], None), (560, [0.0] * 18, 0), (570, [1.0, 2.0, -3.0], 0), (571, [1.0, 2.0, -2.0], 0), (572, [1.0, 1.0, -3.0], 1)]
    df = vectors(spark, rows)
    want = brute_mined(rows, lambda v: v % 10 == 0)
    assert len(want) > 100 and mined(df, df.vec_id % 10 == 0) == want


def test_mined_edges(spark):
    empty = vectors(spark, [])
    assert mined(empty, empty.vec_id % 10 == 0) == []
    alone = vectors(spark, [(0, [1.0, 1.0], 1), (1, [1.0, 0.5], 2)])
    assert mined(alone, alone.vec_id == 0) == []
    ties = vectors(spark, [(0, [1.0], 1), (1, [1.0], 1)] + [(k, [0.75], 2) for k in range(9, 2, -1)])
    assert [r[3] for r in mined(ties, ties.vec_id == 0)] == [3, 4, 5]


def test_bounds_hold_and_decide_pairs():
    rng = np.random.default_rng(5)
    x = np.floor(256 * (rng.normal(size=(300, 64)) * 0.05 + rng.normal(size=(300, 16)).repeat(4, axis=1))).astype(np.int64)
    n = np.arange(300)
    side = hard_negatives.Side(n, n, n % 3, x, hard_negatives.summaries(x))
    exact, widths = x @ x.T, []
    for level in range(len(side.levels)):
        least, most = hard_negatives._bounds(side, side, level, None)
        assert (least <= exact).all() and (exact <= most).all()
        widths.append((most - least).mean())
    assert widths[0] > widths[1] > widths[2]
    tally, edge = {}, np.full((300, 1), 2 ** 60)
    found = hard_negatives.best_in(side, side, -edge, edge, True, 5, tally)
    assert tally["exact"] < 300 * 100 / 4 and len(found[0]) == 1500


def brute_whitened(rows, k):
    good = [e for _, e, _ in rows if e and all(c is not None and math.isfinite(c) for c in e)]
    size = max(map(len, good))
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1000000 for c in e] for e in good if len(e) == size], dtype=float)
    c = x - x.mean(0)
    _, single, right = np.linalg.svd(c, full_matrices=False)
    e = single[single > 1e-12 * single[0]] ** 2 / len(c)
    return x, c @ right[:len(e)][:k].T / np.sqrt(e[:k]), e / (c * c).mean(0).sum()


@pytest.mark.parametrize("kind", ["plain", "short rank", "ill"])
def test_whitening_equals_eigenvectors(spark, kind):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 12)) * np.linspace(3, 0.3, 12)
    if kind == "short rank":
        x[:, 3], x[:, 7] = x[:, 2], 1.5
    if kind == "ill":
        x = x * 4.0 ** np.arange(0, -12, -1) * 1e4
    rows = [(i, e, 0) for i, e in enumerate(x.tolist())]
    odd = [(900, None, 1), (901, [], 1), (902, [1.0] * 11, 1), (903, [None] * 12, 1), (904, [float("nan")] * 12, 1), (905, [1e30] * 12, 1)]
    df = vectors(spark, rows + odd)
    got = sorted(whitening.whiten(df, 8).collect(), key=lambda r: r.vec_id)
    whole, want, shares = brute_whitened(rows, 8)
    assert [r.vec_id for r in got] == list(range(300)) and {r.n for r in got} == {300}
    sums = [int(v) for v in whole.sum(0)]
    assert [r.deviation for r in got] == [sum((300 * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in whole]
    have = np.array([r.whitened for r in got])
    assert have.shape == want.shape
    sign = np.sign((have * want).sum(0))
    assert np.abs(have - want * sign).max() < 1e-5
    assert np.allclose(got[0].explained, shares[:8], rtol=1e-6) and got[0].identity_error < 1e-8


def test_whitening_edges(spark):
    assert whitening.whiten(vectors(spark, [])).collect() == []
    same = whitening.whiten(vectors(spark, [(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (None, [1.0, 2.0], None)])).collect()
    assert [(r.n, r.deviation, r.whitened, r.identity_error) for r in same] == [(3, 0, [], 0.0)] * 3
    huge = vectors(spark, [(1, [1e12], 0), (2, [-1e12], 0)])
    assert [r.deviation for r in whitening.whiten(huge).collect()] == [None, None]


def test_repeated_passes_orthogonalise_what_one_cannot(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(200, 3))
    x = np.concatenate([base, base + 2.0 ** -20 * rng.normal(size=(200, 3))], axis=1) * 2.0 ** 24
    rows = whitening.whole_vectors(vectors(spark, [(i, e, 0) for i, e in enumerate(x.tolist())]))
    model = whitening.fit(rows)
    assert model.passes >= 3 and model.components.shape[1] == 6
    assert whitening.identity_error(rows, model, 6) < 1e-6
