"""The recipe grid against a direct computation, row by row, of each fold."""

import numpy as np
import pytest

from plumbline.operators import evaluation as E
from plumbline.operators import moments as M


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 6)) * [1, 3, 0.5, 1, 2, 1] + [0, 1, 0, 4, 0, 0]
    y = rng.integers(0, 2, 400)
    x[:, 2] += y
    family = np.array([f"f{k % 4}" for k in range(400)])
    x[:, 5] += np.arange(400) % 4
    data = [(k, x[k].tolist(), int(y[k]), family[k], family[k]) for k in range(400)]
    return x, y, family, spark.createDataFrame(data, "vec_id long, v array<double>, y int, family string, source string").repartition(3)


def logistic(z, y, c):
    z1, w = np.c_[z, np.ones(len(z))], np.zeros(z.shape[1] + 1)
    ridge = np.diag([1.0] * z.shape[1] + [0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z1 @ w))
        w = w - np.linalg.solve(ridge + c * (z1 * (p * (1 - p))[:, None]).T @ z1, ridge @ w + c * z1.T @ (p - y))
    return w[:-1], w[-1]


def direct(recipe, x, y, test):
    name, probe, hyper = recipe
    l2, standard, remove = M.TRANSFORMS[name]
    if l2:
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8)
    train, scored, y = x[~test[0]], x[test[1]], y[~test[0]]
    if standard:
        own = scored if standard == "batch" else train
        scored = (scored - own.mean(0)) / np.maximum(own.std(0), 1e-6)
        train = (train - train.mean(0)) / np.maximum(train.std(0), 1e-6)
    if remove:
        top = np.linalg.eigh(train.T @ train / len(train))[1][:, ::-1][:, :remove]
        train, scored = train - train @ top @ top.T, scored - scored @ top @ top.T
    m0, m1 = train[y == 0].mean(0), train[y == 1].mean(0)
    if probe == "logistic":
        w, b = logistic(train, y, hyper)
    else:
        centred = np.where(y[:, None] == 1, train - m1, train - m0)
        cov = centred.T @ centred / len(train)
        w = m1 - m0 if probe == "dom" else np.linalg.solve((1 - hyper) * cov + hyper * np.trace(cov) / len(cov) * np.eye(len(cov)), m1 - m0)
        b = -w @ (m0 + m1) / 2
    return scored @ w + b


def test_the_grid_is_whole():
    assert len(set(E.GRID)) == 64 and {r[0] for r in E.GRID} == set(M.TRANSFORMS)
    assert len(set(E.FOCUSED)) == 18 and set(E.FOCUSED) <= set(E.GRID)


def test_queries_use_the_whole_grid(monkeypatch):
    seen = []
    monkeypatch.setattr(E, "_v", lambda s, d: None)
    monkeypatch.setattr(E, "fold_facts", lambda *x: None)
    monkeypatch.setattr(E, "fold_summary", lambda *x: None)
    monkeypatch.setattr(E, "held_out_scores", lambda df, recipes: seen.append(set(recipes)))
    monkeypatch.setattr(E, "cross_source_scores", lambda df, recipes: seen.append(set(recipes)))
    E._summary(None, None)
    E._cross(None, None)
    assert seen == [set(E.GRID)] * 2


def test_held_out_scores_of_all_recipes(rows):
    x, y, family, df = rows
    got = {}
    for r in E.held_out_scores(df, E.GRID).collect():
        got.setdefault((r.recipe, r.family), {})[r.vec_id] = r.score
    assert len(got) == 64 * 4
    for recipe in E.GRID:
        for f in ("f0", "f1", "f2", "f3"):
            s = got[E.recipe_key(*recipe), f]
            at = np.flatnonzero(family == f)
            assert sorted(s) == at.tolist()
            assert np.allclose([s[k] for k in at], direct(recipe, x, y, (family == f, family == f)), atol=1e-5), recipe


def test_cross_source_scores_of_all_recipes(rows):
    x, y, family, df = rows
    got = {}
    for r in E.cross_source_scores(df, E.GRID).collect():
        got.setdefault((r.recipe, r.pair), {})[r.vec_id] = r.score
    assert len(got) == 64 * 4
    for recipe in E.GRID:
        for a, b in (("f0", "f1"), ("f3", "f0")):
            tested = ((family == a) & (y == 1)) | ((family == b) & (y == 0))
            s = got[E.recipe_key(*recipe), f"{a}>{b}"]
            want = direct(recipe, x, y, ((family == a) | (family == b), tested))
            assert np.allclose([s[k] for k in np.flatnonzero(tested)], want, atol=1e-5), recipe
