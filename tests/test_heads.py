"""Heads fitted by iteration end by their steps or tolerance, not by a low limit."""

import numpy as np
import pytest

from plumbline.operators import evaluation as E


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(300, 5)) * [1, 4, 0.2, 1, 2] + [3, 0, 0, 1, 0]
    x[:, 4] += x[:, 1]
    y = (x[:, 2] * 4 + x[:, 3] + rng.normal(size=300) > 1).astype(int)
    return x, y, spark.createDataFrame([(k, x[k].tolist(), int(y[k])) for k in range(300)], "vec_id long, v array<double>, y int").repartition(3)


def test_logistic_takes_400_steps(rows, monkeypatch):
    x, y, df = rows
    z = (x - x.mean(0)) / x.std(0)
    w, b = np.zeros(5), 0.0
    for _ in range(400):
        p = 1 / (1 + np.exp(-(z @ w + b)))
        w, b = w - 0.5 * (z.T @ (p - y) / 300 + 1e-3 * w), b - 0.5 * (p - y).mean()
    want = [round(float(b - x.mean(0) @ (w / x.std(0))), 5), *(round(float(v), 5) for v in w / x.std(0))]
    monkeypatch.setattr(E, "_v", lambda s, d: df)
    got = {r.i: r.w for r in E.QUERIES["h06_logistic_gd"](df.sparkSession, "").collect()}
    assert np.allclose([got[i] for i in range(6)], want, atol=2e-5)


def test_fits_end_by_tolerance(rows, monkeypatch):
    from pyspark.ml.classification import LinearSVC, LogisticRegression

    _, _, df = rows
    ran = []
    for kind in (LinearSVC, LogisticRegression):
        fit = kind.fit

        def spied(self, data, fit=fit):
            model = fit(self, data)
            summary = model.summary() if callable(model.summary) else model.summary
            ran.append((type(self).__name__, summary.totalIterations, self.getMaxIter()))
            return model

        monkeypatch.setattr(kind, "fit", spied)
    monkeypatch.setattr(E, "_v", lambda s, d: df)
    E.QUERIES["h09_svm"](df.sparkSession, "").collect()
    E.platt(df)
    E.multinomial(df.withColumnRenamed("y", "label"), "v", "label", 3).collect()
    assert [r[0] for r in ran] == ["LinearSVC"] * 4 + ["LogisticRegression"] * 2
    assert all(n < most and most >= 800 for _, n, most in ran)
