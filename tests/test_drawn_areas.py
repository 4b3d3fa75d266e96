import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import evaluation as E
from plumbline.operators import moments as M
from plumbline.plans.ranking import nth_by_hex


@pytest.mark.parametrize("most", [1 << 18, 40])
def test_areas_of_all_draws_from_one_score(spark, most):
    rng = np.random.default_rng(3)
    v = rng.integers(-3, 4, size=(300, 3)).astype(float)  # many equal scores
    v[0] = 900.0  # most scores fall into few of the ranges
    y, family, draws = rng.integers(0, 2, 300), np.array([f"f{k % 2}" for k in range(300)]), rng.integers(1, 8, 300)
    y[family == "f1"] *= draws[family == "f1"] & 1  # the third draw of f1 alone may lack positives
    rows = spark.createDataFrame([(str(family[k]), int(y[k]), v[k].tolist(), int(draws[k])) for k in range(300)], "family string, y int, v array<double>, draws long").repartition(5)
    heads = [("f0", "a", [1.0, 0.5, 0.0], 0.25), ("f0", "b", [0.0, 0.0, 0.0], 1.0), ("f1", "a", [-1.0, 0.0, 2.0], 0.0)]
    got = {(r.family, r.candidate, r.draw): r.auroc for r in E.drawn_areas(rows, heads, M.ClassStats.by(rows, "family"), most).collect()}
    assert len(got) == 9
    for f, c, w, b in heads:
        for d in range(3):
            on = (family == f) & (draws >> d & 1 == 1)
            s = np.round(v[on] @ np.array(w) + b, 9)
            p, q = s[y[on] == 1], s[y[on] == 0]
            assert abs(got[f, c, d] - ((p[:, None] > q).mean() + (p[:, None] == q).mean() / 2)) < 1e-12


def test_summary_ranks_chosen_heads_only(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(k, rng.normal(size=3).tolist(), k % 2, f"f{k // 2 % 6}") for k in range(360)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>, y int, family string")
    ranked, quota = [], E.quota

    def seen(x, by, *rest):
        ranked.extend(r["n"] for r in x.groupBy("family", "prior", "seed").agg(F.count_distinct("candidate").alias("n")).collect())
        return quota(x, by, *rest)

    monkeypatch.setattr(E, "quota", seen)
    got = E.routed_summary(E.routed_comparison(df, priors=(0.5,), seeds=(17,))).collect()
    # of seven heads for each family
    assert len(got) == 4 and len(ranked) == 6 and max(ranked) <= 4


def _tied(spark):
    rng = np.random.default_rng(5)
    v = rng.integers(-2, 3, size=(400, 2)).astype(float)  # 25 vectors, so that most cuts go through equal scores
    y = (v[:, 0] + rng.normal(size=400) * 2 > 0).astype(int)
    family = np.array(["f0"] * 200 + [f"f{k % 3 + 1}" for k in range(200)])
    return v, y, family, spark.createDataFrame([(k * 7 % 400, v[k].tolist(), int(y[k]), str(family[k])) for k in range(400)], "vec_id long, v array<double>, y int, family string").repartition(5)


@pytest.mark.parametrize("limits", [{}, {"most": 50, "size": 4}])
def test_routed_by_direct_computation(spark, monkeypatch, limits):
    v, y, family, df = _tied(spark)
    ids = np.arange(400) * 7 % 400
    priors, seeds = (0.5, 0.7), (17, 29)
    used, sorted_scores = [], E.sorted_scores

    def seen(rows, heads, parts):
        used.extend(heads)
        return sorted_scores(rows, heads, parts, **limits)

    monkeypatch.setattr(E, "sorted_scores", seen)
    got = E.routed_comparison(df, priors=priors, seeds=seeds, correlated=False).collect()
    heads = {(f, c): (np.array(w), b) for f, c, w, b in used}
    assert len(got) == 4 * 4 * 4 and len(used) < 4 * 5
    for r in got:
        drawn = []
        for label in (1, 0):
            own = sorted(np.flatnonzero((family == r.family) & (y == label)), key=lambda k: hashlib.sha1(f"{r.seed}:{ids[k]}".encode()).hexdigest())
            n = int(min(((family == r.family) & (y == 1)).sum() // r.prior, ((family == r.family) & (y == 0)).sum() // (1 - r.prior)))
            drawn += own[: round(n * r.prior) if label else n - round(n * r.prior)]
        drawn = np.array(drawn)

        def right(name):
            w, b = heads[r.family, name]
            s = np.round(v[drawn] @ w + b, 9)
            first = np.lexsort((ids[drawn], -s))[: round(len(drawn) * r.prior)]
            p, q = s[y[drawn] == 1], s[y[drawn] == 0]
            return np.isin(np.arange(len(drawn)), first) == y[drawn], ((p[:, None] > q).mean() + (p[:, None] == q).mean() / 2)

        (own, auroc), (base, _) = right("pooled" if r.candidate == "clean_pool" else r.candidate), right("pooled")
        assert (r.gains, r.losses) == ((own & ~base).sum(), (~own & base).sum())
        assert abs(r.accuracy - own.mean()) < 1e-12 and abs(r.auroc - auroc) < 1e-12


def test_only_rows_at_a_cut_are_ranked(spark, monkeypatch):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(k, rng.normal(size=3).tolist(), k % 2, f"f{k // 2 % 4}") for k in range(400)], "vec_id long, v array<double>, y int, family string")
    ranked, quota = [], E.quota
    monkeypatch.setattr(E, "quota", lambda x, *rest: ranked.append(x.count()) or quota(x, *rest))
    got = E.routed_comparison(df, priors=(0.5,), seeds=(17,)).collect()
    # no two scores are equal: one row for each of at most three heads of a family
    assert len(got) == 16 and 4 <= sum(ranked) <= 12


def test_places_and_marks(spark):
    rng = np.random.default_rng(7)
    rows = [(f"g{k % 2}", f"{rng.integers(0, 60):03x}{k % 5}", k) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, o string, id long").repartition(3)
    wanted = [("g0", 1, 0), ("g0", 77, 1), ("g0", 77, 2), ("g1", 150, 0), ("g1", 151, 1)]
    got = {(r.g, r.draw): (r.o, r.id) for r in nth_by_hex(df, ["g"], "o", ["id"], spark.createDataFrame(wanted, "g string, nth long, draw int")).collect()}
    own = {g: sorted((o, k) for h, o, k in rows if h == g) for g in ("g0", "g1")}
    assert got == {(g, d): own[g][n - 1] for g, n, d in wanted if n <= 150}
    x = rng.normal(size=(90, 2)) + 1e6
    marks = rng.integers(0, 8, 90)
    marked = spark.createDataFrame([(f"g{k % 2}", x[k].tolist(), int(marks[k])) for k in range(90)], "g string, v array<double>, m long").repartition(4)
    found = M.marked_moments(marked, "v", "g", "m")
    assert len(found) == 6
    for (g, bit), (n, mean, sd) in found.items():
        z = x[(np.arange(90) % 2 == int(g[1])) & (marks >> bit & 1 == 1)]
        assert n == len(z) and np.allclose(mean, z.mean(0), rtol=1e-12) and np.allclose(sd, z.std(0), rtol=1e-6)
