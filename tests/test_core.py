"""Core operators on small tables with nulls, ties, one class, repeated and missing rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.functions import vectors as V
from plumbline.operators import certificates as G
from plumbline.operators import evaluation as E
from plumbline.operators import labels as P
from plumbline.operators import moments as M
from plumbline.operators import ranking_ops as W
from plumbline.operators import sampling as D
from plumbline.operators import scoring as C
from plumbline.plans.ranking import hex_rank, running_total, shuffled
from plumbline.plans.tables import first_by


def auroc(score, y):
    pos, neg = [s for s, t in zip(score, y) if t], [s for s, t in zip(score, y) if not t]
    if not pos or not neg:
        return None
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)


@pytest.fixture(scope="module")
def scores(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice("ab"), round(rng.gauss(0, 1), rng.choice([0, 3])), rng.randint(0, 1)) for k in range(400)]
    rows += [(1000 + k, "one class", float(k), 1) for k in range(5)] + [(2000, "single", 0.5, 0)] + [(3000 + k, "tied", 1.0, k % 2) for k in range(6)]
    return rows, spark.createDataFrame(rows, "id long, g string, score double, y int").repartition(3)


def groups(rows):
    out = {}
    for r in rows:
        out.setdefault(r[1], []).append(r)
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_area_and_cuts(scores, parts):
    rows, df = scores
    df = df.repartition(parts)
    got = {r.g: r.auroc for r in W.area(df, ["g"], "score", "y").collect()}
    for g, rs in groups(rows).items():
        want = auroc([r[2] for r in rs], [r[3] for r in rs])
        assert (got[g] is None) == (want is None) and (want is None or math.isclose(got[g], want, abs_tol=1e-12))
    cut = {r.g: r.oracle for r in W.best_cut(df, ["g"], "score", "id", "y").collect()}
    for g, rs in groups(rows).items():
        ys = [r[3] for r in sorted(rs, key=lambda r: (r[2], r[0]))]
        assert math.isclose(cut[g], max(sum(y == 0 for y in ys[:k]) + sum(ys[k:]) for k in range(len(ys) + 1)) / len(ys))


def test_quota_reaches_its_count_and_ignores_shifts(scores):
    rows, df = scores
    a = {r.id: r.pred for r in W.quota(df, ["g"], "score", "id", 0.7).collect()}
    b = {r.id: r.pred for r in W.quota(df.withColumn("score", F.col("score") * 2 + 5), ["g"], "score", "id", 0.7).collect()}
    assert a == b
    for rs in groups(rows).values():
        assert sum(a[r[0]] for r in rs) == round(len(rs) * 0.7)
        top = sorted(rs, key=lambda r: (-r[2], r[0]))[: round(len(rs) * 0.7)]
        assert all(a[r[0]] for r in top)


def test_ranks(scores):
    rows, df = scores
    got = {r.id: r.rank for r in W.average_ranks(df, ["g"], "score").collect()}
    for rs in groups(rows).values():
        for r in rs:
            below, same = sum(x[2] < r[2] for x in rs), sum(x[2] == r[2] for x in rs)
            assert got[r[0]] == below + (same + 1) / 2
    assert {r.rank01 for r in W.scaled_ranks(df, ["g"], "score").filter("g = 'single'").collect()} == {0.0}


def test_precision_and_thresholds(scores):
    rows, df = scores
    got = {r.g: r.ap for r in W.average_precision(df, ["g"], "score", "y").collect()}
    for g, rs in groups(rows).items():
        total, ap = sum(r[3] for r in rs), 0.0
        for t in sorted({r[2] for r in rs}, reverse=True):
            hit = [r for r in rs if r[2] >= t]
            ap += sum(r[3] for r in rs if r[2] == t) / total * sum(r[3] for r in hit) / len(hit) if total else 0
        assert got[g] is None if not total else math.isclose(got[g], ap)
    best = W.best_threshold(df, "score", "y", 19).first()
    acc = lambda c: sum((r[2] >= c) == bool(r[3]) for r in rows) / len(rows)
    assert math.isclose(best.accuracy, acc(best.cut))


def test_spearman_rules(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 4.0), ("a", 3.0, 9.0), ("a", float("nan"), 1.0), ("b", 1.0, 1.0), ("b", 2.0, 2.0), ("c", 1.0, 5.0), ("c", 1.0, 6.0), ("c", 1.0, 7.0)], "g string, x double, y double")
    assert {r.g: r.rho for r in W.spearman(df, ["g"], "x", "y").collect()} == {"a": pytest.approx(1.0), "b": None, "c": None}


def test_distributed_ranks_and_totals(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice("xyz"), rng.randint(0, 9)) for k in range(500)]
    df = spark.createDataFrame(rows, "id long, g string, w long").withColumn("o", shuffled("id")).withColumn("h", T.seeded("s", F.col("id").cast("string")))
    got = running_total(df, ["g"], "o", "id", F.col("w")).collect()
    for g in "xyz":
        total = 0
        for r in sorted((r for r in got if r.g == g), key=lambda r: (r.o, r.id)):
            total += r.w
            assert r.running == total
    for g in "xyz":
        own = sorted((r for r in hex_rank(df, ["g"], "h", "id").collect() if r.g == g), key=lambda r: (r.h, r.id))
        assert [r.nth for r in own] == list(range(1, len(own) + 1))


def test_first_by_and_first_wins(spark):
    df = spark.createDataFrame([(1, "Some text ", 2, 9, 1), (2, "some  TEXT", 1, 5, 0), (3, None, 1, 1, 1), (4, "ab", 1, 2, 1), (5, "some text" + " x" * 1500, 0, 0, 1), (6, "x", 1, 3, 0)], "row_id long, text string, source_ord int, pos long, label int")
    assert {r.row_id for r in D.first_wins(df).collect()} == {2}
    assert first_by(df.filter("false"), ["source_ord"], ["pos"], ["row_id"]).collect() == []


@pytest.mark.parametrize(("p", "n", "cap", "want"), [(100, 100, 50, (25, 25)), (100, 5, 50, (45, 5)), (5, 100, 50, (5, 45)), (3, 2, 50, (3, 2)), (0, 0, 10, (0, 0))])
def test_balance_counts(spark, p, n, cap, want):
    r = D.balance_counts(spark.createDataFrame([(p, n)], "P long, N long"), 0.5, F.lit(cap)).first()
    assert (r.want_pos, r.want_neg) == want


def test_prior_hits_the_rate(spark):
    df = spark.createDataFrame([(k, k % 2) for k in range(1800)], "id long, y int").withColumn("all", F.lit(1))
    r = D.prior_counts(df, ["all"], "y", 12 / 17).first()
    assert abs(r.want_pos / r["size"] - 12 / 17) < 1e-3 and r["size"] >= 900 / (12 / 17) - 2
    assert r["size"] == int(900 / (12 / 17))


def test_folds_and_permutation(spark):
    df = spark.createDataFrame([(k, int(k < 30)) for k in range(100)], "vec_id long, y int").withColumn("o", T.seeded("q", F.col("vec_id").cast("string")))
    f = D.folds(df, "y", "o", "vec_id").groupBy("fold", "y").count().collect()
    assert {r["count"] for r in f if r.y == 1} == {6} and len({r.fold for r in f}) == 5
    p = D.permuted(df, "y", "vec_id", "z").collect()
    assert sum(r.other for r in p) == 30 and len(p) == 100


def test_labels(spark):
    df = spark.createDataFrame([(1, "Safe ", " safe", None, 0.9), (2, "Threat", "safe", "", float("nan")), (3, None, "", None, None), (4, "Insult", "x", "safe", 0.05)], "k int, a string, b string, c string, s double")
    got = {r.k: (r.m, r.y) for r in df.select("k", P.majority(["a", "b", "c"], "safe").alias("m"), P.band("s", 0.5, 0.05).alias("y")).collect()}
    assert got == {1: (0, 1), 2: (None, None), 3: (None, None), 4: (1, 0)}


def test_text(spark):
    df = spark.createDataFrame([("  A b\t\nC ",), (None,), ("Straße 1_x!",)], "t string")
    assert [r[0] for r in df.select(T.canonical("t")).collect()] == ["a b c", None, "straße 1_x!"]
    assert [r[0] for r in df.select(T.strict_key("t")).collect()] == ["abc", None, "straße1_x"]
    assert df.select(T.basename(F.lit("C:\\a\\b.zip"))).first()[0] == "b.zip"


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(3)
    u = np.zeros(8)
    u[2] = 1
    rows = []
    for k in range(1200):
        f, y = k % 4, int(rng.random() < 0.5)
        rows.append((k, (rng.normal(size=8) + 2 * y * u + f * np.eye(8)[5]).tolist(), y, f"f{f}"))
    return rows, spark.createDataFrame(rows, "vec_id long, v array<double>, y int, family string").withColumn("source", F.col("family"))


def test_statistics_equal_numpy(planted):
    rows, df = planted
    x, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    for parts in (1, 5):
        s = M.ClassStats.of(df.repartition(parts))
        c = sum((x[y == k] - x[y == k].mean(0)).T @ (x[y == k] - x[y == k].mean(0)) for k in (0, 1))
        assert np.allclose(s.covariance(), c / len(x)) and np.allclose(s.delta, x[y == 1].mean(0) - x[y == 0].mean(0))
    w, b = M.shrunk_lda(s, 0.3)
    cov = c / len(x)
    want = np.linalg.solve(0.7 * cov + 0.3 * np.trace(cov) / 8 * np.eye(8), s.delta)
    assert np.allclose(w, want) and abs(np.linalg.norm(M.fisher(s)) - 1) < 1e-12
    aug = np.c_[x, np.ones(len(x))]
    reg = np.diag([1.0] * 8 + [0.0])
    ridge = np.linalg.solve(aug.T @ aug + reg, aug.T @ (2.0 * y - 1))
    rw, rb = M.ridge_classifier(s, 1.0)
    assert np.allclose(rw, ridge[:8]) and math.isclose(rb, ridge[8], abs_tol=1e-9)
    assert 0 <= M.auto_shrinkage(df, s) <= 1


def test_fold_statistics_are_differences(planted):
    rows, df = planted
    parts = M.ClassStats.by(df, "family")
    rest = E._total(parts).without(parts["f1"])
    direct = M.ClassStats.of(df.filter("family <> 'f1'"))
    assert np.allclose(rest.covariance(), direct.covariance()) and rest.n == direct.n


def test_planted_direction_is_found_across_families(planted):
    _, df = planted
    s = E.ranked_recipes(E.fold_summary(E.fold_facts(E.held_out_scores(df, E.RECIPES))), 4).collect()
    assert min(r.worst_auroc for r in s) > 0.8 and sorted(r.place for r in s) == list(range(1, len(s) + 1))
    best = sorted(s, key=lambda r: r.place)
    assert all(a.mean_auroc >= b.mean_auroc - 1e-9 for a, b in zip(best, best[1:]))


@pytest.mark.parametrize("name", list(M.TRANSFORMS))
def test_head_replays_its_transform(planted, name):
    rows, df = planted
    head = C.fit_head(df, name, lambda st: M.shrunk_lda(st, 0.1))
    got = {r.vec_id: r.score for r in C.score(df, head).collect()}
    x = np.array([r[1] for r in rows])
    if head["row_l2"]:
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8)
    if head["standardize"]:
        x = (x - x.mean(0)) / np.maximum(x.std(0), 1e-6)
    for c in head.get("components", []):
        x = x - np.outer(x @ np.array(c), np.array(c))
    want = x @ np.array(head["coef"]) + head["intercept"]
    assert np.allclose([got[r[0]] for r in rows], want, rtol=1e-6, atol=1e-8)


def test_heads_and_combinations_refuse_nonsense(planted):
    _, df = planted
    with pytest.raises(ValueError):
        M.check_head({"standardize": "train", "center": None, "scale": [1]})
    with pytest.raises(ValueError):
        M.check_head({"remove_top": 1})
    with pytest.raises(ValueError):
        C.combine(df, {"y": 1.0}, "votes")
    with pytest.raises(ValueError):
        E.guard_families(df.filter("family = 'f1'"))
    with pytest.raises(ValueError):
        E.portable_weights({"a": 1.0}, set())
    r = C.check_width(df.withColumn("v", F.when(F.col("vec_id") < 3, F.array(F.lit(1.0))).otherwise(F.col("v"))), "v", 8).first()
    assert (r["rows"], r["wrong"]) == (1200, 3)


def test_routing_picks_the_near_candidate_whatever_the_order(spark):
    rng = np.random.default_rng(4)
    rows = [(k, (rng.normal(size=4) + (-8 if k % 2 else 8) + (k // 2 % 2)).tolist(), k // 2 % 2, "low" if k % 2 else "high") for k in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>, y int, family string")
    scale = M.dim_moments(df, "v").select("i", F.col("sd").alias("scale"))
    cand = C.mixture(C.class_moments(df, "family"), 0.5).select(F.col("family").alias("candidate"), "i", "m", "s")
    for name, part in (("low", df.filter("family = 'low'")), ("high", df.filter("family = 'high'").repartition(7))):
        batch = M.dim_moments(part, "v").select("i", F.col("mean").alias("mu"), F.col("sd").alias("sigma"))
        assert C.nearest(C.distances(cand, batch, scale)).first()["candidate"] == name


def test_gramian_ranks_and_dark_direction(spark):
    rng = np.random.default_rng(5)
    one = np.outer(rng.normal(size=200), rng.normal(size=6))
    full = rng.normal(size=(200, 6))
    for g, low, high in ((one, 1, 1 + 1e-6), (full, 1, 6)):
        df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(g)], "id long, g array<double>")
        r, share = G.participation(G.second_moment(df))
        assert low - 1e-9 <= r <= high and math.isclose(share, r / 6)
    gbar, seen = rng.normal(size=6), rng.normal(size=(2, 6))
    dark = G.dark_direction(gbar, seen)
    assert abs(np.linalg.norm(dark) - 1) < 1e-12 and np.abs(seen @ dark).max() < 1e-12
    with pytest.raises(ValueError):
        G.dark_direction(seen[0], seen)
    x = [r[0] for r in spark.createDataFrame([(k / 7,) for k in range(-20, 21)], "x double").select(G.erf(F.col("x"))).collect()]
    assert max(abs(a - math.erf(k / 7)) for a, k in zip(x, range(-20, 21))) < 2e-7
    assert G.usable_radius(1.0, 0.0) == math.inf


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([float("nan"), 1.0],), ([float("inf"), 1.0],)], "v array<float>")
    assert [r[0] for r in df.select(V.finite("v")).collect()] == [True, True, False, False]
    for f in (V.row_l2, V.unit):
        got = [r[0] for r in df.limit(2).select(f("v")).collect()]
        assert got[0] == pytest.approx([0.6, 0.8]) and got[1] == [0.0, 0.0]


def test_ensembles(spark):
    rng = random.Random(6)
    rows = []
    for k in range(300):
        y = k % 2
        rows.append((y, min(1.0, max(0.0, y * 0.4 + rng.random() * 0.6)), min(1.0, max(0.0, y * 0.3 + rng.random() * 0.7)), rng.random()))
    df = spark.createDataFrame(rows, "y int, a double, b double, c double")
    mix = E.additive_ensemble(df, ["c", "a", "b"], "y")
    assert math.isclose(sum(w for _, w in mix), 1.0) and mix[0][0] == "c" and len(mix) > 1
    g = E.greedy_ensemble(df.select(*((F.col(c) - F.col("y")).alias(c) for c in "abc")), {"a": 0.9, "b": 0.8, "c": 0.5})
    assert g[0][0] == "a" and math.isclose(sum(w for _, w in g), 1.0)
