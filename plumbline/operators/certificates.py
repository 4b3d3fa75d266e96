"""Statistics over states and adjoints: A05, A06, G01-G17, M12-M14."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import vectors as V
from plumbline.operators import moments as M
from plumbline.operators.ranking_ops import area, budget_to, recall_at, running_best, spearman
from plumbline.plans.tables import VECTORS_SQL, correlation, rd, vectors


def rotated(v: str) -> Column:
    """A vector turned left by one place: the stand-in for an adjoint."""
    return F.concat(F.slice(v, 2, F.size(v) - 1), F.slice(v, 1, 1))


def mean_adjoint(df: DataFrame, g: str = "g") -> DataFrame:
    """(i, gbar)."""
    return M.cells(df, g).groupBy("i").agg(F.avg("x").alias("gbar"))


def second_moment(df: DataFrame, g: str = "g") -> np.ndarray:
    """Mean outer product of the adjoints, d x d on the driver."""
    r = M.gram(df, g).first()
    d = len(r["s"])
    return np.array(r["g"]).reshape(d, d) / r["n"]


def certificate(gbar: np.ndarray, w: np.ndarray) -> float:
    """Signed mean effect of a unit step along w."""
    return float(gbar @ w / np.linalg.norm(w))


def rms_certificate(df: DataFrame, w: np.ndarray, g: str = "g") -> DataFrame:
    """Root mean square effect of a unit step along w."""
    u = V.literal((w / np.linalg.norm(w)).tolist())
    return df.agg(F.sqrt(F.avg(V.dot(g, u) * V.dot(g, u))).alias("rms"))


def participation(second: np.ndarray) -> tuple[float, float]:
    """Effective rank, trace over the largest eigenvalue, and its share of the dimension."""
    top = float(np.linalg.eigvalsh(second)[-1])
    r = float(np.trace(second) / top) if top > 0 else 0.0
    return r, r / len(second)


def dark_direction(gbar: np.ndarray, observed: np.ndarray) -> np.ndarray:
    """The part of gbar that the observed directions (rows) don't see, as a unit vector."""
    q = orthonormal(observed)
    rest = gbar - q.T @ (q @ gbar)
    n = np.linalg.norm(rest)
    if n < 1e-12:
        raise ValueError("the observed directions see all of gbar")
    return rest / n


def orthonormal(rows: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the rows' span, as rows; what depends on the rows before is left out."""
    q, r = np.linalg.qr(np.atleast_2d(rows).T)
    return q.T[np.abs(np.diag(r)) > 1e-10]


def usable_radius(certificate_value: float, curvature_value: float) -> float:
    return math.inf if curvature_value <= 1e-12 else 2 * certificate_value / curvature_value


def direction_pool(stats: M.ClassStats, gbar: np.ndarray, second: np.ndarray, mixes: int, randoms: int, seed: int = 0) -> dict[str, np.ndarray]:
    """Unit directions to try: the probe, gbar, mixtures of both, eigenvectors, coordinates, random ones."""
    probe = M.fisher(stats)
    g = gbar / np.linalg.norm(gbar)
    out = {"probe": probe, "gbar": g}
    for k, t in enumerate(np.linspace(0, 1, mixes + 2)[1:-1]):
        m = (1 - t) * probe + t * g
        out[f"mix{k}"] = m / np.linalg.norm(m)
    for k, e in enumerate(np.linalg.eigh(second)[1][:, ::-1].T[:4]):
        out[f"eig{k}"] = e
    for k in range(len(g)):
        out[f"unit{k}"] = np.eye(len(g))[k]
    rng = np.random.default_rng(seed)
    for k in range(randoms):
        r = rng.normal(size=len(g))
        out[f"random{k}"] = r / np.linalg.norm(r)
    return out


def with_areas(df: DataFrame, pool: DataFrame, y: str = "y") -> DataFrame:
    """`pool` (name, w and more, a short list of directions) with the area of each direction's scores of the rows."""
    rows = df.select(y, "vec_id", "v").crossJoin(F.broadcast(pool.select("name", "w")))
    return pool.join(area(rows.select("name", y, F.round(V.dot("v", "w"), 9).alias("score")), ["name"], "score", y), "name")


def budget_curves(pool: list[tuple[float, float, float]], top: int = 5, reps: int = 400) -> list[tuple[str, int, float, float]]:
    """(ordering, budget, share, recall) of directions with their certificate, area and effect: the best
    effect found within each budget as a share of the best of all, and the share of the `top` effects
    found, if directions are tried by effect, by certificate, by the area's distance from one half, and
    as the mean of `reps` permutations."""
    certificate_, auc, effect = (np.array([r[k] for r in pool], float) for k in range(3))
    m = len(effect)
    best = set(np.argsort(-effect, kind="stable")[:top].tolist())

    def curve(order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.maximum.accumulate(effect[order]) / effect.max(), np.cumsum([k in best for k in order.tolist()]) / min(top, m)

    curves = {k: curve(np.argsort(-x, kind="stable")) for k, x in (("oracle", effect), ("certificate", certificate_), ("probe_auc", np.abs(auc - 0.5)))}
    random = [curve(np.random.default_rng(1000 + r).permutation(m)) for r in range(reps)]
    curves["random"] = tuple(np.mean([c[k] for c in random], axis=0) for k in (0, 1))
    return [(name, b + 1, float(share[b]), float(recall[b])) for name, (share, recall) in curves.items() for b in range(m)]


def budgets_to(curves: DataFrame, shares: tuple[float, ...] = (0.9, 0.99)) -> DataFrame:
    """(ordering, share, budget): the least budget that reaches each share of the best effect."""
    return curves.groupBy("ordering").agg(*(F.min(F.when(F.col("share") >= x - 1e-12, F.col("budget"))).alias(f"to_{round(100 * x)}") for x in shares))


def erf(x: Column) -> Column:
    """Error function to 1.5e-7 by the rational approximation 7.1.26 of Abramowitz and Stegun."""
    t = 1 / (1 + 0.3275911 * F.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def divergence(p: Column, q: Column) -> Column:
    """Kullback-Leibler divergence of two log distributions."""
    return F.aggregate(F.zip_with(p, q, lambda a, b: F.exp(a) * (a - b)), F.lit(0.0), lambda s, x: s + x)


def log_softmax(v: Column) -> Column:
    top = F.array_max(v)
    total = F.ln(F.aggregate(v, F.lit(0.0), lambda a, x: a + F.exp(x - top))) + top
    return F.transform(v, lambda x: x - total)


# ---- queries -------------------------------------------------------------------------------------
def _vg(s, d):
    return vectors(s, d).withColumn("g", rotated("v"))


def _gbar(s, d) -> np.ndarray:
    return np.array([r["gbar"] for r in mean_adjoint(_vg(s, d)).orderBy("i").collect()])


def _delta(s, d) -> np.ndarray:
    return M.ClassStats.of(_vg(s, d)).delta


def _one(s, **values: float) -> DataFrame:
    return s.createDataFrame([tuple(float(v) for v in values.values())], ", ".join(f"{k} double" for k in values)).select(*(rd(k, 5).alias(k) for k in values))


def _pool(s, d) -> DataFrame:
    df = _vg(s, d)
    stats, gbar, second = M.ClassStats.of(df), _gbar(s, d), second_moment(df)
    rows = []
    for k, (name, w) in enumerate(direction_pool(stats, gbar, second, 6, 8).items()):
        rows.append((k + 1, name, w.tolist(), abs(certificate(gbar, w)), float(np.sqrt(w @ second @ w))))
    return s.createDataFrame(rows, "place int, name string, w array<double>, certificate double, effect double")


def _tested(s, d) -> DataFrame:
    return with_areas(_vg(s, d), _pool(s, d))


def _both(s, d) -> DataFrame:
    """How well the certificate and the area foretell the effect, over the pool."""
    t = _tested(s, d).withColumn("far", F.abs(F.col("auroc") - 0.5))
    a, b = spearman(t, [], "certificate", "effect"), spearman(t, [], "far", "effect")
    return a.select(rd("rho").alias("certificate")).crossJoin(b.select(rd("rho").alias("area")))


def _curves(s, d) -> DataFrame:
    rows = _tested(s, d).orderBy("place").select("certificate", "auroc", "effect").collect()  # one for each direction
    return s.createDataFrame(budget_curves([tuple(r) for r in rows]), "ordering string, budget int, share double, recall double")


def _alignment(s, d):
    """Cosines of each source's class difference with each family's mean adjoint."""
    df = _vg(s, d)
    diff = M.cells(df, "v", "source", "y").groupBy("source", "i").agg(F.avg(F.when(F.col("y") == 1, F.col("x"))).alias("a"), F.avg(F.when(F.col("y") == 0, F.col("x"))).alias("b")).select("source", "i", (F.col("a") - F.col("b")).alias("w")).dropna()
    gb = M.cells(df, "g", "family").groupBy("family", "i").agg(F.avg("x").alias("g"))
    own = df.select("source", F.col("family").alias("own")).distinct()
    j = diff.join(gb, "i").groupBy("source", "family").agg((F.sum(F.col("w") * F.col("g")) / F.sqrt(F.sum(F.col("w") * F.col("w")) * F.sum(F.col("g") * F.col("g")))).alias("cos"))
    return j.join(own, (j["source"] == own["source"]) & (j["family"] == own["own"]), "left").select(j["source"], "family", F.abs("cos").alias("cos"), F.col("own").isNotNull().alias("matched"))


_G = f"{VECTORS_SQL}, gc AS (SELECT vec_id, y, source, family, i, v[i % 16 + 1] AS x FROM (SELECT *, unnest(range(1, 17)) AS i FROM vec)), gb AS (SELECT i, avg(x) AS g FROM gc GROUP BY 1), dl AS (SELECT i, avg(x) FILTER (WHERE y = 1) - avg(x) FILTER (WHERE y = 0) AS w FROM cells GROUP BY 1), dg AS (SELECT i, w, g FROM dl JOIN gb USING (i))"
_AL = f"{_G}, df AS (SELECT * FROM (SELECT source, i, avg(x) FILTER (WHERE y = 1) - avg(x) FILTER (WHERE y = 0) AS w FROM cells GROUP BY 1, 2) WHERE w IS NOT NULL), gf AS (SELECT family, i, avg(x) AS g FROM gc GROUP BY 1, 2), al AS (SELECT source, family, abs(sum(w * g) / sqrt(sum(w * w) * sum(g * g))) AS cos FROM df JOIN gf USING (i) GROUP BY 1, 2), own AS (SELECT DISTINCT source, family, true AS matched FROM vec), am AS (SELECT source, family, cos, coalesce(matched, false) AS matched FROM al LEFT JOIN own USING (source, family))"

QUERIES = {
    "a05_second_moment": lambda s, d: M._matrix(s, second_moment(_vg(s, d))),
    "a06_mean_adjoint": lambda s, d: mean_adjoint(_vg(s, d)).select("i", rd("gbar").alias("gbar")),
    "a22_quadratic_form": lambda s, d: _vg(s, d).select(V.dot("v", "g").alias("q")).agg(rd(F.avg("q")).alias("mean"), rd(F.stddev_pop("q") / F.sqrt(F.count("q"))).alias("sem")),
    "g01_certificate": lambda s, d: _one(s, signed=certificate(_gbar(s, d), _delta(s, d)), absolute=abs(certificate(_gbar(s, d), _delta(s, d)))),
    "g02_rms_certificate": lambda s, d: rms_certificate(_vg(s, d), _delta(s, d)).select(rd("rms", 5).alias("rms")),
    "g03_spectrum": lambda s, d: s.createDataFrame([(k + 1, float(x)) for k, x in enumerate(np.linalg.eigvalsh(second_moment(_vg(s, d)))[::-1])], "place int, value double").select("place", rd("value", 5).alias("value")),
    "g04_participation": lambda s, d: _one(s, rank=participation(second_moment(_vg(s, d)))[0], share=participation(second_moment(_vg(s, d)))[1]),
    "g05_alignment": lambda s, d: _one(s, rho=abs(certificate(_gbar(s, d), _delta(s, d))) / np.linalg.norm(_gbar(s, d))),
    "g06_dark_direction": lambda s, d: M._as_cells(s, dark_direction(_gbar(s, d), _delta(s, d)), 0.0),
    "g07_best_directions": lambda s, d: M._as_cells(s, _gbar(s, d) / np.linalg.norm(_gbar(s, d)), 0.0),
    "g08_usable_radius": lambda s, d: _one(s, radius=usable_radius(abs(certificate(_gbar(s, d), _delta(s, d))), 0.25)),
    "g09_predicted_effect": lambda s, d: _vg(s, d).agg(rd(0.1 * F.avg(V.norm("v")) * F.lit(abs(certificate(_gbar(s, d), _delta(s, d)))), 5).alias("effect")),
    "g10_pool": lambda s, d: _pool(s, d).select("place", "name", rd("certificate", 5).alias("certificate")),
    "g11_both": lambda s, d: _both(s, d),
    "g12_orderings": lambda s, d: _curves(s, d).select("ordering", "budget", rd("share", 5).alias("share"), rd("recall", 5).alias("recall")),
    "g12_budgets": lambda s, d: budgets_to(_curves(s, d)),
    "g11_predictiveness": lambda s, d: spearman(_pool(s, d), [], "certificate", "effect").select(rd("rho").alias("rho")),
    "g12_budget_curves": lambda s, d: recall_at(running_best(_pool(s, d).withColumn("all", F.lit(1)), ["all"], "place", "effect"), ["all"], "place", "effect", 5).select("place", rd("best", 5).alias("best"), rd("recall").alias("recall")),
    "g12_budget_to_90": lambda s, d: budget_to(_pool(s, d).withColumn("all", F.lit(1)).withColumn("by_certificate", F.row_number().over(Window.partitionBy("all").orderBy(F.desc("certificate"), "place"))), ["all"], "by_certificate", "effect", 0.9).select("budget"),
    "g13_alignment_matrix": lambda s, d: _alignment(s, d).groupBy("matched").agg(F.count("*").alias("n"), rd(F.avg("cos")).alias("mean"), rd(F.max("cos")).alias("most")),
    "g14_behaviour_gap": lambda s, d: M.cells(_vg(s, d), "v", "vec_id").groupBy("vec_id").agg(rd(F.avg(F.when(F.col("i") <= 4, F.col("x"))) - F.avg(F.when(F.col("i") > 12, F.col("x")))).alias("gap")),
    "g15_steering_effect": lambda s, d: _vg(s, d).select("vec_id", rd(V.dot(V.plus("v", V.scaled("g", F.lit(0.1))), "g") - V.dot("v", "g"), 5).alias("effect")),
    "g16_exactness": lambda s, d: s.range(-20, 21).select((F.col("id") / 5).alias("x")).select("x", rd(0.5 * (1 + erf(F.col("x") / F.sqrt(F.lit(2.0)))), 5).alias("phi")),
    "g17_sweep": lambda s, d: s.range(0, 9).select((F.col("id") * math.pi / 16).alias("theta")).crossJoin(s.range(1, 5).select((F.col("id") / 2).alias("gap"))).groupBy("gap").agg(rd(correlation(F.cos("theta"), F.cos("theta") * F.col("gap"))).alias("r"), rd(F.max(F.sin("theta") * F.col("gap"))).alias("most")),
    "m04_direction_auc": lambda s, d: area(_vg(s, d).withColumn("sc", F.round(V.dot("v", V.unit(V.literal(_delta(s, d).tolist()))), 9)), ["source"], "sc", "y").select("source", rd("auroc").alias("auroc")),
    "m12_divergence": lambda s, d: _vg(s, d).select("vec_id", rd(divergence(log_softmax(F.col("v")), log_softmax(F.col("g")))).alias("kl")),
    "m13_entropy": lambda s, d: _vg(s, d).select("vec_id", log_softmax(F.col("v")).alias("lp")).select("vec_id", rd(-F.aggregate("lp", F.lit(0.0), lambda a, x: a + F.exp(x) * x)).alias("entropy"), rd(F.exp(F.array_max("lp"))).alias("top")),
    "m14_cosine_top": lambda s, d: _vg(s, d).select("vec_id", F.round(V.cosine("v", V.literal(_delta(s, d).tolist())), 9).alias("cos")).orderBy(F.desc("cos"), "vec_id").limit(10).select("vec_id", rd("cos").alias("cos")),
}

SQL = {
    "a05_second_moment": f"WITH {_G} SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, round(avg(a.x * b.x), 5) AS c FROM gc a JOIN gc b USING (vec_id) GROUP BY 1, 2",
    "a06_mean_adjoint": f"WITH {_G} SELECT CAST(i AS INTEGER) AS i, round(g, 6) AS gbar FROM gb",
    "a22_quadratic_form": f"WITH {_G}, q AS (SELECT vec_id, sum(c.x * gc.x) AS q FROM cells c JOIN gc USING (vec_id, i) GROUP BY 1) SELECT round(avg(q), 6) AS mean, round(stddev_pop(q) / sqrt(count(*)), 6) AS sem FROM q",
    "g01_certificate": f"WITH {_G} SELECT round(sum(w * g) / sqrt(sum(w * w)), 5) AS signed, round(abs(sum(w * g) / sqrt(sum(w * w))), 5) AS absolute FROM dg",
    "g02_rms_certificate": f"WITH {_G}, p AS (SELECT vec_id, sum(x * w) AS q FROM gc JOIN dl USING (i) GROUP BY 1), l AS (SELECT sum(w * w) AS l FROM dl) SELECT round(sqrt(avg(q * q / l)), 5) AS rms FROM p, l",
    "g05_alignment": f"WITH {_G} SELECT round(abs(sum(w * g)) / sqrt(sum(w * w) * sum(g * g)), 5) AS rho FROM dg",
    "g06_dark_direction": f"WITH {_G}, k AS (SELECT sum(w * g) / sum(w * w) AS k FROM dg), r AS (SELECT i, g - k * w AS r FROM dg, k), l AS (SELECT sqrt(sum(r * r)) AS l FROM r) SELECT CAST(i AS INTEGER) AS i, round(r / l, 5) AS w FROM r, l UNION ALL SELECT 0, 0.0",
    "g07_best_directions": f"WITH {_G}, l AS (SELECT sqrt(sum(g * g)) AS l FROM gb) SELECT CAST(i AS INTEGER) AS i, round(g / l, 5) AS w FROM gb, l UNION ALL SELECT 0, 0.0",
    "g08_usable_radius": f"WITH {_G} SELECT round(2 * abs(sum(w * g) / sqrt(sum(w * w))) / 0.25, 5) AS radius FROM dg",
    "g09_predicted_effect": f"WITH {_G}, n AS (SELECT avg(l) AS n FROM (SELECT sqrt(sum(x * x)) AS l FROM cells GROUP BY vec_id)) SELECT round(0.1::DOUBLE * any_value(n) * abs(sum(w * g) / sqrt(sum(w * w))), 5) AS effect FROM dg, n",
    "g13_alignment_matrix": f"WITH {_AL} SELECT matched, count(*) AS n, round(avg(cos), 6) AS mean, round(max(cos), 6) AS most FROM am GROUP BY 1",
    "g14_behaviour_gap": f"WITH {VECTORS_SQL} SELECT vec_id, round(avg(x) FILTER (WHERE i <= 4) - avg(x) FILTER (WHERE i > 12), 6) AS gap FROM cells GROUP BY 1",
    "g15_steering_effect": f"WITH {_G} SELECT vec_id, round(sum((c.x + 0.1::DOUBLE * gc.x) * gc.x) - sum(c.x * gc.x), 5) AS effect FROM cells c JOIN gc USING (vec_id, i) GROUP BY 1",
    "g17_sweep": "WITH t AS (SELECT k * pi() / 16 AS theta FROM range(0, 9) r(k)), g AS (SELECT k / 2.0::DOUBLE AS gap FROM range(1, 5) r(k)) SELECT gap, round(corr(cos(theta), cos(theta) * gap), 6) AS r, round(max(sin(theta) * gap), 6) AS most FROM t, g GROUP BY 1",
    "m04_direction_auc": f"WITH {_G}, ln AS (SELECT sqrt(sum(w * w)) AS l FROM dl), s0 AS (SELECT vec_id, y, source, round(sum(x * w / l), 9) AS s FROM cells JOIN dl USING (i), ln GROUP BY 1, 2, 3), rk AS (SELECT *, rank() OVER (PARTITION BY source ORDER BY s) + (count(*) OVER (PARTITION BY source, s) - 1) / 2.0 AS r FROM s0) SELECT source, round((sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0) / nullif(count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0), 0), 6) AS auroc FROM rk GROUP BY 1",
    "g04_participation": f"""WITH RECURSIVE {_G}, m AS (SELECT a.i, b.i AS j, avg(a.x * b.x) AS a FROM gc a JOIN gc b USING (vec_id) GROUP BY 1, 2), mat AS (SELECT list(rw ORDER BY i) AS a FROM (SELECT i, list(a ORDER BY j) AS rw FROM m GROUP BY i)),
        it AS (SELECT 0 AS k, list_transform(range(1, 17), lambda q: 1.0::DOUBLE + q / 100.0::DOUBLE) AS v, 0.0::DOUBLE AS top FROM mat UNION ALL
               SELECT k + 1, list_transform(u, lambda z: z / sqrt(list_dot_product(u, u))), sqrt(list_dot_product(u, u)) FROM (SELECT k, list_transform(range(1, 17), lambda q: list_dot_product(a[q], v)) AS u FROM it, mat WHERE k < 3000))
        SELECT round((SELECT sum(a) FROM m WHERE i = j) / top, 5) AS rank, round((SELECT sum(a) FROM m WHERE i = j) / top / 16, 5) AS share FROM it WHERE k = 3000""",
    "m12_divergence": f"WITH {_G}, a AS (SELECT vec_id, i, x - ln(sum(exp(x)) OVER (PARTITION BY vec_id)) AS p FROM cells), b AS (SELECT vec_id, i, x - ln(sum(exp(x)) OVER (PARTITION BY vec_id)) AS q FROM gc) SELECT vec_id, round(sum(exp(p) * (p - q)), 6) AS kl FROM a JOIN b USING (vec_id, i) GROUP BY 1",
    "m13_entropy": f"WITH {VECTORS_SQL}, a AS (SELECT vec_id, x - ln(sum(exp(x)) OVER (PARTITION BY vec_id)) AS p FROM cells) SELECT vec_id, round(-sum(exp(p) * p), 6) AS entropy, round(max(exp(p)), 6) AS top FROM a GROUP BY 1",
    "m14_cosine_top": f"WITH {_G}, l AS (SELECT sum(w * w) AS l FROM dl), c AS (SELECT vec_id AS id, sum(x * w) / sqrt(sum(x * x) * any_value(l)) AS co FROM cells JOIN dl USING (i), l GROUP BY 1) SELECT id AS vec_id, round(co, 6) AS cos FROM c ORDER BY round(co, 9) DESC, id LIMIT 10",
}
