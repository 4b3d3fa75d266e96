"""Scoring with heads, combining scores and deciding: C01-C14; routing: R01-R05."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import vectors as V
from plumbline.operators import moments as M
from plumbline.operators.ranking_ops import PRIOR, places, quota, scaled_ranks, scored
from plumbline.operators.ranking_ops import _S as SCORED_SQL
from plumbline.plans.staging import stage
from plumbline.plans.tables import VECTORS_SQL, correlation, rd, table, vectors


def fit_head(df: DataFrame, name: str, fit, vec: str = "v", y: str = "y") -> dict:
    """A head: the transform's own moments and components and the affine part fitted behind it."""
    l2, standard, remove = M.TRANSFORMS[name]
    x = df.withColumn(vec, V.row_l2(vec)) if l2 else df
    head: dict = {"row_l2": l2, "standardize": standard, "remove_top": remove}
    if standard:
        m = M.center_and_scale(x, vec)
        if standard == "train":
            r = m.first()
            head |= {"center": list(r["center"]), "scale": list(r["scale"])}
        x = M.standardize(x, vec, m)
    if remove:
        r = M.gram(x, vec).first()
        d = len(r["s"])
        comps = M.top_components(np.array(r["g"]).reshape(d, d) / r["n"], remove)
        head["components"] = comps.tolist()
        x = M.project_out(x, vec, comps)
    w, b = fit(M.ClassStats.of(x, vec, y))
    return M.check_head(head | {"coef": w.tolist(), "intercept": float(b)})


def score(df: DataFrame, head: dict, vec: str = "v", name: str = "score") -> DataFrame:
    """`df` with the head's score; batch standardizing takes the moments of `df` itself."""
    M.check_head(head)
    x = df.withColumn("__v", V.row_l2(vec) if head["row_l2"] else F.col(vec).cast("array<double>"))
    if head["standardize"] == "train":
        x = x.withColumn("__v", V.standardized("__v", V.literal(head["center"]), V.literal(head["scale"])))
    elif head["standardize"] == "batch":
        x = M.standardize(x, "__v", M.center_and_scale(x, "__v"))
    if head["remove_top"]:
        x = M.project_out(x, "__v", np.array(head["components"]))
    return x.withColumn(name, V.dot("__v", V.literal(head["coef"])) + F.lit(head["intercept"])).drop("__v")


def probability(z: Column) -> Column:
    """Logistic of a score cut at 40 on both sides."""
    return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(40.0)), F.lit(-40.0))))


def combine(df: DataFrame, weights: dict[str, float], how: str, name: str = "combined") -> DataFrame:
    """Weighted sum of score columns as ranks, probabilities or as they are."""
    if how not in ("rank", "probability", "score"):
        raise ValueError(f"no way of combining called {how}")
    out, total = df, F.lit(0.0)
    for c, w in weights.items():
        if how == "rank":
            out = scaled_ranks(out, [], c, f"__{c}")
        part = F.col(f"__{c}") if how == "rank" else probability(F.col(c)) if how == "probability" else F.col(c)
        total = total + F.lit(float(w)) * part
    return out.withColumn(name, total).select(*df.columns, name)


def not_normal(logits: Column, normal: int) -> Column:
    """One less the softmax of one class, shifted by the largest logit."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda z: F.exp(z - top))
    return 1 - e[normal] / F.aggregate(e, F.lit(0.0), lambda a, x: a + x)


def check_width(df: DataFrame, vec: str, width: int) -> DataFrame:
    """(rows, wrong): rows whose vector isn't as wide as the head; an empty batch has none."""
    return df.agg(F.count("*").alias("rows"), F.count_if(F.coalesce(F.size(vec) != width, F.lit(True))).alias("wrong"))


def tails_direction(df: DataFrame, score_col: str, tie: str, vec: str, top: int, bottom: int) -> DataFrame:
    """(i, w): difference of the mean vectors of the most and the least confident rows."""
    hi = places(df, [], score_col, tie, True, "__hi")
    lo = places(hi, [], score_col, tie, False, "__lo").filter((F.col("__hi") <= top) | (F.col("__lo") <= bottom))
    c = M.cells(lo.withColumn("__up", F.col("__hi") <= top), vec, "__up")
    return c.groupBy("i").agg((F.avg(F.when(F.col("__up"), F.col("x"))) - F.avg(F.when(~F.col("__up"), F.col("x")))).alias("w"))


# ---- routing -------------------------------------------------------------------------------------
def class_moments(df: DataFrame, by: str, vec: str = "v", y: str = "y") -> DataFrame:
    """(by, i, mean0, mean1, var0, var1); groups without both classes are left out."""
    m = M.dim_moments(df, vec, by, y)
    c = lambda k, v: F.max(F.when(F.col(y) == k, F.col(v)))
    return m.groupBy(by, "i").agg(c(0, "mean").alias("mean0"), c(1, "mean").alias("mean1"), c(0, "var").alias("var0"), c(1, "var").alias("var1")).dropna()


def mixture(moments: DataFrame, prior: float) -> DataFrame:
    """Mean and deviation of each dimension of a mixture of both classes at a prior."""
    mean = (1 - prior) * F.col("mean0") + prior * F.col("mean1")
    gap = F.col("mean1") - F.col("mean0")
    var = (1 - prior) * F.col("var0") + prior * F.col("var1") + prior * (1 - prior) * gap * gap
    return moments.withColumn("m", mean).withColumn("s", F.sqrt(F.greatest(var, F.lit(1e-12))))


def distances(candidates: DataFrame, batch: DataFrame, scale: DataFrame) -> DataFrame:
    """(candidate, distance): mean over dimensions of the squared scaled differences of mean and
    deviation. candidates (candidate, i, m, s); batch (i, mu, sigma); scale (i, scale)."""
    j = candidates.join(F.broadcast(batch), "i").join(F.broadcast(scale), "i")
    a, b = (F.col("mu") - F.col("m")) / F.col("scale"), (F.col("sigma") - F.col("s")) / F.col("scale")
    return j.groupBy("candidate").agg(F.avg(a * a + b * b).alias("distance"))


def nearest(dist: DataFrame) -> DataFrame:
    """The nearest candidate, the first by name of equals."""
    return dist.orderBy(F.round("distance", 12), "candidate").limit(1)


def replace_incumbent(candidates: DataFrame, incumbent: DataFrame, pooled: str, drop_pooled: bool) -> DataFrame:
    """Candidates (candidate, value) with the pooled one replaced by the incumbent, or left out."""
    rest = candidates.filter(F.col("candidate") != pooled)
    if drop_pooled:
        return rest
    return rest.unionByName(candidates.filter(F.col("candidate") == pooled).select("candidate").crossJoin(F.broadcast(incumbent.select("value"))).select("candidate", "value"))


# ---- queries -------------------------------------------------------------------------------------
def _v(s, d):
    return vectors(s, d)


def _batch(s, d):
    return M.dim_moments(_v(s, d).filter("family = 'ambergroup'"), "v").select("i", F.col("mean").alias("mu"), F.col("sd").alias("sigma"))


def _distance(s, d):
    scale = M.dim_moments(_v(s, d), "v").select("i", F.greatest("sd", F.lit(1e-6)).alias("scale"))
    cand = mixture(class_moments(_v(s, d).filter("family <> 'ambergroup'"), "family"), PRIOR).select(F.col("family").alias("candidate"), "i", "m", "s")
    return distances(cand, _batch(s, d), scale)


def _blend(s, d):
    v = _v(s, d)
    base = scored(s, d).select("vec_id", "y", "family", F.col("other").alias("base"), "score")
    w = tails_direction(v.withColumn("s0", F.col("v")[0]), "s0", "vec_id", "v", 60, 40)
    cen = M.cells(v, "v", "vec_id").join(F.broadcast(w), "i").groupBy("vec_id").agg(F.sum(F.col("x") * F.col("w")).alias("cen"))
    x = base.join(cen, "vec_id")
    sign = x.agg(*(F.coalesce(F.signum(correlation("base", c)), F.lit(1.0)).alias(f"sg_{c}") for c in ("score", "cen")))
    x = x.crossJoin(F.broadcast(sign)).withColumn("score", F.col("score") * F.col("sg_score")).withColumn("cen", F.round(F.col("cen") * F.col("sg_cen"), 9))
    x = stage(x, "blend")
    out = x.select("vec_id")
    for c in ("base", "score", "cen"):
        out = out.join(places(x.select("vec_id", c), [], c, "vec_id", False, f"r_{c}").drop(c), "vec_id")
    return out.select("vec_id", (0.7 * F.col("r_base") + 0.2 * F.col("r_score") + 0.1 * F.col("r_cen")).alias("blend"))


_LDA_HEAD = lambda st: M.shrunk_lda(st, 0.1)
_MIX = f"""{VECTORS_SQL}, cm AS (SELECT family, i, avg(x) FILTER (WHERE y = 0) AS m0, avg(x) FILTER (WHERE y = 1) AS m1, var_pop(x) FILTER (WHERE y = 0) AS v0, var_pop(x) FILTER (WHERE y = 1) AS v1 FROM cells GROUP BY 1, 2),
pr AS (SELECT 12::DOUBLE / 17 AS p), mx AS (SELECT family AS candidate, i, (1 - p) * m0 + p * m1 AS m, sqrt(greatest((1 - p) * v0 + p * v1 + p * (1 - p) * (m1 - m0) * (m1 - m0), 1e-12)) AS s FROM cm, pr WHERE m0 IS NOT NULL AND m1 IS NOT NULL)"""
_DIST = f"""{_MIX}, bt AS (SELECT i, avg(x) AS mu, stddev_pop(x) AS sigma FROM cells WHERE family = 'ambergroup' GROUP BY 1), sl AS (SELECT i, greatest(stddev_pop(x), 1e-6) AS scale FROM cells GROUP BY 1),
di AS (SELECT candidate, avg(((mu - m) / scale) ** 2 + ((sigma - s) / scale) ** 2) AS distance FROM mx JOIN bt USING (i) JOIN sl USING (i) WHERE candidate <> 'ambergroup' GROUP BY 1)"""

QUERIES = {
    "c01_head_score": lambda s, d: score(_v(s, d), fit_head(_v(s, d), "l2+std", M.mean_difference)).select("vec_id", rd("score", 5).alias("score")),
    "c01_batch_score": lambda s, d: score(_v(s, d), fit_head(_v(s, d), "std+abtt1", _LDA_HEAD)).select("vec_id", rd("score", 5).alias("score")),
    "c02_rank_combine": lambda s, d: combine(scored(s, d), {"score": 0.7, "other": 0.3}, "rank").select("vec_id", rd("combined").alias("combined")),
    "c03_probability_combine": lambda s, d: combine(scored(s, d), {"score": 0.6, "other": 0.4}, "probability").select("vec_id", rd("combined").alias("combined")),
    "c04_score_combine": lambda s, d: combine(scored(s, d), {"score": 0.5, "other": 0.5}, "score").select("vec_id", rd("combined").alias("combined")),
    "c05_quota_decision": lambda s, d: quota(scored(s, d), ["source"], "other", "vec_id", PRIOR).groupBy("source").agg(F.sum("pred").alias("positives"), F.count("*").alias("n")),
    "c07_fixed_threshold": lambda s, d: combine(scored(s, d), {"score": 0.6, "other": 0.4}, "probability").select("vec_id", (F.col("combined") >= 0.5).cast("int").alias("pred")),
    "c08_softmax": lambda s, d: _v(s, d).select("vec_id", rd(not_normal(F.col("v"), 2)).alias("p")),
    "c09_width": lambda s, d: check_width(table(s, d, "bundle"), "embedding", 16),
    "c10_blend": lambda s, d: _blend(s, d).select("vec_id", rd("blend", 4).alias("blend")),
    "c11_tails_direction": lambda s, d: tails_direction(_v(s, d).withColumn("s0", F.col("v")[0]), "s0", "vec_id", "v", 60, 40).select("i", rd("w").alias("w")),
    "c14_checksum": lambda s, d: table(s, d, "ledger").select(F.sha2(F.col("zip").cast("binary"), 256).alias("sha256")).distinct(),
    "r01_mixture": lambda s, d: mixture(class_moments(_v(s, d), "family"), PRIOR).select(F.col("family").alias("candidate"), "i", rd("m").alias("m"), rd("s").alias("s")),
    "r02_distance": lambda s, d: _distance(s, d).select("candidate", rd("distance").alias("distance")),
    "r03_nearest": lambda s, d: nearest(_distance(s, d)).select("candidate", rd("distance").alias("distance")),
    "r05_incumbent": lambda s, d: replace_incumbent(_distance(s, d).select("candidate", F.col("distance").alias("value")), s.createDataFrame([(1.5,)], "value double"), "deltabase", False).select("candidate", rd("value").alias("value")),
}

SQL = {
    "c01_head_score": f"WITH {VECTORS_SQL}, l2 AS (SELECT vec_id, y, i, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 1e-8) AS x FROM cells), ms AS (SELECT i, avg(x) AS m, greatest(stddev_pop(x), 1e-6) AS sd FROM l2 GROUP BY 1), z AS (SELECT vec_id, y, l2.i, (x - m) / sd AS x FROM l2 JOIN ms USING (i)), q AS (SELECT i, avg(x) FILTER (WHERE y = 1) - avg(x) FILTER (WHERE y = 0) AS w, (avg(x) FILTER (WHERE y = 1) + avg(x) FILTER (WHERE y = 0)) / 2 AS mid FROM z GROUP BY 1), b AS (SELECT -sum(w * mid) AS b FROM q) SELECT vec_id, round(sum(x * w) + any_value(b), 5) AS score FROM z JOIN q USING (i), b GROUP BY 1",
    "c02_rank_combine": f"WITH {SCORED_SQL} SELECT vec_id, round(0.7::DOUBLE * (rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 - 1)::DOUBLE / (count(*) OVER () - 1) + 0.3::DOUBLE * (rank() OVER (ORDER BY other) + (count(*) OVER (PARTITION BY other) - 1) / 2.0 - 1)::DOUBLE / (count(*) OVER () - 1), 6) AS combined FROM sc",
    "c03_probability_combine": f"WITH {SCORED_SQL} SELECT vec_id, round(0.6::DOUBLE / (1 + exp(-greatest(least(score, 40), -40))) + 0.4::DOUBLE / (1 + exp(-greatest(least(other, 40), -40))), 6) AS combined FROM sc",
    "c04_score_combine": f"WITH {SCORED_SQL} SELECT vec_id, round(0.5::DOUBLE * score + 0.5::DOUBLE * other, 6) AS combined FROM sc",
    "c05_quota_decision": f"WITH {SCORED_SQL}, q AS (SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY other DESC, vec_id) <= round_even(count(*) OVER (PARTITION BY source) * (12::DOUBLE / 17), 0) AS INTEGER) AS pred FROM sc) SELECT source, CAST(sum(pred) AS BIGINT) AS positives, count(*) AS n FROM q GROUP BY 1",
    "c07_fixed_threshold": f"WITH {SCORED_SQL} SELECT vec_id, CAST(0.6::DOUBLE / (1 + exp(-greatest(least(score, 40), -40))) + 0.4::DOUBLE / (1 + exp(-greatest(least(other, 40), -40))) >= 0.5 AS INTEGER) AS pred FROM sc",
    "c08_softmax": f"WITH {VECTORS_SQL}, t AS (SELECT vec_id, v, list_max(v) AS top FROM vec) SELECT vec_id, round(1 - exp(v[3] - top) / list_sum(list_transform(v, lambda x: exp(x - top))), 6) AS p FROM t",
    "c09_width": "SELECT count(*) AS rows, count(*) FILTER (WHERE coalesce(len(embedding) <> 16, true)) AS wrong FROM bundle",
    "c11_tails_direction": f"WITH {VECTORS_SQL}, p AS (SELECT vec_id, row_number() OVER (ORDER BY v[1] DESC, vec_id) AS hi, row_number() OVER (ORDER BY v[1], vec_id) AS lo FROM vec), c AS (SELECT i, x, hi <= 60 AS up FROM cells JOIN p USING (vec_id) WHERE hi <= 60 OR lo <= 40) SELECT CAST(i AS INTEGER) AS i, round(avg(x) FILTER (WHERE up) - avg(x) FILTER (WHERE NOT up), 6) AS w FROM c GROUP BY 1",
    "c14_checksum": "SELECT DISTINCT sha256(zip) AS sha256 FROM ledger",
    "r01_mixture": f"WITH {_MIX} SELECT candidate, CAST(i AS INTEGER) AS i, round(m, 6) AS m, round(s, 6) AS s FROM mx",
    "r02_distance": f"WITH {_DIST} SELECT candidate, round(distance, 6) AS distance FROM di",
    "r03_nearest": f"WITH {_DIST} SELECT candidate, round(distance, 6) AS distance FROM di ORDER BY round(di.distance, 12), candidate LIMIT 1",
    "r05_incumbent": f"WITH {_DIST} SELECT candidate, round(CASE WHEN candidate = 'deltabase' THEN 1.5 ELSE distance END, 6) AS value FROM di",
}
