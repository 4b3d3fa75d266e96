"""Ranks, quotas, running values and metrics: W01-W18, M01-M15, C05-C07, A25, A26."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators.sampling import QUERIES as SAMPLING
from plumbline.operators.sampling import SQL as SAMPLING_SQL
from plumbline.plans.ranking import running_by_value, spaced_percentiles
from plumbline.plans.tables import VECTORS_SQL, correlation, first_by, rd, table, vectors

PRIOR = 12 / 17


def _attach(df: DataFrame, per: DataFrame, group: list[str]) -> DataFrame:
    """`df` with the columns of `per`, one row for each group; of no group, one row in all."""
    if not group:
        return df.crossJoin(F.broadcast(per))
    other = per.select(*(F.col(g).alias(f"__of_{g}") for g in group), *(c for c in per.columns if c not in group))
    on = F.lit(True)
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"__of_{g}"))
    return df.join(other, on).drop(*(f"__of_{g}" for g in group))


def tied(df: DataFrame, group: list[str], score: str, y: str | None = None) -> DataFrame:
    """One row for each score of a group: n, pos, and `below`, the rows of smaller scores. Ranks and
    areas come from this table; the rows themselves are never sorted."""
    pos = F.count_if(F.col(y) == 1) if y else F.lit(0)
    per = df.groupBy(*group, score).agg(F.count("*").alias("n"), pos.alias("pos"))
    out = running_by_value(per, group, score, score, {"upto": F.col("n"), "pos_upto": F.col("pos")})
    return out.withColumn("below", F.col("upto") - F.col("n")).withColumn("pos_below", F.col("pos_upto") - F.col("pos"))


def average_ranks(df: DataFrame, group: list[str], score: str, name: str = "rank") -> DataFrame:
    """`df` with ranks from 1, ties sharing their mean rank. Null scores must be dropped before."""
    t = tied(df, group, score)
    r = t.select(*(F.col(g).alias(f"__{g}") for g in group), F.col(score).alias("__s"), (F.col("below") + (F.col("n") + 1) / 2).alias(name))
    on = F.col(score) == F.col("__s")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"__{g}"))
    return df.join(r, on).select(*df.columns, name)


def scaled_ranks(df: DataFrame, group: list[str], score: str, name: str = "rank01") -> DataFrame:
    """Average ranks from 0 to 1; 0 in a group of one row."""
    n = df.groupBy(*group).agg(F.count("*").alias("__n"))
    ranked = average_ranks(df, group, score, "__r")
    return _attach(ranked, n, group).select(*df.columns, F.when(F.col("__n") > 1, (F.col("__r") - 1) / (F.col("__n") - 1)).otherwise(0.0).alias(name))


def places(df: DataFrame, group: list[str], score: str, tie: str, descending: bool = True, name: str = "place") -> DataFrame:
    """`df` with its place from 1 by score, ties by `tie`."""
    return running_by_value(df, group, score, tie, {name: F.lit(1)}, descending)


def quota(df: DataFrame, group: list[str], score: str, tie: str, rate: float | Column, name: str = "pred") -> DataFrame:
    """`df` with 1 for the round(rate * n) highest scores of each group; ties by ascending `tie`. The
    rate is a number, or a column with one value in each group."""
    n = df.groupBy(*group).agg(F.count("*").alias("__n"))
    placed = places(df, group, score, tie, True, "__p")
    k = F.least(F.greatest(F.bround(F.col("__n") * F.lit(rate)), F.lit(0)), F.col("__n"))
    return _attach(placed, n, group).select(*df.columns, (F.col("__p") <= k).cast("int").alias(name))


def area(df: DataFrame, group: list[str], score: str, y: str) -> DataFrame:
    """(group, auroc): area under the ROC curve by rank sums with ties; null with one class only."""
    t = tied(df, group, score, y)
    agg = t.groupBy(*group).agg(F.sum(F.col("pos") * (F.col("below") + (F.col("n") + 1) / 2)).alias("r"), F.sum("pos").cast("double").alias("p"), F.sum(F.col("n") - F.col("pos")).cast("double").alias("q"))
    return agg.select(*group, F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.nullif(F.col("p") * F.col("q"), F.lit(0.0))).alias("auroc"))


def best_cut(df: DataFrame, group: list[str], score: str, tie: str, y: str) -> DataFrame:
    """(group, oracle): best accuracy of any cut of the rows in score order."""
    run = running_by_value(df, group, score, tie, {"neg": F.when(F.col(y) == 0, 1).otherwise(0), "pos": F.when(F.col(y) == 1, 1).otherwise(0)})
    # right at a cut: negatives up to it and positives after it; all positives with no cut at all
    agg = run.groupBy(*group).agg(F.max(F.col("neg") - F.col("pos")).alias("m"), F.max("pos").alias("p"), F.count("*").alias("n"))
    return agg.select(*group, (F.greatest(F.col("m"), F.lit(0)) + F.col("p")).cast("double").alias("right"), "n").select(*group, (F.col("right") / F.col("n")).alias("oracle"))


def average_precision(df: DataFrame, group: list[str], score: str, y: str) -> DataFrame:
    """(group, ap): precision at each distinct threshold, weighted by the recall it adds."""
    t = tied(df, group, score, y)
    whole = t.groupBy(*group).agg(F.sum("n").alias("n_all"), F.sum("pos").alias("pos_all"))
    precision = (F.col("pos_all") - F.col("pos_below")) / (F.col("n_all") - F.col("below"))
    return _attach(t, whole, group).groupBy(*group).agg(F.try_divide(F.sum(F.col("pos") * precision), F.first("pos_all")).alias("ap"))


def confusion(df: DataFrame, group: list[str], y: str, pred: str) -> DataFrame:
    c = lambda a, b: F.count_if((F.col(y) == a) & (F.col(pred) == b)).cast("double")
    return df.groupBy(*group).agg(c(1, 1).alias("tp"), c(0, 1).alias("fp"), c(1, 0).alias("fn"), c(0, 0).alias("tn"))


def class_metrics(conf: DataFrame) -> DataFrame:
    """Accuracy, balanced accuracy, precision, recall, F1 and Matthews correlation of confusion
    counts; what would divide by zero is 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    safe = lambda a, b: F.coalesce(F.try_divide(a, F.nullif(b, F.lit(0.0))), F.lit(0.0))
    recall, spec = safe(tp, tp + fn), safe(tn, tn + fp)
    return conf.withColumns({
        "accuracy": safe(tp + tn, tp + tn + fp + fn), "balanced": (recall + spec) / 2, "precision": safe(tp, tp + fp), "recall": recall,
        "f1": safe(2 * tp, 2 * tp + fp + fn), "mcc": safe(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
    })


def harmonic(*metrics: Column, floor: float = 1e-6) -> Column:
    """Harmonic mean of metrics, each taken as `floor` at least."""
    total = sum((F.lit(1.0) / F.greatest(m, F.lit(floor)) for m in metrics), F.lit(0.0))
    return F.lit(float(len(metrics))) / total


def metric_score(df: DataFrame, group: list[str], p: str, y: str, threshold: float = 0.5) -> DataFrame:
    """(group, auroc, ap, balanced, f1, mcc, quality) of probabilities: quality is the harmonic mean of area,
    average precision, balanced accuracy, F1 and the Matthews correlation brought to 0..1, the last
    three at the threshold. Null where a class is missing."""
    at = class_metrics(confusion(df.withColumn("__pred", (F.col(p) >= threshold).cast("int")), group, y, "__pred")).select(*group, "balanced", "f1", "mcc")
    ar, ap = area(df, group, p, y), average_precision(df, group, p, y)
    joined = _attach(_attach(at, ar, group), ap, group)
    parts = [F.col("auroc"), F.col("ap"), F.col("balanced"), F.col("f1"), (F.col("mcc") + 1) / 2]
    # greatest() passes over nulls, which are no metric of 0
    return joined.withColumn("quality", F.when(F.col("auroc").isNotNull() & F.col("ap").isNotNull(), harmonic(*parts)))


def grid_counts(df: DataFrame, score: str, y: str, cuts: list[float]) -> DataFrame:
    """(cut, tp, fp, fn, tn) of scores at or above each cut: rows are counted between cuts, then the
    counts are summed over the cuts, a table as long as the grid."""
    cuts = sorted(cuts)
    at = F.size(F.filter(F.array(*(F.lit(float(c)) for c in cuts)), lambda c: c <= F.col(score)))
    per = df.groupBy(at.alias("k")).agg(F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) == 0).alias("q"))
    grid = df.sparkSession.createDataFrame([(k + 1, c) for k, c in enumerate(cuts)], "k int, cut double")
    whole = per.agg(F.sum("p").alias("P"), F.sum("q").alias("Q"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("k"))
    joined = grid.join(per, "k", "left").select("k", "cut", F.sum(F.coalesce("p", F.lit(0))).over(w).alias("tp"), F.sum(F.coalesce("q", F.lit(0))).over(w).alias("fp")).crossJoin(F.broadcast(whole))
    return joined.select("cut", *(c.cast("double").alias(n) for n, c in (("tp", F.col("tp")), ("fp", F.col("fp")), ("fn", F.col("P") - F.col("tp")), ("tn", F.col("Q") - F.col("fp")))))


def best_threshold(df: DataFrame, score: str, y: str, quantiles: int, prior: float | None = None) -> DataFrame:
    """(cut, accuracy): the best of evenly spaced quantiles of the score, from 1 to 99 per cent, and one
    half, the first of equals. With a prior, classes are weighted to it."""
    cuts = spaced_percentiles(df, score, 0.01, 0.99, quantiles)
    c = grid_counts(df, score, y, sorted({*cuts, 0.5}))
    n, p = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"), F.col("tp") + F.col("fn")
    a, b = (F.lit(1.0), F.lit(1.0)) if prior is None else (prior / (p / n), (1 - prior) / (1 - p / n))
    acc = (a * F.col("tp") + b * F.col("tn")) / n
    return c.select("cut", acc.alias("accuracy")).orderBy(F.desc(F.round("accuracy", 12)), "cut").limit(1)


def composite_threshold(df: DataFrame, score: str, y: str) -> DataFrame:
    """(cut, value): the best of 281 cuts from 0.15 to 0.85 by 0.4 balanced accuracy, 0.3 F1 and 0.3
    Matthews correlation scaled to 0..1."""
    cuts = [0.15 + 0.7 * k / 280 for k in range(281)]
    m = class_metrics(grid_counts(df, score, y, cuts))
    value = 0.4 * F.col("balanced") + 0.3 * F.col("f1") + 0.3 * (F.col("mcc") + 1) / 2
    return m.select("cut", value.alias("value")).orderBy(F.desc(F.round("value", 12)), "cut").limit(1)


def spearman(df: DataFrame, group: list[str], a: str, b: str) -> DataFrame:
    """(group, rho): correlation of average ranks; NaN rows are dropped, fewer than three rows or a
    constant side give null."""
    clean = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & ~F.isnan(a) & ~F.isnan(b))
    ranked = average_ranks(average_ranks(clean, group, a, "__ra"), group, b, "__rb")
    agg = ranked.groupBy(*group).agg(F.count("*").alias("__n"), correlation("__ra", "__rb").alias("__c"))
    return agg.select(*group, F.when(F.col("__n") >= 3, F.col("__c")).alias("rho"))


def discordant(df: DataFrame, group: list[str], y: str, pred: str, base: str) -> DataFrame:
    """(group, gains, losses): rows right where the base is wrong, and the reverse."""
    right, was = F.col(pred) == F.col(y), F.col(base) == F.col(y)
    return df.groupBy(*group).agg(F.count_if(right & ~was).alias("gains"), F.count_if(~right & was).alias("losses"))


def running_best(df: DataFrame, group: list[str], order: str, value: str, name: str = "best") -> DataFrame:
    """`df` with the largest value so far. One row for each candidate of a group, a short list."""
    return df.withColumn(name, F.max(value).over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def budget_to(df: DataFrame, group: list[str], order: str, value: str, share: float) -> DataFrame:
    """(group, budget): the first place at which the running best reaches a share of the best."""
    run = running_best(df, group, order, value)
    top = df.groupBy(*group).agg(F.max(value).alias("__top"))
    return _attach(run, top, group).groupBy(*group).agg(F.min(F.when(F.col("best") >= share * F.col("__top"), F.col(order))).alias("budget"))


def recall_at(df: DataFrame, group: list[str], order: str, value: str, k: int) -> DataFrame:
    """`df` with the share of the group's top k values met so far."""
    top = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(value), order)) <= k
    return df.withColumn("__top", top.cast("int")).withColumn("recall", F.sum("__top").over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) / k).drop("__top")


def curvature(df: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """(group, curvature): largest absolute second difference on an uneven grid."""
    w = Window.partitionBy(*group).orderBy(x)
    a, b = F.col(x) - F.lag(x).over(w), F.lead(x).over(w) - F.col(x)
    second = 2 * ((F.lead(y).over(w) - F.col(y)) / b - (F.col(y) - F.lag(y).over(w)) / a) / (a + b)
    return df.withColumn("__c", second).groupBy(*group).agg(F.max(F.abs("__c")).alias("curvature"))


# ---- queries -------------------------------------------------------------------------------------
def scored(s, d) -> DataFrame:
    """Vectors with two scores, the first with many ties, and a probability."""
    v = vectors(s, d)
    return v.select("vec_id", "y", "source", "family", F.round(F.col("v")[0], 1).alias("score"), F.col("v")[1].alias("other"), (1 / (1 + F.exp(-F.col("v")[0]))).alias("p"))


_S = f"{VECTORS_SQL}, sc AS (SELECT vec_id, y, source, family, round(v[1], 1) AS score, v[2] AS other, 1 / (1 + exp(-v[1])) AS p FROM vec)"
_RANK = "rank() OVER (PARTITION BY {by} ORDER BY {s}) + (count(*) OVER (PARTITION BY {by}, {s}) - 1) / 2.0"
_QUOTA = f"{_S}, qu AS (SELECT *, CAST(row_number() OVER (PARTITION BY family ORDER BY score DESC, vec_id) <= round_even(count(*) OVER (PARTITION BY family) * (12::DOUBLE / 17), 0) AS INTEGER) AS pred, CAST(row_number() OVER (PARTITION BY family ORDER BY other DESC, vec_id) <= round_even(count(*) OVER (PARTITION BY family) * (12::DOUBLE / 17), 0) AS INTEGER) AS base FROM sc)"
_CONF = "count(*) FILTER (WHERE y = 1 AND {p} = 1)::DOUBLE AS tp, count(*) FILTER (WHERE y = 0 AND {p} = 1)::DOUBLE AS fp, count(*) FILTER (WHERE y = 1 AND {p} = 0)::DOUBLE AS fn, count(*) FILTER (WHERE y = 0 AND {p} = 0)::DOUBLE AS tn"
_MET = "coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0) AS accuracy, (coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2 AS balanced, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) AS mcc"
_AREA = f"{_S}, rk AS (SELECT *, {_RANK.format(by='family', s='score')} AS r FROM sc), ar AS (SELECT family, (sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0) / nullif(count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0), 0) AS auroc FROM rk GROUP BY 1)"


def _with_quota(s, d):
    q = quota(scored(s, d), ["family"], "score", "vec_id", PRIOR)
    return quota(q, ["family"], "other", "vec_id", PRIOR, "base")


def _curve(s, d):
    return table(s, d, "votes").filter("score is not null and not isnan(score)").withColumn("labels_0", F.coalesce(T.cleaned("labels_0"), F.lit("none"))).groupBy("labels_0", F.to_date("voted_at").alias("day")).agg(F.max("score").alias("value")).withColumn("budget", F.row_number().over(Window.partitionBy("labels_0").orderBy("day")))


_CURVE = "cv AS (SELECT *, row_number() OVER (PARTITION BY labels_0 ORDER BY day) AS budget FROM (SELECT coalesce(nullif(lower(trim(labels_0)), ''), 'none') AS labels_0, CAST(voted_at AS DATE) AS day, max(score) AS value FROM votes WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY 1, 2))"


def _ledger(s, d):
    return table(s, d, "ledger").distinct()


QUERIES = {
    "w01_average_ranks": lambda s, d: average_ranks(scored(s, d), [], "score").select("vec_id", "rank"),
    "w02_scaled_ranks": lambda s, d: scaled_ranks(scored(s, d), ["family"], "score").select("vec_id", rd("rank01").alias("rank01")),
    "w03_unaveraged_ranks": lambda s, d: places(scored(s, d), [], "score", "vec_id", False).crossJoin(F.broadcast(scored(s, d).agg(F.count("*").alias("n")))).select("vec_id", rd((F.col("place") - 1) / (F.col("n") - 1)).alias("rank01")),
    "w04_best_cut": lambda s, d: best_cut(scored(s, d), ["family"], "score", "vec_id", "y").select("family", rd("oracle").alias("oracle")),
    "w05_quota": lambda s, d: quota(scored(s, d), [], "score", "vec_id", PRIOR).select("vec_id", "pred"),
    "w08_arg_max": lambda s, d: first_by(scored(s, d).withColumn("far", -F.col("other")), ["family"], ["far", "vec_id"], ["y"]).select("family", "vec_id", "y"),
    "w10_running_best": lambda s, d: running_best(_curve(s, d), ["labels_0"], "budget", "value").select("labels_0", "budget", "best"),
    "w11_recall_at": lambda s, d: recall_at(_curve(s, d), ["labels_0"], "budget", "value", 5).select("labels_0", "budget", rd("recall").alias("recall")),
    "w12_budget_to": lambda s, d: budget_to(_curve(s, d), ["labels_0"], "budget", "value", 0.9),
    "w13_curvature": lambda s, d: curvature(_curve(s, d), ["labels_0"], "budget", "value").select("labels_0", rd("curvature").alias("curvature")),
    "w15_middle_and_last": lambda s, d: _curve(s, d).withColumn("n", F.count("*").over(Window.partitionBy("labels_0"))).groupBy("labels_0").agg(F.max(F.when(F.col("budget") == F.floor(F.col("n") / 2) + 1, F.col("value"))).alias("middle"), F.max(F.when(F.col("budget") == F.col("n"), F.col("value"))).alias("last"), rd(F.avg(F.when(F.col("budget") * 3 > F.col("n") * 2, F.col("value")))).alias("last_third")),
    "w16_latest_rows": lambda s, d: _ledger(s, d).withColumn("r", F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("utc"), F.desc_nulls_last("submission_id"), "zip"))).filter("r <= 2").select("owner", "utc", "submission_id"),
    "w17_leaderboard": lambda s, d: table(s, d, "source_hygiene").filter("rate_before is not null and n is not null").groupBy("source").agg(F.max("rate_before").alias("best"), F.sum("n").alias("n")).select("source", "best", F.bround(F.col("best") * F.col("n")).cast("long").alias("correct"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("best"), "source")).alias("place")),
    "w18_spearman": lambda s, d: spearman(scored(s, d), ["family"], "score", "other").select("family", rd("rho").alias("rho")),
    "w18_pearson": lambda s, d: scored(s, d).groupBy("family").agg(correlation("score", "other").alias("c")).select("family", rd("c").alias("r")),
    "m01_quota_accuracy": lambda s, d: _with_quota(s, d).groupBy("family").agg(rd(F.avg((F.col("pred") == F.col("y")).cast("double"))).alias("accuracy")),
    "m02_auroc": lambda s, d: area(scored(s, d), ["family"], "score", "y").select("family", rd("auroc").alias("auroc")),
    "m03_oracle": lambda s, d: best_cut(scored(s, d), [], "other", "vec_id", "y").select(rd("oracle").alias("oracle")),
    "m05_average_precision": lambda s, d: average_precision(scored(s, d), ["family"], "score", "y").select("family", rd("ap").alias("ap")),
    "m05_class_metrics": lambda s, d: class_metrics(confusion(_with_quota(s, d), ["family"], "y", "pred")).select("family", *(rd(c).alias(c) for c in ("accuracy", "balanced", "precision", "recall", "f1", "mcc"))),
    "m06_harmonic": lambda s, d: metric_score(scored(s, d).withColumn("q", F.round("p", 9)), ["family"], "q", "y").select("family", rd("quality").alias("harmonic")),
    "m07_best_threshold": lambda s, d: best_threshold(scored(s, d), "p", "y", 199).select(rd("cut").alias("cut"), rd("accuracy").alias("accuracy")),
    "m08_prior_threshold": lambda s, d: best_threshold(scored(s, d), "p", "y", 399, PRIOR).select(rd("cut").alias("cut"), rd("accuracy").alias("accuracy")),
    "m09_composite_threshold": lambda s, d: composite_threshold(scored(s, d), "p", "y").select(rd("cut").alias("cut"), rd("value").alias("value")),
    "m10_selection_score": lambda s, d: area(scored(s, d), ["family"], "score", "y").join(average_precision(scored(s, d), ["family"], "score", "y"), "family").join(class_metrics(confusion(_with_quota(s, d), ["family"], "y", "pred")), "family").select("family", rd((F.col("auroc") + F.col("ap") + F.col("balanced")) / 3).alias("value")),
    "m15_bootstrap_interval": lambda s, d: SAMPLING["d18_bootstrap"](s, d).agg(rd(F.percentile("mean", 0.025)).alias("low"), rd(F.percentile("mean", 0.975)).alias("high")),
    "m15_bootstrap_interval_whole": lambda s, d: SAMPLING["d18_bootstrap_whole"](s, d).agg(rd(F.percentile("mean", 0.025)).alias("low"), rd(F.percentile("mean", 0.975)).alias("high")),
    "a25_confusion": lambda s, d: confusion(_with_quota(s, d), [], "y", "pred"),
    "a26_gains_losses": lambda s, d: discordant(_with_quota(s, d), ["family"], "y", "pred", "base"),
    "c06_threshold": lambda s, d: scored(s, d).groupBy("family").agg(F.count_if(F.col("p") >= 1 - PRIOR).alias("positives")),
    "c12_quota_variants": lambda s, d: places(scored(s, d), [], "score", "vec_id").agg(*(F.count_if((F.col("place") <= k) & (F.col("y") == 1)).alias(f"hits_{k}") for k in (120, 125, 130))),
    "c13_baselines": lambda s, d: scored(s, d).agg(F.avg(F.col("y").cast("double")).alias("r")).select(rd("r").alias("all_positive"), rd(2 * F.col("r") * F.col("r") - 2 * F.col("r") + 1).alias("random_quota")),
}

_GRID = """g AS (SELECT DISTINCT cut FROM (SELECT unnest(list_append(quantile_cont(p, list_transform(range(0, {k}), lambda i: 0.01::DOUBLE + i * 0.98::DOUBLE / ({k} - 1))), 0.5)) AS cut FROM sc)),
c AS (SELECT cut, count(*) FILTER (WHERE y = 1 AND p >= cut)::DOUBLE AS tp, count(*) FILTER (WHERE y = 0 AND p < cut)::DOUBLE AS tn, count(*) AS n, count(*) FILTER (WHERE y = 1)::DOUBLE AS pos FROM sc, g GROUP BY 1)"""
SQL = {
    "w01_average_ranks": f"WITH {_S} SELECT vec_id, (rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0)::DOUBLE AS rank FROM sc",
    "w02_scaled_ranks": f"WITH {_S} SELECT vec_id, round(CASE WHEN count(*) OVER (PARTITION BY family) > 1 THEN ({_RANK.format(by='family', s='score')} - 1)::DOUBLE / (count(*) OVER (PARTITION BY family) - 1) ELSE 0 END, 6) AS rank01 FROM sc",
    "w03_unaveraged_ranks": f"WITH {_S} SELECT vec_id, round((row_number() OVER (ORDER BY score, vec_id) - 1)::DOUBLE / (count(*) OVER () - 1), 6) AS rank01 FROM sc",
    "w04_best_cut": f"WITH {_S}, r AS (SELECT family, sum(CASE WHEN y = 0 THEN 1 ELSE -1 END) OVER (PARTITION BY family ORDER BY score, vec_id ROWS UNBOUNDED PRECEDING) AS m, y FROM sc) SELECT family, round((greatest(max(m), 0) + sum(y))::DOUBLE / count(*), 6) AS oracle FROM r GROUP BY 1",
    "w05_quota": f"WITH {_S} SELECT vec_id, CAST(row_number() OVER (ORDER BY score DESC, vec_id) <= round_even(count(*) OVER () * (12::DOUBLE / 17), 0) AS INTEGER) AS pred FROM sc",
    "w08_arg_max": f"WITH {_S} SELECT family, vec_id, y FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY other DESC, vec_id) AS r FROM sc) WHERE r = 1",
    "w10_running_best": f"WITH {_CURVE} SELECT labels_0, CAST(budget AS INTEGER) AS budget, max(value) OVER (PARTITION BY labels_0 ORDER BY budget) AS best FROM cv",
    "w11_recall_at": f"WITH {_CURVE}, t AS (SELECT *, CAST(row_number() OVER (PARTITION BY labels_0 ORDER BY value DESC, budget) <= 5 AS INTEGER) AS top FROM cv) SELECT labels_0, CAST(budget AS INTEGER) AS budget, round(sum(top) OVER (PARTITION BY labels_0 ORDER BY budget) / 5.0::DOUBLE, 6) AS recall FROM t",
    "w12_budget_to": f"WITH {_CURVE}, r AS (SELECT *, max(value) OVER (PARTITION BY labels_0 ORDER BY budget) AS best, max(value) OVER (PARTITION BY labels_0) AS top FROM cv) SELECT labels_0, CAST(min(budget) FILTER (WHERE best >= 0.9::DOUBLE * top) AS INTEGER) AS budget FROM r GROUP BY 1",
    "w13_curvature": f"WITH {_CURVE}, r AS (SELECT labels_0, 2 * ((lead(value) OVER w - value) / (lead(budget) OVER w - budget) - (value - lag(value) OVER w) / (budget - lag(budget) OVER w)) / (lead(budget) OVER w - lag(budget) OVER w) AS c FROM cv WINDOW w AS (PARTITION BY labels_0 ORDER BY budget)) SELECT labels_0, round(max(abs(c)), 6) AS curvature FROM r GROUP BY 1",
    "w15_middle_and_last": f"WITH {_CURVE}, r AS (SELECT *, count(*) OVER (PARTITION BY labels_0) AS n FROM cv) SELECT labels_0, max(value) FILTER (WHERE budget = n // 2 + 1) AS middle, max(value) FILTER (WHERE budget = n) AS last, round(avg(value) FILTER (WHERE budget * 3 > n * 2), 6) AS last_third FROM r GROUP BY 1",
    "w16_latest_rows": "SELECT owner, utc, submission_id FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY utc DESC, submission_id DESC NULLS LAST, zip) AS r FROM (SELECT DISTINCT * FROM ledger)) WHERE r <= 2",
    "w17_leaderboard": "SELECT source, best, CAST(round_even(best * n, 0) AS BIGINT) AS correct, CAST(row_number() OVER (ORDER BY best DESC, source) AS INTEGER) AS place FROM (SELECT source, max(rate_before) AS best, sum(n)::DOUBLE AS n FROM source_hygiene WHERE rate_before IS NOT NULL AND n IS NOT NULL GROUP BY 1)",
    "w18_spearman": f"WITH {_S}, r AS (SELECT family, {_RANK.format(by='family', s='score')} AS a, {_RANK.format(by='family', s='other')} AS b FROM sc) SELECT family, CASE WHEN count(*) >= 3 AND isfinite(corr(a, b)) THEN round(corr(a, b), 6) END AS rho FROM r GROUP BY 1",
    "w18_pearson": f"WITH {_S} SELECT family, CASE WHEN isfinite(corr(score, other)) THEN round(corr(score, other), 6) END AS r FROM sc GROUP BY 1",
    "m01_quota_accuracy": f"WITH {_QUOTA} SELECT family, round(avg(CASE WHEN pred = y THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM qu GROUP BY 1",
    "m02_auroc": f"WITH {_AREA} SELECT family, round(auroc, 6) AS auroc FROM ar",
    "m03_oracle": f"WITH {_S}, r AS (SELECT sum(CASE WHEN y = 0 THEN 1 ELSE -1 END) OVER (ORDER BY other, vec_id ROWS UNBOUNDED PRECEDING) AS m, y FROM sc) SELECT round((greatest(max(m), 0) + sum(y))::DOUBLE / count(*), 6) AS oracle FROM r",
    "m05_average_precision": f"WITH {_S}, t AS (SELECT family, score, count(*) AS n, sum(y) AS pos FROM sc GROUP BY 1, 2), u AS (SELECT *, sum(n) OVER w AS cn, sum(pos) OVER w AS cp, sum(pos) OVER (PARTITION BY family) AS P FROM t WINDOW w AS (PARTITION BY family ORDER BY score DESC)) SELECT family, round(CASE WHEN max(P) > 0 THEN sum(pos * cp::DOUBLE / cn) / max(P) END, 6) AS ap FROM u GROUP BY 1",
    "m05_class_metrics": f"WITH {_QUOTA}, cf AS (SELECT family, {_CONF.format(p='pred')} FROM qu GROUP BY 1), me AS (SELECT family, {_MET} FROM cf) SELECT family, round(accuracy, 6) AS accuracy, round(balanced, 6) AS balanced, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(mcc, 6) AS mcc FROM me",
    "m06_harmonic": f"WITH {_S}, sq AS (SELECT *, round(p, 9) AS q FROM sc), cf AS (SELECT family, count(*) FILTER (WHERE y = 1 AND q >= 0.5)::DOUBLE AS tp, count(*) FILTER (WHERE y = 0 AND q >= 0.5)::DOUBLE AS fp, count(*) FILTER (WHERE y = 1 AND q < 0.5)::DOUBLE AS fn, count(*) FILTER (WHERE y = 0 AND q < 0.5)::DOUBLE AS tn FROM sq GROUP BY 1), me AS (SELECT family, {_MET} FROM cf), rk AS (SELECT *, {_RANK.format(by='family', s='q')} AS r FROM sq), ar AS (SELECT family, (sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0) / nullif(count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0), 0) AS auroc FROM rk GROUP BY 1), t AS (SELECT family, q, count(*) AS n, sum(y) AS pos FROM sq GROUP BY 1, 2), u AS (SELECT *, sum(n) OVER w AS cn, sum(pos) OVER w AS cp, sum(pos) OVER (PARTITION BY family) AS P FROM t WINDOW w AS (PARTITION BY family ORDER BY q DESC)), ap AS (SELECT family, CASE WHEN max(P) > 0 THEN sum(pos * cp::DOUBLE / cn) / max(P) END AS ap FROM u GROUP BY 1) SELECT family, round(CASE WHEN auroc IS NULL OR ap IS NULL THEN NULL ELSE 5 / (1 / greatest(auroc, 1e-6) + 1 / greatest(ap, 1e-6) + 1 / greatest(balanced, 1e-6) + 1 / greatest(f1, 1e-6) + 1 / greatest((mcc + 1) / 2, 1e-6)) END, 6) AS harmonic FROM ar JOIN ap USING (family) JOIN me USING (family)",
    "m07_best_threshold": f"WITH {_S}, {_GRID.format(k=199)} SELECT round(cut, 6) AS cut, round((tp + tn) / n, 6) AS accuracy FROM c ORDER BY round((tp + tn) / n, 12) DESC, c.cut LIMIT 1",
    "m08_prior_threshold": f"WITH {_S}, {_GRID.format(k=399)}, x AS (SELECT cut AS ct, (12::DOUBLE / 17 / (pos / n) * tp + (1 - 12::DOUBLE / 17) / (1 - pos / n) * tn) / n AS acc FROM c) SELECT round(ct, 6) AS cut, round(acc, 6) AS accuracy FROM x ORDER BY round(acc, 12) DESC, ct LIMIT 1",
    "m09_composite_threshold": f"WITH {_S}, g AS (SELECT 0.15::DOUBLE + 0.7::DOUBLE * k / 280 AS cut FROM range(0, 281) t(k)), cf AS (SELECT cut AS ct, count(*) FILTER (WHERE y = 1 AND p >= cut)::DOUBLE AS tp, count(*) FILTER (WHERE y = 0 AND p >= cut)::DOUBLE AS fp, count(*) FILTER (WHERE y = 1 AND p < cut)::DOUBLE AS fn, count(*) FILTER (WHERE y = 0 AND p < cut)::DOUBLE AS tn FROM sc, g GROUP BY 1), me AS (SELECT ct, {_MET} FROM cf), v AS (SELECT ct, 0.4::DOUBLE * balanced + 0.3::DOUBLE * f1 + 0.3::DOUBLE * (mcc + 1) / 2 AS val FROM me) SELECT round(ct, 6) AS cut, round(val, 6) AS value FROM v ORDER BY round(val, 12) DESC, ct LIMIT 1",
    "m10_selection_score": f"WITH {_QUOTA}, cf AS (SELECT family, {_CONF.format(p='pred')} FROM qu GROUP BY 1), me AS (SELECT family, {_MET} FROM cf), rk AS (SELECT *, {_RANK.format(by='family', s='score')} AS r FROM sc), ar AS (SELECT family, (sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0) / nullif(count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0), 0) AS auroc FROM rk GROUP BY 1), t AS (SELECT family, score, count(*) AS n, sum(y) AS pos FROM sc GROUP BY 1, 2), u AS (SELECT *, sum(n) OVER w AS cn, sum(pos) OVER w AS cp, sum(pos) OVER (PARTITION BY family) AS P FROM t WINDOW w AS (PARTITION BY family ORDER BY score DESC)), ap AS (SELECT family, CASE WHEN max(P) > 0 THEN sum(pos * cp::DOUBLE / cn) / max(P) END AS ap FROM u GROUP BY 1) SELECT family, round((auroc + ap + balanced) / 3, 6) AS value FROM ar JOIN ap USING (family) JOIN me USING (family)",
    "a25_confusion": f"WITH {_QUOTA} SELECT {_CONF.format(p='pred')} FROM qu",
    "a26_gains_losses": f"WITH {_QUOTA} SELECT family, count(*) FILTER (WHERE pred = y AND base <> y) AS gains, count(*) FILTER (WHERE pred <> y AND base = y) AS losses FROM qu GROUP BY 1",
    "c06_threshold": f"WITH {_S} SELECT family, count(*) FILTER (WHERE p >= 1 - 12::DOUBLE / 17) AS positives FROM sc GROUP BY 1",
    "c12_quota_variants": f"WITH {_S}, r AS (SELECT y, row_number() OVER (ORDER BY score DESC, vec_id) AS place FROM sc) SELECT count(*) FILTER (WHERE place <= 120 AND y = 1) AS hits_120, count(*) FILTER (WHERE place <= 125 AND y = 1) AS hits_125, count(*) FILTER (WHERE place <= 130 AND y = 1) AS hits_130 FROM r",
    "c13_baselines": f"WITH {_S}, r AS (SELECT avg(y::DOUBLE) AS r FROM sc) SELECT round(r, 6) AS all_positive, round(2 * r * r - 2 * r + 1, 6) AS random_quota FROM r",
    "m15_bootstrap_interval": f"SELECT round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM ({SAMPLING_SQL['d18_bootstrap']})",
}
SQL["m15_bootstrap_interval_whole"] = SQL["m15_bootstrap_interval"]
