"""Evaluation over families, ranking of recipes, candidates and ensembles: E01-E14, A08, A09, W07,
W09, W14, R04, and iterative or library-backed heads: H03, H06-H09, H12, H16, V06, V07, V16."""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import vectors as V
from plumbline.operators import moments as M
from plumbline.operators import sampling as D
from plumbline.operators.ranking_ops import area, best_cut, best_threshold, class_metrics, confusion, metric_score, quota, spearman
from plumbline.plans.ranking import nth_by_hex
from plumbline.plans.staging import stage
from plumbline.plans.tables import VECTORS_SQL, correlation, rd, table, vectors

PRIOR = 12 / 17
#: Probes of the grid and their settings: shrinkage, nothing, C.
PROBES = [*(("lda", h) for h in (0.02, 0.1, 0.3, 0.6, 0.9)), ("dom", 0.0), ("logistic", 0.002), ("logistic", 0.05)]
GRID = [(t, p, h) for t in M.TRANSFORMS for p, h in PROBES]
#: The part of the grid that one pass over the rows fits and that removes nothing from them.
RECIPES = [("raw", "dom", 0.0), ("raw", "lda", 0.1), ("raw", "lda", 0.6), ("l2", "dom", 0.0), ("l2", "lda", 0.1), ("l2", "lda", 0.6)]
#: The grid by which candidates are ranked.
FOCUSED = [(t, p, h) for t in ("raw", "std", "l2+std") for p, h in (("lda", 0.1), ("lda", 0.3), ("lda", 0.6), ("lda", 0.9), ("logistic", 0.002), ("dom", 0.0))]


class Fold(NamedTuple):
    """Families kept out of training, the statistics of all others and of the rows to be scored."""

    held: tuple[str, ...]
    rest: M.ClassStats
    tested: M.ClassStats


def recipe_key(transform: str, probe: str, hyper: float) -> str:
    return f"{transform}|{probe}|{hyper:g}"


def _total(parts: dict[str, M.ClassStats]) -> M.ClassStats:
    return M.ClassStats([(y, p.n[y], p.s[y], p.g[y]) for p in parts.values() for y in (0, 1)])


def _views(df: DataFrame, recipes: list[tuple[str, str, float]]) -> dict[bool, DataFrame]:
    """The rows as they are and scaled to length 1, as far as the recipes need them; whatever else a
    transform does is affine, so that its head becomes one on these."""
    made = {False: df, True: df.withColumn("v", V.row_l2("v"))}
    return {l2: made[l2] for l2 in dict.fromkeys(M.TRANSFORMS[r[0]][0] for r in recipes)}


def _affine(transform: str, fold: Fold) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(a, c) such that a @ (v - c) is the transformed training row; the same of a scored row."""
    _, standard, remove = M.TRANSFORMS[transform]
    d = len(fold.rest.s[0])
    if not standard:
        return ((np.eye(d), np.zeros(d)),) * 2
    c, scale = fold.rest.center_and_scale()
    a = np.diag(1 / scale)
    if remove:
        z = fold.rest.mapped(a, c)
        top = M.top_components((z.g[0] + z.g[1]) / sum(z.n.values()), min(remove, sum(z.n.values()) - 1))
        a = a - top.T @ top @ a
    if standard != "batch":
        return ((a, c),) * 2
    own, scale = fold.tested.center_and_scale()
    return (a, c), (np.diag(1 / scale), own)


def logistic_fits(df: DataFrame, fits: list[tuple[tuple[str, ...], np.ndarray, np.ndarray, float]], tol: float = 1e-7, most: int = 200) -> list[tuple[np.ndarray, float]]:
    """(w, b) for each (held, a, c, C): the logistic head on the rows a @ (v - c) of all families but
    the held, least w @ w / 2 + C * loss with a free intercept. Newton steps, halved where they
    don't lower the loss, until no slope is above `tol` for each row. One pass serves a step of all
    fits that aren't done, and returns d + 1 and (d + 1)^2 sums for each."""
    if not fits:
        return []
    d = len(fits[0][2])
    maps = []
    for _, a, c, _ in fits:  # from (w, b) of transformed rows to weights and intercept of the rows
        m = np.zeros((d + 1, d + 1))
        m[:d, :d], m[d, :d], m[d, d] = a.T, -(a @ c), 1
        maps.append(m)
    x = stage(df.select("family", F.col("y").cast("int").alias("y"), F.col("v").cast("array<double>").alias("v")), "logistic")
    sums = "k int, n long, loss double, g array<double>, h array<double>"

    def totals(at: dict[int, np.ndarray]) -> dict[int, tuple]:
        by: dict[tuple[str, ...], list[int]] = {}
        for k in at:
            by.setdefault(fits[k][0], []).append(k)
        by_held = [(held, ks, np.array([maps[k] @ at[k] for k in ks])) for held, ks in by.items()]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got: dict[int, list] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                v, y = np.c_[v, np.ones(len(v))], batch.column("y").to_numpy(zero_copy_only=False)
                family = np.array(batch.column("family").to_pylist(), dtype=object)
                for held, ks, w in by_held:
                    use = ~np.isin(family, held)
                    u, t = v[use], y[use, None]
                    m = u @ w.T
                    p = 0.5 * (1 + np.tanh(m / 2))
                    loss, g, s = (np.logaddexp(0, m) - t * m).sum(0), (p - t).T @ u, p * (1 - p)
                    for j, k in enumerate(ks):
                        one = got.setdefault(k, [0, 0.0, np.zeros(d + 1), np.zeros((d + 1, d + 1))])
                        one[0] += len(u)
                        one[1] += loss[j]
                        one[2] += g[j]
                        one[3] += (u * s[:, j : j + 1]).T @ u
            yield _sums(got)

        def add(t: pa.Table) -> pa.Table:
            g = t.column("g").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1).sum(0)
            h = t.column("h").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1).sum(0)
            return pa.Table.from_batches([_sums({t.column("k")[0].as_py(): [sum(t.column("n").to_pylist()), sum(t.column("loss").to_pylist()), g, h]})])

        return {r["k"]: (r["n"], r["loss"], np.array(r["g"]), np.array(r["h"]).reshape(d + 1, d + 1)) for r in x.mapInArrow(run, sums).groupBy("k").applyInArrow(add, sums).collect()}

    ridge = np.diag([1.0] * d + [0.0])
    best: dict[int, tuple] = {}  # the lowest point so far: (value, weights, slope, curvature)
    step = {k: np.zeros(d + 1) for k in range(len(fits))}
    done: dict[int, np.ndarray] = {}
    for _ in range(most):
        at = {k: s if k not in best else best[k][1] + s for k, s in step.items()}
        for k, (n, loss, g, h) in totals(at).items():
            w, m, big_c = at[k], maps[k], fits[k][3]
            value = w @ ridge @ w / 2 + big_c * loss
            if k in best and value > best[k][0] + 1e-12 * abs(best[k][0]):
                step[k] = step[k] / 2
                continue
            slope, curve = ridge @ w + big_c * m.T @ g, ridge + big_c * m.T @ h @ m
            best[k] = (value, w, slope, curve)
            step[k] = -np.linalg.lstsq(curve, slope, rcond=None)[0]
            if np.abs(slope).max() <= tol * big_c * n:
                done[k] = w
                del step[k]
        if not step:
            return [(done[k][:d], float(done[k][d])) for k in range(len(fits))]
    raise RuntimeError(f"{len(step)} logistic heads not fitted after {most} passes")


def _sums(got: dict[int, list]) -> pa.RecordBatch:
    flat = [pa.array([np.asarray(r[j]).ravel().tolist() for r in got.values()], pa.list_(pa.float64())) for j in (2, 3)]
    return pa.RecordBatch.from_arrays([pa.array(list(got), pa.int32()), pa.array([r[0] for r in got.values()], pa.int64()), pa.array([float(r[1]) for r in got.values()], pa.float64()), *flat], names=["k", "n", "loss", "g", "h"])


def _heads(view: DataFrame, folds: dict[str, Fold], recipes: list[tuple[str, str, float]]) -> list[tuple[str, str, list[float], float]]:
    """(fold, recipe, w, b) of every fold and recipe, as heads on the rows of the view."""
    fitted, wanted = [], {}
    for name, fold in folds.items():
        for t in dict.fromkeys(r[0] for r in recipes):
            train, test = _affine(t, fold)
            stats = fold.rest.mapped(*train)
            for r in recipes:
                if r[0] != t:
                    continue
                if r[1] == "logistic":
                    # transforms that differ in scored rows only share their fit
                    key = (fold.held, "std" if t in ("std", "batchstd") else "l2+std" if t in ("l2+std", "l2+batchstd") else t, r[2])
                    wanted.setdefault(key, (fold.held, *train, r[2]))
                    fitted.append((name, r, test, key))
                else:
                    fitted.append((name, r, test, M.mean_difference(stats) if r[1] == "dom" else M.shrunk_lda(stats, r[2])))
    fits = dict(zip(wanted, logistic_fits(view, list(wanted.values()))))
    out = []
    for name, r, (a, c), head in fitted:
        w, b = head if isinstance(head[0], np.ndarray) else fits[head]
        w = a.T @ w
        out.append((name, recipe_key(*r), w.tolist(), float(b - w @ c)))
    return out


def held_out_scores(df: DataFrame, recipes: list[tuple[str, str, float]], least_test: int = 20, least_train: int = 100) -> DataFrame:
    """(recipe, family, vec_id, y, score): every row scored by heads fitted without its family. The
    statistics of all folds come from one pass: a fold's are the total less its family's. Only
    logistic heads need further passes."""
    out = None
    for l2, view in _views(df, recipes).items():
        parts = M.ClassStats.by(view, "family")
        total = _total(parts)
        folds = {}
        for family, part in parts.items():
            rest = total.without(part)
            if sum(part.n.values()) < least_test or sum(rest.n.values()) < least_train or min(rest.n.values()) == 0:
                continue
            folds[family] = Fold((family,), rest, part)
        heads = _heads(view, folds, [r for r in recipes if M.TRANSFORMS[r[0]][0] == l2])
        h = df.sparkSession.createDataFrame(heads, "family string, recipe string, w array<double>, b double")
        # heads: folds x recipes rows
        part = view.join(F.broadcast(h), "family").select("recipe", "family", "vec_id", "y", F.round(V.dot("v", "w") + F.col("b"), 9).alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


def fold_facts(scores: DataFrame, rate: float = PRIOR, fold: str = "family") -> DataFrame:
    """(recipe, fold, accuracy, auroc, oracle) of scores by quota, rank and best cut."""
    by = ["recipe", fold]
    scores = stage(scores, "scores")
    acc = quota(scores, by, "score", "vec_id", rate).groupBy(*by).agg(F.avg((F.col("pred") == F.col("y")).cast("double")).alias("accuracy"))
    return acc.join(area(scores, by, "score", "y"), by).join(best_cut(scores, by, "score", "vec_id", "y"), by)


def fold_summary(facts: DataFrame, fold: str = "family") -> DataFrame:
    """Mean, least and population deviation over folds; folds without an area don't count in it."""
    return facts.groupBy("recipe").agg(F.count("*").alias("folds"), F.avg("accuracy").alias("mean_accuracy"), F.min("accuracy").alias("worst_accuracy"), F.stddev_pop("accuracy").alias("sd_accuracy"), F.avg("auroc").alias("mean_auroc"), F.min("auroc").alias("worst_auroc"))


def ranked_recipes(summary: DataFrame, folds: int) -> DataFrame:
    """Recipes by completeness, mean and worst area, then mean accuracy: (recipe, place)."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc(F.col("folds") == folds), F.desc(F.round("mean_auroc", 9)), F.desc(F.round("worst_auroc", 9)), F.desc(F.round("mean_accuracy", 9)), "recipe")  # one row for each recipe
    return summary.withColumn("place", F.row_number().over(w))


def ranked_pairs(summary: DataFrame) -> DataFrame:
    """Recipes of the cross-source test by worst, then mean accuracy."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc(F.round("worst_accuracy", 9)), F.desc(F.round("mean_accuracy", 9)), "recipe")
    return summary.withColumn("place", F.row_number().over(w))


def first_per_transform(ranked: DataFrame, most: int = 3) -> DataFrame:
    """The best recipe of each transform, at most three of them."""
    t = ranked.withColumn("transform", F.split("recipe", "[|]")[0])
    top = t.withColumn("r", F.row_number().over(Window.partitionBy("transform").orderBy("place"))).filter("r = 1")
    return top.orderBy("place").limit(most).select("transform", "recipe", "place")


def cross_source_scores(df: DataFrame, recipes: list[tuple[str, str, float]], least_pos: int = 5, least_neg: int = 5) -> DataFrame:
    """(recipe, pair, vec_id, y, score): positives of a family with the negatives of the next, scored
    by heads fitted on all other families."""
    pairs = [(r["pos_family"], r["neg_family"]) for r in D.cross_pairs(df, "family", "y", least_pos, least_neg).collect()]  # one for each family
    out = None
    for l2, view in _views(df, recipes).items():
        parts = M.ClassStats.by(view, "family")
        total = _total(parts)
        folds = {}
        for a, b in pairs:
            rest = total.without(parts[a]).without(parts[b]) if a != b else total.without(parts[a])
            tested = M.ClassStats([(y, parts[f].n[y], parts[f].s[y], parts[f].g[y]) for f, y in ((a, 1), (b, 0))])
            folds[f"{a}>{b}"] = Fold(tuple(dict.fromkeys((a, b))), rest, tested)
        heads = _heads(view, folds, [r for r in recipes if M.TRANSFORMS[r[0]][0] == l2])
        sides = {f"{a}>{b}": ((a, 1), (b, 0)) for a, b in pairs}
        h = df.sparkSession.createDataFrame([(f, y, *head) for head in heads for f, y in sides[head[0]]], "family string, y int, pair string, recipe string, w array<double>, b double")
        part = view.join(F.broadcast(h), ["family", "y"]).select("recipe", "pair", "vec_id", "y", F.round(V.dot("v", "w") + F.col("b"), 9).alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


def report(summary: DataFrame, baseline: float) -> DataFrame:
    """Each recipe's gain over the baseline and whether its worst fold clears it."""
    return summary.select("recipe", (F.col("mean_accuracy") - baseline).alias("delta"), (F.col("worst_accuracy") > baseline).alias("clears"))


def report_lines(ranked: DataFrame, baseline: float, top: int = 15) -> DataFrame:
    """(line, text): the best recipes with their worst and mean accuracy and areas, how far the worst fold
    is from the baseline, and how many of all recipes clear it there. `top` is the report's length."""
    gap = F.round(F.col("worst_accuracy") - baseline, 6)
    text = F.format_string("%-34s%8.4f%8.4f%8.4f%8.4f%8.4f  %+.4f%s", "recipe", "worst_accuracy", "mean_accuracy", "sd_accuracy", "mean_auroc", "worst_auroc", gap, F.when(gap < 0, " below").otherwise(""))
    rows = ranked.filter(F.col("place") <= top).select(F.col("place").cast("int").alias("line"), text.alias("text"))
    last = ranked.agg(F.count_if(gap >= 0).alias("c"), F.count("*").alias("n"))
    return rows.unionByName(last.select(F.lit(top + 1).alias("line"), F.format_string("%d/%d recipes clear the baseline on their worst fold", "c", "n").alias("text")))


def gate(ranked: DataFrame, baseline: float) -> DataFrame:
    """Recipes with their verdict by the mean fold: shipped or skipped."""
    return ranked.select("recipe", "place", F.when(F.col("mean_accuracy") >= baseline, "shipped").otherwise("skipped").alias("verdict"))


def candidates(df: DataFrame, facts: DataFrame, cross: DataFrame | None, baseline: float = PRIOR, least_rows: int = 1500, members: int = 3) -> DataFrame:
    """(name, recipe, worst, mean, pooled, trained_rows, verdict, reason): the heads to be built. The best
    recipe; the best logistic one, for a threshold; the best of the cross-source test, if it is another;
    the best recipes of different transforms together; and one head for each family with enough rows
    and both classes, with what the pooled recipe reaches on it. What stays below the baseline by its
    mean fold is skipped. `facts` as from fold_facts, `cross` a summary over pairs; both are as long as
    the grid and the families, and so is the result."""
    facts = stage(facts, "facts")
    ranked = ranked_recipes(fold_summary(facts), facts.select("family").distinct().count()).orderBy("place").collect()  # one for each recipe
    if not ranked:
        raise ValueError("no recipe was evaluated")
    counts = {r["family"]: (r["n"], r["p"]) for r in df.groupBy("family").agg(F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("p")).collect()}  # one for each family
    whole = sum(n for n, _ in counts.values())
    best = ranked[0]
    rows: list[list] = [["best_single", best["recipe"], best["worst_accuracy"], best["mean_accuracy"], None, whole]]
    logistic = [r for r in ranked if r["recipe"].split("|")[1] == "logistic"]
    if logistic:
        rows.append(["best_threshold", logistic[0]["recipe"], logistic[0]["worst_accuracy"], logistic[0]["mean_accuracy"], None, whole])
    if cross is not None:
        first = ranked_pairs(cross).filter("place = 1").first()
        if first and (first["recipe"] != best["recipe"] or first["mean_accuracy"] < baseline):
            rows.append(["best_cross_source", first["recipe"], first["worst_accuracy"], first["mean_accuracy"], None, whole])
    picked = list({r["recipe"].split("|")[0]: r for r in reversed(ranked)}.values())
    picked = sorted(picked, key=lambda r: r["place"])[:members]
    if len(picked) > 1:
        rows.append(["best_ensemble", " + ".join(r["recipe"] for r in picked), min(r["worst_accuracy"] for r in picked), float(np.mean([r["mean_accuracy"] for r in picked])), None, whole])
    pooled = {r["family"]: r["accuracy"] for r in facts.filter(F.col("recipe") == best["recipe"]).collect()}
    for family in sorted(counts):
        n, p = counts[family]
        if n >= least_rows and 0 < p < n:
            rows.append([f"source_{family}", best["recipe"], None, None, pooled.get(family), n])
    out = []
    for r in rows:
        below = r[3] is not None and r[3] < baseline
        out.append((*r, "skipped" if below else "built", f"mean fold {r[3]:.4f} below the baseline {baseline:.4f}" if below else None))
    return df.sparkSession.createDataFrame(out, "name string, recipe string, worst double, mean double, pooled double, trained_rows long, verdict string, reason string")


def coarse_configs(spark, dims: int, scalers: list[str], ks: list[int], probes: list[str]) -> DataFrame:
    """The product of settings, without those that want more dimensions than there are."""
    a = spark.createDataFrame([(x,) for x in scalers], "scaler string")
    b = spark.createDataFrame([(x,) for x in ks], "k int").filter(F.col("k") <= dims)
    c = spark.createDataFrame([(x,) for x in probes], "probe string")
    return a.crossJoin(b).crossJoin(c)


def out_of_fold(df: DataFrame, shrinkage: float, reps: int = 2, k: int = 5) -> DataFrame:
    """(vec_id, y, score): mean over repeats of scores by heads fitted on the other folds."""
    out = None
    for rep in range(reps):
        f = D.folds(df.withColumn("o", F.sha1(F.concat(F.lit(f"{rep}:"), F.col("vec_id").cast("string")).cast("binary"))), "y", "o", "vec_id", k).withColumn("fold", F.col("fold").cast("string"))
        parts = M.ClassStats.by(f, "fold")
        total = _total(parts)
        heads = [(fold, *(lambda wb: (wb[0].tolist(), wb[1]))(M.shrunk_lda(total.without(p), shrinkage))) for fold, p in parts.items()]
        h = df.sparkSession.createDataFrame(heads, "fold string, w array<double>, b double")
        part = f.join(F.broadcast(h), "fold").select("vec_id", "y", (V.dot("v", "w") + F.col("b")).alias("score"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("vec_id", "y").agg(F.avg("score").alias("score"))


def optimized(df: DataFrame, configs: list[tuple[str, str, float]], seeds: tuple[int, ...] = (17, 29, 41), k: int = 5) -> DataFrame:
    """(recipe, mean_cv, sd_cv, worst_fold, accuracy, threshold, auroc, balanced, f1, n): cross-validation of
    each config over repeated stratified folds, its scores averaged over the repeats, the threshold
    that fits these best and the metrics there; best accuracy first, then best worst fold. A score's
    probability is its logistic function; folds are judged at one half.

    All configs of a seed share one pass for the statistics of the folds and one for the scores."""
    parts_of = None
    for seed in seeds:
        f = D.folds(df.withColumn("o", F.sha1(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"))), "y", "o", "vec_id", k).withColumn("family", F.col("fold").cast("string"))
        got = held_out_scores(f, configs, 1, 2).select("recipe", F.col("family").alias("fold"), "vec_id", "y", "score", F.lit(seed).alias("seed"))
        parts_of = got if parts_of is None else parts_of.unionByName(got)
    x = stage(parts_of.withColumn("p", 1 / (1 + F.exp(-F.col("score")))), "repeats")
    per = x.groupBy("recipe", "seed", "fold").agg(F.avg(((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("double")).alias("a"))
    per = per.groupBy("recipe").agg(F.avg("a").alias("mean_cv"), F.coalesce(F.stddev_samp("a"), F.lit(0.0)).alias("sd_cv"), F.min("a").alias("worst_fold"))
    mean = stage(x.groupBy("recipe", "vec_id", "y").agg(F.round(F.avg("p"), 9).alias("p")), "averaged")
    cuts = [(recipe_key(*c), best_threshold(mean.filter(F.col("recipe") == recipe_key(*c)), "p", "y", 199).first()) for c in configs]  # one for each config
    cut = df.sparkSession.createDataFrame([(r, c["cut"]) for r, c in cuts if c], "recipe string, threshold double")
    at = mean.join(F.broadcast(cut), "recipe").withColumn("pred", (F.col("p") >= F.col("threshold")).cast("int"))
    met = class_metrics(confusion(at, ["recipe", "threshold"], "y", "pred")).select("recipe", "threshold", "accuracy", "balanced", "f1", (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).cast("long").alias("n"))
    out = per.join(met, "recipe").join(area(mean, ["recipe"], "p", "y"), "recipe")
    return out.select("recipe", "mean_cv", "sd_cv", "worst_fold", "accuracy", "threshold", "auroc", "balanced", "f1", "n").orderBy(F.desc(F.round("accuracy", 9)), F.desc(F.round("worst_fold", 9)), "recipe")


def layer_sweep(df: DataFrame, layer: str, shrinkage: float = 0.1, shuffles: int = 20) -> DataFrame:
    """(layer, accuracy, f1, auroc, control, control_sd, dummy): each layer's own head on its second half;
    mean and deviation of the area of heads fitted on `shuffles` permutations of the first half's labels;
    and the accuracy of the first half's more frequent class. Columns vec_id, v, y and the layer.

    A permutation leaves the sum of the outer products as it is, so its head takes the sums of the rows
    with label 1 only, all permutations in one pass."""
    df = df.withColumn(layer, F.col(layer).cast("string"))
    halves = stage(D.within_share(df.withColumn("o", F.sha1(F.concat(F.lit("h:"), F.col("vec_id").cast("string")).cast("binary"))), [layer, "y"], "o", "vec_id", 0.5), "halves")
    train = halves.filter("train")
    parts = {k: p for k, p in M.ClassStats.by(train, layer).items() if min(p.n.values()) > 0}
    reps = train.select(layer, "vec_id", "v", F.explode(F.sequence(F.lit(1), F.lit(shuffles))).alias("rep"))
    reps = D.hex_rank(reps.withColumn("o", F.sha1(F.concat_ws(":", F.col("rep").cast("string"), F.col("vec_id").cast("string")).cast("binary"))), [layer, "rep"], "o", "vec_id")
    ones = df.sparkSession.createDataFrame([(k, p.n[1]) for k, p in parts.items()], f"{layer} string, ones long")
    sums = M.dim_moments(reps.join(F.broadcast(ones), layer).filter(F.col("nth") <= F.col("ones")), "v", layer, "rep")
    means: dict[tuple[str, int], dict[int, float]] = {}
    for r in sums.select(layer, "rep", "i", "mean").collect():  # layers x shuffles x d numbers
        means.setdefault((r[layer], r["rep"]), {})[r["i"]] = r["mean"]
    heads = [(k, 0, *(lambda wb: (wb[0].tolist(), wb[1]))(M.shrunk_lda(p, shrinkage))) for k, p in parts.items()]
    for (k, rep), m in means.items():
        p = parts[k]
        s1 = np.array([m[i] for i in sorted(m)]) * p.n[1]
        shuffled = M.ClassStats([(1, p.n[1], s1, np.zeros_like(p.g[1])), (0, p.n[0], p.s[0] + p.s[1] - s1, p.g[0] + p.g[1])])
        heads.append((k, rep, *(lambda wb: (wb[0].tolist(), wb[1]))(M.shrunk_lda(shuffled, shrinkage))))
    h = df.sparkSession.createDataFrame(heads, f"{layer} string, rep int, w array<double>, b double")
    t = halves.filter("not train").join(h, layer).select(layer, "rep", "vec_id", "y", F.round(V.dot("v", "w") + F.col("b"), 9).alias("score"))
    t = stage(t, "layers")
    areas = area(t, [layer, "rep"], "score", "y")
    own = areas.filter("rep = 0").select(layer, "auroc")
    control = areas.filter("rep > 0").groupBy(layer).agg(F.avg("auroc").alias("control"), F.stddev_pop("auroc").alias("control_sd"))
    met = class_metrics(confusion(t.filter("rep = 0").withColumn("pred", (F.col("score") >= 0).cast("int")), [layer], "y", "pred")).select(layer, "accuracy", "f1")
    more = df.sparkSession.createDataFrame([(k, int(p.n[1] > p.n[0])) for k, p in parts.items()], f"{layer} string, usual int")
    dummy = t.filter("rep = 0").join(F.broadcast(more), layer).groupBy(layer).agg(F.avg((F.col("y") == F.col("usual")).cast("double")).alias("dummy"))
    return met.join(own, layer).join(control, layer, "left").join(dummy, layer).select(layer, "accuracy", "f1", "auroc", "control", "control_sd", "dummy")


def greedy_ensemble(errors: DataFrame, quality: dict[str, float], most: int = 3) -> list[tuple[str, float]]:
    """Names and weights: the best first, then what adds most quality for the likeness of its errors to the
    mean error of those chosen. A likeness that isn't defined, as an error is constant, counts as full.
    `errors` has one column for each candidate; a step is one aggregation."""
    names = list(quality)
    chosen = [max(names, key=lambda n: quality[n])]
    while len(chosen) < min(most, len(names)):
        rest = [n for n in names if n not in chosen]
        mean = sum((F.col(c) for c in chosen), F.lit(0.0)) / len(chosen)
        x = errors.withColumn("__mean", mean)
        like = x.agg(*(correlation("__mean", n).alias(n) for n in rest)).first()
        chosen.append(max(rest, key=lambda n: quality[n] * (1 - 0.35 * (1.0 if like[n] is None else abs(like[n])))))
    raw = [max(quality[c] - 0.45, 0.01) ** 2 for c in chosen]
    return [(c, w / sum(raw)) for c, w in zip(chosen, raw)]


def additive_ensemble(df: DataFrame, columns: list[str], y: str, grid: tuple[float, ...] = (0.15, 0.25, 0.35, 0.5), least_gain: float = 2e-4, most: int = 3, prior: float = PRIOR, tried: int = 11) -> list[tuple[str, float]]:
    """Starts from the first probability column and walks the next `tried` in the given order, the best
    first. A candidate is mixed in with the weight of the grid that gives the highest accuracy at a
    threshold tuned anew for the prior, if that is higher than before by more than `least_gain`."""
    tuned = lambda e: (best_threshold(df.select(F.col(y).alias("y"), e.alias("p")), "p", "y", 399, prior).first() or {"accuracy": 0.0})["accuracy"]
    mix: list[tuple[str, float]] = [(columns[0], 1.0)]
    expr = F.col(columns[0])
    best = tuned(expr)
    for c in columns[1 : tried + 1]:
        trials = [(g, (1 - g) * expr + g * F.col(c)) for g in grid]
        got = [tuned(e) for _, e in trials]
        k = max(range(len(trials)), key=lambda k: (got[k], -k))
        if got[k] > best + least_gain:
            g, expr = trials[k]
            best = got[k]
            mix = [(n, w * (1 - g)) for n, w in mix] + [(c, g)]
        if len(mix) == most:
            break
    return mix


def guard_families(df: DataFrame, least: int = 3) -> int:
    """The number of families, or an error where there are too few to hold one out."""
    n = df.select("family").distinct().count()
    if n < least:
        raise ValueError(f"{n} families; holding one out needs {least}")
    return n


def routed_comparison(df: DataFrame, priors: tuple[float, ...] = (0.5, PRIOR), seeds: tuple[int, ...] = (17, 29, 41), unclean: tuple[str, ...] = (), least: int = 20, hyper: float = 0.6, correlated: bool = True) -> DataFrame:
    """(family, prior, seed, method, candidate, distance, accuracy, auroc, gains, losses, rho): for every held
    family, prior and seed the rows drawn to the prior, scored by the head of all other families
    (pooled), by the nearest stored head, pooled among them (routed), by the nearest of a single family
    (routed_source_only), and by the pool without the `unclean` families (clean_pool), all by quota.
    Distance is that of the moments of the drawn rows from a head's mixture; gains and losses are against
    pooled; rho is the rank correlation of distance and area over the single families, left out with its
    column if not `correlated`: only it needs the areas of heads that no method chooses.

    Statistics cover all rows of a family, in one pass. A row is written once with marks of the draws
    that have it, and scored once by each head, whatever their number. Quotas are cuts in the sorted
    scores of the chosen heads; only rows of a score that a cut goes through are ranked."""
    recipe = ("std", "lda", hyper)
    df = stage(df.withColumn("__row", F.monotonically_increasing_id()), "rows")
    parts = M.ClassStats.by(df, "family")
    total = _total(parts)
    usable = [f for f, p in parts.items() if min(p.n.values()) >= 2]
    held_ones = [f for f, p in parts.items() if sum(p.n.values()) >= least and min(p.n.values()) > 0 and min(total.without(p).n.values()) > 0]

    def head(stats: M.ClassStats) -> tuple[list[float], float]:
        (a, c), _ = _affine(recipe[0], Fold((), stats, stats))
        w, b = M.shrunk_lda(stats.mapped(a, c), hyper)
        return (a.T @ w).tolist(), float(b - (a.T @ w) @ c)

    sources = {f: head(parts[f]) for f in usable}
    heads, pools, same = [], {}, {}
    for held in held_ones:
        pool = total.without(parts[held])
        clean = pool
        for f in unclean:
            if f in parts and f != held:
                clean = clean.without(parts[f])
        pools[held] = pool
        heads += [(held, f, *sources[f]) for f in usable if f != held]
        heads.append((held, "pooled", *head(pool)))
        if clean is pool or min(clean.n.values()) <= 0:
            same[held, "clean_pool"] = "pooled"
        else:
            heads.append((held, "clean_pool", *head(clean)))
    spark = df.sparkSession
    draws = [(prior, seed) for prior in priors for seed in seeds]
    if len(draws) > 60:
        raise ValueError(f"{len(draws)} draws; their marks have room for 60")
    rows = stage(drawn_marks(df.filter(F.col("family").isin(held_ones)), draws), "drawn")
    moments = M.marked_moments(rows, "v", "family", "draws")

    def mixture(p: M.ClassStats, prior: float) -> tuple[np.ndarray, np.ndarray]:
        (m0, m1), (v0, v1) = p.means, (np.diag(p.g[y]) / p.n[y] - (p.s[y] / p.n[y]) ** 2 for y in (0, 1))
        return (1 - prior) * m0 + prior * m1, np.sqrt(np.maximum((1 - prior) * v0 + prior * v1 + prior * (1 - prior) * (m1 - m0) ** 2, 1e-12))

    distances, methods, quotas = [], [], {}
    for (held, draw), (n, mu, sg) in moments.items():
        prior, seed = draws[draw]
        _, scale = pools[held].center_and_scale()
        far = {}
        for f in [*(f for f in usable if f != held), "pooled"]:
            mean, sd = mixture(pools[held] if f == "pooled" else parts[f], prior)
            far[f] = round(float(np.mean(((mu - mean) / scale) ** 2 + ((sg - sd) / scale) ** 2)), 12)
        distances += [(held, prior, seed, f, x) for f, x in far.items()]
        single = [f for f in far if f != "pooled"]
        chosen = {"pooled": "pooled", "clean_pool": "clean_pool", "routed": min(far, key=lambda f: (far[f], f))}
        if single:
            chosen["routed_source_only"] = min(single, key=lambda f: (far[f], f))
        methods += [(held, prior, seed, k, f, same.get((held, f), f)) for k, f in chosen.items()]
        for name in {same.get((held, f), f) for f in chosen.values()}:
            quotas[held, name, draw] = min(max(round(n * prior), 0), n)
    key = ["family", "prior", "seed"]
    ddl = "family string, prior double, seed int"
    far = spark.createDataFrame(distances, f"{ddl}, candidate string, distance double")
    chosen = spark.createDataFrame(methods, f"{ddl}, method string, candidate string, head string")
    by = [*key, "candidate"]
    drawn_as = spark.createDataFrame([(k, *d) for k, d in enumerate(draws)], "draw int, prior double, seed int")
    named = {(family, name) for family, name, _ in quotas}
    first = [h for h in heads if h[:2] in named]
    ranges = stage(sorted_scores(rows, first, parts), "routed_scores")
    counts = stage(_draw_counts(ranges), "routed_counts")
    areas = _areas(counts)
    if correlated:
        areas = areas.unionByName(drawn_areas(rows, [h for h in heads if h[:2] not in named], parts))
    areas = stage(areas.join(F.broadcast(drawn_as), "draw").select(*by, "auroc"), "routed_areas")
    sums = _judged(rows, first, quotas, _cuts(ranges, counts, quotas), drawn_as)
    reached = sums.select(*key, F.col("candidate").alias("head"), (F.col("right") / F.col("n")).alias("accuracy"), "gains", "losses")
    out = chosen.join(reached, [*key, "head"]).join(areas.withColumnRenamed("candidate", "head"), [*key, "head"]).join(far, by, "left")
    columns = [*key, "method", "candidate", "distance", "accuracy", "auroc", "gains", "losses"]
    if not correlated:
        return out.select(*columns)
    rho = spearman(areas.filter("candidate not in ('pooled', 'clean_pool')").join(far, by), key, "distance", "auroc")
    return out.join(rho, key, "left").select(*columns, "rho")


def drawn_marks(df: DataFrame, draws: list[tuple[float, int]]) -> DataFrame:
    """The rows of (family, y, v, vec_id, __row) that some draw (prior, seed) takes, with `draws`, a bit
    for each that does: of each family and class the first in the seed's hash order, as many as the
    prior wants. What is compared are the last rows taken, a few for each family and draw."""
    spark = df.sparkSession
    group = ["family", "y", "seed"]
    seeds = list(dict.fromkeys(seed for _, seed in draws))
    order = {seed: F.sha1(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary")) for seed in seeds}
    each = F.explode(F.array(*(F.struct(F.lit(seed).alias("seed"), o.alias("o")) for seed, o in order.items())))
    keys = df.select("family", "y", "vec_id", "__row", each.alias("k")).select("family", "y", "vec_id", "__row", "k.seed", "k.o").filter("o is not null")
    wants: dict[tuple, dict[int, int]] = {}
    for prior in dict.fromkeys(prior for prior, _ in draws):
        for r in D.prior_counts(df, ["family"], "y", prior).collect():  # one row for each family
            for k, draw in enumerate(draws):
                if draw[0] == prior:
                    for y, n in ((1, r["want_pos"]), (0, r["want_neg"])):
                        wants.setdefault((r["family"], y), {})[k] = n
    wanted = spark.createDataFrame([(*g, draws[k][1], k, n) for g, own in wants.items() for k, n in own.items() if n > 0], "family string, y int, seed int, draw int, nth long")
    last = {(r["family"], r["y"], r["draw"]): (r["o"], r["vec_id"], r["__row"]) for r in nth_by_hex(keys, group, "o", ["vec_id", "__row"], wanted).collect()}
    kind = df.schema["vec_id"].dataType.simpleString()
    cuts = [(*g, sum(1 << k for k, n in own.items() if n > 0 and (*g, k) not in last), *(last.get((*g, k)) for k in range(len(draws)))) for g, own in wants.items()]
    ddl = ", ".join(["family string", "y int", "__all long", *(f"__c{k} struct<o: string, vec_id: {kind}, __row: bigint>" for k in range(len(draws)))])
    src = df.select("family", "y", "v", "vec_id", "__row", *(order[seed].alias(f"__o{seed}") for seed in seeds)).join(F.broadcast(spark.createDataFrame(cuts, ddl)), ["family", "y"])
    marks = F.col("__all")
    for k, (_, seed) in enumerate(draws):
        own = F.struct(F.col(f"__o{seed}").alias("o"), "vec_id", "__row")
        marks = marks.bitwiseOR(F.when(own <= F.col(f"__c{k}"), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    return src.filter("vec_id is not null").select("family", "y", "v", "vec_id", "__row", marks.alias("draws")).filter("draws <> 0")


#: Rows of a family scored at once, rows whose scores by one head are sorted in one task, about, and
#: scores in a row of the sorted table.
_SCORED, _SORTED, _RANGE = 1 << 15, 1 << 18, 1 << 14


def _score(v: np.ndarray, w: np.ndarray, b: float) -> np.ndarray:
    """Scores of the rows by one head, rounded to nine digits where doubles have as many."""
    score = np.zeros(len(v))
    for k, x in enumerate(w):
        score += v[:, k] * x
    score += b
    return np.where(np.abs(score) < 4e6, np.round(score, 9), score) + 0.0


def _by_family(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(family, its rows in the batch, their vectors)."""
    if batch.num_rows:
        v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        family = batch.column("family").dictionary_encode()
        of = family.indices.to_numpy()
        for k, name in enumerate(family.dictionary.to_pylist()):
            at = np.flatnonzero(of == k)
            yield name, at, v[at]


def sorted_scores(rows: DataFrame, heads: list[tuple[str, str, list[float], float]], parts: dict[str, M.ClassStats], most: int = _SORTED, size: int = _RANGE) -> DataFrame:
    """(family, candidate, part, range, score, code, n): the scores of (family, y, v, draws) by the heads
    (family, candidate, w, b) of each family, rising within a range, from range to range of a part and
    from part to part. `code` has a row's draws and in its lowest bit whether it's positive; equal
    scores and codes are one entry with their number, and equal scores are in one range.

    A row's score by a head is made and sorted once for all draws. The scores of a large family are
    divided into parts, about evenly by their mean and deviation, and a score is in one part, so what
    follows from them is exact however they divide."""
    by_family: dict[str, tuple] = {}
    for family in dict.fromkeys(h[0] for h in heads):
        own = [h for h in heads if h[0] == family]
        w, b = np.array([h[2] for h in own]), np.array([h[3] for h in own])
        p = parts[family]
        n = p.n[0] + p.n[1]
        mean, second = (p.s[0] + p.s[1]) / n, (p.g[0] + p.g[1]) / n
        sd = np.sqrt(np.maximum(np.einsum("ki,ij,kj->k", w, second - np.outer(mean, mean), w), 0))
        z = np.array([NormalDist().inv_cdf(k / count) for k in range(1, count)]) if (count := -(-n // most)) > 1 else np.zeros(0)
        by_family[family] = ([h[1] for h in own], w, b, (w @ mean + b)[:, None] + sd[:, None] * z)
    shared = rows.sparkSession.sparkContext.broadcast(by_family)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        count: dict[str, int] = {}

        def scored(family: str) -> Iterator[pa.RecordBatch]:
            names, w, b, cuts = shared.value[family]
            v, code = (np.concatenate(x) for x in zip(*held.pop(family)))
            count.pop(family)
            for name, own, at, cut in zip(names, w, b, cuts):
                score = _score(v, own, at)
                order = np.lexsort((code, score))
                s, c = score[order], code[order]
                first = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (c[1:] != c[:-1])])
                n, s, c = np.diff(np.r_[first, len(s)]), s[first], c[first]
                ends = np.r_[0, np.searchsorted(s, cut), len(s)]
                some = [k for k in range(len(ends) - 1) if ends[k] < ends[k + 1]]
                lists = [pa.ListArray.from_arrays(pa.array(np.r_[0, ends[1:][some]].astype(np.int32)), pa.array(x)) for x in (s, c, n)]
                yield pa.RecordBatch.from_arrays([pa.array([family] * len(some)), pa.array([name] * len(some)), pa.array(some, pa.int32()), *lists], names=["family", "candidate", "part", "score", "code", "n"])

        for batch in batches:
            if batch.num_rows:
                code = batch.column("draws").to_numpy() * 2 + (batch.column("y").to_numpy() == 1)
            for name, at, v in _by_family(batch):
                if name not in shared.value:
                    continue
                held.setdefault(name, []).append((v, code[at]))
                count[name] = count.get(name, 0) + len(at)
                if count[name] >= _SCORED:
                    yield from scored(name)
        for name in list(held):
            yield from scored(name)

    def one_part(t: pa.Table) -> pa.Table:
        score, code, n = (t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("score", "code", "n"))
        order = np.lexsort((code, score))
        score, code, n = score[order], code[order], n[order]
        start = np.flatnonzero(np.r_[True, score[1:] != score[:-1]])
        ends = np.unique(np.r_[0, start[np.searchsorted(start, np.arange(size, start[-1] + 1, size))], len(score)]).astype(np.int32)
        first = t.slice(0, 1)
        same = {c: pa.array([first.column(c)[0].as_py()] * (len(ends) - 1), t.schema.field(c).type) for c in ("family", "candidate", "part")}
        lists = {c: pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for c, x in (("score", score), ("code", code), ("n", n))}
        return pa.table(same | {"range": pa.array(range(len(ends) - 1), pa.int32())} | lists)

    ddl = "family string, candidate string, part int"
    lists = "score array<double>, code array<long>, n array<long>"
    scored_rows = rows.select("family", "y", "v", "draws").mapInArrow(run, f"{ddl}, {lists}")
    return scored_rows.groupBy("family", "candidate", "part").applyInArrow(one_part, f"{ddl}, range int, {lists}")


def _ranges_of(batch: pa.RecordBatch) -> Iterator[tuple[dict, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(other columns, code, n, where each distinct score starts, these scores) of each row of sorted scores."""
    rest = [c for c in batch.schema.names if c not in ("score", "code", "n")]
    for i in range(batch.num_rows):
        score, code, n = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("score", "code", "n"))
        start = np.flatnonzero(np.r_[True, score[1:] != score[:-1]])
        yield {c: batch.column(c)[i].as_py() for c in rest}, code, n, start, score[start]


def _draw_counts(ranges: DataFrame) -> DataFrame:
    """(family, candidate, part, range, draw, u, pos, neg) of sorted scores: positives and negatives of each
    draw, and the pairs within the range that stand in order, ties as a half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for at, code, n, start, _ in _ranges_of(batch):
                for draw in range(int(np.bitwise_or.reduce(code)).bit_length() - 1):
                    here = n * (code >> (draw + 1) & 1)
                    pos = np.add.reduceat(here * (code & 1), start)
                    neg = np.add.reduceat(here * (1 - (code & 1)), start)
                    found.append(at | {"draw": draw, "u": float((pos * (np.cumsum(neg) - neg / 2)).sum()), "pos": int(pos.sum()), "neg": int(neg.sum())})
            yield pa.RecordBatch.from_pylist(found, pa.schema([("family", pa.string()), ("candidate", pa.string()), *((c, pa.int32()) for c in ("part", "range", "draw")), ("u", pa.float64()), ("pos", pa.int64()), ("neg", pa.int64())]))

    return ranges.mapInArrow(run, "family string, candidate string, part int, range int, draw int, u double, pos long, neg long")


def _areas(counts: DataFrame) -> DataFrame:
    """(family, candidate, draw, auroc) from the counts of ranges."""
    by = ["family", "candidate", "draw"]
    before = Window.partitionBy(*by).orderBy("part", "range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    per = counts.withColumn("below", F.coalesce(F.sum("neg").over(before), F.lit(0)))
    agg = per.groupBy(*by).agg(F.sum(F.col("u") + F.col("pos") * F.col("below")).alias("u"), F.sum("pos").cast("double").alias("p"), F.sum("neg").cast("double").alias("q"))
    return agg.filter("p + q > 0").select(*by, F.try_divide("u", F.nullif(F.col("p") * F.col("q"), F.lit(0.0))).alias("auroc"))


def drawn_areas(rows: DataFrame, heads: list[tuple[str, str, list[float], float]], parts: dict[str, M.ClassStats], most: int = _SORTED) -> DataFrame:
    """(family, candidate, draw, auroc) for the heads (family, candidate, w, b) of each family: the area
    under the ROC curve of each draw, a bit of `draws` in (family, y, v, draws)."""
    return _areas(_draw_counts(sorted_scores(rows, heads, parts, most)))


def _cuts(ranges: DataFrame, counts: DataFrame, quotas: dict[tuple[str, str, int], int]) -> dict[tuple[str, str, int], tuple[float, float]]:
    """{(family, candidate, draw): (score, share)}: the score of the last row of a quota, numbers of the
    highest scores, and which share of the draw's rows of that score is in it. None for a quota of 0."""
    by = ["family", "candidate", "draw"]
    wanted = ranges.sparkSession.createDataFrame([(*k, n) for k, n in quotas.items() if n > 0], "family string, candidate string, draw int, quota long")
    down = Window.partitionBy(*by).orderBy(F.desc("part"), F.desc("range")).rowsBetween(Window.unboundedPreceding, 0)  # one row for each range
    n = F.col("pos") + F.col("neg")
    per = counts.withColumn("upto", F.sum(n).over(down)).withColumn("above", F.col("upto") - n).join(F.broadcast(wanted), by).filter("above < quota and quota <= upto")
    per = per.groupBy("family", "candidate", "part", "range").agg(F.collect_list(F.struct("draw", (F.col("quota") - F.col("above")).alias("nth"))).alias("wanted"))  # one entry for each draw at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for at, code, n, start, score in _ranges_of(batch):
                for want in at["wanted"]:
                    own = np.add.reduceat(n * (code >> (want["draw"] + 1) & 1), start)[::-1]
                    upto = np.cumsum(own)
                    k = int(np.searchsorted(upto, want["nth"]))
                    found.append({"family": at["family"], "candidate": at["candidate"], "draw": want["draw"], "score": float(score[::-1][k]), "share": float((want["nth"] - upto[k] + own[k]) / own[k])})
            yield pa.RecordBatch.from_pylist(found, pa.schema([("family", pa.string()), ("candidate", pa.string()), ("draw", pa.int32()), ("score", pa.float64()), ("share", pa.float64())]))

    got = ranges.join(F.broadcast(per), ["family", "candidate", "part", "range"]).mapInArrow(run, "family string, candidate string, draw int, score double, share double")
    return {(r["family"], r["candidate"], r["draw"]): (r["score"], r["share"]) for r in got.collect()}  # one row for each quota


def _judged(rows: DataFrame, heads: list[tuple[str, str, list[float], float]], quotas: dict[tuple[str, str, int], int], cuts: dict[tuple[str, str, int], tuple[float, float]], drawn_as: DataFrame) -> DataFrame:
    """(family, prior, seed, candidate, n, right, gains, losses) of each quota over (family, y, v, vec_id, __row,
    draws): rows predicted right, and only by this head or only by the pooled one. Rows above or below
    the cut are counted where they are read; those of its very score are ranked by vec_id."""
    by_family: dict[str, tuple] = {}
    for family in dict.fromkeys(h[0] for h in heads):
        own = {h[1]: (np.array(h[2]), h[3]) for h in heads if h[0] == family}
        of: dict[int, dict[str, tuple[float, float]]] = {}
        for (f, name, draw) in quotas:
            if f == family:
                of.setdefault(draw, {})[name] = cuts.get((f, name, draw), (float("nan"), 1.0))
        by_family[family] = (own, of)
    shared = rows.sparkSession.sparkContext.broadcast(by_family)
    kind = rows.schema["vec_id"].dataType.simpleString()
    numbers = ["n", "right", "gains", "losses"]
    counted = pa.schema([("family", pa.string()), ("candidate", pa.string()), ("draw", pa.int32()), *((c, pa.int64()) for c in numbers)])
    ranked = [("__row", pa.int64()), ("y", pa.int32()), ("score", pa.float64()), ("share", pa.float64()), ("pred", pa.int32()), ("base", pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        id_type = None

        def out(own: pa.Table, ids: pa.Array) -> Iterator[pa.RecordBatch]:
            none = [pa.nulls(own.num_rows, f.type) if f.name not in own.schema.names else own.column(f.name).combine_chunks() for f in [*counted, *(pa.field(*f) for f in ranked)]]
            yield pa.RecordBatch.from_arrays([*none, ids], names=[*counted.names, *(f[0] for f in ranked), "vec_id"])

        for batch in batches:
            id_type = batch.schema.field("vec_id").type
            if batch.num_rows:
                labels, marks, row = (batch.column(c).to_numpy() for c in ("y", "draws", "__row"))
            for name, at, v in _by_family(batch):
                if name not in shared.value:
                    continue
                own, of = shared.value[name]
                scores = {c: _score(v, w, b) for c, (w, b) in own.items()}
                for draw, cut in of.items():
                    on = np.flatnonzero(marks[at] >> draw & 1)
                    if not len(on):
                        continue
                    y = labels[at[on]]
                    # 2 is a row of the cut's score
                    side = {c: np.where(scores[c][on] == x, 2, scores[c][on] > x) for c, (x, _) in cut.items()}
                    base = side["pooled"]
                    for c, pred in side.items():
                        sure = (pred < 2) & (base < 2)
                        right, was = pred[sure] == y[sure], base[sure] == y[sure]
                        got = np.array([sure.sum(), right.sum(), (right & ~was).sum(), (~right & was).sum()])
                        sums[name, c, draw] = sums[name, c, draw] + got if (name, c, draw) in sums else got
                        k = np.flatnonzero(~sure)
                        if len(k):
                            here = at[on[k]]
                            columns = {"family": [name] * len(k), "candidate": [c] * len(k), "draw": pa.array([draw] * len(k), pa.int32()), "__row": row[here], "y": pa.array(y[k].astype(np.int32)), "score": scores[c][on[k]], "share": np.full(len(k), cut[c][1])}
                            columns |= {a: pa.array(x[k].astype(np.int32), mask=x[k] == 2) for a, x in (("pred", pred), ("base", base))}
                            yield from out(pa.table(columns), batch.column("vec_id").take(pa.array(here)))
        if sums:
            yield from out(pa.Table.from_pylist([dict(zip(counted.names, (*k, *map(int, x)))) for k, x in sums.items()], counted), pa.nulls(len(sums), id_type))

    ddl = f"family string, candidate string, draw int, n long, right long, gains long, losses long, __row long, y int, score double, share double, pred int, base int, vec_id {kind}"
    got = stage(rows.select("family", "y", "v", "vec_id", "__row", "draws").mapInArrow(run, ddl).join(F.broadcast(drawn_as), "draw"), "routed_judged")
    key = ["family", "prior", "seed"]
    by = [*key, "candidate"]
    unsure = got.filter("n is null")
    placed = stage(quota(unsure.filter("pred is null").select(*by, "vec_id", "__row", "score", "share"), by, "score", "vec_id", F.col("share"), "placed").select(*by, "__row", "placed"), "routed_placed")
    of_pooled = placed.filter("candidate = 'pooled'").select(*key, "__row", F.col("placed").alias("placed_base"))
    settled = unsure.join(placed, [*by, "__row"], "left").join(of_pooled, [*key, "__row"], "left")
    right, was = F.coalesce("pred", "placed") == F.col("y"), F.coalesce("base", "placed_base") == F.col("y")
    ones = settled.select(*by, F.lit(1).cast("long").alias("n"), *(x.cast("long").alias(c) for c, x in (("right", right), ("gains", right & ~was), ("losses", ~right & was))))
    return got.filter("n is not null").select(*by, *numbers).unionByName(ones).groupBy(*by).agg(*(F.sum(c).alias(c) for c in numbers))


def routed_summary(compared: DataFrame) -> DataFrame:
    """(prior, method, mean_accuracy, mean_auroc, gains, losses) over families and seeds."""
    return compared.groupBy("prior", "method").agg(F.avg("accuracy").alias("mean_accuracy"), F.avg("auroc").alias("mean_auroc"), F.sum("gains").alias("gains"), F.sum("losses").alias("losses"))


# ---- heads fitted by iteration -------------------------------------------------------------------
#: Iterations of a library head, so many that its tolerance ends the fit.
MOST = 4000


def logistic_gd(df: DataFrame, vec: str, y: str, steps: int = 400, rate: float = 0.5, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """Full-batch gradient steps on standardized vectors, taken back to raw coordinates. Each step is
    one pass in which every task returns d + 1 numbers."""
    m = M.center_and_scale(df, vec).first()
    center, scale = np.array(m["center"]), np.array(m["scale"])
    x = stage(M.standardize(df.select(F.col(vec).alias("v"), F.col(y).cast("double").alias("y")), "v", M.center_and_scale(df, vec)), "gd")
    n, d = x.count(), len(center)
    at = np.zeros(d + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d + 1)
        for batch in batches:
            z = np.c_[batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d), np.ones(batch.num_rows)]
            total += (0.5 * (1 + np.tanh(z @ at / 2)) - batch.column("y").to_numpy(zero_copy_only=False)) @ z
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["g"])

    for _ in range(steps):
        g = sum((np.array(r["g"]) for r in x.mapInArrow(run, "g array<double>").collect()), np.zeros(d + 1)) / n
        at = at - rate * (g + l2 * np.append(at[:d], 0.0))
    return M.in_raw_coordinates(at[:d], float(at[d]), center, scale)


def ml_vectors(df: DataFrame, vec: str = "v", y: str = "y") -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("features", array_to_vector(F.col(vec))).withColumn("label", F.col(y).cast("double"))


def ml_fit(df: DataFrame, kind: str, **options):
    """A library head: logistic (C), elastic net, linear SVM; fitted on (features, label)."""
    from pyspark.ml.classification import LinearSVC, LogisticRegression

    n = df.count()
    if kind == "logistic":
        return LogisticRegression(regParam=1 / (options.get("C", 1.0) * n), elasticNetParam=options.get("l1_ratio", 0.0), standardization=False, maxIter=options.get("maxIter", MOST), tol=1e-9).fit(df)
    if kind == "svm":
        return LinearSVC(regParam=1 / (options.get("C", 1.0) * n), standardization=False, maxIter=options.get("maxIter", MOST)).fit(df)
    raise ValueError(f"no head called {kind}")


def platt(df: DataFrame, folds: int = 3) -> DataFrame:
    """(vec_id, y, p): SVM margins out of fold, turned into probabilities by a logistic of one feature."""
    from pyspark.ml.feature import VectorAssembler

    f = D.folds(df.withColumn("o", F.sha1(F.col("vec_id").cast("string").cast("binary"))), "y", "o", "vec_id", folds)
    f = stage(f, "platt")
    parts = []
    for k in range(folds):
        model = ml_fit(ml_vectors(f.filter(F.col("fold") != k)), "svm")
        w = V.literal(model.coefficients.toArray().tolist())
        parts.append(f.filter(F.col("fold") == k).select("vec_id", "y", (V.dot("v", w) + F.lit(float(model.intercept))).alias("margin")))
    margins = parts[0]
    for p in parts[1:]:
        margins = margins.unionByName(p)
    x = VectorAssembler(inputCols=["margin"], outputCol="features").transform(margins).withColumn("label", F.col("y").cast("double"))
    model = ml_fit(x, "logistic", C=1e6)
    a, b = float(model.coefficients[0]), float(model.intercept)
    return margins.select("vec_id", "y", (1 / (1 + F.exp(-(a * F.col("margin") + b)))).alias("p"))


def portable_weights(weights: dict[str, float], portable: set[str]) -> dict[str, float]:
    """Weights of the portable parts, adding up to 1."""
    kept = {k: w for k, w in weights.items() if k in portable}
    total = sum(kept.values())
    if not total:
        raise ValueError("no part is portable")
    return {k: w / total for k, w in kept.items()}


def projected(df: DataFrame, k: int, drop: int = 0) -> DataFrame:
    """(vec_id, z): coordinates on the leading principal components, without the first `drop`."""
    r = M.gram(df, "v").first()
    d = len(r["s"])
    mean = np.array(r["s"]) / r["n"]
    comps = M.top_components(np.array(r["g"]).reshape(d, d) / r["n"] - np.outer(mean, mean), k + drop)[drop:]
    # a component's sign is that of its largest cell
    comps = comps * np.sign(comps[np.arange(len(comps)), np.abs(comps).argmax(1)])[:, None]
    x = df.withColumn("__c", V.minus("v", V.literal(mean.tolist())))
    return x.select("vec_id", "y", F.array(*(V.dot("__c", V.literal(c.tolist())) for c in comps)).alias("z"))


def multinomial(df: DataFrame, vec: str, y: str, k: int) -> DataFrame:
    """(class, i, w): a multinomial logistic head on the k best dimensions, standardized."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    top = [r["i"] for r in M.top_features(df, vec, y, k).collect()]
    z = M.standardize(df.select(y, F.array(*(F.col(vec)[i - 1] for i in top)).alias("v")), "v", M.center_and_scale(df.select(F.array(*(F.col(vec)[i - 1] for i in top)).alias("v")), "v"))
    model = LogisticRegression(family="multinomial", regParam=0.01, maxIter=MOST).fit(z.select(array_to_vector("v").alias("features"), F.col(y).cast("double").alias("label")))
    rows = [(c, top[j], float(w)) for c, line in enumerate(model.coefficientMatrix.toArray()) for j, w in enumerate(line)]
    return df.sparkSession.createDataFrame(rows, "class int, i int, w double")


def layer_validation(df: DataFrame, layer: str, shrinkage: float = 0.1) -> DataFrame:
    """(layer, auroc): cross-validated area of every layer. One pass of `out_of_fold` a layer, and
    there are few of them."""
    out = None
    for k in sorted(r[layer] for r in df.select(layer).distinct().collect()):
        part = area(out_of_fold(df.filter(F.col(layer) == k), shrinkage, 1).withColumn("score", F.round("score", 9)), [], "score", "y").select(F.lit(k).alias(layer), "auroc")
        out = part if out is None else out.unionByName(part)
    return out


# ---- queries -------------------------------------------------------------------------------------
def _v(s, d):
    return vectors(s, d)


def _facts(s, d):
    return fold_facts(held_out_scores(_v(s, d), GRID))


def _summary(s, d):
    return fold_summary(_facts(s, d))


def _ranked(s, d):
    x = stage(_facts(s, d), "facts")
    return ranked_recipes(fold_summary(x), x.select("family").distinct().count())


def _cross(s, d):
    return fold_summary(fold_facts(cross_source_scores(_v(s, d), GRID), PRIOR, "pair"))


def _rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *(rd(c).alias(c) for c, t in df.dtypes if t == "double" and c not in keys))


def _layers(s, d):
    return table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), (F.col("label") >= 5).cast("int").alias("y"), (F.col("vec_id") % 4).cast("string").alias("layer"))


def _probabilities(s, d) -> DataFrame:
    """A probability from each cell of the vectors, m0, m1 and so on, and their names."""
    v = stage(_v(s, d), "vectors")
    width = v.agg(F.max(F.size("v")).alias("n")).first()["n"] or 0
    return v.select("vec_id", "y", *(F.round(1 / (1 + F.exp(-F.col("v")[k])), 9).alias(f"m{k}") for k in range(width)))


def _names(p: DataFrame) -> list[str]:
    return [c for c in p.columns if c[0] == "m"]


def _ensemble(s, d) -> DataFrame:
    p = _probabilities(s, d)
    names = _names(p)
    long = p.select("y", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("p")) for n in names))).alias("c")).select("y", "c.*")
    q = {r["name"]: r["quality"] or 0.0 for r in metric_score(long, ["name"], "p", "y").collect()}  # one for each candidate
    return s.createDataFrame(greedy_ensemble(p.select(*((F.col(n) - F.col("y")).alias(n) for n in names)), {n: q[n] for n in names}), "name string, weight double")


def _additive(s, d) -> DataFrame:
    p = _probabilities(s, d)
    got = {n: best_threshold(p.select("y", F.col(n).alias("p")), "p", "y", 399, PRIOR).first()["accuracy"] for n in _names(p)}
    return s.createDataFrame(additive_ensemble(p, sorted(got, key=lambda n: -got[n]), "y"), "name string, weight double")


def _routed(s, d, correlated: bool = True) -> DataFrame:
    return routed_comparison(_v(s, d), correlated=correlated)


QUERIES = {
    "e01_fold_facts": lambda s, d: _rounded(_facts(s, d), "recipe", "family"),
    "e01_dom_areas": lambda s, d: area(held_out_scores(_v(s, d), [("raw", "dom", 0.0)]), ["recipe", "family"], "score", "y").select("family", rd("auroc").alias("auroc")),
    "a08_fold_summary": lambda s, d: _rounded(_summary(s, d), "recipe", "folds"),
    "w07_ranked_recipes": lambda s, d: _ranked(s, d).select("recipe", "place"),
    "w09_first_per_transform": lambda s, d: first_per_transform(_ranked(s, d)),
    "e02_cross_source": lambda s, d: _rounded(ranked_pairs(_cross(s, d)), "recipe", "place"),
    "a09_pair_summary": lambda s, d: _rounded(_cross(s, d), "recipe", "folds"),
    "e03_report": lambda s, d: report(_summary(s, d), 2 * PRIOR * PRIOR - 2 * PRIOR + 1).select("recipe", rd("delta").alias("delta"), "clears"),
    "e04_candidates": lambda s, d: _rounded(candidates(_v(s, d), _facts(s, d), _cross(s, d), least_rows=150), "name", "recipe", "trained_rows", "verdict", "reason"),
    "e04_gate": lambda s, d: gate(_ranked(s, d), PRIOR),
    "e03_lines": lambda s, d: report_lines(_ranked(s, d), PRIOR),
    "e05_out_of_fold": lambda s, d: _rounded(area(out_of_fold(_v(s, d), 0.1).withColumn("score", F.round("score", 9)), [], "score", "y")),
    "e05_optimized": lambda s, d: _rounded(optimized(_v(s, d), [(t, "lda", h) for t in ("raw", "std", "l2") for h in (0.1, 0.6)]), "recipe", "n"),
    "e06_configs": lambda s, d: coarse_configs(s, 16, ["standard", "robust"], [4, 8, 16, 32], ["l2", "l1", "svm"]),
    "e07_greedy_ensemble": lambda s, d: _ensemble(s, d).select("name", rd("weight").alias("weight")),
    "e08_additive_ensemble": lambda s, d: _additive(s, d).select("name", rd("weight").alias("weight")),
    "e09_layer_sweep": lambda s, d: _rounded(layer_sweep(_layers(s, d), "layer"), "layer"),
    "e10_layer_validation": lambda s, d: _rounded(layer_validation(_layers(s, d), "layer"), "layer"),
    "m11_out_of_fold": lambda s, d: out_of_fold(_v(s, d), 0.1).select("vec_id", rd("score", 5).alias("score")),
    "h07_multinomial": lambda s, d: multinomial(table(s, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("v"), "label"), "v", "label", 8).select("class", "i", rd("w", 3).alias("w")),
    "e11_score_map": lambda s, d: _layers(s, d).groupBy("layer", "y").agg(rd(F.avg(V.total("v"))).alias("mean_total")),
    "e12_predictions": lambda s, d: _v(s, d).select("vec_id", "y", (1 / (1 + F.exp(-F.col("v")[0]))).alias("p")).select("vec_id", rd("p").alias("p"), ((F.col("p") >= 0.5).cast("int") == F.col("y")).alias("correct")),
    "e13_focused_grid": lambda s, d: _rounded(fold_summary(fold_facts(held_out_scores(_v(s, d), FOCUSED))), "recipe", "folds"),
    "e14_guard": lambda s, d: s.createDataFrame([(guard_families(_v(s, d)),)], "families long"),
    "r04_routed_comparison": lambda s, d: _rounded(_routed(s, d), "family", "prior", "seed", "method", "candidate", "gains", "losses"),
    "a10_routed_summary": lambda s, d: _rounded(routed_summary(_routed(s, d, correlated=False)), "prior", "method", "gains", "losses"),
    "h03_logistic": lambda s, d: _head(s, ml_fit(ml_vectors(_v(s, d)), "logistic", C=0.05)),
    "h06_logistic_gd": lambda s, d: M._as_cells(s, *logistic_gd(_v(s, d), "v", "y")),
    "h06_direction": lambda s, d: M._as_cells(s, (lambda w: w / np.linalg.norm(w))(logistic_gd(_v(s, d), "v", "y")[0]), 0.0).filter("i > 0"),
    "h16_portable": lambda s, d: s.createDataFrame(list(portable_weights({r["source"]: r["weight"] for r in table(s, d, "mix_weights").collect()}, {r["source"] for r in table(s, d, "mix_weights").filter("max_repeats > 1").collect()}).items()), "source string, weight double").select("source", rd("weight").alias("weight")),
    "h08_elastic_net": lambda s, d: _head(s, ml_fit(ml_vectors(_v(s, d)), "logistic", C=1.0, l1_ratio=0.5)),
    "h09_svm": lambda s, d: _head(s, ml_fit(ml_vectors(_v(s, d)), "svm")),
    "h12_platt": lambda s, d: platt(_v(s, d)).agg(rd(F.avg("p"), 3).alias("mean_p"), F.count("*").alias("n")),
    "v07_components": lambda s, d: projected(_v(s, d), 4, 1).select(*(rd(F.var_pop(F.col("z")[k]), 4).alias(f"var{k}") for k in range(4))),
    "v16_plane": lambda s, d: projected(_v(s, d), 2).groupBy("y").agg(*(rd(F.avg(F.col("z")[k]), 4).alias(f"z{k}") for k in range(2))),
}


def _head(s, model) -> DataFrame:
    return M._as_cells(s, model.coefficients.toArray(), float(model.intercept)).select("i", rd("w", 3).alias("w"))


_ONE_LESS = f"{VECTORS_SQL}, fs AS (SELECT family, y, i, sum(x) AS s, count(*) AS n FROM cells GROUP BY 1, 2, 3), sz AS (SELECT family, count(*) AS n FROM vec GROUP BY 1), hd AS (SELECT h.family AS held, i, sum(s) FILTER (WHERE y = 1) / sum(fs.n) FILTER (WHERE y = 1) - sum(s) FILTER (WHERE y = 0) / sum(fs.n) FILTER (WHERE y = 0) AS w FROM fs JOIN sz h ON h.family <> fs.family WHERE h.n >= 20 AND (SELECT sum(n) FROM sz) - h.n >= 100 GROUP BY 1, 2), s0 AS (SELECT family, vec_id, y, round(sum(x * w), 9) AS score FROM cells JOIN hd ON hd.held = cells.family AND hd.i = cells.i GROUP BY 1, 2, 3), rk AS (SELECT *, rank() OVER (PARTITION BY family ORDER BY score) + (count(*) OVER (PARTITION BY family, score) - 1) / 2.0 AS r FROM s0)"
SQL = {
    "e01_dom_areas": f"WITH {_ONE_LESS} SELECT family, round((sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0) / nullif(count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0), 0), 6) AS auroc FROM rk GROUP BY 1",
    "e06_configs": "SELECT * FROM (VALUES ('standard'), ('robust')) a(scaler), (VALUES (4), (8), (16)) b(k), (VALUES ('l2'), ('l1'), ('svm')) c(probe)",
    "e11_score_map": "SELECT CAST(vec_id % 4 AS VARCHAR) AS layer, CAST(label >= 5 AS INTEGER) AS y, round(avg(list_sum(CAST(embedding AS DOUBLE[]))), 6) AS mean_total FROM embeddings GROUP BY 1, 2",
    "e12_predictions": f"WITH {VECTORS_SQL} SELECT vec_id, round(1 / (1 + exp(-v[1])), 6) AS p, CAST(1 / (1 + exp(-v[1])) >= 0.5 AS INTEGER) = y AS correct FROM vec",
    "h16_portable": "SELECT source, round(weight / sum(weight) OVER (), 6) AS weight FROM mix_weights WHERE max_repeats > 1",
    "e14_guard": f"WITH {VECTORS_SQL} SELECT count(DISTINCT family) AS families FROM vec",
}
