"""Aggregations and result roll-ups: A07-A24, A27, A28, G18-G22."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import sampling as D
from plumbline.operators.ranking_ops import _S as SCORED_SQL
from plumbline.operators.ranking_ops import scored
from plumbline.plans.ranking import exact_percentiles
from plumbline.plans.tables import CORPUS_SQL, harmonized, rd, table


def known(c: Column | str) -> Column:
    """The number, null where it is NaN."""
    return F.nanvl(F.col(c) if isinstance(c, str) else c, F.lit(None).cast("double"))


def profile(df: DataFrame, scanned: DataFrame) -> DataFrame:
    """(source, n, positives, rate, scanned) of each source, with a total where source is null."""
    kept = df.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("positives"))
    rows = scanned.groupBy("source").agg(F.count("*").alias("scanned")).join(kept, "source", "left").fillna(0, ["n", "positives"])
    out = rows.rollup("source").agg(F.sum("n").alias("n"), F.sum("positives").alias("positives"), F.sum("scanned").alias("scanned"))
    return out.withColumn("rate", rd(F.coalesce(F.try_divide("positives", "n"), F.lit(0.0))))


def describe(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles without NaN."""
    v = known(value)
    flat = df.groupBy(*by).agg(F.count(v).alias("n"), rd(F.avg(v)).alias("mean"), rd(F.stddev_samp(v)).alias("sd"), rd(F.min(v)).alias("least"), rd(F.max(v)).alias("most"))
    parts = exact_percentiles(df, list(by), v, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    on = F.lit(True)
    for c in by:
        on = on & flat[c].eqNullSafe(parts[c])
    return flat.join(parts, on, "left").select(*(flat[c] for c in by), "n", "mean", "sd", "least", *(rd(c).alias(c) for c in ("q1", "median", "q3")), "most")


def ratio_of_means(df: DataFrame, outer: str, inner: str, a: str, b: str) -> DataFrame:
    """Means over seeds within (outer, inner), then over inner, and their ratio; population deviation."""
    per = df.groupBy(outer, inner).agg(F.avg(known(a)).alias("a"), F.avg(known(b)).alias("b"))
    return per.groupBy(outer).agg(rd(F.avg("a")).alias("mean_a"), rd(F.avg("b")).alias("mean_b"), rd(F.try_divide(F.avg("a"), F.nullif(F.avg("b"), F.lit(0.0)))).alias("ratio"), rd(F.stddev_pop("a")).alias("sd_a"))


def efficiency(df: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """Ratio of the sums of absolute effects."""
    return df.groupBy(by).agg(rd(F.try_divide(F.sum(F.abs(known(a))), F.nullif(F.sum(F.abs(known(b))), F.lit(0.0)))).alias("efficiency"))


def log_log_fit(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """Slope, intercept and R squared of ln y on ln x, and the slope through the origin of y on x."""
    c = df.filter((F.col(x) > 0) & (F.col(y) > 0)).withColumn("lx", F.ln(F.col(x))).withColumn("ly", F.ln(F.col(y)))
    return c.groupBy(by).agg(rd(F.regr_slope("ly", "lx")).alias("slope"), rd(F.regr_intercept("ly", "lx")).alias("intercept"), rd(F.regr_r2("ly", "lx")).alias("r2"), rd(F.sum(F.col(x) * F.col(y)) / F.sum(F.col(x) * F.col(x))).alias("through_origin"))


def method_summary(df: DataFrame, methods: list[str], baseline: str, by: str) -> DataFrame:
    """Mean of each method over the rows that have it, the baseline's mean over the same rows, and
    the groups that have it."""
    long = df.select(by, F.col(baseline).alias("base"), F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.col(m).alias("value")) for m in methods))).alias("r")).select(by, "base", "r.*").filter("value is not null")
    return long.groupBy("method").agg(F.count("*").alias("n"), rd(F.avg("value")).alias("mean"), rd(F.avg("base")).alias("baseline"), F.count_distinct(by).alias("groups"))


def rolling_budget(df: DataFrame, owner: str, at: str, hours: int, allowed: int) -> DataFrame:
    """`df` with the number of the owner's rows in the hours up to each row, and when the oldest of
    the last `allowed` leaves that span."""
    seconds = F.unix_micros(F.col(at).cast("timestamp"))
    w = Window.partitionBy(owner).orderBy("__t")
    out = df.withColumn("__t", seconds).withColumn("recent", F.count("*").over(w.rangeBetween(-hours * 3_600_000_000, 0)))
    frees = F.min(at).over(Window.partitionBy(owner).orderBy("__t", "submission_id", "zip").rowsBetween(-(allowed - 1), 0)) + F.expr(f"interval {hours} hours")
    return out.withColumn("frees_at", frees).drop("__t")


def paired_differences(df: DataFrame, key: str, side: str, value: str) -> DataFrame:
    """Mean, population deviation and share above zero of value(1) - value(0) over keys with both."""
    p = df.groupBy(key).agg(F.avg(F.when(F.col(side) == 1, known(value))).alias("a"), F.avg(F.when(F.col(side) == 0, known(value))).alias("b"))
    diff = F.col("a") - F.col("b")
    return p.filter(diff.isNotNull()).agg(F.count("*").alias("n"), rd(F.avg(diff)).alias("mean"), rd(F.stddev_pop(diff)).alias("sd"), rd(F.avg((diff > 0).cast("double"))).alias("share_positive"))


def unnested(df: DataFrame, key: str, *arrays: str) -> DataFrame:
    """One row for each place of parallel arrays."""
    return df.select(key, F.posexplode(F.arrays_zip(*arrays)).alias("place", "z")).select(key, "place", *(F.col(f"z.{a}").alias(a) for a in arrays))


def not_completed(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return wanted.select(key).distinct().join(done.select(key), key, "left_anti")


def facts(df: DataFrame, values: dict[str, str]) -> DataFrame:
    """(name, shown): scalars of a one-row table as text with their formats."""
    rows = F.array(*(F.struct(F.lit(k).alias("name"), F.format_string(f, F.col(k)).alias("shown")) for k, f in values.items()))
    return df.select(F.explode(rows).alias("r")).select("r.*")


def _votes(s, d):
    return table(s, d, "votes").withColumn("kind", F.coalesce(T.cleaned("labels_0"), F.lit("none"))).withColumn("other", F.coalesce(T.cleaned("labels_1"), F.lit("none")))


def _hyg(s, d):
    return table(s, d, "source_hygiene").filter("pos is not null and neg is not null")


_V = "vt AS (SELECT *, CASE WHEN isnan(score) THEN NULL ELSE score END AS sc, coalesce(nullif(lower(trim(labels_0)), ''), 'none') AS kind, coalesce(nullif(lower(trim(labels_1)), ''), 'none') AS other FROM votes)"
_H = "hy AS (SELECT * FROM source_hygiene WHERE pos IS NOT NULL AND neg IS NOT NULL)"

QUERIES = {
    "a07_corpus_profile": lambda s, d: profile(D.balance(D._first(s, d), 0.5, D._cap()), harmonized(s, d)),
    "a10_method_by_prior": lambda s, d: _hyg(s, d).groupBy("action").agg(F.sum("pos").alias("gains"), F.sum("neg").alias("losses"), rd(F.avg(F.col("kept_rows"))).alias("mean_kept")),
    "a11_method_summary": lambda s, d: method_summary(_hyg(s, d).select("source", F.col("pos").cast("double").alias("pos"), F.when(F.col("action") != "dropped", F.col("kept_rows").cast("double")).alias("kept"), F.col("neg").cast("double").alias("neg")), ["pos", "kept"], "neg", "source"),
    "a12_mean_like": lambda s, d: scored(s, d).agg(rd(F.avg("score")).alias("mean"), rd(F.avg(F.when(F.col("family").isin("ambergroup", "zephyrbase"), F.col("score")))).alias("mean_like")),
    "a13_describe": lambda s, d: describe(_votes(s, d), "score", "kind"),
    "a14_crosstab": lambda s, d: D.crosstab(_votes(s, d), "kind", "other"),
    "a14_pivot": lambda s, d: harmonized(s, d).filter("label in (0, 1)").groupBy("source").pivot("label", [0, 1]).count().select("source", F.coalesce("0", F.lit(0)).alias("negatives"), F.coalesce("1", F.lit(0)).alias("positives")),
    "a15_ratio_of_means": lambda s, d: ratio_of_means(_hyg(s, d).withColumn("p", F.col("pos").cast("double")).withColumn("q", F.col("neg").cast("double")), "source", "batch_id", "p", "q"),
    "a16_efficiency": lambda s, d: efficiency(scored(s, d), "family", "score", "other"),
    "a17_known_mean": lambda s, d: _votes(s, d).groupBy("kind").agg(rd(F.avg(known("score"))).alias("mean")),
    "a18_quantiles": lambda s, d: exact_percentiles(_votes(s, d), [], known("score"), {"p10": 0.1, "p50": 0.5, "p90": 0.9}).select(*(rd(n).alias(n) for n in ("p10", "p50", "p90"))),
    "a19_flag_rates": lambda s, d: scored(s, d).crossJoin(F.broadcast(exact_percentiles(scored(s, d).filter("y = 0"), [], F.col("other"), {"thr": 0.5}))).groupBy("family", "y").agg(rd(F.avg("other")).alias("mean"), rd(F.avg((F.col("other") > F.col("thr")).cast("double"))).alias("flagged")),
    "a20_paired_differences": lambda s, d: paired_differences(scored(s, d), "source", "y", "score"),
    "a21_layer_rollup": lambda s, d: scored(s, d).groupBy("family").agg(rd(F.avg("score")).alias("mean"), rd(F.avg(F.abs("other"))).alias("mean_abs"), rd(F.max(F.abs("other"))).alias("max_abs"), rd(F.when(F.count("p") == F.count("*"), F.avg("p"))).alias("mean_p")),
    "a23_log_log_fit": lambda s, d: log_log_fit(_hyg(s, d), "action", "n", "kept_rows"),
    "a27_distinct": lambda s, d: table(s, d, "corpus").agg(F.count_distinct(T.cleaned("source")).alias("sources"), F.count_distinct(T.duplicate_group("text")).alias("groups"), F.count_distinct("batch_id").alias("batches")),
    "a28_rolling_budget": lambda s, d: rolling_budget(table(s, d, "ledger").distinct(), "owner", "utc", 24, 5).select("owner", "utc", "zip", "submission_id", "recent", "frees_at"),
    "g18_confound_summary": lambda s, d: scored(s, d).groupBy("source").agg(rd(F.avg("other")).alias("mean"), F.max_by("vec_id", F.struct("score", -F.col("vec_id"))).alias("best")),
    "g19_facts": lambda s, d: facts(table(s, d, "labels").agg(F.count("*").alias("rows"), F.avg("quality").alias("quality"), F.avg("toxic").alias("toxic")), {"rows": "%d", "quality": "%.3f", "toxic": "%.4f"}),
    "g20_scale_table": lambda s, d: table(s, d, "source_dim").agg(F.min(F.col("cap") * F.col("scan").cast("long")).alias("least"), F.max(F.col("cap") * F.col("scan").cast("long")).alias("most")),
    "g21_not_completed": lambda s, d: not_completed(harmonized(s, d), _hyg(s, d).withColumn("source", T.cleaned("source")).filter("action = 'rebalanced'"), "source"),
    "g22_unnested": lambda s, d: unnested(_votes(s, d).groupBy("row_id").agg(F.sort_array(F.collect_list("vote_id")).alias("ids"), F.sort_array(F.collect_list("received_at")).alias("times")), "row_id", "ids", "times"),
}

SQL = {
    "a07_corpus_profile": f"WITH {D._BAL}, k AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE label = 1) AS positives FROM bal GROUP BY 1), r AS (SELECT b.source, coalesce(any_value(k.n), 0) AS n, coalesce(any_value(k.positives), 0) AS positives, count(*) AS scanned FROM base b LEFT JOIN k USING (source) GROUP BY 1) SELECT source, CAST(sum(n) AS BIGINT) AS n, CAST(sum(positives) AS BIGINT) AS positives, CAST(sum(scanned) AS BIGINT) AS scanned, round(coalesce(sum(positives)::DOUBLE / nullif(sum(n), 0), 0), 6) AS rate FROM r GROUP BY ROLLUP (source)",
    "a10_method_by_prior": f"WITH {_H} SELECT action, CAST(sum(pos) AS BIGINT) AS gains, CAST(sum(neg) AS BIGINT) AS losses, round(avg(kept_rows), 6) AS mean_kept FROM hy GROUP BY 1",
    "a11_method_summary": f"WITH {_H}, l AS (SELECT source, neg::DOUBLE AS base, unnest(['pos', 'kept']) AS method, unnest([pos::DOUBLE, CASE WHEN action <> 'dropped' THEN kept_rows::DOUBLE END]) AS value FROM hy) SELECT method, count(*) AS n, round(avg(value), 6) AS mean, round(avg(base), 6) AS baseline, count(DISTINCT source) AS groups FROM l WHERE value IS NOT NULL GROUP BY 1",
    "a12_mean_like": f"WITH {SCORED_SQL} SELECT round(avg(score), 6) AS mean, round(avg(score) FILTER (WHERE family IN ('ambergroup', 'zephyrbase')), 6) AS mean_like FROM sc",
    "a13_describe": f"WITH {_V} SELECT kind, count(sc) AS n, round(avg(sc), 6) AS mean, round(stddev_samp(sc), 6) AS sd, round(min(sc), 6) AS least, round(quantile_cont(sc, 0.25), 6) AS q1, round(quantile_cont(sc, 0.5), 6) AS median, round(quantile_cont(sc, 0.75), 6) AS q3, round(max(sc), 6) AS most FROM vt GROUP BY 1",
    "a14_crosstab": f"WITH {_V} SELECT kind, other, count(*) AS n, CAST(grouping(kind, other) AS BIGINT) AS gid FROM vt GROUP BY CUBE (kind, other)",
    "a14_pivot": f"WITH {CORPUS_SQL} SELECT source, count(*) FILTER (WHERE label = 0) AS negatives, count(*) FILTER (WHERE label = 1) AS positives FROM base WHERE label IN (0, 1) GROUP BY 1",
    "a15_ratio_of_means": f"WITH {_H}, p AS (SELECT source, batch_id, avg(pos::DOUBLE) AS a, avg(neg::DOUBLE) AS b FROM hy GROUP BY 1, 2) SELECT source, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(avg(a) / nullif(avg(b), 0), 6) AS ratio, round(stddev_pop(a), 6) AS sd_a FROM p GROUP BY 1",
    "a16_efficiency": f"WITH {SCORED_SQL} SELECT family, round(sum(abs(score)) / nullif(sum(abs(other)), 0), 6) AS efficiency FROM sc GROUP BY 1",
    "a17_known_mean": f"WITH {_V} SELECT kind, round(avg(sc), 6) AS mean FROM vt GROUP BY 1",
    "a18_quantiles": f"WITH {_V} SELECT round(quantile_cont(sc, 0.1), 6) AS p10, round(quantile_cont(sc, 0.5), 6) AS p50, round(quantile_cont(sc, 0.9), 6) AS p90 FROM vt",
    "a19_flag_rates": f"WITH {SCORED_SQL}, t AS (SELECT quantile_cont(other, 0.5) AS thr FROM sc WHERE y = 0) SELECT family, y, round(avg(other), 6) AS mean, round(avg(CASE WHEN other > thr THEN 1.0::DOUBLE ELSE 0 END), 6) AS flagged FROM sc, t GROUP BY 1, 2",
    "a20_paired_differences": f"WITH {SCORED_SQL}, p AS (SELECT source, avg(score) FILTER (WHERE y = 1) - avg(score) FILTER (WHERE y = 0) AS d FROM sc GROUP BY 1) SELECT count(*) AS n, round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS sd, round(avg(CASE WHEN d > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share_positive FROM p WHERE d IS NOT NULL",
    "a21_layer_rollup": f"WITH {SCORED_SQL} SELECT family, round(avg(score), 6) AS mean, round(avg(abs(other)), 6) AS mean_abs, round(max(abs(other)), 6) AS max_abs, round(CASE WHEN count(p) = count(*) THEN avg(p) END, 6) AS mean_p FROM sc GROUP BY 1",
    "a23_log_log_fit": f"WITH {_H}, c AS (SELECT action, n, kept_rows, ln(n) AS lx, ln(kept_rows) AS ly FROM hy WHERE n > 0 AND kept_rows > 0) SELECT action, round(regr_slope(ly, lx), 6) AS slope, round(regr_intercept(ly, lx), 6) AS intercept, round(regr_r2(ly, lx), 6) AS r2, round(sum(n * kept_rows)::DOUBLE / sum(n * n), 6) AS through_origin FROM c GROUP BY 1",
    "a27_distinct": "SELECT count(DISTINCT nullif(lower(trim(source)), '')) AS sources, " + f"count(DISTINCT {D.canon_sql('text')}) AS groups, count(DISTINCT batch_id) AS batches FROM corpus",
    "a28_rolling_budget": "WITH l AS (SELECT DISTINCT * FROM ledger) SELECT owner, utc, zip, submission_id, count(*) OVER (PARTITION BY owner ORDER BY utc RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS recent, min(utc) OVER (PARTITION BY owner ORDER BY utc, submission_id NULLS FIRST, zip ROWS 4 PRECEDING) + INTERVAL 24 HOURS AS frees_at FROM l",
    "g18_confound_summary": f"WITH {SCORED_SQL} SELECT source, round(avg(other), 6) AS mean, first(vec_id ORDER BY score DESC, vec_id) AS best FROM sc GROUP BY 1",
    "g19_facts": "WITH f AS (SELECT count(*) AS rows, avg(quality) AS quality, avg(toxic) AS toxic FROM labels) SELECT unnest(['rows', 'quality', 'toxic']) AS name, unnest([printf('%d', rows), printf('%.3f', quality), printf('%.4f', toxic)]) AS shown FROM f",
    "g20_scale_table": "SELECT min(cap::BIGINT * scan) AS least, max(cap::BIGINT * scan) AS most FROM source_dim",
    "g21_not_completed": f"WITH {CORPUS_SQL} SELECT DISTINCT source FROM base WHERE source NOT IN (SELECT lower(trim(source)) FROM source_hygiene WHERE pos IS NOT NULL AND neg IS NOT NULL AND action = 'rebalanced' AND source IS NOT NULL)",
    "g22_unnested": "WITH g AS (SELECT row_id, list(vote_id ORDER BY vote_id) AS ids, list(received_at ORDER BY received_at) AS times FROM votes GROUP BY 1) SELECT row_id, CAST(generate_subscripts(ids, 1) - 1 AS INTEGER) AS place, unnest(ids) AS ids, unnest(times) AS times FROM g",
}
