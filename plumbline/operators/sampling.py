"""Deduplication, sampling and splitting, D01-D22. Counts follow fixed formulas with rounding half
to even; which rows are taken follows an order by hash, the same on every cluster."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.plans.ranking import hex_rank
from plumbline.plans.tables import CORPUS_SQL, VECTORS_SQL, canon_sql, first_by, harmonized, rd, strip_sql, table, vectors

PRIOR = 12 / 17
#: Resamples of a bootstrap.
REPS = 300


def first_wins(df: DataFrame, least: int = 3, most: int = 2000) -> DataFrame:
    """Rows whose stripped text has between `least` and `most` characters, the first of each
    canonical text by source order, place and id. The length is judged before copies are dropped,
    and a row dropped later for another reason still stands for its copies."""
    rows = df.filter(F.char_length(T.stripped("text")).between(least, most)).withColumn("key", T.duplicate_group("text"))
    keep = [c for c in rows.columns if c not in ("text", "key")]
    return first_by(rows, ["key"], ["source_ord", "pos", "row_id"], keep)


def balance_counts(counts: DataFrame, rate: float, cap: Column) -> DataFrame:
    """From (P, N) the numbers of positives and negatives to keep under a cap at a rate; if
    negatives fall short, positives fill the cap."""
    pos = F.least(F.col("P"), F.bround(cap * rate).cast("long"))
    neg = F.least(F.col("N"), F.greatest(cap - pos, F.lit(0)))
    more = F.when((pos + neg < cap) & (pos < F.col("P")), F.least(F.col("P"), cap - neg)).otherwise(pos)
    return counts.withColumn("want_pos", more).withColumn("want_neg", neg)


def class_counts(df: DataFrame, by: list[str], y: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count_if(F.col(y) == 1).alias("P"), F.count_if(F.col(y) == 0).alias("N"))


def take(df: DataFrame, wanted: DataFrame, by: list[str], y: str, order: str, tie: str) -> DataFrame:
    """Of each group and class the first rows in hash order, as many as wanted (want_pos, want_neg)."""
    ranked = hex_rank(df, [*by, y], order, tie)
    on = ranked.join(wanted.select(*by, "want_pos", "want_neg"), by) if by else ranked.crossJoin(F.broadcast(wanted.select("want_pos", "want_neg")))
    return on.filter(F.col("nth") <= F.when(F.col(y) == 1, F.col("want_pos")).otherwise(F.col("want_neg"))).select(*df.columns)


def balance(df: DataFrame, rate: float, cap: Column, order: str = "key", tie: str = "row_id") -> DataFrame:
    """Each source cut down to its cap at a rate of positives. Columns source, label, cap."""
    wanted = balance_counts(class_counts(df, ["source", "cap"], "label"), rate, cap).drop("cap")
    return take(df, wanted, ["source"], "label", order, tie)


def clean_counts(df: DataFrame, by: str, y: str, least: int, rate: float) -> DataFrame:
    """For each group P, N, its action and the numbers kept: dropped if a class has too few rows,
    kept if already at the rate, else rebalanced to it."""
    c = class_counts(df, [by], y).filter("P + N > 0")
    n = F.least(F.floor(F.col("P") / rate), F.floor(F.col("N") / (1 - rate)))
    drop = F.least("P", "N") < least
    pos = F.when(drop, 0).otherwise(F.bround(n * rate).cast("long"))
    out = c.withColumn("want_pos", pos).withColumn("want_neg", F.when(drop, 0).otherwise(n - pos))
    same = (F.col("want_pos") == F.col("P")) & (F.col("want_neg") == F.col("N"))
    return out.withColumn("action", F.when(drop, "dropped").when(same, "kept").otherwise("rebalanced")).withColumn("rate_before", F.bround(F.col("P") / (F.col("P") + F.col("N")), 4))


def prior_counts(df: DataFrame, by: list[str], y: str, rate: float) -> DataFrame:
    """The largest numbers of both classes that stand at the rate, for each group; one row at least."""
    c = class_counts(df, by, y)
    n = F.greatest(F.lit(1), F.least(F.floor(F.col("P") / F.lit(rate)), F.floor(F.col("N") / F.lit(1 - rate))))
    return c.withColumn("size", n).withColumn("want_pos", F.bround(F.col("size") * F.lit(rate)).cast("long")).withColumn("want_neg", F.col("size") - F.col("want_pos"))


def stratified_counts(df: DataFrame, y: str, cap: int) -> DataFrame:
    """(class, n, want): of each class its share of the cap, one row at least."""
    c = df.groupBy(y).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # one row for each class
    return c.withColumn("want", F.greatest(F.lit(1), F.bround(F.lit(cap) * F.col("n") / total).cast("long")))


def stratified_rows(df: DataFrame, y: str, cap: int, order: str, tie: str) -> DataFrame:
    """The rows of `stratified_counts`: of each class the first in hash order. No cap below the number
    of rows takes any off."""
    want = stratified_counts(df, y, cap).select(F.col(y).alias("__y"), "want")
    ranked = hex_rank(df, [y], order, tie)
    return ranked.join(want, ranked[y].eqNullSafe(want["__y"])).filter(F.col("nth") <= F.col("want")).select(*df.columns)


#: Groups whose class counts the greedy assignment holds at once.
MOST_GROUPS = 1_000_000


def greedy_group_folds(df: DataFrame, group: str, y: str, k: int = 5) -> DataFrame:
    """(group, n, fold): whole groups in folds, each in turn in the fold where the shares of the
    classes then differ least between the folds, the group with the most uneven classes first; of equal
    folds the one with fewer rows, then the first. Groups, one row each, are assigned on the driver,
    as each choice depends on all before; more than MOST_GROUPS are refused."""
    import numpy as np

    per = class_counts(df, [group], y)
    if per.limit(MOST_GROUPS + 1).count() > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups; group_folds takes any number")
    rows = [(r[group], np.array([r["N"], r["P"]], float)) for r in per.collect()]
    whole = sum((c for _, c in rows), np.zeros(2))
    whole[whole == 0] = 1
    folds = np.zeros((k, 2))
    out = []
    for name, c in sorted(rows, key=lambda r: (-float(np.std(r[1])), -float(r[1].sum()), str(r[0]))):
        def after(f: int, c=c) -> tuple[float, float, int]:
            trial = folds.copy()
            trial[f] += c
            return round(float(np.mean(np.std(trial / whole, axis=0))), 12), float(folds[f].sum()), f

        best = min(range(k), key=after)
        folds[best] += c
        out.append((name, int(c.sum()), best))
    kind = df.schema[group].dataType.simpleString()
    return df.sparkSession.createDataFrame(out, f"`{group}` {kind}, n long, fold int")


def held_out(df: DataFrame, family: str, y: str, least_test: int, least_train: int) -> DataFrame:
    """Sizes of the leave-one-family-out folds in one pass: a fold's training rows are the total
    less the family's. Folds with too few rows are left out."""
    c = class_counts(df, [family], y)
    w = Window.partitionBy(F.lit(0))  # one row for each family
    out = c.select(F.col(family).alias("held"), (F.col("P") + F.col("N")).alias("n_test"), F.col("P").alias("pos_test"), (F.sum(F.col("P") + F.col("N")).over(w) - F.col("P") - F.col("N")).alias("n_train"), (F.sum("P").over(w) - F.col("P")).alias("pos_train"))
    return out.filter((F.col("n_test") >= least_test) & (F.col("n_train") >= least_train))


def cross_pairs(df: DataFrame, family: str, y: str, least_pos: int, least_neg: int) -> DataFrame:
    """Cyclic pairs of families: the positives of one tested with the negatives of the next, all
    other families for training. Needs three families."""
    c = class_counts(df, [family], y).withColumnRenamed(family, "pos_family")
    w = Window.partitionBy(F.lit(0)).orderBy("pos_family")
    everything = Window.partitionBy(F.lit(0))
    out = c.withColumn("neg_family", F.coalesce(F.lead("pos_family").over(w), F.min("pos_family").over(everything))).withColumn("k", F.count("*").over(everything)).withColumn("all", F.sum(F.col("P") + F.col("N")).over(everything))
    other = c.select(F.col("pos_family").alias("neg_family"), F.col("N").alias("neg"), (F.col("P") + F.col("N")).alias("other"))
    out = out.join(other, "neg_family").filter("k >= 3")
    return out.filter((F.col("P") >= least_pos) & (F.col("neg") >= least_neg)).select("pos_family", "neg_family", F.col("P").alias("n_pos"), F.col("neg").alias("n_neg"), (F.col("all") - F.col("P") - F.col("N") - F.col("other")).alias("n_train"))


def within_share(df: DataFrame, by: list[str], order: str, tie: str, share: float) -> DataFrame:
    """`df` with `train`: whether a row is among the first floor(share * n) of its group."""
    ranked = hex_rank(df, by, order, tie)
    n = df.groupBy(*by).agg(F.count("*").alias("__n"))
    on = F.lit(True)
    for b in by:
        on = on & ranked[b].eqNullSafe(n[b])
    joined = ranked.join(n, on) if by else ranked.crossJoin(F.broadcast(n))
    return joined.select(*(ranked[c] for c in df.columns), (F.col("nth") <= F.floor(F.col("__n") * share)).alias("train"))


def folds(df: DataFrame, y: str, order: str, tie: str, most: int = 5) -> DataFrame:
    """`df` with `fold`: the place within the class modulo the number of folds, which is that of the
    smaller class between 2 and `most`."""
    k = df.groupBy(y).agg(F.count("*").alias("n")).agg(F.greatest(F.lit(2), F.least(F.lit(most), F.min("n"))).alias("__k"))
    return hex_rank(df, [y], order, tie).crossJoin(F.broadcast(k)).select(*df.columns, F.pmod(F.col("nth") - 1, F.col("__k")).cast("int").alias("fold"))


def group_folds(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """(group, n, fold): whole groups in folds, by size in serpentine order so that folds are alike."""
    n = df.groupBy(group).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), group)) - 1  # one row for each group
    turn = F.floor(place / k) % 2
    return n.withColumn("p", place).withColumn("fold", F.when(turn == 0, F.col("p") % k).otherwise(k - 1 - F.col("p") % k).cast("int")).drop("p")


def bootstrap_means(df: DataFrame, value: str, order: str, tie: str, reps: int, seed: str) -> DataFrame:
    """(rep, mean): means of `reps` samples with replacement, drawn by hash."""
    ranked = hex_rank(df.filter(F.col(value).isNotNull()), [], order, tie).select("nth", value)
    n = ranked.agg(F.count("*").alias("n"))
    draw = F.conv(F.substring(T.seeded(seed, F.concat_ws("/", F.col("rep").cast("string"), F.col("nth").cast("string"))), 1, 12), 16, 10).cast("long")
    draws = ranked.select("nth").crossJoin(F.broadcast(n)).select("n", "nth", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"))
    picked = draws.select("rep", (F.pmod(draw, F.col("n")) + 1).alias("nth"))
    return picked.join(ranked, "nth").groupBy("rep").agg(rd(F.avg(value)).alias("mean"))


def permuted(df: DataFrame, y: str, key: str, seed: str) -> DataFrame:
    """(key, y, other): each row's label and that of a random other row, a permutation."""
    a = hex_rank(df.select(key, y).withColumn("o", T.seeded(seed + "a", F.col(key).cast("string"))), [], "o", key)
    b = hex_rank(df.select(key, F.col(y).alias("other")).withColumn("o", T.seeded(seed + "b", F.col(key).cast("string"))), [], "o", key)
    return a.select(key, y, "nth").join(b.select("other", "nth"), "nth").select(key, y, "other")


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of both, with margins where one is null."""
    return df.cube(a, b).agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))


def minimal_pairs(subjects: DataFrame, words: DataFrame, spurious: float, seed: str) -> DataFrame:
    """Prompt pairs that differ in one word, with a confounding mark that agrees with the label in
    a given share: (subject, word, y, mark, prompt)."""
    y = F.explode(F.array(F.lit(0), F.lit(1))).alias("y")
    rows = subjects.crossJoin(words).select("subject", "word", y)
    draw = F.conv(F.substring(T.seeded(seed, F.concat_ws("/", "subject", "word", F.col("y").cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    agrees = draw < spurious
    mark = F.when(agrees, F.col("y")).otherwise(1 - F.col("y"))
    return rows.withColumn("mark", mark).withColumn("prompt", F.format_string("%s %s. Honestly, %s is %s%s", F.when(F.col("y") == 1, "terrible").otherwise("decent"), "subject", "subject", "word", F.when(F.col("mark") == 1, "!").otherwise(".")))


def planted_tokens(n: DataFrame, length: int, seed: str, vocabulary: int = 50) -> DataFrame:
    """(id, tokens, y): random tokens with a content token planted where y is 1."""
    draw = lambda k: F.conv(F.substring(T.seeded(seed, F.concat_ws("/", F.col("id").cast("string"), k.cast("string"))), 1, 8), 16, 10).cast("long")
    y = F.pmod(draw(F.lit(0)), F.lit(2)).cast("int")
    place = F.pmod(draw(F.lit(-1)), F.lit(length)) + 1
    tokens = F.transform(F.sequence(F.lit(1), F.lit(length)), lambda k: F.when((y == 1) & (k == place), F.lit(vocabulary)).otherwise(F.pmod(draw(k), F.lit(vocabulary))).cast("int"))
    return n.select("id", tokens.alias("tokens"), y.alias("y"))


def gaussian_system(spark, n: int, d: int, seed: int = 0, rotate: bool = False) -> DataFrame:
    """(id, x, g): normal states and adjoints; the adjoints rotated if asked. `n` rows, made on the driver."""
    import numpy as np

    rng = np.random.default_rng(seed)
    x, g = rng.normal(size=(n, d)), rng.normal(size=(n, d)) * np.linspace(2, 0.5, d)
    if rotate:
        g = g @ np.linalg.qr(rng.normal(size=(d, d)))[0]
    return spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, g))], "id long, x array<double>, g array<double>")


# ---- queries -------------------------------------------------------------------------------------
LEAST, CAP_SCALE = 5, 0.002


def _first(s, d):
    return first_wins(harmonized(s, d)).filter("label in (0, 1)")


def _cap() -> Column:
    return F.greatest(F.lit(1), F.bround(F.col("cap") * CAP_SCALE).cast("long"))


def _lab(s, d):
    return harmonized(s, d).filter("label in (0, 1)").withColumn("key", T.duplicate_group(F.coalesce("text", F.lit(""))))


def _vec(s, d):
    return vectors(s, d).select("vec_id", "y", "source", "family").withColumn("o", T.seeded("17", F.col("vec_id").cast("string")))


def _best_votes(s, d):
    v = table(s, d, "votes").filter("score is not null and not isnan(score)").join(table(s, d, "corpus").select("row_id", "text").filter("text is not null"), "row_id")
    v = v.withColumn("key", T.duplicate_group("text")).withColumn("far", -F.abs(F.col("score") - 0.5))
    return first_by(v, ["key"], ["far", "vote_id"], ["row_id", "score"]).select("key", "vote_id", "row_id", "score")


def _excluded(s, d):
    new = table(s, d, "documents").select("doc_id", T.strict_key("text").alias("key")).filter("key <> ''")
    old = table(s, d, "corpus").select(T.strict_key("text").alias("key")).filter("key <> ''").distinct()
    fresh = first_by(new.join(old, "key", "left_anti"), ["key"], ["doc_id"], [])
    counts = new.agg(F.count("*").alias("rows")).crossJoin(new.join(old, "key", "left_semi").agg(F.count("*").alias("excluded"))).crossJoin(fresh.agg(F.count("*").alias("kept")))
    return counts


def _quality_means(s, d, reps: int):
    q = table(s, d, "labels").filter("quality is not null").groupBy("doc_id").agg(F.max("quality").cast("double").alias("quality"))
    return bootstrap_means(q.withColumn("o", T.seeded("b", F.col("doc_id").cast("string"))), "quality", "o", "doc_id", reps, "29")


_FIRST = f"""{CORPUS_SQL}, keyed AS (SELECT *, sha1({canon_sql('text')}) AS key FROM base WHERE length({strip_sql('text')}) BETWEEN 3 AND 2000),
won AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY source_ord, pos, row_id) AS nth FROM keyed) WHERE nth = 1),
fst AS (SELECT * FROM won WHERE label IN (0, 1))"""
_LAB = f"{CORPUS_SQL}, lab AS (SELECT *, sha1({canon_sql(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')}) AS key FROM base WHERE label IN (0, 1))"
_VEC = f"{VECTORS_SQL}, vo AS (SELECT vec_id, y, source, family, sha1('17:' || vec_id) AS o FROM vec)"
_BAL = f"""{_FIRST}, cc AS (SELECT source, greatest(1, CAST(round_even(any_value(cap) * {CAP_SCALE}, 0) AS BIGINT)) AS cap, count(*) FILTER (WHERE label = 1) AS P, count(*) FILTER (WHERE label = 0) AS N FROM fst GROUP BY 1),
w0 AS (SELECT *, least(P, CAST(round_even(cap * 0.5, 0) AS BIGINT)) AS wp FROM cc), w1 AS (SELECT *, least(N, greatest(cap - wp, 0)) AS want_neg FROM w0),
w2 AS (SELECT *, CASE WHEN wp + want_neg < cap AND wp < P THEN least(P, cap - want_neg) ELSE wp END AS want_pos FROM w1),
bal AS (SELECT f.* FROM (SELECT *, row_number() OVER (PARTITION BY source, label ORDER BY key, row_id) AS r FROM fst) f JOIN w2 USING (source) WHERE f.r <= CASE WHEN label = 1 THEN want_pos ELSE want_neg END)"""
_CLEAN = f"""{_LAB}, cc AS (SELECT source, count(*) FILTER (WHERE label = 1) AS P, count(*) FILTER (WHERE label = 0) AS N FROM lab GROUP BY 1),
c1 AS (SELECT *, CAST(least(floor(P / 0.5::DOUBLE), floor(N / 0.5::DOUBLE)) AS BIGINT) AS k, least(P, N) < {LEAST} AS bad FROM cc),
c2 AS (SELECT *, CASE WHEN bad THEN 0 ELSE CAST(round_even(k * 0.5::DOUBLE, 0) AS BIGINT) END AS want_pos FROM c1),
cln AS (SELECT *, CASE WHEN bad THEN 0 ELSE k - want_pos END AS want_neg FROM c2)"""
_PRI = f"""{_VEC}, cc AS (SELECT family, count(*) FILTER (WHERE y = 1) AS P, count(*) FILTER (WHERE y = 0) AS N FROM vo GROUP BY 1),
p1 AS (SELECT *, greatest(1, least(CAST(floor(P / (12::DOUBLE / 17)) AS BIGINT), CAST(floor(N / (1 - 12::DOUBLE / 17)) AS BIGINT))) AS size FROM cc),
pri AS (SELECT *, CAST(round_even(size * (12::DOUBLE / 17), 0) AS BIGINT) AS want_pos, size - CAST(round_even(size * (12::DOUBLE / 17), 0) AS BIGINT) AS want_neg FROM p1)"""

QUERIES = {
    "d01_first_wins": lambda s, d: first_wins(harmonized(s, d)).select("key", "row_id", "source", "label"),
    "d02_by_text_and_label": lambda s, d: first_by(table(s, d, "corpus").filter("text is not null and label in (0, 1)").withColumn("key", T.duplicate_group("text")), ["key", "label"], ["row_id"], []).select("key", "label", "row_id"),
    "d03_most_decisive": _best_votes,
    "d04_excluding_known": _excluded,
    "d05_balance": lambda s, d: balance(_first(s, d), 0.5, _cap()).select("row_id", "source", "label"),
    "d06_proportional_cap": lambda s, d: take(_lab(s, d), s.createDataFrame([(300, 200)], "want_pos long, want_neg long"), [], "label", "key", "row_id").select("row_id", "label"),
    "d07_clean_report": lambda s, d: clean_counts(_lab(s, d), "source", "label", LEAST, 0.5).select("source", "P", "N", "want_pos", "want_neg", "action"),
    "d07_clean_rows": lambda s, d: take(_lab(s, d), clean_counts(_lab(s, d), "source", "label", LEAST, 0.5), ["source"], "label", "key", "row_id").select("row_id", "source", "label"),
    "d08_stratified_cap": lambda s, d: stratified_counts(_lab(s, d).withColumn("grp", F.col("family")), "grp", 200),
    "d08_stratified_rows": lambda s, d: stratified_rows(_vec(s, d), "family", 200, "o", "vec_id").select("vec_id", "family"),
    "d09_prior_counts": lambda s, d: prior_counts(_vec(s, d), ["family"], "y", PRIOR).select("family", "P", "N", "size", "want_pos", "want_neg"),
    "d09_prior_rows": lambda s, d: take(_vec(s, d), prior_counts(_vec(s, d), ["family"], "y", PRIOR), ["family"], "y", "o", "vec_id").select("vec_id", "family", "y"),
    "d10_held_out_folds": lambda s, d: held_out(_vec(s, d), "family", "y", 20, 100),
    "d11_cross_pairs": lambda s, d: cross_pairs(_vec(s, d), "family", "y", 5, 5),
    "d12_within_source": lambda s, d: within_share(_vec(s, d), ["family", "y"], "o", "vec_id", 0.8).select("vec_id", "train"),
    "d13_halves": lambda s, d: within_share(_vec(s, d), [], "o", "vec_id", 0.5).select("vec_id", "train"),
    "d14_balanced_sample": lambda s, d: take(_vec(s, d), s.createDataFrame([(40, 40)], "want_pos long, want_neg long"), [], "y", "o", "vec_id").select("vec_id", "y"),
    "d15_folds": lambda s, d: folds(_vec(s, d), "y", "o", "vec_id").select("vec_id", "fold"),
    "d15_group_folds": lambda s, d: group_folds(_vec(s, d), "source"),
    "d15_greedy_folds": lambda s, d: greedy_group_folds(_vec(s, d), "source", "y"),
    "d16_tuning_rows": lambda s, d: stratified_rows(_vec(s, d), "y", 100, "o", "vec_id").select("vec_id", "y"),
    "d16_tuning_cap": lambda s, d: stratified_counts(_vec(s, d), "y", 100),
    "d17_crosstab": lambda s, d: crosstab(take(_vec(s, d), s.createDataFrame([(50, 50)], "want_pos long, want_neg long"), [], "y", "o", "vec_id"), "family", "y"),
    "d18_bootstrap": lambda s, d: _quality_means(s, d, REPS),
    "d18_bootstrap_whole": lambda s, d: _quality_means(s, d, REPS),
    "d19_permuted_labels": lambda s, d: permuted(_vec(s, d), "y", "vec_id", "41"),
    "d20_minimal_pairs": lambda s, d: minimal_pairs(table(s, d, "source_dim").select(T.cleaned("name").alias("subject")).distinct(), table(s, d, "source_dim").select(T.cleaned("note").alias("word")).dropna().distinct(), 0.85, "5"),
    "d21_planted_tokens": lambda s, d: planted_tokens(table(s, d, "labels").select(F.col("doc_id").alias("id")).distinct(), 8, "3"),
    "d22_gaussian_system": lambda s, d: gaussian_system(s, 50, 8),
}

_NTH = "SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY o, vec_id) AS r FROM vo)"
SQL = {
    "d01_first_wins": f"WITH {_FIRST} SELECT key, row_id, source, label FROM won",
    "d02_by_text_and_label": f"SELECT sha1({canon_sql('text')}) AS key, label, min(row_id) AS row_id FROM corpus WHERE text IS NOT NULL AND label IN (0, 1) GROUP BY 1, 2",
    "d03_most_decisive": f"SELECT key, vote_id, row_id, score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY -abs(score - 0.5), vote_id) AS nth FROM (SELECT v.vote_id, v.row_id, v.score, sha1({canon_sql('c.text')}) AS key FROM votes v JOIN corpus c USING (row_id) WHERE c.text IS NOT NULL AND v.score IS NOT NULL AND NOT isnan(v.score))) WHERE nth = 1",
    "d04_excluding_known": "WITH n AS (SELECT regexp_replace(lower(text), '[^\\pL\\pN_]+', '', 'g') AS key FROM documents), o AS (SELECT DISTINCT regexp_replace(lower(text), '[^\\pL\\pN_]+', '', 'g') AS key FROM corpus), m AS (SELECT key, key IN (SELECT key FROM o WHERE key <> '') AS known FROM n WHERE key <> '') SELECT count(*) AS rows, count(*) FILTER (WHERE known) AS excluded, count(DISTINCT CASE WHEN NOT known THEN key END) AS kept FROM m",
    "d05_balance": f"WITH {_BAL} SELECT row_id, source, label FROM bal",
    "d06_proportional_cap": f"WITH {_LAB} SELECT row_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY key, row_id) AS r FROM lab) WHERE r <= CASE WHEN label = 1 THEN 300 ELSE 200 END",
    "d07_clean_report": f"WITH {_CLEAN} SELECT source, P, N, CAST(want_pos AS BIGINT) AS want_pos, CAST(want_neg AS BIGINT) AS want_neg, CASE WHEN bad THEN 'dropped' WHEN want_pos = P AND want_neg = N THEN 'kept' ELSE 'rebalanced' END AS action FROM cln",
    "d07_clean_rows": f"WITH {_CLEAN} SELECT row_id, source, label FROM (SELECT *, row_number() OVER (PARTITION BY source, label ORDER BY key, row_id) AS r FROM lab) JOIN cln USING (source) WHERE r <= CASE WHEN label = 1 THEN want_pos ELSE want_neg END",
    "d08_stratified_cap": f"WITH {_LAB} SELECT family AS grp, count(*) AS n, greatest(1, CAST(round_even(200 * count(*) / (sum(count(*)) OVER ())::DOUBLE, 0) AS BIGINT)) AS want FROM lab GROUP BY 1",
    "d08_stratified_rows": f"WITH {_VEC}, w AS (SELECT family AS c, greatest(1, CAST(round_even(200 * count(*) / (sum(count(*)) OVER ())::DOUBLE, 0) AS BIGINT)) AS want FROM vo GROUP BY 1) SELECT vec_id, family FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY o, vec_id) AS r FROM vo) t JOIN w ON w.c = t.family WHERE r <= want",
    "d09_prior_counts": f"WITH {_PRI} SELECT family, P, N, size, want_pos, want_neg FROM pri",
    "d09_prior_rows": f"WITH {_PRI} SELECT vec_id, family, y FROM (SELECT *, row_number() OVER (PARTITION BY family, y ORDER BY o, vec_id) AS r FROM vo) JOIN pri USING (family) WHERE r <= CASE WHEN y = 1 THEN want_pos ELSE want_neg END",
    "d10_held_out_folds": f"WITH {_VEC} SELECT * FROM (SELECT family AS held, count(*) AS n_test, count(*) FILTER (WHERE y = 1) AS pos_test, CAST(sum(count(*)) OVER () - count(*) AS BIGINT) AS n_train, CAST(sum(count(*) FILTER (WHERE y = 1)) OVER () - count(*) FILTER (WHERE y = 1) AS BIGINT) AS pos_train FROM vo GROUP BY 1) WHERE n_test >= 20 AND n_train >= 100",
    "d11_cross_pairs": f"""WITH {_VEC}, c AS (SELECT family, count(*) FILTER (WHERE y = 1) AS P, count(*) FILTER (WHERE y = 0) AS N FROM vo GROUP BY 1),
        q AS (SELECT *, coalesce(lead(family) OVER (ORDER BY family), min(family) OVER ()) AS nf, count(*) OVER () AS k, sum(P + N) OVER () AS total FROM c)
        SELECT q.family AS pos_family, nf AS neg_family, q.P AS n_pos, o.N AS n_neg, CAST(total - q.P - q.N - o.P - o.N AS BIGINT) AS n_train FROM q JOIN c o ON o.family = nf WHERE k >= 3 AND q.P >= 5 AND o.N >= 5""",
    "d12_within_source": f"WITH {_VEC} SELECT vec_id, row_number() OVER (PARTITION BY family, y ORDER BY o, vec_id) <= floor(count(*) OVER (PARTITION BY family, y) * 0.8::DOUBLE) AS train FROM vo",
    "d13_halves": f"WITH {_VEC} SELECT vec_id, row_number() OVER (ORDER BY o, vec_id) <= floor(count(*) OVER () * 0.5::DOUBLE) AS train FROM vo",
    "d14_balanced_sample": f"WITH {_VEC} {_NTH.format(cols='vec_id, y', by='y')} WHERE r <= 40",
    "d15_folds": f"WITH {_VEC}, k AS (SELECT greatest(2, least(5, min(n))) AS k FROM (SELECT count(*) AS n FROM vo GROUP BY y)) SELECT vec_id, CAST((row_number() OVER (PARTITION BY y ORDER BY o, vec_id) - 1) % k AS INTEGER) AS fold FROM vo, k",
    "d15_group_folds": f"WITH {_VEC} SELECT source, n, CAST(CASE WHEN (p // 5) % 2 = 0 THEN p % 5 ELSE 4 - p % 5 END AS INTEGER) AS fold FROM (SELECT source, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source) - 1 AS p FROM vo GROUP BY 1)",
    "d16_tuning_rows": f"WITH {_VEC}, w AS (SELECT y AS c, greatest(1, CAST(round_even(100 * count(*) / (sum(count(*)) OVER ())::DOUBLE, 0) AS BIGINT)) AS want FROM vo GROUP BY 1) SELECT vec_id, y FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY o, vec_id) AS r FROM vo) t JOIN w ON w.c = t.y WHERE r <= want",
    "d16_tuning_cap": f"WITH {_VEC} SELECT y, count(*) AS n, greatest(1, CAST(round_even(100 * count(*) / (sum(count(*)) OVER ())::DOUBLE, 0) AS BIGINT)) AS want FROM vo GROUP BY 1",
    "d17_crosstab": f"WITH {_VEC} SELECT family, y, count(*) AS n, CAST(grouping(family, y) AS BIGINT) AS gid FROM ({_NTH.format(cols='*', by='y')} WHERE r <= 50) GROUP BY CUBE (family, y)",
    "d18_bootstrap": "WITH q AS (SELECT doc_id, max(quality)::DOUBLE AS quality FROM labels WHERE quality IS NOT NULL GROUP BY 1), r AS (SELECT quality, row_number() OVER (ORDER BY sha1('b:' || doc_id), doc_id) AS nth, count(*) OVER () AS n FROM q), p AS (SELECT rep, CAST(concat('0x', substr(sha1('29:' || rep || '/' || nth), 1, 12)) AS UBIGINT) % n + 1 AS pick FROM r, range(1, 301) t(rep)) SELECT CAST(rep AS INTEGER) AS rep, round(avg(quality), 6) AS mean FROM p JOIN r ON r.nth = p.pick GROUP BY 1",
    "d19_permuted_labels": f"WITH {_VEC} SELECT a.vec_id, a.y, b.y AS other FROM (SELECT vec_id, y, row_number() OVER (ORDER BY sha1('41a:' || vec_id), vec_id) AS n FROM vo) a JOIN (SELECT y, row_number() OVER (ORDER BY sha1('41b:' || vec_id), vec_id) AS n FROM vo) b USING (n)",
    "d20_minimal_pairs": """WITH s AS (SELECT DISTINCT """ + "nullif(lower(regexp_replace(name, '^\\s+|\\s+$', '', 'g')), '')" + """ AS subject FROM source_dim), w AS (SELECT DISTINCT lower(trim(note)) AS word FROM source_dim WHERE note IS NOT NULL AND trim(note) <> ''),
        r AS (SELECT *, CASE WHEN CAST(concat('0x', substr(sha1('5:' || subject || '/' || word || '/' || y), 1, 8)) AS UBIGINT)::DOUBLE / 4294967296 < 0.85 THEN y ELSE 1 - y END AS mark FROM s, w, (VALUES (0), (1)) v(y))
        SELECT subject, word, y, mark, CASE WHEN y = 1 THEN 'terrible' ELSE 'decent' END || ' ' || subject || '. Honestly, ' || subject || ' is ' || word || CASE WHEN mark = 1 THEN '!' ELSE '.' END AS prompt FROM r""",
    "d21_planted_tokens": """WITH i AS (SELECT DISTINCT doc_id AS id FROM labels), h AS (SELECT id, CAST(CAST(concat('0x', substr(sha1('3:' || id || '/0'), 1, 8)) AS UBIGINT) % 2 AS INTEGER) AS y, CAST(concat('0x', substr(sha1('3:' || id || '/-1'), 1, 8)) AS UBIGINT) % 8 + 1 AS place FROM i)
        SELECT id, list_transform(range(1, 9), lambda k: CAST(CASE WHEN y = 1 AND k = place THEN 50 ELSE CAST(concat('0x', substr(sha1('3:' || id || '/' || k), 1, 8)) AS UBIGINT) % 50 END AS INTEGER)) AS tokens, y FROM h""",
}
SQL["d18_bootstrap_whole"] = SQL["d18_bootstrap"]
