"""Label mapping and predicates, P01-P21."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.functions.vectors import finite
from plumbline.plans.ranking import exact_percentiles
from plumbline.plans.tables import CORPUS_SQL, canon_sql, harmonized, rd, strip_sql, table


def band(score: Column | str, high: float, low: float, strict: bool = False) -> Column:
    """1 from `high` up, 0 from `low` down, null between; null and NaN scores are null. With
    `strict` the bounds themselves are null."""
    s = F.nanvl(F.col(score) if isinstance(score, str) else score, F.lit(None).cast("double"))
    return F.when(s > high if strict else s >= high, 1).when(s < low if strict else s <= low, 0)


def majority(votes: list[str], safe: str) -> Column:
    """0 where most votes are `safe`, 1 where most are something else; null for ties and for no
    votes. Null and blank votes don't count; case and white space around are ignored."""
    cast = F.filter(F.array(*(T.cleaned(v) for v in votes)), lambda v: v.isNotNull())
    yes = F.size(F.filter(cast, lambda v: v == safe))
    return F.when(yes * 2 > F.size(cast), 0).when(yes * 2 < F.size(cast), 1)


def mean_band(df: DataFrame, key: str, score: str, order: str, high: float, low: float) -> DataFrame:
    """Mean score of each key in a band; keys in between are dropped. (key, mean_score, y, first)."""
    clean = F.nanvl(score, F.lit(None).cast("double"))
    out = df.groupBy(key).agg(F.avg(clean).alias("mean_score"), F.min(order).alias("first"))
    return out.withColumn("y", band("mean_score", high, low, True)).filter("y is not null").select(key, rd("mean_score").alias("mean_score"), "y", "first")


def concepts(df: DataFrame, key: str, text: str) -> DataFrame:
    """Labels derived from a text: has a question mark, has a digit, is longer than the median, has
    a larger share of capitals than the median."""
    n = F.char_length(text)
    share = F.char_length(F.regexp_replace(text, "[^A-Z]", "")) / F.greatest(F.lit(1), n)
    rows = df.filter(F.col(text).isNotNull()).select(key, F.contains(text, F.lit("?")).cast("int").alias("question"), F.col(text).rlike("[0-9]").cast("int").alias("digit"), n.alias("n"), share.alias("share"))
    middle = exact_percentiles(rows, [], F.col("n"), {"n_mid": 0.5}).crossJoin(exact_percentiles(rows, [], F.col("share"), {"share_mid": 0.5}))
    # one row of two numbers
    return rows.crossJoin(F.broadcast(middle)).select(key, "question", "digit", (F.col("n") > F.col("n_mid")).cast("int").alias("long"), (F.col("share") > F.col("share_mid")).cast("int").alias("capitals"))


def of_layers(df: DataFrame, layer: str, wanted: list[int]) -> DataFrame:
    """Rows of the wanted layers; those of no layer are left out."""
    return df.filter(F.col(layer).isin(wanted))


def varying(df: DataFrame, names: list[str]) -> DataFrame:
    """Those columns that aren't constant: (name, positives, rows)."""
    one = df.agg(*(F.struct(F.min(n).alias("a"), F.max(n).alias("b"), F.sum(n).alias("s"), F.count(n).alias("c")).alias(n) for n in names))
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("v")) for n in names))).alias("r")
    return one.select(rows).filter("r.v.a <> r.v.b").select("r.name", F.col("r.v.s").alias("positives"), F.col("r.v.c").alias("rows"))


def agreeing(df: DataFrame, y: str, score: str, high: float = 0.7, low: float = 0.3) -> DataFrame:
    """Rows whose label a teacher's score supports."""
    return df.filter(((F.col(y) == 1) & (F.col(score) >= high) & ~F.isnan(score)) | ((F.col(y) == 0) & (F.col(score) <= low)))


def size_fingerprint(df: DataFrame, levels: list[str], low: int, high: int) -> DataFrame:
    """Row counts at each level of a hierarchy that lie between low and high; a null level is a total."""
    sets = [levels[:k] for k in range(1, len(levels) + 1)]
    return df.groupingSets(sets, *levels).agg(F.count("*").alias("n"), F.grouping_id().alias("gid")).filter(F.col("n").between(low, high)).select(*levels, "gid", "n")


def majority_share(df: DataFrame, by: str, value: str) -> DataFrame:
    """Share of the most frequent value where a column has two or three of them."""
    per = df.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    return per.groupBy(by).agg(F.count("*").alias("distinct_values"), rd(F.max("n") / F.sum("n")).alias("share")).filter("distinct_values between 2 and 3")


def known_words(words: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of (word) that stand as one word in some text."""
    vocabulary = texts.select(F.explode(F.array_distinct(F.split(F.lower("text"), "[^\\p{L}\\p{N}]+"))).alias("word")).distinct()
    return words.join(vocabulary, "word", "left_semi")


def _v(s, d):
    return table(s, d, "votes")


def _teacher(s, d):
    return _v(s, d).groupBy("row_id").agg(F.avg(F.nanvl("score", F.lit(None).cast("double"))).alias("score")).join(table(s, d, "corpus").select("row_id", "label"), "row_id")


_VOTES = [f"labels_{k}" for k in range(5)]
_SCORE = "CASE WHEN isnan(score) THEN NULL ELSE score END"
_CONCEPTS = """rows AS (SELECT row_id, CAST(contains(text, '?') AS INTEGER) AS question, CAST(regexp_matches(text, '[0-9]') AS INTEGER) AS digit,
  length(text) AS n, length(regexp_replace(text, '[^A-Z]', '', 'g'))::DOUBLE / greatest(1, length(text)) AS share FROM corpus WHERE text IS NOT NULL),
mid AS (SELECT quantile_cont(n, 0.5) AS n_mid, quantile_cont(share, 0.5) AS share_mid FROM rows),
con AS (SELECT row_id, question, digit, CAST(n > n_mid AS INTEGER) AS long, CAST(share > share_mid AS INTEGER) AS capitals FROM rows, mid)"""

QUERIES = {
    "label_p01_band_label": lambda s, d: _v(s, d).select("vote_id", "row_id", band("score", 0.5, 0.05).alias("y")).filter("y is not null"),
    "label_p02_nested_band": lambda s, d: _v(s, d).join(table(s, d, "corpus").select("row_id", "text"), "row_id").select("vote_id", F.struct("text", F.col("score").alias("toxicity")).alias("prompt")).select("vote_id", F.col("prompt.text").alias("text"), band(F.col("prompt.toxicity"), 0.5, 0.05).alias("y")).filter((F.col("y").isNotNull()) & (T.stripped("text") != "")).select("vote_id", "y"),
    "label_p03_category_collapse": lambda s, d: table(s, d, "labels").filter("quality is not null").select("doc_id", F.when(F.col("quality") == 2, 0).otherwise(1).alias("y")),
    "label_p04_string_label": lambda s, d: _v(s, d).filter("labels_0 is not null").select("vote_id", (T.cleaned("labels_0") == "harassment").cast("int").alias("y")).fillna(0, ["y"]),
    "label_p05_passthrough": lambda s, d: table(s, d, "corpus").filter("label in (0, 1)").select("row_id", F.col("label").cast("int").alias("y")),
    "label_p06_majority_vote": lambda s, d: _v(s, d).select("vote_id", majority(_VOTES, "safe").alias("y")).filter("y is not null"),
    "label_p07_mean_band": lambda s, d: mean_band(_v(s, d), "row_id", "score", "vote_id", 0.5, 0.2),
    "label_p08_hard_threshold": lambda s, d: _v(s, d).filter("score is not null and not isnan(score)").select("vote_id", (F.col("score") >= 0.5).cast("int").alias("y")),
    "label_p09_one_vs_normal": lambda s, d: table(s, d, "events").select("event_id", (F.col("event_type") != "view").cast("int").alias("y")),
    "label_p10_length": lambda s, d: table(s, d, "corpus").filter(F.char_length(T.stripped("text")).between(3, 2000)).select("row_id"),
    "label_p11_non_empty": lambda s, d: table(s, d, "corpus").filter(T.canonical("text") != "").select("row_id"),
    "label_p12_layer": lambda s, d: of_layers(table(s, d, "embeddings").withColumn("layer", F.col("label")), "layer", [0, 1, 2, 3, 4, 5, 6, 7, 8, 9]).select("vec_id", "layer", "label"),
    "label_p13_family": lambda s, d: harmonized(s, d).groupBy("family", "source").agg(F.count("*").alias("n")),
    "label_p14_without_families": lambda s, d: harmonized(s, d).filter(~F.col("family").isin("ambergroup", "deltabase")).groupBy("source").agg(F.count("*").alias("n")),
    "label_p15_concepts": lambda s, d: concepts(table(s, d, "corpus"), "row_id", "text"),
    "label_p16_varying": lambda s, d: varying(concepts(table(s, d, "corpus"), "row_id", "text").withColumn("always", F.lit(1)), ["question", "digit", "long", "capitals", "always"]),
    "label_p17_agreeing": lambda s, d: agreeing(_teacher(s, d), "label", "score").select("row_id", "label"),
    "label_p18_fingerprint": lambda s, d: size_fingerprint(harmonized(s, d), ["family", "source", "split"], 10, 500),
    "label_p19_majority_share": lambda s, d: majority_share(harmonized(s, d), "source", "label"),
    "label_p20_finite": lambda s, d: table(s, d, "bundle").agg(F.count_if(finite("embedding")).alias("finite"), F.count_if(~finite("embedding")).alias("other")),
    "label_p21_known_words": lambda s, d: known_words(table(s, d, "person_names").select(F.lower("name_part").alias("word")).distinct(), table(s, d, "corpus")),
}

SQL = {
    "label_p01_band_label": f"SELECT * FROM (SELECT vote_id, row_id, CASE WHEN s >= 0.5 THEN 1 WHEN s <= 0.05 THEN 0 END AS y FROM (SELECT *, {_SCORE} AS s FROM votes)) WHERE y IS NOT NULL",
    "label_p02_nested_band": f"SELECT vote_id, y FROM (SELECT vote_id, text, CASE WHEN s >= 0.5 THEN 1 WHEN s <= 0.05 THEN 0 END AS y FROM (SELECT v.*, c.text, {_SCORE} AS s FROM votes v JOIN corpus c USING (row_id))) WHERE y IS NOT NULL AND {strip_sql('text')} <> ''",
    "label_p03_category_collapse": "SELECT doc_id, CASE WHEN quality = 2 THEN 0 ELSE 1 END AS y FROM labels WHERE quality IS NOT NULL",
    "label_p04_string_label": f"SELECT vote_id, CAST(lower({strip_sql('labels_0')}) = 'harassment' AS INTEGER) AS y FROM votes WHERE labels_0 IS NOT NULL",
    "label_p05_passthrough": "SELECT row_id, label AS y FROM corpus WHERE label IN (0, 1)",
    "label_p06_majority_vote": f"SELECT * FROM (SELECT vote_id, CASE WHEN 2 * len(list_filter(l, lambda x: x = 'safe')) > len(l) THEN 0 WHEN 2 * len(list_filter(l, lambda x: x = 'safe')) < len(l) THEN 1 END AS y FROM (SELECT vote_id, list_filter([{', '.join(f'lower({strip_sql(v)})' for v in _VOTES)}], lambda x: x IS NOT NULL AND x <> '') AS l FROM votes)) WHERE y IS NOT NULL",
    "label_p07_mean_band": f"SELECT row_id, round(m, 6) AS mean_score, y, f AS first FROM (SELECT *, CASE WHEN m > 0.5 THEN 1 WHEN m < 0.2 THEN 0 END AS y FROM (SELECT row_id, avg({_SCORE}) AS m, min(vote_id) AS f FROM votes GROUP BY 1)) WHERE y IS NOT NULL",
    "label_p08_hard_threshold": "SELECT vote_id, CAST(score >= 0.5 AS INTEGER) AS y FROM votes WHERE score IS NOT NULL AND NOT isnan(score)",
    "label_p09_one_vs_normal": "SELECT event_id, CAST(event_type <> 'view' AS INTEGER) AS y FROM events",
    "label_p10_length": f"SELECT row_id FROM corpus WHERE length({strip_sql('text')}) BETWEEN 3 AND 2000",
    "label_p11_non_empty": f"SELECT row_id FROM corpus WHERE {canon_sql('text')} <> ''",
    "label_p12_layer": "SELECT vec_id, label AS layer, label FROM embeddings WHERE label BETWEEN 0 AND 9",
    "label_p13_family": f"WITH {CORPUS_SQL} SELECT family, source, count(*) AS n FROM base GROUP BY 1, 2",
    "label_p14_without_families": f"WITH {CORPUS_SQL} SELECT source, count(*) AS n FROM base WHERE family NOT IN ('ambergroup', 'deltabase') GROUP BY 1",
    "label_p15_concepts": f"WITH {_CONCEPTS} SELECT * FROM con",
    "label_p16_varying": f"WITH {_CONCEPTS} SELECT name, CAST(sum(v) AS BIGINT) AS positives, count(*) AS rows FROM (SELECT unnest(['question', 'digit', 'long', 'capitals']) AS name, unnest([question, digit, long, capitals]) AS v FROM con) GROUP BY 1 HAVING min(v) <> max(v)",
    "label_p17_agreeing": f"SELECT row_id, label FROM (SELECT row_id, avg({_SCORE}) AS s FROM votes GROUP BY 1) JOIN corpus USING (row_id) WHERE (label = 1 AND s >= 0.7) OR (label = 0 AND s <= 0.3)",
    "label_p18_fingerprint": f"WITH {CORPUS_SQL} SELECT family, source, split, CAST(grouping(family, source, split) AS BIGINT) AS gid, count(*) AS n FROM base GROUP BY GROUPING SETS ((family), (family, source), (family, source, split)) HAVING count(*) BETWEEN 10 AND 500",
    "label_p19_majority_share": f"WITH {CORPUS_SQL} SELECT source, count(*) AS distinct_values, round(max(n)::DOUBLE / sum(n), 6) AS share FROM (SELECT source, label, count(*) AS n FROM base WHERE label IS NOT NULL GROUP BY 1, 2) GROUP BY 1 HAVING count(*) BETWEEN 2 AND 3",
    "label_p20_finite": "SELECT count(*) FILTER (WHERE ok) AS finite, count(*) FILTER (WHERE NOT ok) AS other FROM (SELECT len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AS ok FROM bundle)",
    "label_p21_known_words": "SELECT DISTINCT lower(name_part) AS word FROM person_names WHERE lower(name_part) IN (SELECT unnest(regexp_split_to_array(lower(text), '[^\\pL\\pN]+')) FROM corpus)",
}
