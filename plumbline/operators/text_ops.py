"""Text functions F01-F16 as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.plans.ranking import exact_percentiles
from plumbline.plans.tables import canon_sql, rd, strip_sql, table


def length_profile(df: DataFrame, text: str, by: str) -> DataFrame:
    """Count, mean, sample deviation and quartiles of the character length for each group."""
    n = F.char_length(text)
    flat = df.groupBy(by).agg(F.count(n).alias("n"), rd(F.avg(n)).alias("mean"), rd(F.stddev_samp(n)).alias("sd"), F.min(n).alias("least"), F.max(n).alias("most"))
    parts = exact_percentiles(df, [by], n, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return flat.join(parts, flat[by].eqNullSafe(parts[by]), "left").select(flat[by], "n", "mean", "sd", "least", *(rd(c).alias(c) for c in ("q1", "median", "q3")), "most")


def fact_check(spoken: DataFrame, facts: DataFrame, tolerance: float) -> DataFrame:
    """Whether each spoken number of (name, said) is within the tolerance of the fact (name, value)."""
    return spoken.join(facts, "name", "left").select("name", "said", "value", F.coalesce(F.abs(F.col("said") - F.col("value")) <= tolerance, F.lit(False)).alias("agrees"))


def undefined_names(used: DataFrame, defined: DataFrame, pattern: str) -> DataFrame:
    """Names that a pattern finds in the used texts and not in the defining ones."""
    def names(df: DataFrame) -> DataFrame:
        return df.select(F.explode(F.regexp_extract_all("text", F.lit(pattern), 1)).alias("name")).distinct()

    return names(used).join(names(defined), "name", "left_anti")


def _c(s, d):
    return table(s, d, "corpus")


_SHA = f"sha1({canon_sql('text')})"
_RECIPES = [("raw", "lda", 0.02), ("std", "lda", 0.1), ("l2", "dom", 0.0), ("l2+std", "logistic", 0.002), ("std+abtt4", "logistic", 1e-05), ("batchstd", "lda", 1e6)]


def recipe_key(transform: str, probe: str, hyper: float) -> str:
    """Transform, probe and hyper-parameter in its shortest form, joined by bars."""
    return f"{transform}|{probe}|{hyper:g}"


QUERIES = {
    "f01_canonical_text": lambda s, d: _c(s, d).select("row_id", T.canonical("text").alias("key")),
    "f02_canonical_words": lambda s, d: _c(s, d).select("row_id", F.array_join(F.filter(F.split(F.lower("text"), "(?U)\\s+"), lambda w: w != ""), " ").alias("key")),
    "f03_stable_rank": lambda s, d: _c(s, d).select("row_id", T.stable_rank("text").alias("rank_hex")),
    "f04_duplicate_group": lambda s, d: _c(s, d).filter("text is not null").groupBy(T.duplicate_group("text").alias("grp")).agg(F.count("*").alias("n")),
    "f05_hash_split": lambda s, d: _c(s, d).filter("text is not null").groupBy((T.hash_bucket("text") < 2000).alias("validation")).agg(F.count("*").alias("n"), F.sum(T.hash_bucket("text")).alias("bucket_sum")),
    "f06_hash_strata": lambda s, d: _c(s, d).filter("text is not null").select("row_id", F.when(F.col("label") == 1, 1 + F.pmod(F.conv(T.stable_rank("text"), 16, 10).cast("decimal(20,0)"), F.lit(6))).otherwise(0).cast("int").alias("stratum")),
    "f07_strict_key": lambda s, d: _c(s, d).select("row_id", T.strict_key("text").alias("key")),
    "f08_stripped": lambda s, d: _c(s, d).select("row_id", T.stripped("text").alias("text")),
    "f09_length_order": lambda s, d: _c(s, d).filter("text is not null").groupBy(F.char_length("text").alias("n_chars")).agg(F.count("*").alias("n"), F.min("row_id").alias("first_row_id")),
    "f10_template": lambda s, d: table(s, d, "source_dim").select("source_ord", F.format_string("%s says %s. Honestly %s.", F.coalesce("note", F.lit("someone")), "name", "name").alias("prompt")),
    "f11_recipe_key": lambda s, d: s.createDataFrame([(recipe_key(*r),) for r in _RECIPES], "recipe_key string"),
    "f12_basename": lambda s, d: table(s, d, "ledger").groupBy(T.basename("zip").alias("name")).agg(F.count("*").alias("n")),
    "f13_fact_check": lambda s, d: fact_check(
        table(s, d, "source_hygiene").groupBy(F.col("source").alias("name")).agg(rd(F.avg("rate_before"), 2).alias("said")),
        table(s, d, "source_hygiene").groupBy(F.col("source").alias("name")).agg(rd(F.sum("pos") / F.nullif(F.sum("n"), F.lit(0))).alias("value")), 0.05),
    "f14_undefined_names": lambda s, d: undefined_names(_c(s, d), table(s, d, "documents"), "#([A-Za-z]+)"),
    "f16_length_profile": lambda s, d: length_profile(_c(s, d), "text", "label"),
}

SQL = {
    "f01_canonical_text": f"SELECT row_id, {canon_sql('text')} AS key FROM corpus",
    "f02_canonical_words": f"SELECT row_id, {canon_sql('text')} AS key FROM corpus",
    "f03_stable_rank": f"SELECT row_id, substr({_SHA}, 1, 16) AS rank_hex FROM corpus",
    "f04_duplicate_group": f"SELECT {_SHA} AS grp, count(*) AS n FROM corpus WHERE text IS NOT NULL GROUP BY 1",
    "f05_hash_split": f"SELECT b < 2000 AS validation, count(*) AS n, CAST(sum(b) AS BIGINT) AS bucket_sum FROM (SELECT CAST(concat('0x', substr({_SHA}, 1, 8)) AS UBIGINT) % 10000 AS b FROM corpus WHERE text IS NOT NULL) GROUP BY 1",
    "f06_hash_strata": f"SELECT row_id, CAST(CASE WHEN label = 1 THEN 1 + CAST(concat('0x', substr({_SHA}, 1, 16)) AS UBIGINT) % 6 ELSE 0 END AS INTEGER) AS stratum FROM corpus WHERE text IS NOT NULL",
    "f07_strict_key": "SELECT row_id, regexp_replace(lower(text), '[^\\pL\\pN_]+', '', 'g') AS key FROM corpus",
    "f08_stripped": f"SELECT row_id, {strip_sql('text')} AS text FROM corpus",
    "f09_length_order": "SELECT CAST(length(text) AS INTEGER) AS n_chars, count(*) AS n, min(row_id) AS first_row_id FROM corpus WHERE text IS NOT NULL GROUP BY 1",
    "f10_template": "SELECT source_ord, coalesce(note, 'someone') || ' says ' || name || '. Honestly ' || name || '.' AS prompt FROM source_dim",
    "f11_recipe_key": "SELECT * FROM (VALUES ('raw|lda|0.02'), ('std|lda|0.1'), ('l2|dom|0'), ('l2+std|logistic|0.002'), ('std+abtt4|logistic|1e-05'), ('batchstd|lda|1e+06')) t(recipe_key)",
    "f12_basename": "SELECT list_extract(regexp_split_to_array(zip, '[\\\\/]'), -1) AS name, count(*) AS n FROM ledger GROUP BY 1",
    "f13_fact_check": "SELECT name, said, value, coalesce(abs(said - value) <= 0.05, false) AS agrees FROM (SELECT source AS name, round(avg(rate_before), 2) AS said, round(sum(pos)::DOUBLE / nullif(sum(n), 0), 6) AS value FROM source_hygiene GROUP BY 1)",
    "f14_undefined_names": "SELECT DISTINCT unnest(regexp_extract_all(text, '#([A-Za-z]+)', 1)) AS name FROM corpus EXCEPT SELECT unnest(regexp_extract_all(text, '#([A-Za-z]+)', 1)) FROM documents",
    "f16_length_profile": "SELECT label, count(text) AS n, round(avg(length(text)), 6) AS mean, round(stddev_samp(length(text)), 6) AS sd, CAST(min(length(text)) AS INTEGER) AS least, round(quantile_cont(length(text), 0.25), 6) AS q1, round(quantile_cont(length(text), 0.5), 6) AS median, round(quantile_cont(length(text), 0.75), 6) AS q3, CAST(max(length(text)) AS INTEGER) AS most FROM corpus GROUP BY 1",
}
