"""The project's tables in the shape the operators take, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import cleaned
from plumbline.functions.vectors import finite

WHITE = "[\\s\\pZ\\x{0b}\\x{85}]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rd(c: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison across engines, without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def correlation(a: Column | str, b: Column | str) -> Column:
    """Pearson's correlation; null where a side is constant."""
    return F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))


def first_by(df: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """One row for each key, the first in the given order. An aggregation, so a key that holds a
    third of all rows reaches its reducer as one partial row per task."""
    rest = [c for c in dict.fromkeys([*order, *keep]) if c not in keys]
    got = df.groupBy(*keys).agg(F.min(F.struct(*order, *(c for c in rest if c not in order))).alias("__first"))
    return got.select(*keys, *(F.col(f"__first.{c}").alias(c) for c in rest))


def registry(source_dim: DataFrame) -> DataFrame:
    """(source, source_ord, family, cap, scan): the first listing of each cleaned source name; a
    missing family is the source's own name."""
    rows = source_dim.select(cleaned("name").alias("source"), "source_ord", cleaned("family").alias("family"), "cap", "scan").filter("source is not null")
    return first_by(rows, ["source"], ["source_ord"], ["family", "cap", "scan"]).withColumn("family", F.coalesce("family", "source"))


def harmonized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """corpus with cleaned sources of the registry: (row_id, text, label, source, source_ord,
    family, cap, scan, pos, split, batch_id). Rows of other sources are left out."""
    corpus = table(spark, sf_dir, "corpus").select("row_id", "text", "label", cleaned("source").alias("source"), "pos", "split", "batch_id")
    return corpus.join(registry(table(spark, sf_dir, "source_dim")), "source").select("row_id", "text", "label", "source", "source_ord", "family", "cap", "scan", "pos", "split", "batch_id")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bundle without vectors that have a cell that isn't a number; a null family is the source."""
    return table(spark, sf_dir, "bundle").filter(finite("embedding")).select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "y", "source", F.coalesce("family", "source", F.lit("__missing__")).alias("family"))


def clean_sql(c: str) -> str:
    return f"nullif(lower(regexp_replace({c}, '^{WHITE}+|{WHITE}+$', '', 'g')), '')"


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{WHITE}+|{WHITE}+$', '', 'g')"


def canon_sql(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '{WHITE}+', ' ', 'g'))"


REGISTRY_SQL = f"""reg AS (SELECT source, source_ord, coalesce(fam, source) AS family, cap, scan FROM (
    SELECT {clean_sql("name")} AS source, source_ord, {clean_sql("family")} AS fam, cap, scan,
           row_number() OVER (PARTITION BY {clean_sql("name")} ORDER BY source_ord) AS nth
    FROM source_dim) WHERE nth = 1 AND source IS NOT NULL)"""
CORPUS_SQL = f"""{REGISTRY_SQL}, base AS (
    SELECT c.row_id, c.text, c.label, r.source, r.source_ord, r.family, r.cap, r.scan, c.pos, c.split, c.batch_id
    FROM corpus c JOIN reg r ON r.source = {clean_sql("c.source")})"""
VECTORS_SQL = """vec AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, y, source, coalesce(family, source, '__missing__') AS family
    FROM bundle WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cells AS (SELECT vec_id, y, source, family, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vec)"""
