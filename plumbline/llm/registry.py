"""Queries of the operators for training data, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import duplicates, encoding, lookalike, mixing, neardup, overlap, pii, quota_sample, splits
from plumbline.plans.staging import stage


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _allocation(s: SparkSession, d: str) -> DataFrame:
    rows = quota_sample.sample_size(_t(s, d, "plan_params"))
    # a table of categories, read by the draw and by what it reached
    return stage(quota_sample.allocation(_t(s, d, "corpus"), _t(s, d, "label_targets"), _t(s, d, "source_dim"), _t(s, d, "source_hygiene"), rows), "allocation")


def _reached(s: SparkSession, d: str) -> DataFrame:
    return quota_sample.reached(_t(s, d, "corpus"), _allocation(s, d))


def _mixture(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    tokens = mixing.source_tokens(_t(s, d, "documents"), encoding.vocabulary_path())
    return tokens, mixing.apportion(tokens, _t(s, d, "mix_weights"), quota_sample.sample_size(_t(s, d, "plan_params"), "mix_tokens"))


def _splittable(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    return _t(s, d, "corpus"), _t(s, d, "source_dim"), splits.split_percents(_t(s, d, "plan_params"))


def _links(s: SparkSession, d: str) -> DataFrame:
    return neardup.membership(_t(s, d, "corpus"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": lambda s, d: duplicates.copies(_t(s, d, "corpus")),
        "p1_collapsed": lambda s, d: duplicates.collapsed(_t(s, d, "corpus")),
        "p1_collisions": lambda s, d: duplicates.collisions(_t(s, d, "corpus")),
        "p2_found": lambda s, d: neardup.near_pairs(_t(s, d, "corpus")),
        "p3_found": lambda s, d: overlap.overlap_pairs(_t(s, d, "corpus")),
        "p3_report": lambda s, d: overlap.overlap_report(_t(s, d, "corpus"), _t(s, d, "source_dim")),
        "p2_groups": _links,
        "p4_found": lambda s, d: splits.related_sources(_t(s, d, "source_dim"), _t(s, d, "corpus")),
        "p4_splits": lambda s, d: splits.assign_splits(*_splittable(s, d)),
        "p4_report": lambda s, d: splits.split_report(*_splittable(s, d)),
        "p4_undivided": lambda s, d: splits.undivided(*_splittable(s, d)),
        "p5_found": lambda s, d: lookalike.lookalike_pairs(_t(s, d, "corpus")),
        "p5_forms": lambda s, d: lookalike.canonical_texts(_t(s, d, "corpus")),
        "p6_found": lambda s, d: _reached(s, d).filter("unmet").select("source", "label"),
        "p6_reached": _reached,
        "p6_allocation": _allocation,
        "p6_sample": lambda s, d: quota_sample.draw(_t(s, d, "corpus"), _allocation(s, d)),
        "p7_ids": lambda s, d: encoding.encode(_t(s, d, "documents"), encoding.vocabulary_path()),
        "p7_offsets": lambda s, d: encoding.offsets(_t(s, d, "documents"), encoding.vocabulary_path()),
        "p7_decoded": lambda s, d: encoding.decoded(encoding.encode(_t(s, d, "documents"), encoding.vocabulary_path()), encoding.vocabulary_path()),
        "p8_found": lambda s, d: mixing.short_sources(*_mixture(s, d), quota_sample.sample_size(_t(s, d, "plan_params"), "mix_tokens")),
        "p8_mixture": lambda s, d: mixing.mixture(*_mixture(s, d)),
        "p8_report": lambda s, d: mixing.mixture_report(*_mixture(s, d)),
        "p9_found": lambda s, d: pii.personal_data(_t(s, d, "documents"), _t(s, d, "person_names")),
        "p9_masked": lambda s, d: pii.masked(_t(s, d, "documents"), _t(s, d, "person_names")),
    }


_CLEAN = "nullif(lower(regexp_replace({}, '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g')), '')"

_REACH = f"""WITH RECURSIVE listed AS (
            SELECT {_CLEAN.format("name")} AS name, {_CLEAN.format("family")} AS family FROM source_dim
        ), member AS (
            SELECT DISTINCT name, coalesce(family, name) AS family FROM listed WHERE name IS NOT NULL
        ), reach AS (
            SELECT name AS start, name FROM member
            UNION
            SELECT r.start, m2.name FROM reach r JOIN member m1 ON m1.name = r.name JOIN member m2 ON m2.family = m1.family
        )"""

_SQL = {
    "p4_found": f"""
        {_REACH}
        SELECT DISTINCT start AS name_a, name AS name_b FROM reach WHERE start < name""",
    "p4_undivided": f"""
        {_REACH}, have AS (
            SELECT {_CLEAN.format("source")} AS name, count(*) AS n FROM corpus GROUP BY 1
        ), with_rows AS (
            SELECT r.start AS name, coalesce(sum(h.n), 0) AS n FROM reach r LEFT JOIN (
                SELECT name, n FROM have UNION ALL
                SELECT m.name, h.n / (SELECT count(DISTINCT name) FROM member x WHERE x.family = h.name) FROM have h JOIN member m ON m.family = h.name
                WHERE h.name NOT IN (SELECT name FROM member)
            ) h ON h.name = r.name GROUP BY 1
        )
        SELECT name, CAST(round(n) AS BIGINT) AS rows, CAST(CASE WHEN n > 0 THEN 1 ELSE 0 END AS BIGINT) AS splits FROM with_rows""",
    "p6_found": f"""
        WITH wanted AS (
            SELECT {_CLEAN.format("source")} AS source, label, sum(target_share) AS share, max(min_rows) AS least FROM label_targets GROUP BY 1, 2
        ), have AS (
            SELECT {_CLEAN.format("source")} AS source, label, count(*) AS n FROM corpus WHERE label IS NOT NULL GROUP BY 1, 2
        )
        SELECT w.source, w.label FROM wanted w LEFT JOIN have h ON h.source = w.source AND h.label = w.label
        WHERE w.source IS NOT NULL AND w.label IS NOT NULL
          AND coalesce(h.n, 0) < greatest(w.least, CAST(round(w.share * (SELECT max(amount) FROM plan_params WHERE param = 'sample_rows')) AS BIGINT))""",
}


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can express on whole tables. The others rest on character
    forms, a tokenizer, hashed draws or a fitted model; tests compare them with brute force."""
    return dict(_SQL)
