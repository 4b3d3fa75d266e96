"""Problem 6: a sample that follows target shares of categories.

Quotas are allocated from the top of a category tree (all, family of sources, source, label): what a
leaf can't supply goes first to its siblings (other labels of the source), then to its cousins (other
sources of the family), then to all. Leaves draw their quota by permuted rank: rows in the order of
a seeded hash, counted by bucket first, so that only the bucket in which the quota ends is sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.splits import cleaned, source_components
from plumbline.plans.ranking import bucket_of, shuffled
from plumbline.plans.staging import stage

BOTH = ["source", "label"]


def sample_size(plan_params: DataFrame, param: str = "sample_rows") -> int:
    """A number from the five-row parameter table; 0 where it is missing."""
    got = plan_params.filter(F.col("param") == param).agg(F.max("amount").alias("n")).first()
    return int(got["n"] or 0)


def hygiene_counts(hygiene: DataFrame) -> DataFrame:
    """(source, label, counted): rows by the latest run of each batch and source. Of runs at the
    same time the one with the larger id counts; a null count counts nothing."""
    w = Window.partitionBy("batch_id", "source").orderBy(F.desc_nulls_last("run_ts"), F.desc_nulls_last("run_id"), F.desc_nulls_last("pos"), F.desc_nulls_last("neg"))
    rows = hygiene.select("run_id", "run_ts", "batch_id", cleaned("source").alias("source"), "pos", "neg").filter("source is not null")
    last = rows.withColumn("r", F.row_number().over(w)).filter("r = 1")
    both = last.select("source", F.expr("stack(2, 1, pos, 0, neg) as (label, n)"))
    return both.groupBy(*BOTH).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("counted"))


def _pass_on(table: DataFrame, within: list[str]) -> DataFrame:
    """Give what is lacking within each node to its leaves with rows to spare, those with the
    larger target first. Columns quota, available, lacking."""
    w = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    spare = F.col("available") - F.col("quota")
    before = F.coalesce(F.sum(spare).over(w.orderBy(F.desc("target_share"), *BOTH).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    more = F.least(spare, F.greatest(F.sum("lacking").over(w) - before, F.lit(0)))
    out = table.withColumn("more", more)
    given = F.sum("more").over(w)
    ahead = F.coalesce(F.sum("lacking").over(w.orderBy(*BOTH).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    served = F.least(F.col("lacking"), F.greatest(given - ahead, F.lit(0)))
    return out.withColumn("served", served).withColumn("quota", F.col("quota") + F.col("more")).withColumn("lacking", F.col("lacking") - F.col("served")).drop("more", "served")


def allocation(corpus: DataFrame, label_targets: DataFrame, source_dim: DataFrame, hygiene: DataFrame, rows: int) -> DataFrame:
    """One row for each category of label_targets: (source, label, family, target_share, wanted,
    available, counted, quota, levelled, short). `available` are its rows in corpus, `counted` those by
    the hygiene runs, `wanted` the greater of min_rows and its rounded share of `rows`, `quota` what is
    drawn after passing on, `levelled` what was taken off for the sample's size, `short` whether
    available rows don't suffice.

    A category named twice is one, with the sum of its shares and the greatest minimum; rows with a
    null or other label or an unnamed source are in no category. This table has as many rows as
    label_targets, so its windows are small."""
    targets = (
        label_targets.select(cleaned("source").alias("source"), "label", "target_share", "min_rows")
        .dropna(subset=BOTH).groupBy(*BOTH).agg(F.coalesce(F.sum("target_share"), F.lit(0.0)).alias("target_share"), F.coalesce(F.max("min_rows"), F.lit(0)).alias("min_rows"))
    )
    have = corpus.select(cleaned("source").alias("source"), "label").dropna().groupBy(*BOTH).agg(F.count("*").alias("available"))
    dim = source_components(source_dim).select(F.col("name").alias("source"), F.col("label").alias("family"))
    t = targets.join(have, BOTH, "left").join(hygiene_counts(hygiene), BOTH, "left").join(dim, "source", "left")
    t = t.select(
        *BOTH, F.coalesce("family", "source").alias("family"), "target_share", F.coalesce("min_rows", F.lit(0)).cast("long").alias("min_rows"),
        F.greatest(F.col("min_rows").cast("long"), F.round(F.col("target_share") * rows).cast("long")).alias("wanted"),
        F.coalesce("available", F.lit(0)).alias("available"), F.coalesce("counted", F.lit(0)).alias("counted"),
    )
    t = t.withColumn("quota", F.least("wanted", "available")).withColumn("lacking", F.col("wanted") - F.col("quota"))
    for within in (["family", "source"], ["family"], []):
        t = _pass_on(t, within)
    # rounding and minima make the quotas add up to a little more or less than the sample: the
    # categories with the most rows above their minimum level that out
    free = F.greatest(F.least("available", "quota") - F.col("min_rows"), F.lit(0))
    w = Window.partitionBy(F.lit(0))
    surplus = F.greatest(F.sum("quota").over(w) - rows, F.lit(0))
    before = F.coalesce(F.sum("free").over(w.orderBy(F.desc("free"), *BOTH).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    share = F.when(F.sum("free").over(w) > 0, F.floor(F.col("surplus") * F.col("free") / F.sum("free").over(w))).otherwise(0)
    # no more than what lies above the minima, which the sample may so exceed
    t = t.withColumn("free", free).withColumn("surplus", F.least(surplus, F.sum("free").over(w))).withColumn("cut", share)
    rest = F.col("surplus") - F.sum("cut").over(w)
    left = F.col("free") - F.col("cut")
    ahead = F.coalesce(F.sum(F.signum(left)).over(w.orderBy(F.desc("free"), *BOTH).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = t.withColumn("levelled", (F.col("cut") + F.when((left > 0) & (ahead < rest), 1).otherwise(0)).cast("long"))
    t = t.withColumn("quota", (F.col("quota") - F.col("levelled")).cast("long"))
    return t.select(*BOTH, "family", "target_share", "min_rows", "wanted", "available", "counted", "quota", "levelled", (F.col("available") < F.col("wanted")).alias("short"))


def draw(corpus: DataFrame, quotas: DataFrame, seed: int = 42) -> DataFrame:
    """(row_id, source, label): of each category its quota of rows, the first in the order of a
    seeded hash of row_id. Repeated ids are rows of their own."""
    rows = corpus.select(F.col("row_id").cast("long").alias("row_id"), cleaned("source").alias("source"), "label").dropna(subset=BOTH)
    rows = rows.withColumn("turn", shuffled("row_id", seed=seed)).withColumn("bucket", bucket_of(F.col("turn")))
    per = rows.groupBy(*BOTH, "bucket").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*BOTH).orderBy("bucket"))
    ends = per.withColumn("upto", upto).join(quotas.select(*BOTH, "quota"), BOTH)
    # the bucket in which the quota ends, and how many of its rows are still wanted
    ends = ends.filter("upto - n < quota").groupBy(*BOTH).agg(F.max(F.struct("bucket", (F.col("quota") - F.col("upto") + F.col("n")).alias("wanted"))).alias("end"))
    ends = stage(ends.select(*BOTH, "end.*").withColumnRenamed("bucket", "end"), "ends")
    kept = rows.join(ends, BOTH).filter("bucket <= end")
    last = kept.filter("bucket = end").withColumn("place", F.row_number().over(Window.partitionBy(*BOTH).orderBy("turn", "row_id"))).filter("place <= wanted")
    return kept.filter("bucket < end").select("row_id", *BOTH).unionByName(last.select("row_id", *BOTH))


def reached(corpus: DataFrame, quotas: DataFrame, seed: int = 42) -> DataFrame:
    """(source, label, family, target_share, min_rows, wanted, available, counted, quota, levelled, drawn,
    unmet): the allocation beside what the drawn sample has of each category. A category's target is
    unmet if it has too few rows even with those that were taken off for the sample's size."""
    drawn = draw(corpus, quotas, seed).groupBy(*BOTH).agg(F.count("*").alias("drawn"))
    out = quotas.drop("short").join(drawn, BOTH, "left").withColumn("drawn", F.coalesce("drawn", F.lit(0).cast("long")))
    return out.withColumn("unmet", F.col("drawn") + F.col("levelled") < F.col("wanted"))
