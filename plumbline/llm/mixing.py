"""Problem 8: a mixture of sources by target weights.

Sainte-Laguë apportionment: each wanted token is a block that goes to the source with the highest
quotient of its weight by 1, 3, 5 and so on, as long as the source can fill it with its documents,
each at most max_repeats times. The same rule divides a source's quota among its shards, by their
tokens. Within a shard the documents, in seeded order, are cut into stretches of equal tokens; stretches
are drawn in another seeded order, as many as the shard's quota holds beyond whole rounds.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.encoding import token_counts
from plumbline.llm.splits import cleaned
from plumbline.plans.ranking import running_total, shuffled
from plumbline.plans.staging import stage


def source_tokens(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, source, tokens) of every document, staged. source is cleaned, null where missing."""
    rows = token_counts(documents.withColumn("__source", cleaned("source")), path, "__source")
    return stage(rows.withColumnRenamed("__source", "source"), "tokens")


def highest_quotients(weights: dict[str, float], room: dict[str, int], total: int) -> dict[str, int]:
    """How many of the `total` highest quotients weight / 1, 3, 5, ... each name has, at most `room`
    of its own; the first name of equals. Starts from shares in proportion to the weights and moves
    single quotients, so that the steps are about as many as the names, whatever the total."""
    w = {k: Fraction(x) for k, x in weights.items() if math.isfinite(x) and x > 0 and room[k] > 0}
    total = min(total, sum(room[k] for k in w))
    got, left, rest = {}, total, sum(w.values())
    for k in sorted(w, key=lambda k: room[k] / w[k]):  # those that are full first
        got[k] = min(room[k], int(left * w[k] / rest))
        left, rest = left - got[k], rest - w[k]
    best = [(-w[k] / (2 * n + 1), k) for k, n in got.items() if n < room[k]]
    heapq.heapify(best)
    for _ in range(left):
        _, k = heapq.heappop(best)
        got[k] += 1
        if got[k] < room[k]:
            heapq.heappush(best, (-w[k] / (2 * got[k] + 1), k))
    while True:
        more = min(((-w[k] / (2 * n + 1), k) for k, n in got.items() if n < room[k]), default=None)
        last = max(((-w[k] / (2 * n - 1), k) for k, n in got.items() if n), default=None)
        if more is None or last is None or more >= last:
            return got
        got[more[1]] += 1
        got[last[1]] -= 1


def apportion(tokens: DataFrame, weights: DataFrame, mix_tokens: int) -> DataFrame:
    """One row for each source of the weights: (source, weight, max_repeats, tokens, block_tokens,
    blocks, short). tokens is the size of all its documents, blocks its part of the mixture in
    blocks of block_tokens, that is one token, and short whether tokens * max_repeats is less than
    weight * mix_tokens.

    A source named twice counts with the sum of its weights and the least max_repeats; null or
    negative weights count as 0. Tokens that no source can fill are left out. The table of sources
    comes to the driver, one row for each, whatever the size of the documents."""
    w = (
        weights.select(cleaned("source").alias("source"), F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("weight"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"))
        .filter("source is not null").groupBy("source").agg(F.sum("weight").alias("weight"), F.min("max_repeats").cast("long").alias("max_repeats"))
    )
    have = tokens.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    t = w.join(have, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    rows = t.withColumn("short", F.col("tokens") * F.col("max_repeats") < F.col("weight") * mix_tokens).collect()  # one for each source
    got = highest_quotients({r.source: r.weight for r in rows}, {r.source: r.tokens * r.max_repeats for r in rows}, mix_tokens)
    plan = [(r.source, r.weight, r.max_repeats, r.tokens, 1, got.get(r.source, 0), r.short) for r in rows]
    return tokens.sparkSession.createDataFrame(plan, "source string, weight double, max_repeats long, tokens long, block_tokens long, blocks long, short boolean")


#: Shards of a source, by hash of the document; so many that the largest source is divided well.
SHARDS = 16
#: Tokens of a stretch of documents that is drawn as one.
STRETCH = 4096


def shard_quotas(tokens: DataFrame, plan: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(source, shard, whole, part): each shard's tokens and its part of the source's quota, by highest
    quotients of its tokens. At most sources x shards rows come to the driver."""
    per = tokens.filter("source is not null and tokens > 0").groupBy("source", _shard(shards)).agg(F.sum("tokens").alias("whole"))
    of: dict[str, dict[int, int]] = {}
    for r in per.collect():
        of.setdefault(r.source, {})[r.shard] = r.whole
    out = []
    for r in plan.select("source", "max_repeats", (F.col("blocks") * F.col("block_tokens")).alias("part")).filter("part > 0").collect():
        whole = of.get(r.source, {})
        got = highest_quotients({k: float(n) for k, n in whole.items()}, {k: n * r.max_repeats for k, n in whole.items()}, r.part)
        out += [(r.source, k, whole[k], got[k]) for k in sorted(got) if got[k]]
    return tokens.sparkSession.createDataFrame(out, "source string, shard int, whole long, part long")


def _shard(shards: int) -> Column:
    return F.pmod(shuffled("doc_id", seed=17), F.lit(shards)).cast("int").alias("shard")


def mixture(tokens: DataFrame, plan: DataFrame, seed: int = 42, shards: int = SHARDS, stretch: int = STRETCH) -> DataFrame:
    """(doc_id, source, tokens, uses) of every document used: as many whole rounds as its shard's part
    holds, and once more the documents of the stretches drawn for the rest. Each shard's draw ends
    within a document; of these last documents of a source as many are used, in seeded order, as its
    quota still lacks tokens, so a source is off by less than one document. A document is never used
    more than max_repeats times; empty documents aren't used."""
    quota = shard_quotas(tokens, plan, shards).withColumn("rounds", F.floor(F.col("part") / F.col("whole"))).withColumn("rest", F.col("part") - F.col("rounds") * F.col("whole"))
    of = ["source", "shard"]
    rows = tokens.filter("source is not null and tokens > 0").withColumn("shard", _shard(shards)).withColumn("turn", shuffled("doc_id", seed=seed))
    rows = running_total(rows, of, "turn", "doc_id", F.col("tokens"))
    rows = rows.withColumn("from", F.col("running") - F.col("tokens")).withColumn("stretch", F.floor(F.col("from") / stretch))
    rows = stage(rows.select("doc_id", "tokens", *of, "stretch", "from", "turn"), "stretches")
    # stretches in the order of the draw, with the tokens drawn before each
    per = rows.groupBy(*of, "stretch").agg(F.sum("tokens").alias("n"), F.min("from").alias("first")).withColumn("drawn", shuffled(*of, "stretch", seed=seed + 1))
    per = running_total(per, of, "drawn", "stretch", F.col("n"), "upto").select(*of, "stretch", (F.col("upto") - F.col("n") - F.col("first")).alias("shift"))
    x = rows.join(per, [*of, "stretch"]).join(quota, of).withColumn("at", F.col("from") + F.col("shift"))
    x = stage(x.select("doc_id", *of, "tokens", "turn", "rounds", "rest", "at"), "drawn")
    # the document within which a shard's rest ends: one row for each shard
    last = x.filter("at < rest and at + tokens > rest")
    due = last.groupBy("source").agg(F.sum(F.col("rest") - F.col("at")).alias("due"))
    ahead = F.coalesce(F.sum("tokens").over(Window.partitionBy("source").orderBy("turn", "doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = last.withColumn("ahead", ahead).join(due, "source").withColumn("uses", F.col("rounds") + F.when(F.col("ahead") < F.col("due"), 1).otherwise(0))
    sure = x.filter("not (at < rest and at + tokens > rest)").withColumn("uses", F.col("rounds") + F.when(F.col("at") < F.col("rest"), 1).otherwise(0))
    names = ["doc_id", "source", "tokens", "uses"]
    return sure.select(*names).unionByName(last.select(*names)).filter("uses > 0")


def mixture_report(tokens: DataFrame, plan: DataFrame, seed: int = 42) -> DataFrame:
    """(source, weight, tokens, blocks, used_tokens, actual_share, short) of every source."""
    used = mixture(tokens, plan, seed).groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("used_tokens"))
    out = plan.join(used, "source", "left").withColumn("used_tokens", F.coalesce("used_tokens", F.lit(0)))
    share = F.try_divide(F.col("used_tokens"), F.sum("used_tokens").over(Window.partitionBy(F.lit(0))))
    return out.select("source", "weight", "tokens", "blocks", "used_tokens", F.coalesce(share, F.lit(0.0)).alias("actual_share"), "short")


def short_sources(tokens: DataFrame, plan: DataFrame, mix_tokens: int, seed: int = 42) -> DataFrame:
    """(source): the sources of which the mixture has fewer tokens than wanted, and which can't have
    more: all their tokens, max_repeats times, are less than weight * mix_tokens."""
    report = mixture_report(tokens, plan, seed)
    return report.filter(F.col("used_tokens") < F.col("weight") * mix_tokens).filter("short").select("source")
