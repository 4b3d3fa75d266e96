"""Ranks and running totals over rows that need not fit into one task.

A window without PARTITION BY gathers all rows in one task. Here rows are first counted by bucket of
a hashed order with map-side combining; the running totals of the buckets, a table of fixed size per
group, then shift windows that only see one bucket each.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096


def shuffled(*key: Column | str, seed: int = 42) -> Column:
    """A pseudo-random long for each row, the same on every cluster."""
    return F.xxhash64(F.lit(seed), *key)


def bucket_of(order: Column, buckets: int = BUCKETS) -> Column:
    """Bucket number of a hashed long, rising with it."""
    return F.shiftrightunsigned(order.bitwiseXOR(F.lit(-(1 << 63))), 64 - (buckets.bit_length() - 1)).cast("int")


def running_total(df: DataFrame, group: list[str], order: str, tie: str, weight: Column, name: str = "running", buckets: int = BUCKETS) -> DataFrame:
    """`df` with the sum of `weight` over all rows of the group up to and with this one, in the order
    of the hashed long `order`, then `tie`. Rows equal in both count in some order of their own."""
    src = df.withColumn("__bucket", bucket_of(F.col(order), buckets)).withColumn("__weight", weight)
    per = src.groupBy(*group, "__bucket").agg(F.sum("__weight").alias("__sum"))
    before = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select(*(F.col(g).alias(f"__{g}") for g in group), F.col("__bucket").alias("__b"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    on = F.col("__bucket") == F.col("__b")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"__{g}"))
    inside = Window.partitionBy(*group, "__bucket").orderBy(order, tie).rowsBetween(Window.unboundedPreceding, 0)
    within = src.withColumn("__within", F.sum("__weight").over(inside))
    return within.join(base, on).select(*df.columns, (F.col("__base") + F.col("__within")).alias(name))


def hex_rank(df: DataFrame, group: list[str], order: str, tie: str, name: str = "nth") -> DataFrame:
    """`df` with each row's place, from 1, in its group by a hexadecimal order key, then `tie`.

    Rows are counted by the key's first three digits, so that a group holding a third of all rows
    is ranked by 4096 windows instead of one."""
    src = df.withColumn("__bucket", F.conv(F.substring(order, 1, 3), 16, 10).cast("int"))
    per = src.groupBy(*group, "__bucket").agg(F.count("*").alias("__n"))
    before = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select(*(F.col(g).alias(f"__{g}") for g in group), F.col("__bucket").alias("__b"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    on = F.col("__bucket") == F.col("__b")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"__{g}"))
    inside = src.withColumn("__within", F.row_number().over(Window.partitionBy(*group, "__bucket").orderBy(order, tie)))
    return inside.join(base, on).select(*df.columns, (F.col("__base") + F.col("__within")).alias(name))


def nth_by_hex(df: DataFrame, group: list[str], order: str, tie: list[str], wanted: DataFrame) -> DataFrame:
    """The rows of `df` at the places, from 1, that `wanted` has for its groups in the order of a hexadecimal
    key, then `tie`, with the other columns of `wanted` (group, nth, ...), a small table. Rows are counted by
    the key's first three digits, and only those in a bucket with a wanted place are sorted."""
    src = df.withColumn("__bucket", F.substring(order, 1, 3))
    per = src.groupBy(*group, "__bucket").agg(F.count("*").alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, 0))
    held = per.withColumn("__upto", upto).join(F.broadcast(wanted), group).filter((F.col("nth") <= F.col("__upto")) & (F.col("nth") > F.col("__upto") - F.col("__n")))
    held = held.withColumn("__nth", F.col("nth") - F.col("__upto") + F.col("__n")).drop("__n", "__upto")
    near = src.join(F.broadcast(held), [*group, "__bucket"])
    placed = near.withColumn("__place", F.row_number().over(Window.partitionBy(*wanted.columns).orderBy(order, *tie)))
    return placed.filter("__place = __nth").select(*df.columns, *(c for c in wanted.columns if c not in group))


def _attached(df: DataFrame, per: DataFrame, group: list[str]) -> DataFrame:
    """`df` with the columns of `per`, one row for each group; of no group, one row in all."""
    if not group:
        return df.crossJoin(F.broadcast(per))
    other = per.select(*(F.col(g).alias(f"__of_{g}") for g in group), *(c for c in per.columns if c not in group))
    on = F.lit(True)
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"__of_{g}"))
    return df.join(other, on).drop(*(f"__of_{g}" for g in group))


def _probes(df: DataFrame, value: str, buckets: int) -> list[float]:
    got = df.agg(F.percentile_approx(value, [k / buckets for k in range(1, buckets)], 1000).alias("s")).first()["s"] or []
    return [float(x) for x in got]


def value_splits(df: DataFrame, value: str, buckets: int = 256) -> list[float]:
    """About equal parts of a numeric column: at most `buckets` numbers, whatever the size of `df`."""
    return sorted(set(_probes(df, value, buckets)))


def _numbers(x: list[float]) -> Column:
    # one literal for the optimizer to fold, instead of one for each number
    return F.from_json(F.lit(json.dumps([float(v) for v in x])), "array<double>")


def _tie_parts(df: DataFrame, value: str, tie: str, often: list[float], parts: int = 64) -> Column | None:
    """Number of a row's part of its value's rows, by `tie`, for values so frequent that they fill more
    than one bucket, and for nulls. None for the other rows, or where ties aren't numbers."""
    kind = df.schema[tie].dataType.typeName()
    if tie == value or kind not in ("byte", "short", "integer", "long", "float", "double", "decimal"):
        return None
    src = df.filter(F.col(value).isin(often) | F.col(value).isNull()) if often else df.filter(F.col(value).isNull())
    got = src.groupBy(value).agg(F.percentile_approx(tie, [k / parts for k in range(1, parts)], 1000).alias("s")).collect()  # at most buckets / 2 rows
    out = None
    for r in got:
        cuts = sorted(set(r["s"] or []))
        part = F.size(F.filter(_numbers(cuts), lambda x: x <= F.col(tie).cast("double"))) if cuts else F.lit(0)
        is_it = F.col(value).isNull() if r[value] is None else F.col(value) == F.lit(r[value])
        out = F.when(is_it, part) if out is None else out.when(is_it, part)
    return out


def running_by_value(df: DataFrame, group: list[str], value: str, tie: str, sums: dict[str, Column], descending: bool = False, buckets: int = 256) -> DataFrame:
    """`df` with sums over all rows of the group up to and with this one, in the order of a number,
    then `tie`. Each window sees one range of values, and of a value that fills several ranges one
    range of ties; a table of at most some thousand rows a group carries the totals across ranges.
    Rows with a null value come first, or last if descending."""
    probes = _probes(df, value, buckets)
    splits, often = sorted(set(probes)), sorted({a for a, b in zip(probes, probes[1:]) if a == b})
    bucket = F.size(F.filter(_numbers(splits), lambda x: x <= F.col(value))) if splits else F.lit(0)
    bucket = F.coalesce(F.when(F.col(value).isNull(), -1).otherwise(bucket), F.lit(-1))
    src = df.withColumn("__bucket", -bucket if descending else bucket)
    # a frequent value is the least of its bucket
    parts = _tie_parts(df, value, tie, often)
    src = src.withColumn("__part", F.lit(0) if parts is None else F.coalesce(parts, F.lit(-1 if descending else 1 << 20)))
    for k, c in sums.items():
        src = src.withColumn(f"__w_{k}", c)
    per = src.groupBy(*group, "__bucket", "__part").agg(*(F.sum(f"__w_{k}").alias(f"__s_{k}") for k in sums))
    before = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy("__bucket", "__part").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select(*(F.col(g).alias(f"__{g}") for g in group), F.col("__bucket").alias("__b"), F.col("__part").alias("__p"), *(F.coalesce(F.sum(f"__s_{k}").over(before), F.lit(0)).alias(f"__base_{k}") for k in sums))
    on = (F.col("__bucket") == F.col("__b")) & (F.col("__part") == F.col("__p"))
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"__{g}"))
    inside = Window.partitionBy(*group, "__bucket", "__part").orderBy(F.desc(value) if descending else F.asc(value), tie).rowsBetween(Window.unboundedPreceding, 0)
    for k in sums:
        src = src.withColumn(f"__in_{k}", F.sum(f"__w_{k}").over(inside))
    return src.join(base, on).select(*df.columns, *((F.col(f"__base_{k}") + F.col(f"__in_{k}")).alias(k) for k in sums))


def _counted(df: DataFrame, group: list[str], value: Column) -> DataFrame:
    """(group, __v, __below, __upto, __n): each distinct value, the rows below it and up to it, all rows."""
    per = df.select(*group, value.alias("__v")).filter("__v is not null").groupBy(*group, "__v").agg(F.count("*").alias("__c"))
    run = running_by_value(per, group, "__v", "__v", {"__upto": F.col("__c")})
    total = per.groupBy(*group).agg(F.sum("__c").alias("__n"))
    return _attached(run, total, group).withColumn("__below", F.col("__upto") - F.col("__c"))


def exact_percentiles(df: DataFrame, group: list[str], value: Column, probes: dict[str, float]) -> DataFrame:
    """(group, one column for each probe): exact percentiles with linear interpolation, of groups that have
    a value. Values are counted, not gathered: a group may hold any number of them."""
    x = _counted(df, group, value)
    at = lambda k: F.max(F.when((F.col("__below") <= k) & (k < F.col("__upto")), F.col("__v"))).cast("double")
    out = []
    for name, p in probes.items():
        place = (F.col("__n") - 1) * F.lit(float(p))
        out += [at(F.floor(place)).alias(f"__lo_{name}"), at(F.ceil(place)).alias(f"__hi_{name}"), F.first(place - F.floor(place)).alias(f"__f_{name}")]
    got = x.groupBy(*group).agg(*out)
    return got.select(*group, *((F.col(f"__lo_{n}") * (1 - F.col(f"__f_{n}")) + F.col(f"__hi_{n}") * F.col(f"__f_{n}")).alias(n) for n in probes))


def spaced_percentiles(df: DataFrame, value: str, first: float, last: float, count: int) -> list[float]:
    """The exact percentiles at `count` even steps from `first` to `last`, of all rows: that many numbers."""
    x = _counted(df, [], F.col(value))
    span = F.greatest(F.col("__n") - 1, F.lit(1)) * F.lit((last - first) / (count - 1))
    nearest = lambda rank: (rank - F.col("__n") * F.lit(first)) / span
    # a step of the grid may be a part of a rank, and a percentile lies between two ranks
    lo, hi = F.greatest(F.floor(nearest(F.col("__below") - 2)), F.lit(0)), F.least(F.ceil(nearest(F.col("__upto") + 2)), F.lit(count - 1))
    x = x.withColumn("__lo", lo).withColumn("__hi", hi).filter("__lo <= __hi").withColumn("__k", F.explode(F.sequence("__lo", "__hi")))
    x = x.withColumn("__at", (F.col("__n") - 1) * (F.lit(first) + F.col("__k") * F.lit(last - first) / (count - 1)))
    has = lambda k: (F.col("__below") <= k) & (k < F.col("__upto"))
    down, up = F.floor("__at"), F.ceil("__at")
    got = x.groupBy("__k").agg(F.max(F.when(has(down), F.col("__v"))).alias("lo"), F.max(F.when(has(up), F.col("__v"))).alias("hi"), F.first(F.col("__at") - down).alias("f"))
    return [r["lo"] * (1 - r["f"]) + r["hi"] * r["f"] for r in got.orderBy("__k").collect()]
