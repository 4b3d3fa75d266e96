"""Problem 1: records that differ only in formatting.

The key of a text is a 128-bit hash of its canonical form: visual form, case folded, only letters
and digits; records of labelled fields as their sorted (name, value) pairs. Counts are aggregated
with map-side combining, so a group holding a third of all rows reaches its reducer as one partial
row per task. A second, independent hash of the form is carried as collision check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.splits import SMALL, components, merged_in_one_task
from plumbline.llm.wordsets import keep_by_filter, key_filter, key_table
from plumbline.plans.staging import stage

#: A group beyond this many rows is joined by broadcast. There are at most rows / HOT_ROWS such groups.
HOT_ROWS = 1_000_000


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return key_table(df.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).cast("string").alias("text")), "row_id", "text")


def distinct_keys(rows: DataFrame, id_col: str = "row_id", extra: dict[str, Column] | None = None) -> DataFrame:
    """`rows` from `key_table`; out comes one row for each distinct key (key_hi, key_lo,
    key_check), its number of rows n, and of its whole group first_row_id, copies and the maxima
    of the `extra` aggregates.

    Keys whose texts have the same bare letters and digits in the same order belong together (same_hi,
    same_lo, same_check): a text whose layout can't be read and a record, or records that are read as
    different fields. Letters and digits are compared by 128 bits and an independent check, as the keys
    are; texts whose 128-bit keys collide stay apart."""
    extra = extra or {}
    own = ["key_hi", "key_lo", "key_check"]
    key = F.struct(*own)
    stats = rows.groupBy(*own).agg(F.count("*").alias("n"), F.min(id_col).alias("first"), *(c.alias(k) for k, c in extra.items()))
    found = shared_keys(rows)
    # a group has as many keys here as its texts have layouts, never its rows
    w = Window.partitionBy("same")
    return stats.join(found, [stats[c] == found[f"of_{c}"] for c in own], "left").withColumn("same", F.coalesce("same", key)).select(
        *own, "n", F.col("same.key_hi").alias("same_hi"), F.col("same.key_lo").alias("same_lo"),
        F.min("first").over(w).alias("first_row_id"), F.sum("n").over(w).alias("copies"), *(F.max(k).over(w).alias(k) for k in extra),
    )


def shared_keys(rows: DataFrame) -> DataFrame:
    """(of_key_hi, of_key_lo, of_key_check, same) of the keys in groups of several keys, see
    `distinct_keys`; `same` is the group's least key."""
    own = ["key_hi", "key_lo", "key_check"]
    # the letters and digits that several keys share, of which at least one is a record's
    key = F.struct(*own)
    plain = F.struct(F.coalesce("alias_hi", "key_hi").alias("hi"), F.coalesce("alias_lo", "key_lo").alias("lo"), F.coalesce("alias_check", "key_check").alias("check"))
    slim = rows.select(key.alias("key"), plain.alias("plain"), F.col("alias_hi").isNotNull().alias("record")).withColumn("low", F.col("plain.lo"))
    aliases = slim.filter("record").select("plain", "low").distinct()
    links = keep_by_filter(slim, "low", key_filter(aliases.select("low"))).select("key", "plain").distinct().join(aliases.select("plain"), "plain", "left_semi")
    shared = links.groupBy("plain").agg(F.min("key").alias("least"), F.max("key").alias("most")).filter("least <> most").select("plain")
    links = stage(links.join(shared, "plain", "left_semi"), "shared")
    count = links.count()
    if not count:
        kind = rows.select(key.alias("k")).schema["k"].dataType.simpleString()
        of = rows.sparkSession.createDataFrame([], f"key {kind}, same {kind}")
    else:
        # keys and letters are the two kinds of node; a name is the key itself in digits
        name = F.concat_ws(",", F.lit("k"), *(F.col(f"key.{c}") for c in own))
        edges = links.select(name.alias("a"), F.concat_ws(",", F.lit("p"), "plain.hi", "plain.lo", "plain.check").alias("b"))
        # one task up to a checked size, beyond it the search of problem 4
        label = (merged_in_one_task(edges) if count <= SMALL else components(edges)).filter("node like 'k%'")
        of = links.select("key", name.alias("node")).distinct().join(label, "node")
        least = of.groupBy("label").agg(F.min("key").alias("same"))
        of = of.join(least, "label").select("key", "same")
    return of.select(*(F.col(f"key.{c}").alias(f"of_{c}") for c in own), "same")


def copies(df: DataFrame, id_col: str = "row_id", text_col: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
    """(first_row_id, row_id) for each row that repeats an earlier one.

    Null texts and texts without a letter or digit are in no group; an empty table gives no rows;
    repeated ids each give a row of their own. Other columns of `df` aren't looked at."""
    rows = stage(_rows(df, id_col, text_col), "keys")
    # only groups with copies go into the join with the rows
    on = ["key_hi", "key_lo", "key_check"]
    many = stage(distinct_keys(rows).filter("copies > 1").select(*on, "first_row_id", "n"), "copies")
    hot = F.broadcast(many.filter(F.col("n") > hot_rows).drop("n"))
    slim = rows.select("row_id", *on)
    found = slim.join(hot, on).unionByName(slim.join(hot, on, "left_anti").join(many.filter(F.col("n") <= hot_rows).drop("n"), on))
    return found.filter("row_id <> first_row_id").select("first_row_id", "row_id")


def collapsed(df: DataFrame, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """(first_row_id, copies): one row for each distinct record with its number of copies.
    Texts without a letter or digit, also null ones, are no records."""
    return distinct_keys(_rows(df, id_col, text_col)).select("first_row_id", "copies").distinct()


def collisions(df: DataFrame, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """(keys, collisions): distinct 128-bit keys and how many of them stand for more than one form."""
    per = _rows(df, id_col, text_col).groupBy("key_hi", "key_lo").agg((F.min("key_check") != F.max("key_check")).alias("bad"))
    return per.agg(F.count("*").alias("keys"), F.count_if("bad").alias("collisions"))
