"""Problem 3: records of the evaluation splits that stand in the training split too.

An exact prefix-filter join of two sides on their rarest words (shingles of one word, as the
project's data define them): the evaluation sets are indexed under their prefix words, the training
sets probe that index with length and position filters, and what is left is verified on whole sets.
Sets that share a frequent word are brought together by the next common word too, and where these are
still many, by the one after it; within a task, so no more postings are sent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import wordsets as ws
from plumbline.llm.duplicates import shared_keys
from plumbline.llm.neardup import BLOCK, DIFFERENT, hot_words, in_word_groups, keyed, postings, unpacked, verified
from plumbline.plans.staging import stage

_PAIRS = 1 << 21  # index entries looked at in one step
#: Pairs of sets of a word above which the sets are compared by the next common word too.
_WORK = 1 << 24
_LONGEST = 3  # words by which sets are brought together


def probe(group: np.ndarray, held: np.ndarray, sketch_a: np.ndarray, sketch_b: np.ndarray, size: np.ndarray, place: np.ndarray, wide: np.ndarray, line: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (evaluation, training) within a word that length, position and the sketches of the
    words after it don't rule out, in parts of bounded size. `group` numbers the words."""
    sim, of = ws.SIMILARITY
    unit = of + sim
    share = (of - sim) * size - unit * place  # what a set may spend on words that only one has, see `trie_pairs`
    ev, tr = np.flatnonzero(held), np.flatnonzero(~held)
    span = int(size.max(initial=0)) * 2 + 2
    ev = ev[np.lexsort((size[ev], group[ev]))]
    index = group[ev] * span + size[ev]
    largest = (size - place) * unit // sim - size
    smallest = -(-sim * size // of)
    lo = np.searchsorted(index, group[tr] * span + smallest[tr], "left")
    hi = np.searchsorted(index, group[tr] * span + np.minimum(largest[tr], span - 1), "right")
    some = hi > lo
    tr, lo, n = tr[some], lo[some], (hi - lo)[some]
    ends = np.cumsum(n)
    first = 0
    while first < len(tr):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] - n[first] + _PAIRS, "right")))
        m = n[first:last]
        at = np.repeat(lo[first:last] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        i, j = ev[at], np.repeat(tr[first:last], m)
        kept = (share[i] + share[j] >= 0) & (size[j] <= largest[i])
        i, j = i[kept], j[kept]
        far = np.bitwise_count(sketch_a[i] ^ sketch_a[j]).astype(np.int64) + np.bitwise_count(sketch_b[i] ^ sketch_b[j])
        budget = (share[i] + share[j]) // unit
        kept = far <= budget
        i, j, budget = i[kept], j[kept], budget[kept]
        kept = ws.wide_near(wide, line, i, j, budget)
        yield i[kept], j[kept]
        first = last


def longer(cols: dict[str, np.ndarray], base: np.ndarray, following: np.ndarray, length: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Sets that share `length` words, brought together by the next common one instead: a set once for each
    word that can be it, in groups of their own; and the row that each comes from. A set's word at a place
    is `following` at `base` and that place. Two similar sets meet where the word is the next that both
    have, with all words in between on one side only. A set that ends here is similar to itself
    alone, and stays as it is."""
    a, b = ws.SIMILARITY
    n, at = cols["size"], cols["place"] + length - 1
    ends = n <= length
    copies = np.where(ends, 1, n - -(-a * n // b) + length - at)
    row = np.repeat(np.arange(len(n)), copies)
    first = np.cumsum(copies) - copies
    place = at[row] + 1 + np.arange(len(row)) - first[row]
    on = ~ends[row]
    word = np.full(len(row), 1 << 16)
    word[on] = following[(base[row] + place)[on]]
    out = {k: cols[k][row] for k in ("held", "size")}
    # the sketches of what stands after the new word
    for k, bit in zip(("sketch_a", "sketch_b"), ws.bits(word << 20)):
        upto = np.r_[np.uint64(0), np.bitwise_xor.accumulate(np.where(on, bit, np.uint64(0)))]
        out[k] = cols[k][row] ^ upto[1:] ^ upto[first][row]
    out["group"] = np.unique((cols["group"][row] << 17) | word, return_inverse=True)[1]
    out["place"] = np.where(on, place - length, cols["place"][row])
    return out, row


def _join(t: pa.Table, work: int = _WORK) -> Iterator[pa.RecordBatch]:
    cols = unpacked(t)
    del cols["cross"], cols["side"]
    ids, wide, lines = t["id"].to_numpy(), cols.pop("wide"), cols.pop("line")
    column = t["next"].combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 2
    following = np.frombuffer(column.buffers()[2] or b"", np.uint16).astype(np.int64)
    known = np.diff(offsets) > 0
    known |= cols["size"] == 1
    base = offsets[:-1] - cols["place"] - 1
    row = np.arange(len(ids))
    for length in range(1, _LONGEST + 1):
        group = cols["group"]
        many = (np.bincount(group, cols["held"]) * np.bincount(group, ~cols["held"]) > work)[group]
        if length == 1:
            # of a rare word no set tells what follows
            many &= (np.bincount(group, ~known) == 0)[group]
        if length == _LONGEST:
            many[:] = False
        few = {k: x[~many] for k, x in cols.items()}
        own = row[~many]
        for i, j in probe(**few, wide=wide, line=lines[own] if length == 1 else np.full(len(own), -1)):
            yield pa.RecordBatch.from_arrays([pa.array(ids[own[i]]), pa.array(ids[own[j]])], names=["id_a", "id_b"])
        if not many.any():
            return
        row = row[many]
        cols, of = longer({k: x[many] for k, x in cols.items()}, base[row], following, length)
        row = row[of]


def in_grid(posts: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Postings with those of hot words spread over a grid: a training set is in one row of blocks and
    goes to all blocks of evaluation sets, and the other way round."""
    if hot is None:
        return posts
    held = F.col("meta").bitwiseAND(4) > 0
    x = posts.join(hot, "word", "left")
    own, other = F.when(held, F.col("held_blocks")).otherwise(F.col("blocks")), F.when(held, F.col("blocks")).otherwise(F.col("held_blocks"))
    x = x.withColumn("mine", F.pmod(F.xxhash64("id"), own)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(other - 1, F.lit(0)))))
    block = F.when(held, F.xxhash64("word", "other", "mine")).otherwise(F.xxhash64("word", "mine", "other"))
    return x.select(F.when(F.col("blocks").isNull(), F.col("word")).otherwise(block).alias("word"), "id", "sketch_a", "sketch_b", "wide", "meta", "next")


def _sided(df: DataFrame, id_col: str, text_col: str, split_col: str) -> DataFrame:
    split = F.lower(F.trim(F.col(split_col)))
    return df.select(
        F.col(id_col).cast("long").alias("row_id"),
        F.col(text_col).cast("string").alias("text"),
        F.when(split == "train", False).when(split.isin("validation", "test"), True).alias("held"),
    )


def _parts(df: DataFrame, id_col: str, text_col: str, split_col: str, block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(row_id, held, same) of the rows in groups of the same text that have rows of both sides; all
    rows with their keys and word sets; and the verified pairs of an evaluation and a training set."""
    table = stage(ws.word_table(_sided(df, id_col, text_col, split_col), "row_id", "text", "held", all_rows=True, packed=True), "sides")
    # near copies
    sets = ws.distinct_sets(table.filter("held is not null"), sided=True)
    order = ws.word_order(sets, sided=True)
    posts = in_grid(postings(sets, order), hot_words(sets, order, block))
    pairs = stage(in_word_groups(posts, _join, "id_a long, id_b long").distinct(), "candidates")
    classes = stage(verified(pairs, sets), "classes")
    ids = classes.select(F.explode(F.array("lo_a", "lo_b")).alias("set_lo"))
    # the same: groups of problem 1, linked by all rows, with rows on both sides
    own, same = ["key_hi", "key_lo", "key_check"], ["same_hi", "same_lo", "same_check"]
    found = stage(shared_keys(table), "groups")
    rows = table.filter("held is not null").join(found, [table[c] == found[f"of_{c}"] for c in own], "left")
    rows = rows.withColumns({s: F.coalesce(F.col("same")[k], k) for s, k in zip(same, own)})
    both = rows.groupBy(*same).agg(F.max("held").alias("any_held"), F.max(~F.col("held")).alias("any_train"))
    both = stage(both.filter("any_held and any_train").select(*same), "both")
    # rows of either kind
    rows = rows.select("row_id", "held", "key_hi", "key_lo", "alias_hi", "alias_lo", "set_hi", "set_lo", *same)
    rows = stage(ws.keep_by_filters(rows, {"same_lo": ws.key_filter(both.select("same_lo")), "set_lo": ws.key_filter(ids)}), "found")
    return rows.join(both, same).select("row_id", "held", F.struct(*same).alias("same")), keyed(rows, "held"), classes


def _near(classes: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs of an evaluation (_a) and a training row (_b) of the classes whose texts aren't the same."""
    a = rows.filter("held").select(*(F.col(c).alias(f"{c}_a") for c in rows.columns))
    b = rows.filter("not held").select(*(F.col(c).alias(f"{c}_b") for c in rows.columns))
    near = classes.join(a, (F.col("hi_a") == F.col("set_hi_a")) & (F.col("lo_a") == F.col("set_lo_a"))).join(
        b, (F.col("hi_b") == F.col("set_hi_b")) & (F.col("lo_b") == F.col("set_lo_b"))
    )
    return near.filter(DIFFERENT)


def overlaps(df: DataFrame, id_col: str = "row_id", text_col: str = "text", split_col: str = "split", block: int = BLOCK) -> DataFrame:
    """(eval_id, train_id): all pairs of a row in validation or test and a row in train whose texts
    are the same in the sense of problem 1 or near copies in the sense of problem 2.

    Rows of another or no split, null texts and texts without a letter or digit are in no pair; an
    empty side gives no rows. Other columns of `df` aren't looked at."""
    rows, sided, classes = _parts(df, id_col, text_col, split_col, block)
    same = rows.filter("held").select(F.col("row_id").alias("eval_id"), "same").join(rows.filter("not held").select(F.col("row_id").alias("train_id"), "same"), "same").select("eval_id", "train_id")
    near = _near(classes, sided).select(F.col("row_id_a").alias("eval_id"), F.col("row_id_b").alias("train_id"))
    return same.unionByName(near).distinct()


def overlap_counts(df: DataFrame, id_col: str = "row_id", text_col: str = "text", split_col: str = "split", block: int = BLOCK) -> DataFrame:
    """(eval_id, pairs): for each evaluation row with an overlap its number of `overlaps`, counted from
    the numbers of rows of groups and of different texts, without making the pairs. Repeated ids count
    once. A row's same texts and its near copies exclude each other, so their numbers add up."""
    rows, sided, classes = _parts(df, id_col, text_col, split_col, block)
    train = rows.filter("not held").groupBy("same").agg(F.count_distinct("row_id").alias("pairs"))
    same = rows.filter("held").select(F.col("row_id").alias("eval_id"), "same").distinct().join(train, "same").select("eval_id", "pairs")
    text = [c for c in sided.columns if c != "row_id"]
    units = stage(sided.groupBy(*text).agg(F.count_distinct("row_id").alias("n"), F.min("row_id").alias("row_id")), "units")
    per = _near(classes, units).groupBy(*(F.col(f"{c}_a").alias(c) for c in text)).agg(F.sum("n_b").alias("pairs"))
    near = sided.filter("held").join(per, text).select(F.col("row_id").alias("eval_id"), "pairs").distinct()
    return same.unionByName(near).groupBy("eval_id").agg(F.sum("pairs").alias("pairs"))


def overlap_pairs(df: DataFrame, **columns: str) -> DataFrame:
    """(row_id_a, row_id_b), a < b, of `overlaps`."""
    return overlaps(df, **columns).filter("eval_id <> train_id").select(F.least("eval_id", "train_id").alias("row_id_a"), F.greatest("eval_id", "train_id").alias("row_id_b")).distinct()


def overlap_report(df: DataFrame, source_dim: DataFrame) -> DataFrame:
    """(split, source, family, eval_rows, overlapping_rows, pairs) for every evaluation split and
    cleaned source; a source listed under several families has a line for each, and one without a
    family its own name. Rows without a source have a null source and family."""
    clean = F.nullif(F.lower(F.trim(F.regexp_replace("source", "(?U)^\\s+|\\s+$", ""))), F.lit(""))
    rows = df.select(F.col("row_id").cast("long").alias("eval_id"), F.lower(F.trim("split")).alias("split"), clean.alias("source")).filter("split in ('validation', 'test')")
    hits = overlap_counts(df)
    per = rows.join(hits, "eval_id", "left").groupBy("split", "source").agg(F.count("*").alias("eval_rows"), F.count("pairs").alias("overlapping_rows"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))
    name = F.lower(F.regexp_replace("name", "(?U)^\\s+|\\s+$", ""))
    family = F.lower(F.regexp_replace("family", "(?U)^\\s+|\\s+$", ""))
    dim = source_dim.select(name.alias("source"), F.coalesce(F.nullif(family, F.lit("")), name).alias("family")).distinct()
    return per.join(dim, "source", "left").select("split", "source", F.coalesce("family", "source").alias("family"), "eval_rows", "overlapping_rows", "pairs")
