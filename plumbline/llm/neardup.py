"""Problem 2: near copies, as a binary-trie self-join.

1. Every text becomes its set of word hashes; equal sets are one class from the start, so exact copies
   are compared once.
2. Classes are posted under their rarest words (prefix filter), by the exact number of classes that
   have a word: two sets similar enough share one. A word of a single class is never posted. A word
   with more than BLOCK postings is spread over pairs of blocks, so no task gets an unbounded group.
3. Within a word's postings a binary trie is joined with itself: pairs of nodes are traversed together,
   their differing bits add up, and a pair is dropped once they exceed the error budget. The bits are
   parity sketches of the words after the posted one. The words before it, which two sets that meet
   here first don't share, are errors from the start, so a set brings what its size allows less its
   word's place. A sketch distance never exceeds the true difference, so no pair is lost.
4. Surviving pairs of classes are verified on the whole word sets, then expanded to rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import wordsets as ws
from plumbline.llm.duplicates import copies
from plumbline.llm.splits import components
from plumbline.plans.staging import stage

#: Postings that one block of a frequent word holds at most, about.
BLOCK = 1 << 15
_LEAF = 64
_CELLS = 1 << 15  # pairs of sets compared at once
_FLUSH = 1 << 19  # pairs found after which they are handed on
_BATCH = 60_000  # postings joined at once, rounded up to whole words
_BAND_BITS = 6
_SKETCH = ((1 << 32) - 1) << (63 - _BAND_BITS - 32)  # the folded sketch in a key

POSTING = "word long, id long, sketch_a long, sketch_b long, wide binary, meta long"


def hot_words(sets: DataFrame, order: ws.WordOrder, block: int) -> DataFrame | None:
    """(word, blocks, held_blocks) of the words with more than `block` postings of all sets, or of
    sets with columns in_train and in_held on one of these sides; None where there is none."""
    if order.most <= block:
        return None
    # a word stands in the prefix of a set only if most of the set's words are as frequent
    frequent = order.frequent(block)
    shared = sets.sparkSession.sparkContext.broadcast((order._replace(number=None), frequent))
    sides = [F.col(c) for c in ("in_train", "in_held")] if "in_held" in sets.columns else [F.lit(True).alias("in_train"), F.lit(False).alias("in_held")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            order, among = shared.value
            flat, n = ws.flat_words(b.column("words"))
            if among is not None and len(n):
                has = among[np.minimum(np.searchsorted(among, flat), len(among) - 1)] == flat
                some = np.add.reduceat(has.astype(np.int64), np.cumsum(n) - n) >= ws.least_after(n)
                flat, n, b = flat[np.repeat(some, n)], n[some], b.filter(pa.array(some))
            if not len(n):
                continue
            p = ws.prefixes(flat, n, order)
            word, inverse = np.unique(p.word, return_inverse=True)
            counts = [np.bincount(inverse, b.column(c).to_numpy(zero_copy_only=False)[p.row], len(word)).astype(np.int64) for c in ("in_train", "in_held")]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (word, *counts)], names=["word", "n", "held"])

    per = sets.select(*sides, "words").mapInArrow(run, "word long, n long, held long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("held").alias("held"))
    of = lambda c: F.greatest(F.ceil(F.col(c) / block), F.lit(1))
    hot = stage(per.filter((F.col("n") > block) | (F.col("held") > block)).select("word", of("n").alias("blocks"), of("held").alias("held_blocks")), "hot")
    return None if hot.isEmpty() else hot


def postings(sets: DataFrame, order: ws.WordOrder) -> DataFrame:
    """(word, id, sketches, wide, meta) for the prefix words of every distinct set. meta packs the set's
    size, the word's place and three marks, see `unpacked`. With columns in_held and in_train a set is
    posted once for each side it is on, and next has the words that follow a frequent one."""
    shared = sets.sparkSession.sparkContext.broadcast(order._replace(number=None))
    sided = "in_held" in sets.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, n = ws.flat_words(b.column("words"))
            if not len(n):
                continue
            p = ws.prefixes(flat, n, shared.value)
            low, high = ws.sketches_after(p)
            line = np.full(len(p.row), -1)
            large = n > ws.WIDE_FROM
            wide = np.zeros((0, 8), np.uint64)
            if large.any():
                some = np.flatnonzero(large[p.row])
                line[some] = np.arange(len(some))
                wide = ws.wide_sketches_after(ws.Prefixes(p.row[some], p.place[some], p.word[some], p.ordered, p.start, p.end))
            meta = (n[p.row] << 32) | (np.minimum(p.place, 0xFFFFFF) << 8)
            ids = b.column("id").to_numpy(zero_copy_only=False)[p.row]
            columns = [p.word, ids, low.view(np.int64), high.view(np.int64)]
            sides = [(np.ones(len(p.row), bool), 0)]
            if sided:
                sides = [(b.column(c).to_numpy(zero_copy_only=False)[p.row], mark) for c, mark in (("in_train", 0), ("in_held", 4))]
            often = shared.value.of(p.word) > shared.value.rare if sided else None
            for on, mark in sides:
                more = [ws.following(ws.Prefixes(*(x[on] for x in p[:3]), *p[3:]), n, often[on])] if sided else []
                yield pa.RecordBatch.from_arrays([*(pa.array(x[on]) for x in columns), ws.packed_wide(wide, line[on]), pa.array(meta[on] | mark), *more], names=["word", "id", "sketch_a", "sketch_b", "wide", "meta", *["next"] * sided])

    return sets.select("id", *(["in_held", "in_train"] if sided else []), "words").mapInArrow(run, POSTING + ", next binary" * sided)


def in_blocks(posts: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Postings with those of hot words spread over pairs of blocks: each goes to its own block with
    every other, under a name of the pair. The marks tell pairs of different blocks and the side."""
    if hot is None:
        return posts
    x = posts.join(hot.select("word", "blocks"), "word", "left")
    x = x.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("blocks") - 1, F.lit(0)))))
    name = F.when(F.col("blocks").isNull(), F.col("word")).otherwise(F.xxhash64("word", F.least("mine", "other"), F.greatest("mine", "other")))
    marks = F.when(F.col("mine") < F.col("other"), 2).when(F.col("mine") > F.col("other"), 3).otherwise(0)
    return x.select(name.alias("word"), "id", "sketch_a", "sketch_b", "wide", F.col("meta").bitwiseOR(marks.cast("long")).alias("meta"))


def _depth(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Number of leading bits that two keys share."""
    x = first ^ last
    for s in (1, 2, 4, 8, 16, 32):
        x |= x >> np.uint64(s)
    return 64 - np.bitwise_count(x).astype(np.int64)


def trie_pairs(group: np.ndarray, cross: np.ndarray, side: np.ndarray, sketch_a: np.ndarray, sketch_b: np.ndarray, size: np.ndarray, place: np.ndarray, wide: np.ndarray, line: np.ndarray, tally: Counter | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within groups that sketches, sizes and places don't rule out, in parts of bounded
    size. `sketch_a` and `sketch_b` are of the words after the posted one, `place` is the number of
    words before it.

    Two sets of sizes n and m that first meet at places i and j are similar enough if and only if
    (of + sim) * (i + j + words after that only one has) <= (of - sim) * (n + m). So each posting brings
    a share of the budget, (of - sim) * n - (of + sim) * i. The trie's keys are a side bit, a band of
    that share and the first sketch; a node is a range of the sorted keys, its depth the number of bits
    they share. Node pairs start from each group's root with itself. `tally` counts what is done."""
    sim, of = ws.SIMILARITY
    unit = of + sim
    share = (of - sim) * size - unit * place
    band = np.clip(share // unit + 24, 0, (1 << _BAND_BITS) - 1).astype(np.uint64)
    # both sketches folded into 32 bits are a sketch too, whose bits tell more of sets of some dozen words
    folded = sketch_a ^ sketch_b
    folded ^= folded >> np.uint64(32)
    key = (side.astype(np.uint64) << np.uint64(63)) | (band << np.uint64(63 - _BAND_BITS)) | ((folded & np.uint64(0xFFFFFFFF)) << np.uint64(63 - _BAND_BITS - 32)) | (sketch_a >> np.uint64(1 + _BAND_BITS + 32))
    order = np.lexsort((key, group))
    key, a, b, size, place, group, cross, share = (x[order] for x in (key, sketch_a, sketch_b, size, place, group, cross, share))
    total = len(key)
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    end = np.r_[start[1:], total]
    top = key >> np.uint64(63)
    # sizes of the sets that this posting can be the first common word with, from its place on
    largest = (size - place) * unit // sim - size
    smallest = -(-sim * size // of)
    masks = np.array([(((1 << d) - 1) << (64 - d)) & _SKETCH for d in range(65)], np.uint64)
    part = np.clip(share, -4000, unit * 128).astype(np.int16)  # no two sketches differ by more than 128 bits
    bounds = np.r_[part, part[-1:]]
    tally = Counter() if tally is None else tally
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held_back = 0

    def leaves(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        nonlocal held_back
        widest = np.maximum(a1 - a0, b1 - b0)
        for low, most_rows in ((0, 2), (2, 4), (4, 8), (8, 16), (16, 32), (32, 64)):
            at = np.flatnonzero((widest > low) & (widest <= most_rows))
            lane = np.arange(most_rows)
            step = max(1, _CELLS // (most_rows * most_rows))
            tally["cells"] += len(at) * most_rows * most_rows
            for s in range(0, len(at), step):
                q = at[s : s + step]
                i, j = np.minimum(a0[q, None] + lane, total - 1), np.minimum(b0[q, None] + lane, total - 1)
                far = np.bitwise_count(a[i][:, :, None] ^ a[j][:, None, :]).astype(np.int16)
                far *= unit
                g, x, y = np.nonzero(far <= part[i][:, :, None] + part[j][:, None, :])
                i, j, q = i[g, x], j[g, y], q[g]
                # lanes beyond a node's end aren't its own
                kept = (x < (a1 - a0)[q]) & (y < (b1 - b0)[q]) & ((i < j) | (a0[q] != b0[q]))
                i, j = i[kept], j[kept]
                budget = share[i] + share[j]
                kept = (np.bitwise_count(a[i] ^ a[j]).astype(np.int64) + np.bitwise_count(b[i] ^ b[j])) * unit <= budget
                kept &= (size[j] <= largest[i]) & (size[i] <= largest[j]) & (size[j] >= smallest[i]) & (size[i] >= smallest[j])
                kept &= ~cross[i] | (top[i] != top[j])
                i, j, budget = i[kept], j[kept], budget[kept]
                i, j = order[i], order[j]
                kept = ws.wide_near(wide, line, i, j, budget // unit)
                found.append((i[kept], j[kept]))
                held_back += len(found[-1][0])
                if held_back > _FLUSH:
                    yield tuple(np.concatenate(c) for c in zip(*found))
                    found.clear()
                    held_back = 0

    stack = [(start, end, start, end)]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        if len(a0) > 1 << 17:
            half = len(a0) // 2
            stack += [(a0[:half], a1[:half], b0[:half], b1[:half]), (a0[half:], a1[half:], b0[half:], b1[half:])]
            continue
        # the bits that all sets of both nodes agree upon tell the least number of errors
        da, db = _depth(key[a0], key[a1 - 1]), _depth(key[b0], key[b1 - 1])
        errors = np.bitwise_count((key[a0] ^ key[b0]) & masks[np.minimum(da, db)]).astype(np.int64)
        cuts = np.stack([a0, a1, b0, b1], 1)
        most = np.maximum.reduceat(bounds, cuts[:, :2].ravel())[::2].astype(np.int64) + np.maximum.reduceat(bounds, cuts[:, 2:].ravel())[::2]
        within = errors * unit <= most
        tally["visited"] += len(a0)
        tally["dropped"] += int((~within).sum())
        na, nb = (a1 - a0)[~within], (b1 - b0)[~within]
        tally["ruled_out"] += int(np.where((a0 == b0)[~within], na * (na - 1) // 2, na * nb).sum())
        alive = within & ~(cross[a0] & (da > 0) & (db > 0) & (top[a0] == top[b0]))
        alive &= (a0 != b0) | (a1 - a0 > 1)
        a0, a1, b0, b1 = a0[alive], a1[alive], b0[alive], b1[alive]
        if not len(a0):
            continue
        na, nb = a1 - a0, b1 - b0
        small = (na <= _LEAF) & (nb <= _LEAF)
        yield from leaves(a0[small], a1[small], b0[small], b1[small])
        a0, a1, b0, b1, na, nb = (x[~small] for x in (a0, a1, b0, b1, na, nb))
        if not len(a0):
            continue
        same = a0 == b0
        split_a = same | (na >= nb)
        x0, x1 = np.where(split_a, a0, b0), np.where(split_a, a1, b1)
        mid = _divide(key, x0, x1)
        y0, y1 = np.where(split_a, b0, a0), np.where(split_a, b1, a1)
        o, s = ~same, same
        below = [(x0[o], mid[o], y0[o], y1[o]), (mid[o], x1[o], y0[o], y1[o])]
        below += [(x0[s], mid[s], x0[s], mid[s]), (x0[s], mid[s], mid[s], x1[s]), (mid[s], x1[s], mid[s], x1[s])]
        stack.append(tuple(np.concatenate(c) for c in zip(*below)))
    if found:
        yield tuple(np.concatenate(c) for c in zip(*found))


def _divide(key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Where each node's second child begins: at the first bit not shared; a node of equal keys,
    which has no such bit, is halved."""
    depth = _depth(key[lo], key[hi - 1])
    whole = depth >= 64
    bit = np.uint64(1) << (63 - np.minimum(depth, 63)).astype(np.uint64)
    a, b = lo.copy(), hi - 1  # key[a] lacks the bit, key[b] has it
    while True:
        open_ = b - a > 1
        if not open_.any():
            break
        m = (a + b) // 2
        has = (key[m] & bit) != 0
        b = np.where(open_ & has, m, b)
        a = np.where(open_ & ~has, m, a)
    return np.where(whole, (lo + hi + 1) // 2, b)


def in_word_groups(posts: DataFrame, join: Callable[[pa.Table], Iterator[pa.RecordBatch]], ddl: str) -> DataFrame:
    """`join` applied to all postings of some whole words at a time, sorted by word. A task holds
    the postings of one word, bounded by blocks, and a batch more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            rest.append(b)
            rows += b.num_rows
            if rows < _BATCH:
                continue
            t = pa.Table.from_batches(rest).combine_chunks()
            word = t["word"].to_numpy()
            cut = int(np.flatnonzero(word != word[-1])[-1]) + 1 if word[0] != word[-1] else 0
            if cut:
                yield from join(t.slice(0, cut))
            t = t.slice(cut)
            rest, rows = t.to_batches(), t.num_rows
        if rows:
            yield from join(pa.Table.from_batches(rest).combine_chunks())

    return posts.repartition("word").sortWithinPartitions("word").mapInArrow(run, ddl)


def unpacked(t: pa.Table) -> dict[str, np.ndarray]:
    """The columns of postings sorted by word: group numbers, size, place, and the marks held (of
    the evaluation side), cross (a pair of different blocks) and side (which of the two)."""
    word, meta = t["word"].to_numpy(), t["meta"].to_numpy()
    wide, line = ws.unpacked_wide(t["wide"])
    return {
        "group": np.cumsum(np.r_[True, word[1:] != word[:-1]]), "held": (meta & 4) > 0, "cross": (meta & 2) > 0, "side": (meta & 1) > 0,
        "sketch_a": t["sketch_a"].to_numpy().view(np.uint64), "sketch_b": t["sketch_b"].to_numpy().view(np.uint64),
        "size": meta >> 32, "place": (meta >> 8) & 0xFFFFFF, "wide": wide, "line": line,
    }


def _join(t: pa.Table) -> Iterator[pa.RecordBatch]:
    cols = unpacked(t)
    del cols["held"]
    ids = t["id"].to_numpy()
    for i, j in trie_pairs(**cols):
        x, y = ids[i], ids[j]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["id_a", "id_b"])


def candidate_classes(posts: DataFrame) -> DataFrame:
    """Distinct (id_a, id_b), id_a < id_b, of sets that the trie join can't rule out."""
    return in_word_groups(posts, _join, "id_a long, id_b long").distinct()


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(hi_a, lo_a, hi_b, lo_b) of the candidate pairs (id_a, id_b) whose whole word sets are similar
    enough. `sets` has id, set_hi, set_lo, words."""
    mixed = F.col("id").bitwiseXOR(F.shiftright("id", 33) * 40503)  # ids rise within a file, and files begin alike
    of = sets.select("id", "set_hi", "set_lo", "words").withColumn("turn", mixed)
    ids = pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")).select(mixed.alias("turn"))
    near = stage(ws.keep_by_filter(of, "turn", ws.key_filter(ids)).drop("turn"), "near")
    a = near.select(F.col("id").alias("id_a"), F.col("set_hi").alias("hi_a"), F.col("set_lo").alias("lo_a"), F.col("words").alias("words_a"))
    b = near.select(F.col("id").alias("id_b"), F.col("set_hi").alias("hi_b"), F.col("set_lo").alias("lo_b"), F.col("words").alias("words_b"))
    sim, of_ = ws.SIMILARITY
    joined = pairs.join(a, "id_a").join(b, "id_b")
    classes = ["hi_a", "lo_a", "hi_b", "lo_b"]
    if dict(sets.dtypes)["words"] == "binary":
        return joined.select(*classes, "words_a", "words_b").mapInArrow(_similar, "hi_a long, lo_a long, hi_b long, lo_b long")
    both = F.size(F.array_intersect("words_a", "words_b"))
    return joined.filter(both * of_ >= (F.size("words_a") + F.size("words_b") - both) * sim).select(*classes)


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The classes of rows with similar packed words."""
    sim, of = ws.SIMILARITY
    for b in batches:
        (x, n), (y, m) = (ws.flat_words(b.column(c)) for c in ("words_a", "words_b"))
        rows = np.arange(b.num_rows)
        word = np.sort(np.r_[np.repeat(rows, n) << 40 | x, np.repeat(rows, m) << 40 | y])
        both = np.bincount(word[1:][word[1:] == word[:-1]] >> 40, minlength=b.num_rows)
        yield b.select(["hi_a", "lo_a", "hi_b", "lo_b"]).filter(pa.array(both * of >= (n + m - both) * sim))


def similar_classes(table: DataFrame, block: int = BLOCK) -> DataFrame:
    """Verified pairs of different word sets of a staged `word_table`."""
    sets = ws.distinct_sets(table)
    order = ws.word_order(sets)
    posts = in_blocks(postings(sets, order), hot_words(sets, order, block))
    return verified(stage(candidate_classes(posts), "candidates"), sets)


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    src = df.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).cast("string").alias("text"))
    return stage(ws.word_table(src, "row_id", "text"), "words")


def near_pairs(df: DataFrame, id_col: str = "row_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(row_id_a, row_id_b), a < b: all pairs of texts of 15 words or more that aren't the same in
    the sense of problem 1 and share at least 0.7 of their distinct words.

    Null, empty and shorter texts are in no pair; an empty table gives no rows; a repeated id
    isn't paired with itself. Other columns of `df` aren't looked at."""
    table = _texts(df, id_col, text_col)
    return expanded(stage(similar_classes(table, block), "classes"), keyed(table))


_SET, _KEY = ["set_hi", "set_lo"], ["key_hi", "key_lo", "plain_hi", "plain_lo"]


def keyed(table: DataFrame, *carry: str) -> DataFrame:
    """(row_id, *carry, set_hi, set_lo, key_hi, key_lo, plain_hi, plain_lo) of the rows with a word set."""
    return table.filter("set_lo is not null").select("row_id", *carry, *_SET, "key_hi", "key_lo", F.coalesce("alias_hi", "key_hi").alias("plain_hi"), F.coalesce("alias_lo", "key_lo").alias("plain_lo"))


def expanded(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(row_id_a, row_id_b), a < b: rows of the pairs of classes, and of classes whose texts differ in
    the sense of problem 1. `rows` as from `keyed`."""
    inner = rows.groupBy(*_SET).agg((F.min(F.struct("key_hi", "key_lo")) != F.max(F.struct("key_hi", "key_lo"))).alias("mixed")).filter("mixed")
    every = pairs.unionByName(inner.select(F.col("set_hi").alias("hi_a"), F.col("set_lo").alias("lo_a"), F.col("set_hi").alias("hi_b"), F.col("set_lo").alias("lo_b")))
    every = stage(every, "pairs")
    ids = every.select(F.explode(F.array("lo_a", "lo_b")).alias("set_lo"))
    rows = ws.keep_by_filter(rows, "set_lo", ws.key_filter(ids))
    a = rows.select(*(F.col(c).alias(f"{c}_a") for c in rows.columns))
    b = rows.select(*(F.col(c).alias(f"{c}_b") for c in rows.columns))
    out = every.join(a, (F.col("hi_a") == F.col("set_hi_a")) & (F.col("lo_a") == F.col("set_lo_a"))).join(
        b, (F.col("hi_b") == F.col("set_hi_b")) & (F.col("lo_b") == F.col("set_lo_b"))
    )
    same_class = (F.col("hi_a") == F.col("hi_b")) & (F.col("lo_a") == F.col("lo_b"))
    out = out.filter(f"{DIFFERENT} and row_id_a <> row_id_b").filter(~same_class | (F.col("row_id_a") < F.col("row_id_b")))
    return out.select(F.least("row_id_a", "row_id_b").alias("row_id_a"), F.greatest("row_id_a", "row_id_b").alias("row_id_b"))


#: Texts that aren't the same in the sense of problem 1.
DIFFERENT = "not (key_hi_a = key_hi_b and key_lo_a = key_lo_b) and not (plain_hi_a = plain_hi_b and plain_lo_a = plain_lo_b)"


def membership(df: DataFrame, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """(row_id, group_id, links) for every row: the least row of its group of near copies, joined
    through any number of links, and its number of links to other rows. A row without near copy has
    the first row of its exact copies as group, itself if it has none or no letter or digit, and 0
    links. A repeated id stands once.

    Links and groups come from pairs of units, that is, of different texts with their numbers of rows,
    so copies aren't expanded."""
    table = _texts(df, id_col, text_col)
    rows = keyed(table)
    units = stage(rows.groupBy(*_SET, *_KEY).agg(F.min("row_id").alias("row_id"), F.count_distinct("row_id").alias("n")), "units")
    pairs = stage(expanded(stage(similar_classes(table), "classes"), units.drop("n")), "links")
    both = pairs.unionByName(pairs.select(F.col("row_id_b").alias("row_id_a"), F.col("row_id_a").alias("row_id_b")))
    size = units.select(F.col("row_id").alias("row_id_b"), "n")
    links = both.join(size, "row_id_b").groupBy(F.col("row_id_a").alias("unit")).agg(F.sum("n").alias("links"))
    of = components(pairs).select(F.col("node").alias("unit"), F.col("label").alias("group_id")).join(links, "unit")
    near = units.select(*_SET, *_KEY, F.col("row_id").alias("unit")).join(of, "unit")
    linked = stage(rows.join(near, [*_SET, *_KEY]).select("row_id", "group_id", "links").distinct(), "linked")
    first = copies(df, id_col, text_col).select("row_id", F.col("first_row_id").alias("first")).distinct()
    every = df.select(F.col(id_col).cast("long").alias("row_id")).distinct()
    out = every.join(linked, "row_id", "left").join(first, "row_id", "left")
    return out.select("row_id", F.coalesce("group_id", "first", "row_id").alias("group_id"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))


def groups(df: DataFrame, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """The rows of `membership` that have a near copy."""
    return membership(df, id_col, text_col).filter("links > 0")
