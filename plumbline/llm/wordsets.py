"""Hashed keys and word sets of texts: the rows that the operators on pairs of texts start from."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.charform import record_key, signs, visual_form, word_bytes, word_record
from plumbline.plans.staging import stage

#: Words whose exact order every task holds, at 12 bytes each: the most frequent ones. Words beyond it
#: are rarer than all of these, and stand before them in the order of their hashes.
MOST_WORDS = 1 << 20
#: Sets with a word from which on its postings tell the words that follow, see `following`.
OFTEN = 1 << 13
#: Bits of the filter on row keys: fixed, 1 MB.
FILTER_BITS = 1 << 23
MIN_WORDS = 15
SIMILARITY = (7, 10)
_BYTES = 5  # of a word's hash

KEYS = "key_hi long, key_lo long, key_check long, alias_hi long, alias_lo long, alias_check long"
_NAMES = [c.split()[0] for c in KEYS.split(", ")]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def hash128(text: str) -> tuple[int, int]:
    """128-bit hash of a string as two signed longs."""
    x = xxhash.xxh3_128_intdigest(text.encode("utf-8", "surrogatepass"))
    return _signed(x >> 64), _signed(x & (1 << 64) - 1)


def key_row(form: str, plain: str) -> tuple | None:
    """128-bit key of a visual form whose letters and digits are `plain`, an independent 64-bit
    check of it, and for records both of `plain` itself. None without a sign."""
    if not plain:
        return None
    record = record_key(form)
    key = (plain if record is None else f"\x1d{record}").encode("utf-8", "surrogatepass")
    x = xxhash.xxh3_128_intdigest(key)
    alias = (None, None, None) if record is None else (*hash128(plain), _signed(xxhash.xxh64_intdigest(plain.encode("utf-8", "surrogatepass"), seed=7)))
    return (_signed(x >> 64), _signed(x & (1 << 64) - 1), _signed(xxhash.xxh64_intdigest(key, seed=7)), *alias)


def key_table(df: DataFrame, id_col: str, text_col: str, *carry: str) -> DataFrame:
    """(id, *carry, keys) of every text with a letter or digit; other rows are left out."""
    src = df.select(F.col(id_col), F.col(text_col).alias("__text"), *carry)
    fields = [src.schema[c] for c in (id_col, *carry)]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", " + KEYS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, rows = [], []
            for i, text in enumerate(b.column("__text").to_pylist()):
                if text and (row := key_row(form := visual_form(text), signs(form))):
                    kept.append(i)
                    rows.append(row)
            base = b.take(pa.array(kept, pa.int32()))
            cols = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 6)]
            yield pa.RecordBatch.from_arrays(
                [base.column(c) for c in (id_col, *carry)] + cols,
                names=[id_col, *carry, *_NAMES],
            )

    return src.mapInArrow(run, ddl)


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """40-bit hashes of all words of texts whose words have blanks between them, and each word's text:
    a sum over its bytes, by value and place, that is mixed."""
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    inside = data != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, n = edges[::2], edges[1::2] - edges[::2]
    if not len(n):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.cumsum(n) - n
    power = np.multiply.accumulate(np.full(n.max(), 0x9E3779B97F4A7C15, np.uint64))
    value = _BYTE_VALUES[data[inside]] * power[np.arange(n.sum()) - np.repeat(first, n)]
    ends = np.cumsum([len(t) + 1 for t in texts])
    return (_mixed(np.add.reduceat(value, first), 0xD1B54A32D192ED03) >> np.uint64(24)).astype(np.int64), np.searchsorted(ends, start, "right")


def _hashed(text: bytes) -> bytes:
    """The 128-bit hash and the check of `key_row`, as three longs, most significant byte first."""
    return xxhash.xxh3_128_digest(text) + xxhash.xxh64_digest(text, seed=7)


def _longs(hashes: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(hashes), ">i8").astype(np.int64).reshape(-1, 3)


def packed_words(flat: np.ndarray, n: np.ndarray) -> pa.Array:
    """A binary column with the 40-bit values of each row."""
    data = flat.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :_BYTES]
    offsets = np.r_[0, np.cumsum(n) * _BYTES].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def word_table(df: DataFrame, id_col: str, text_col: str, *carry: str, min_words: int = MIN_WORDS, all_rows: bool = False, packed: bool = False) -> DataFrame:
    """(id, *carry, keys, set_hi, set_lo, words) of every text with at least `min_words` words;
    with `all_rows` shorter texts stand in it too, their set columns null. `words` has the
    40-bit hashes of the distinct words, `packed` five bytes each in a binary column; set_hi/set_lo
    are the 128-bit hash of the set."""
    src = df.select(F.col(id_col), F.col(text_col).alias("__text"), *carry)
    fields = [src.schema[c] for c in (id_col, *carry)]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", {KEYS}, set_hi long, set_lo long, words {'binary' if packed else 'array<long>'}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, forms, texts = [], [], []
            for i, text in enumerate(b.column("__text").to_pylist()):
                if text:
                    form, found = word_bytes(text)
                    at.append(i)
                    forms.append(form)
                    texts.append(found)
            word, row = hashed_words(texts)
            count = np.bincount(row, minlength=len(texts))
            kept = np.flatnonzero(count >= (1 if all_rows else min_words))
            keys, aliases, records = [], [], []
            for k, i in enumerate(kept.tolist()):
                plain = texts[i].translate(None, b" ")
                record = word_record(forms[i])
                if record is None:
                    keys.append(_hashed(plain))
                else:
                    keys.append(_hashed(f"\x1d{record}".encode("utf-8", "surrogatepass")))
                    aliases.append(_hashed(plain))
                    records.append(k)
            base = b.take(pa.array(np.array(at, np.int32)[kept]))
            alias, none = np.zeros((len(kept), 3), np.int64), np.ones(len(kept), bool)
            alias[records], none[records] = _longs(aliases), False
            cols = [*map(pa.array, _longs(keys).T.copy()), *(pa.array(c, mask=none) for c in alias.T.copy())]
            # the distinct words of each row
            long = count >= min_words
            own = np.sort((row << 40 | word)[long[row]])
            own = own[np.r_[True, own[1:] != own[:-1]]] if len(own) else own
            flat, sizes = own & ((1 << 40) - 1), np.bincount(own >> 40, minlength=len(texts))[kept]
            full = sizes > 0
            for sum_ in set_hash(flat, sizes[full]):
                column = np.zeros(len(sizes), np.int64)
                column[full] = sum_
                cols.append(pa.array(column, mask=~full))
            if packed:
                cols.append(packed_words(flat, sizes))
            else:
                cols.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(flat), mask=pa.array(~full)))
            yield pa.RecordBatch.from_arrays(
                [base.column(c) for c in (id_col, *carry)] + cols,
                names=[id_col, *carry, *_NAMES, "set_hi", "set_lo", "words"],
            )

    return src.mapInArrow(run, ddl)


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mix of each value (the finalizer of the public splitmix64 generator)."""
    z = x.astype(np.uint64) + np.uint64(seed)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


#: A number for each byte, see `hashed_words`.
_BYTE_VALUES = _mixed(np.arange(256), 0x2545F4914F6CDD1D)


def set_hash(flat: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hash of each set, the sums of two mixes of its values, so their order is nothing."""
    if not len(n):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.cumsum(n) - n
    return tuple(np.add.reduceat(_mixed(flat, seed), start).view(np.int64) for seed in (0x9E3779B97F4A7C15, 0x3C6EF372FE94F82A))


def flat_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column without nulls, or of one from `packed_words`, and each row's length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_binary(column.type):
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].reshape(-1, _BYTES)
        out = np.zeros((len(data), 8), np.uint8)
        out[:, :_BYTES] = data
        return out.view("<i8").ravel(), np.diff(offsets).astype(np.int64) // _BYTES
    n = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy(zero_copy_only=False), n.astype(np.int64)


class WordOrder(NamedTuple):
    """Words from the rarest to the most frequent: `words` is sorted, `rank` counts from 1. A word that
    isn't listed has rank 0; if the list is `complete`, such a word can't link two sets. `most` is the
    number of sets with the most frequent word, `number` that of each word by rank, on the driver only."""

    words: np.ndarray
    rank: np.ndarray
    complete: bool
    most: int
    rare: int = 0
    number: np.ndarray | None = None

    def frequent(self, block: int) -> np.ndarray | None:
        """The words of more than `block` sets; None if there may be others that aren't listed."""
        if self.number is None or (not self.complete and not (self.number <= block).any()):
            return None
        return self.words[self.rank > np.searchsorted(self.number, block, "right")]

    def of(self, flat: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(flat), np.int64)
        at = np.minimum(np.searchsorted(self.words, flat), len(self.words) - 1)
        return np.where(self.words[at] == flat, self.rank[at], 0).astype(np.int64)


def distinct_sets(table: DataFrame, sided: bool = False) -> DataFrame:
    """(id, set_hi, set_lo, words) of every distinct word set of a staged `word_table`, staged; with
    `sided`, where the table has the boolean column held, also whether a row of each side has it
    (in_held, in_train). Equal sets are one row, told apart by all 128 bits of their hash.

    Sets that only one row has, as far as a fixed-size bitmap tells, needn't be gathered."""
    on = ["set_hi", "set_lo"]
    rows = table.filter("set_lo is not null")
    if sided:
        rows = rows.withColumn("in_held", F.col("held")).withColumn("in_train", ~F.col("held"))
    sides = ["in_held", "in_train"] if sided else []
    rows = rows.select(*on, *sides, "words")
    several = rows.groupBy(*on).agg(F.count("*").alias("n")).filter("n > 1")
    bits = key_filter(several.select("set_lo"))
    once = keep_by_filter(rows, "set_lo", bits, unset=True)
    again = keep_by_filter(rows, "set_lo", bits).groupBy(*on).agg(*(F.max(c).alias(c) for c in sides), F.any_value("words").alias("words"))
    return stage(once.unionByName(again).select(F.monotonically_increasing_id().alias("id"), *on, *sides, "words"), "sets")


def word_order(sets: DataFrame, sided: bool = False, most: int = MOST_WORDS, often: int = OFTEN) -> WordOrder:
    """The order of the words by the exact number of distinct sets that have them. Words that only one
    set has, or with `sided` only one side, aren't listed, since they link nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]
        size = 0

        def counted() -> Iterator[pa.RecordBatch]:
            for k, parts in enumerate(held):
                if parts:
                    word, n = np.unique(np.concatenate(parts), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(n * (1 - k)), pa.array(n * k)], names=["word", "n", "m"])
                    parts.clear()

        for b in batches:
            flat, n = flat_words(b.column("words"))
            if sided:
                for k, c in enumerate(("in_held", "in_train")):
                    held[k].append(flat[np.repeat(b.column(c).to_numpy(zero_copy_only=False), n)])
            else:
                held[0].append(flat)
            size += len(flat)
            if size > 4_000_000:
                yield from counted()
                size = 0
        yield from counted()

    columns = ["words", "in_held", "in_train"] if sided else ["words"]
    per = sets.select(*columns).mapInArrow(run, "word long, n long, m long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    per = per.filter("n > 0 and m > 0" if sided else "n > 1").select("word", (F.col("n") + F.col("m")).alias("n"))
    per = stage(per, "frequencies")
    listed, complete = per, True
    if per.count() > most:
        kind = F.floor(F.log2("n") * 16).cast("int")
        sizes = per.groupBy(kind.alias("kind")).count().collect()  # at most 1,024 classes
        room, least = most, 1 << 30
        for r in sorted(sizes, key=lambda r: -r["kind"]):
            room -= r["count"]
            if room < 0:
                break
            least = r["kind"]
        listed, complete = per.filter(kind >= least), False
    got = listed.toArrow()
    word, n = got["word"].to_numpy(), got["n"].to_numpy()
    rank = np.empty(len(word), np.int32)
    rank[np.lexsort((word, n))] = np.arange(1, len(word) + 1)
    order = np.argsort(word)
    return WordOrder(word[order], rank[order], complete, int(n.max(initial=0)), int((n < often).sum()), np.sort(n))


def key_filter(ids: DataFrame) -> np.ndarray:
    """Fixed-size bitmap of the low bits of a column of hashed longs. A row whose bit is unset has
    no partner; one whose bit is set may have one. The size doesn't depend on the number of ids."""
    bit = F.pmod(F.col(ids.columns[0]), F.lit(FILTER_BITS))
    got = (
        ids.select(F.shiftright(bit, 6).alias("at"), F.expr("shiftleft(1L, cast(" + f"pmod(`{ids.columns[0]}`, 64)" + " as int))").alias("bits"))
        .groupBy("at")
        .agg(F.bit_or("bits").alias("bits"))
        .toArrow()
    )
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[got["at"].to_numpy()] = got["bits"].to_numpy()
    return out


def keep_by_filter(table: DataFrame, column: str, bitmap: np.ndarray, unset: bool = False) -> DataFrame:
    """Rows whose bit in `key_filter` is set; every row that has a partner is among them. With `unset`
    the others."""
    shared = table.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in batches:
            v = b.column(column).to_numpy(zero_copy_only=False)
            bit = v % FILTER_BITS
            yield b.filter(pa.array((bits[bit >> 6] >> (bit & 63)) & 1 == (0 if unset else 1)))

    return table.mapInArrow(run, table.schema)


def keep_by_filters(table: DataFrame, bitmaps: dict[str, np.ndarray]) -> DataFrame:
    """Rows of which at least one of these columns isn't null and has its bit set in its `key_filter`."""
    shared = table.sparkSession.sparkContext.broadcast(bitmaps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = np.zeros(b.num_rows, bool)
            for c, bits in shared.value.items():
                bit = b.column(c).fill_null(0).to_numpy() % FILTER_BITS
                kept |= ((bits[bit >> 6] >> (bit & 63)) & 1 == 1) & b.column(c).is_valid().to_numpy(zero_copy_only=False)
            yield b.filter(pa.array(kept))

    return table.mapInArrow(run, table.schema)


def needed_overlap(total: np.ndarray) -> np.ndarray:
    """Least number of common words of two sets of `total` words together at the similarity."""
    a, b = SIMILARITY
    return -(-a * total // (a + b))


def least_after(n: np.ndarray) -> np.ndarray:
    """Least number of words of a set that stand at or after a word of its prefix."""
    a, b = SIMILARITY
    return -(-a * n // b)


class Prefixes(NamedTuple):
    """The rarest words of sets: the set's row, the word's place in the set's order and the word; and
    all words in that order, with where each row begins and ends among them."""

    row: np.ndarray
    place: np.ndarray
    word: np.ndarray
    ordered: np.ndarray
    start: np.ndarray
    end: np.ndarray


def prefixes(flat: np.ndarray, n: np.ndarray, order: WordOrder) -> Prefixes:
    """For each set as many of its rarest words as two sets of the wanted similarity can't both miss.
    Words are ordered by rank, those without one by 28 bits of their hash, then by all of it; the first
    two and the row fit into one number. Words that can't link two sets aren't returned."""
    row = np.repeat(np.arange(len(n)), n)
    rank, low = order.of(flat), flat & ((1 << 28) - 1)
    by = None
    if len(n) < 1 << 14:
        key = (row << 49) | (rank << 28) | low
        by = np.argsort(key)
        key = key[by]
        if (key[1:] == key[:-1]).any():
            by = None
    if by is None:
        by = np.lexsort((flat, low, rank, row))
    end = np.cumsum(n)
    start = end - n
    at = np.arange(len(flat)) - np.repeat(start, n)
    kept = at < np.repeat(n - least_after(n) + 1, n)
    if order.complete:
        kept &= rank[by] > 0
    ordered = flat[by]
    return Prefixes(row[kept], at[kept], ordered[kept], ordered, start, end)


def after(values: np.ndarray, p: Prefixes) -> np.ndarray:
    """Of each prefix word the exclusive or of the values of all words that stand after it in its set."""
    upto = np.zeros((len(values) + 1, *values.shape[1:]), values.dtype)
    np.bitwise_xor.accumulate(values, out=upto[1:])
    return upto[p.end[p.row]] ^ upto[p.start[p.row] + p.place + 1]


def following(p: Prefixes, n: np.ndarray, some: np.ndarray) -> pa.Array:
    """A binary column with 16 bits, the first 7 of them those of `bits`, of each word after the prefix
    words marked in `some` that can be one of the next two common words of two similar sets: the k-th
    common word is among the first n - least overlap + k of each."""
    a, b = SIMILARITY
    last = np.minimum(n - -(-a * n // b) + 2, n - 1)[p.row]
    count = np.where(some, last - p.place, 0)
    at = np.repeat(p.start[p.row] + p.place + 1 - (np.cumsum(count) - count), count) + np.arange(count.sum())
    data = ((p.ordered[at] >> 20) & 0xFFFF).astype(np.uint16)
    return pa.Array.from_buffers(pa.binary(), len(p.row), [None, pa.py_buffer(np.r_[0, np.cumsum(2 * count)].astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def sketches_after(p: Prefixes) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit parity sketches of the words after each prefix word."""
    return tuple(after(x, p) for x in bits(p.ordered))


def wide_sketches_after(p: Prefixes) -> np.ndarray:
    """The same of 512 bits, a row of eight numbers for each."""
    return np.stack([after(x, p) for x in _wide_bits(p.ordered)], 1) if len(p.row) else np.zeros((0, 8), np.uint64)


def sketches(flat: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit parity sketches of each set. A word in only one of two sets changes one bit of
    the pair at most, so their Hamming distance never exceeds the number of such words."""
    start = np.cumsum(n) - n
    return tuple(np.bitwise_xor.reduceat(x, start) for x in bits(flat))


def bits(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's bit in the two sketches."""
    one = np.uint64(1)
    bit = ((flat >> 20) & 127).astype(np.uint64)
    low = np.where(bit < 64, one << (bit & np.uint64(63)), np.uint64(0))
    high = np.where(bit >= 64, one << (bit & np.uint64(63)), np.uint64(0))
    return low, high


def _wide_bits(flat: np.ndarray) -> list[np.ndarray]:
    bit = (flat >> 11) & 511
    value = np.uint64(1) << (bit & 63).astype(np.uint64)
    return [np.where(bit >> 6 == k, value, np.uint64(0)) for k in range(8)]


#: Sets above this size have a second sketch of 512 bits, as the first one says little of them.
WIDE_FROM = 64


def wide_sketches(flat: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Parity sketches of 512 bits, a row of eight words for each set."""
    start = np.cumsum(n) - n
    return np.stack([np.bitwise_xor.reduceat(x, start) for x in _wide_bits(flat)], 1)


def packed_wide(wide: np.ndarray, owner: np.ndarray) -> pa.Array:
    """A binary column with the wide sketch of each owner, empty where it is -1."""
    has = owner >= 0
    offsets = np.r_[0, np.cumsum(has * 64)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(owner), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(wide[owner[has]]).tobytes())])


def unpacked_wide(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The wide sketches of a column and each row's line among them, or -1."""
    a = column.combine_chunks()
    a = a.chunk(0) if isinstance(a, pa.ChunkedArray) else a
    offsets = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1]
    has = np.diff(offsets) > 0
    data = np.frombuffer(a.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data.view(np.uint64).reshape(-1, 8) if has.any() else np.zeros((0, 8), np.uint64), np.where(has, np.cumsum(has) - 1, -1)


def wide_near(wide: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray, budget: np.ndarray) -> np.ndarray:
    """False for pairs whose wide sketches differ by more than the budget."""
    out = np.ones(len(i), bool)
    both = np.flatnonzero((at[i] >= 0) & (at[j] >= 0))
    for s in range(0, len(both), 1 << 16):
        k = both[s : s + (1 << 16)]
        out[k] = np.bitwise_count(wide[at[i[k]]] ^ wide[at[j[k]]]).sum(1) <= budget[k]
    return out


def difference_budget(total: np.ndarray) -> np.ndarray:
    """Most words that may stand in only one of two sets of `total` words together."""
    return total - 2 * needed_overlap(total)
