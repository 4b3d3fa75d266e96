"""Problem 5: one form for texts that look the same.

Widths, styles, compositions, kinds of blank and invisible characters are decided by a character
alone. Look-alike letters are repaired by script: the dominant script of each token is found, and
only in a token that mixes scripts are look-alikes put back, and only if the result exists in the
vocabulary of the corpus. The vocabulary is that of all texts, plus results on which two different
spellings agree. It is never gathered: a fixed-size bitmap of the proposed results goes to the
tasks, which send on only the words that may be among them, for an exact join.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import wordsets as ws
from plumbline.llm.charform import apply_repairs, plain_look, repairs, words
from plumbline.plans.staging import stage

_REPAIR = pa.list_(pa.struct([("token", pa.string()), ("repair", pa.string()), ("spelling", pa.string()), ("word", pa.string()), ("word_hash", pa.int64())]))
_DDL = "row_id long, raw_hi long, raw_lo long, form_hi long, form_lo long, form string, looks string, found array<struct<token:string,repair:string,spelling:string,word:string,word_hash:long>>"


def _word_hash(word: str) -> int:
    x = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
    return x - (1 << 64) if x >> 63 else x


def _proposals(df: DataFrame, with_form: bool) -> DataFrame:
    """Per text its hash and that of its form; for texts with proposed repairs, instead of the
    form, the text's plain look and the proposals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for row_id, text in zip(b.column("row_id").to_pylist(), b.column("text").to_pylist()):
                if text is None:
                    continue
                raw = ws.hash128(text)
                looks = plain_look(text)
                got = {} if looks.isascii() else repairs(looks)
                if got:
                    found = []
                    for token, repair in got.items():
                        word = "".join(words(repair))
                        found.append({"token": token, "repair": repair, "spelling": "".join(words(token)), "word": word, "word_hash": _word_hash(word)})
                    rows.append((row_id, *raw, None, None, None, looks, found))
                else:
                    form = apply_repairs(looks, got)
                    rows.append((row_id, *raw, *(raw if form == text else ws.hash128(form)), form if with_form else None, None, None))
            cols = list(zip(*rows)) if rows else [[]] * 8
            types = [pa.int64()] * 5 + [pa.string(), pa.string(), _REPAIR]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["row_id", "raw_hi", "raw_lo", "form_hi", "form_lo", "form", "looks", "found"])

    return df.select("row_id", "text").mapInArrow(run, _DDL)


def _vocabulary(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """Those of the wanted words (word, word_hash) that occur in some text."""
    shared = df.sparkSession.sparkContext.broadcast(ws.key_filter(wanted.select("word_hash")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = shared.value, set()
        for b in batches:
            own: set[str] = set()
            for text in b.column("text").to_pylist():
                if text:
                    own.update(words(plain_look(text)))
            own -= seen
            if len(seen) > 500_000:  # words met again cost room, not results
                seen.clear()
            seen |= own
            out = []
            for w in own:
                bit = _word_hash(w) % ws.FILTER_BITS
                if (int(bits[bit >> 6]) >> (bit & 63)) & 1:
                    out.append(w)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["word"])

    return df.select("text").mapInArrow(run, "word string").join(wanted.select("word"), "word", "left_semi").distinct()


def _repaired(df: DataFrame, mixed: DataFrame, with_form: bool) -> DataFrame:
    """(row_id, raw_hi, raw_lo, form_hi, form_lo, form) of the texts with proposals."""
    each = mixed.select("row_id", "raw_hi", "raw_lo", F.explode("found").alias("f")).select("row_id", "raw_hi", "raw_lo", "f.*")
    wanted = each.groupBy("word", "word_hash").agg((F.min("spelling") != F.max("spelling")).alias("agreed"))
    wanted = stage(wanted, "proposals")
    accepted = _vocabulary(df, wanted.filter("not agreed")).unionByName(wanted.filter("agreed").select("word"))
    made = (
        each.join(accepted, "word")
        .groupBy("row_id", "raw_hi", "raw_lo")
        .agg(F.map_from_entries(F.collect_set(F.struct("token", "repair"))).alias("made"))
    )
    ready = mixed.select("row_id", "raw_hi", "raw_lo", "looks").join(made, ["row_id", "raw_hi", "raw_lo"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            forms = [apply_repairs(x, dict(m or ())) for x, m in zip(b.column("looks").to_pylist(), b.column("made").to_pylist())]
            hashes = [ws.hash128(f) for f in forms]
            cols = [b.column(c) for c in ("row_id", "raw_hi", "raw_lo")]
            cols += [pa.array([h[k] for h in hashes], pa.int64()) for k in (0, 1)]
            cols.append(pa.array(forms if with_form else [None] * len(forms), pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=["row_id", "raw_hi", "raw_lo", "form_hi", "form_lo", "form"])

    return ready.mapInArrow(run, "row_id long, raw_hi long, raw_lo long, form_hi long, form_lo long, form string")


def _source(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).cast("string").alias("text"))


def canonical_texts(df: DataFrame, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """(row_id, form): every text in its consistent form. A null text has a null form and an empty
    one an empty form; an empty table gives no rows; a repeated row is kept as often as it occurs."""
    src = _source(df, id_col, text_col)
    mixed = stage(_proposals(src, False).filter("looks is not null").select("row_id", "raw_hi", "raw_lo", "looks", "found"), "mixed")
    clean = _proposals(src, True).filter("looks is null").select("row_id", "form")
    nulls = src.filter("text is null").select("row_id", F.lit(None).cast("string").alias("form"))
    return clean.unionByName(_repaired(src, mixed, True).select("row_id", "form")).unionByName(nulls)


def lookalike_pairs(df: DataFrame, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """(row_id_a, row_id_b), a < b: different strings with the same form. Null texts and texts
    without a letter or digit are in no pair. Copies of one string aren't paired with each other:
    the variants of a form are paired first, then each pair is expanded to its rows."""
    src = _source(df, id_col, text_col).filter(F.col("text").rlike("[\\p{L}\\p{N}]"))
    done = stage(_proposals(src, False), "forms")
    mixed = done.filter("looks is not null")
    names = ["row_id", "raw_hi", "raw_lo", "form_hi", "form_lo"]
    rows = done.filter("looks is null").select(*names).unionByName(_repaired(src, mixed, False).select(*names))
    rows = stage(rows, "rows")
    form = ["form_hi", "form_lo"]
    several = rows.groupBy(*form).agg((F.min(F.struct("raw_hi", "raw_lo")) != F.max(F.struct("raw_hi", "raw_lo"))).alias("several")).filter("several").select(*form)
    rows = ws.keep_by_filter(rows, "form_lo", ws.key_filter(several.select("form_lo"))).join(several, form, "left_semi")
    rows = stage(rows, "variants")
    variants = rows.select(*form, "raw_hi", "raw_lo").distinct()
    pairs = variants.toDF(*form, "hi_a", "lo_a").join(variants.toDF(*form, "hi_b", "lo_b"), form).filter("struct(hi_a, lo_a) < struct(hi_b, lo_b)").drop(*form)
    raw = rows.select("row_id", "raw_hi", "raw_lo")
    out = pairs.join(raw.toDF("id_a", "hi_a", "lo_a"), ["hi_a", "lo_a"]).join(raw.toDF("id_b", "hi_b", "lo_b"), ["hi_b", "lo_b"])
    return out.filter("id_a <> id_b").select(F.least("id_a", "id_b").alias("row_id_a"), F.greatest("id_a", "id_b").alias("row_id_b"))
