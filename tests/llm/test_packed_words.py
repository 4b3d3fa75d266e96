"""Words taken from bytes and kept as bytes, and how often overlaps read the table of all rows."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa

from plumbline.llm import neardup, overlap
from plumbline.llm import wordsets as ws
from plumbline.llm.charform import PAGE, visual_form, word_bytes, word_record, words


def test_words_in_bytes_are_the_same_words(corpus_rows):
    rng = random.Random(4)
    page = [bytes([i]).decode(PAGE) for i in range(256) if i not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
    signs = page + list("еаοｅ​‍́\u0085ſ😀½ﬁ")
    texts = [t for _, t, *_ in corpus_rows if t] + ["".join(rng.choice(p) for _ in range(rng.randrange(1, 14))) for p in (page, signs) * 2000 if p]
    texts += ["a: 1; b: 2", '{"a": "x", "é": 2}', "Größe: ß\nµ: 2", "ŠŸŒ ƒ µ ª²"]
    for t in texts:
        form, found = word_bytes(t)
        look = visual_form(t)
        assert (form if isinstance(form, str) else form.decode(PAGE)) == look, repr(t)
        assert [w for w in found.decode("utf-8", "surrogatepass").split(" ") if w] == words(look), repr(t)
    assert word_record(b"a: 1; b: 2") == word_record("a: 1; b: 2") and word_record(b"a 1; b 2") is None


def test_word_hashes_are_of_words():
    texts = ["eins zwei drei", "", "zwei eins", "aa a aaa", "ab ba", "é e", ""]
    word, row = ws.hashed_words([t.encode() for t in texts])
    named = [(w, k) for k, t in enumerate(texts) for w in t.split()]
    assert row.tolist() == [k for _, k in named]
    assert len(set(word.tolist())) == len({w for w, _ in named}) == len(set(zip(word.tolist(), (w for w, _ in named))))
    assert 0 <= word.min() and word.max() < 1 << 40
    assert not len(ws.hashed_words([])[0]) and not len(ws.hashed_words([b"", b""])[0])


def test_packed_words_come_back():
    flat, n = np.array([0, 1, (1 << 40) - 1, 7 << 33, 5]), np.array([2, 0, 3])
    for column in (ws.packed_words(flat, n), pa.concat_arrays([ws.packed_words(flat[:1], n[:0]), ws.packed_words(np.r_[9, flat], np.r_[1, n])]).slice(1)):
        got, m = ws.flat_words(column)
        assert got.tolist() == flat.tolist() and m.tolist() == n.tolist()


def test_hot_words_by_sets_of_frequent_words(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(400):
        hot = rng.permutation(30)[: 24 if k % 2 else 5]
        rows.append((k, " ".join(f"h{x}" for x in hot) + " " + " ".join(f"r{rng.integers(500)}" for _ in range(6 if k % 2 else 20))))
    df = spark.createDataFrame(rows, "row_id long, text string").repartition(3)
    sets = ws.distinct_sets(neardup._texts(df, "row_id", "text"))
    order = ws.word_order(sets)
    want = Counter()
    for r in sets.collect():
        flat = np.array(r.words, np.int64)
        want.update(ws.prefixes(flat, np.array([len(flat)]), order).word.tolist())
    for block in (3, 20, 60):
        got = neardup.hot_words(sets, order, block)
        assert {r.word: r.blocks for r in got.collect()} == {w: -(-n // block) for w, n in want.items() if n > block}
    assert len(order.frequent(60)) < 60 < len(order.words)


def test_result_doesnt_read_the_table_of_all_rows_again(corpus):
    """The rows of overlaps are picked in one pass; it was four, with the words of all rows beside them."""
    files = overlap.overlap_pairs(corpus).inputFiles()
    assert files and not any("/sides-" in f for f in files)
