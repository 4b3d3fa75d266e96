"""Problems 1, 2, 3 and 5 against brute force over all pairs of rows."""

import itertools

import numpy as np
import pytest

from plumbline.llm import duplicates, lookalike, neardup, overlap, wordsets
from plumbline.llm.charform import record_key, signs, visual_form, words


@pytest.fixture(scope="module")
def truth(corpus_rows):
    forms = {i: visual_form(t) for i, t, *_ in corpus_rows if t and signs(visual_form(t))}
    keys = {i: (signs(f), record_key(f)) for i, f in forms.items()}
    plain_of_record = {p: r for p, r in keys.values() if r}
    same = {i: r or plain_of_record.get(p) or p for i, (p, r) in keys.items()}
    sets = {i: frozenset(words(f)) for i, f in forms.items() if len(words(f)) >= 15}
    near = set()
    for a, b in itertools.combinations(sorted(sets), 2):
        k = len(sets[a] & sets[b])
        if 10 * k >= 7 * (len(sets[a]) + len(sets[b]) - k) and same[a] != same[b]:
            near.add((a, b))
    return forms, same, near


def pairs(df):
    return [tuple(r) for r in df.collect()]


def test_copies(corpus, corpus_rows, truth):
    _, same, _ = truth
    groups = {}
    for i in sorted(same):
        groups.setdefault(same[i], []).append(i)
    want = {(g[0], x) for g in groups.values() for x in g[1:]}
    assert set(pairs(duplicates.copies(corpus))) == want
    assert set(pairs(duplicates.copies(corpus, hot_rows=3))) == want
    count = {r.first_row_id: r.copies for r in duplicates.collapsed(corpus).collect()}
    rows = [i for i, *_ in corpus_rows if i in same]
    assert sum(count.values()) == len(rows) and count.keys() == {g[0] for g in groups.values()}
    assert duplicates.collisions(corpus).first()["collisions"] == 0


@pytest.mark.parametrize("block", [neardup.BLOCK, 3])
def test_near_pairs(corpus, truth, block):
    assert set(pairs(neardup.near_pairs(corpus, block=block))) == truth[2]


def test_near_groups(corpus, truth):
    up = {}
    for a, b in sorted(truth[2]):
        for x in (a, b):
            up.setdefault(x, {x})
        merged = up[a] | up[b]
        for x in merged:
            up[x] = merged
    got = {r.row_id: r.group_id for r in neardup.groups(corpus).collect()}
    assert got == {x: min(g) for x, g in up.items()}


@pytest.mark.parametrize("block", [neardup.BLOCK, 3])
def test_overlaps(corpus, corpus_rows, truth, block):
    _, same, near = truth
    split = {i: (s or "").strip() for i, _, _, _, s in corpus_rows}
    want = set()
    for a, b in itertools.combinations(sorted(same), 2):
        sides = {split[a] == "train", split[b] == "train"}
        if sides == {True, False} and {split[a], split[b]} <= {"train", "validation", "test"} and ((a, b) in near or same[a] == same[b]):
            want.add((a, b))
    got = pairs(overlap.overlap_pairs(corpus, block=block))
    assert set(got) == want and len(got) == len(want)


def test_overlap_report(spark, corpus):
    dim = spark.createDataFrame([("plaza", None), ("lake", "Water "), ("Lake", "wet")], "name string, family string")
    got = overlap.overlap_report(corpus, dim).collect()
    assert {r.family for r in got if r.source == "lake"} == {"water", "wet"}
    assert all(r.overlapping_rows <= r.eval_rows for r in got) and {r.split for r in got} == {"validation", "test"}


def test_lookalike_pairs(corpus, corpus_rows, truth):
    forms = truth[0]
    text = {i: t for i, t, *_ in corpus_rows}
    want = {(a, b) for a, b in itertools.combinations(sorted(forms), 2) if forms[a] == forms[b] and text[a] != text[b]}
    assert set(pairs(lookalike.lookalike_pairs(corpus))) == want and want


def test_canonical_texts(spark, corpus, corpus_rows):
    got = sorted((r.row_id, r.form or "") for r in lookalike.canonical_texts(corpus).collect())
    assert [i for i, _ in got] == sorted(i for i, *_ in corpus_rows)
    rows = [(1, "Тhe pаrcel"), (2, "the parcel"), (3, "zоrkblatt"), (4, "zorkblаtt"), (5, "unsееn")]
    forms = {r.row_id: r.form for r in lookalike.canonical_texts(spark.createDataFrame(rows, "row_id long, text string")).collect()}
    assert forms[1] == "The parcel"  # in the vocabulary
    assert forms[3] == "zorkblatt"  # two spellings agree
    assert forms[5] == "unsееn"  # not in the vocabulary: left as it is


def test_empty(nothing, spark):
    dim = spark.createDataFrame([], "name string, family string")
    for df in (duplicates.copies(nothing), duplicates.collapsed(nothing), neardup.near_pairs(nothing), neardup.groups(nothing), overlap.overlap_pairs(nothing), overlap.overlap_report(nothing, dim), lookalike.lookalike_pairs(nothing), lookalike.canonical_texts(nothing)):
        assert df.collect() == []


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 40, rng.integers(1, 300))) for _ in range(60)]
    sets += [np.unique(np.r_[s[: len(s) // 2], rng.integers(0, 1 << 40, 5)]) for s in sets]
    flat, n = np.concatenate(sets), np.array([len(s) for s in sets])
    a, b = wordsets.sketches(flat, n)
    wide = wordsets.wide_sketches(flat, n)
    for i, j in itertools.combinations(range(len(sets)), 2):
        true = len(np.setxor1d(sets[i], sets[j]))
        assert int(np.bitwise_count(a[i] ^ a[j])) + int(np.bitwise_count(b[i] ^ b[j])) <= true
        assert int(np.bitwise_count(wide[i] ^ wide[j]).sum()) <= true


def test_trie_join_loses_nothing():
    """Random clusters: every pair in a group within budget is among the trie's pairs."""
    rng = np.random.default_rng(5)
    base = [np.unique(rng.integers(0, 1 << 40, rng.integers(15, 90))) for _ in range(25)]
    sets = []
    for s in base:
        for _ in range(12):
            kept = s[rng.random(len(s)) > 0.1]
            sets.append(np.unique(np.r_[kept, rng.integers(0, 1 << 40, rng.integers(0, 4))]))
    flat, n = np.concatenate(sets), np.array([len(s) for s in sets])
    a, b = wordsets.sketches(flat, n)
    group = np.zeros(len(n), np.int64)
    none = np.zeros(len(n), bool)
    parts = neardup.trie_pairs(group, none, none, a, b, n, np.zeros(len(n), np.int64), np.zeros((0, 8), np.uint64), np.full(len(n), -1))
    got = {(min(x, y), max(x, y)) for i, j in parts for x, y in zip(i.tolist(), j.tolist())}
    for x, y in itertools.combinations(range(len(sets)), 2):
        k = len(np.intersect1d(sets[x], sets[y]))
        if 10 * k >= 7 * (len(sets[x]) + len(sets[y]) - k):
            assert (x, y) in got
