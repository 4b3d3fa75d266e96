"""Exact word frequencies over distinct sets, hot words in blocks, the trie's budget, and counts without pairs."""

import itertools
from collections import Counter

import numpy as np

from plumbline.llm import neardup, overlap
from plumbline.llm import wordsets as ws
from test_pairs import truth  # noqa: F401


def _sets(spark, rows, seed=1, words=3000):
    rng = np.random.default_rng(seed)
    texts = [" ".join(f"w{k}" for k in (rng.zipf(1.3, 40) % words)) + " " + " ".join(f"u{rng.integers(words)}" for _ in range(12)) for _ in range(rows)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts + texts[: rows // 2])], "row_id long, text string").repartition(6)
    return ws.distinct_sets(neardup._texts(df, "row_id", "text"))


def test_sets_are_distinct_and_counts_exact(spark, corpus):
    table = neardup._texts(corpus, "row_id", "text")
    sets = ws.distinct_sets(table).collect()
    assert len({(r.set_hi, r.set_lo) for r in sets}) == len(sets) == table.select("set_hi", "set_lo").distinct().count()
    assert len({r.id for r in sets}) == len(sets)
    n = Counter(w for r in sets for w in r.words)
    order = ws.word_order(ws.distinct_sets(table))
    assert order.complete and order.words.tolist() == sorted(w for w, k in n.items() if k > 1) and order.most == max(n.values())
    by_rank = [n[w] for w in order.words[np.argsort(order.rank)].tolist()]
    assert by_rank == sorted(by_rank)


def test_a_short_list_of_words_loses_no_pair(spark, corpus):
    sets = ws.distinct_sets(neardup._texts(corpus, "row_id", "text"))
    want = None
    for most in (1 << 20, 5, 0):
        order = ws.word_order(sets, most=most)
        assert len(order.words) <= most
        got = set(map(tuple, neardup.verified(neardup.candidate_classes(neardup.postings(sets, order)), sets).collect()))
        want = want or got
        assert got == want


def test_postings_of_a_set_dont_grow_with_the_rows(spark):
    per = []
    for rows in (300, 3000):
        sets = _sets(spark, rows)
        order = ws.word_order(sets, most=200)
        posts = neardup.in_blocks(neardup.postings(sets, order), neardup.hot_words(sets, order, 1000))
        assert rows == sets.count()
        per.append(posts.count() / rows)
    assert per[1] < per[0] * 1.1, per


def test_budget_prunes_the_trie():
    """A group of unrelated sets with places as a prefix filter gives them."""
    rng = np.random.default_rng(2)
    count = 4000
    n = np.clip(rng.normal(39, 10, count).astype(int), 15, 90)
    place = (rng.random(count) * (n - -(-7 * n // 10) + 1)).astype(int)
    flat = rng.integers(0, 1 << 40, (n - place - 1).sum())
    a, b = ws.sketches(flat, n - place - 1)
    none = np.zeros(count, bool)
    tally = Counter()
    for _ in neardup.trie_pairs(np.zeros(count, int), none, none, a, b, n, place, np.zeros((0, 8), np.uint64), np.full(count, -1), tally):
        pass
    # places spread evenly; of the texts of the test tables, whose hot words stand late, more
    assert tally["ruled_out"] > 0.3 * count * (count - 1) / 2, tally


def test_counts_equal_pairs(corpus):
    pairs = Counter(r.eval_id for r in overlap.overlaps(corpus).collect())
    assert {r.eval_id: r.pairs for r in overlap.overlap_counts(corpus).collect()} == dict(pairs)


def test_membership_has_every_row(corpus, corpus_rows, truth):  # noqa: F811
    _, same, near = truth
    links = Counter(x for p in near for x in p)
    got = neardup.membership(corpus).collect()
    assert sorted(r.row_id for r in got) == sorted({i for i, *_ in corpus_rows})
    assert {r.row_id: r.links for r in got if r.links} == dict(links)
    first = {}
    for i in sorted(same):
        first.setdefault(same[i], i)
    for r in got:
        if not r.links:
            assert r.group_id == (first[same[r.row_id]] if r.row_id in same else r.row_id)
    of = {r.row_id: r.group_id for r in got}
    assert all(of[a] == of[b] for a, b in near)
    assert all(of[g] == g for g in of.values()) and len(list(itertools.groupby(sorted(of.values())))) > 3
