"""Sets of a frequent word, brought together by the words after it."""

import random

import numpy as np
import pyarrow as pa

from plumbline.llm import overlap
from plumbline.llm import wordsets as ws


def _postings(sets, held):
    words = [np.array(sorted(s), np.int64) for s in sets]
    flat, n = np.concatenate(words), np.array([len(w) for w in words])
    word, count = np.unique(flat, return_counts=True)
    rank = np.empty(len(word), np.int32)
    rank[np.lexsort((word, count))] = np.arange(1, len(word) + 1)
    p = ws.prefixes(flat, n, ws.WordOrder(word, rank, False, int(count.max())))
    low, high = ws.sketches_after(p)
    meta = (n[p.row] << 32) | (p.place << 8) | np.where(np.array(held)[p.row], 4, 0)
    t = pa.table({"word": p.word, "id": p.row, "sketch_a": low.view(np.int64), "sketch_b": high.view(np.int64), "wide": ws.packed_wide(np.zeros((0, 8), np.uint64), np.full(len(p.row), -1)), "meta": meta, "next": ws.following(p, n, np.ones(len(p.row), bool))})
    return t.sort_by("word").combine_chunks()


def _similar(sets, held):
    return {(i, j) for i, s in enumerate(sets) if held[i] for j, t in enumerate(sets) if not held[j] and 10 * len(s & t) >= 7 * len(s | t)}


def _found(posts, work):
    return {(i, j) for b in overlap._join(posts, work) for i, j in zip(b["id_a"].to_pylist(), b["id_b"].to_pylist())}


def test_no_pair_is_lost():
    rng = random.Random(5)
    words = [rng.getrandbits(40) for _ in range(60)]
    sets = [set(rng.sample(words, rng.choice([1, 2, 3, 4, 9, 20, 30]))) for _ in range(150)]
    for s in list(sets):
        for _ in range(3):
            t = set(s)
            for _ in range(rng.randrange(5)):
                t ^= {rng.choice(words)}
            sets.append(t or s)
    held = [rng.random() < 0.3 for _ in sets]
    want, posts = _similar(sets, held), _postings(sets, held)
    assert want
    for work in (1 << 60, 50, 0):
        assert not want - _found(posts, work)


def test_sets_of_frequent_words_are_seldom_compared(monkeypatch):
    rng = random.Random(6)
    words = [rng.getrandbits(40) for _ in range(300)]
    sets = [set(rng.sample(words, 20)) for _ in range(3000)]
    sets += [s ^ {rng.choice(words)} for s in sets[:50]]
    held = [k % 4 == 0 for k in range(3000)] + [k % 4 > 0 for k in range(50)]
    want, posts = _similar(sets, held), _postings(sets, held)
    pairs, probe = [], overlap.probe

    def counted(**c):
        pairs.append(int((np.bincount(c["group"], c["held"]) * np.bincount(c["group"], ~c["held"])).sum()))
        return probe(**c)

    monkeypatch.setattr(overlap, "probe", counted)
    assert not want - _found(posts, 1 << 60)
    before = sum(pairs)
    pairs.clear()
    assert not want - _found(posts, 100)
    assert sum(pairs) * 3 < before
