"""Whether a repair is accepted by the vocabulary decides how a text is written, never which texts are equal."""

import itertools
import random

from plumbline.llm import lookalike
from plumbline.llm.charform import LATIN_TWINS, visual_form

WORDS = "harbour coat peace exact тропа наука Ποταμος οικος mixed Copper Ave".split()


def test_equality_is_that_of_the_visual_form(spark):
    rng = random.Random(8)
    back = {}
    for twins in LATIN_TWINS.values():
        for c, p in twins.items():
            back.setdefault(p, []).append(c)
            back.setdefault(c, []).append(p)
    rows = []
    for k in range(400):
        text = " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 3)))
        out = "".join(rng.choice(back[c]) if c in back and rng.random() < 0.25 else c for c in text)
        rows.append((k, out if rng.random() > 0.1 else out.replace(" ", " ")))
    df = spark.createDataFrame(rows, "row_id long, text string").repartition(4)
    got = {tuple(r) for r in lookalike.lookalike_pairs(df).collect()}
    forms = {k: visual_form(t) for k, t in rows}
    want = {(a, b) for a, b in itertools.combinations(range(400), 2) if forms[a] == forms[b] and rows[a][1] != rows[b][1]}
    assert got == want and len(want) > 50
    written = {r.row_id: r.form for r in lookalike.canonical_texts(df).collect()}
    groups = {}
    for k, form in forms.items():
        groups.setdefault(form, set()).add(written[k])
    assert all(len(g) == 1 for g in groups.values())
