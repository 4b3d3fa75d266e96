import itertools
import math
import random

import pytest

from plumbline.llm import pii, pii_training

GIVEN = ["Brimira", "Calmira", "Dormira", "Brithas", "Calthas", "Dorthas", "Robin", "Reed", "Zoëlle"]
FAMILY = ["Lundaker", "Kervaker", "Ostaker", "Lundquist", "Kervquist", "Ostquist", "Stone", "Winter"]


@pytest.fixture(scope="module")
def model():
    names = pii.Names(set(GIVEN), set(FAMILY), {"robin": 0.9, "reed": 0.9, "stone": 0.9, "winter": 0.95})
    return pii.Model(names).fit(pii_training.examples(GIVEN, FAMILY, ["robin", "reed", "stone", "winter"], list(names.heads), list(names.tails), 4000))


def found(model, text):
    return [(k, text[a:b]) for a, b, k in model.segments(text)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("You can write to brimira.stone@mail.example any time.", [("email", "brimira.stone@mail.example")]),
        ("ping calthas77 [at] corvid [dot] test about it", [("email", "calthas77 [at] corvid [dot] test")]),
        ("Contact: dorthas at post dot example dot org", [("email", "dorthas at post dot example dot org")]),
        ("Call me on +44 7700 900651 after the memo.", [("phone", "+44 7700 900651")]),
        ("Her number is five five five zero one eight six and she never answers.", [("phone", "five five five zero one eight six")]),
        ("tel +1 555 555 0153 ext. 84", [("phone", "+1 555 555 0153 ext. 84")]),
        ("My social is QQ 76 41 93 A, is that enough?", [("id_number", "QQ 76 41 93 A")]),
        ("See ticket 530606176 and thread #147942.", []),
        ("Address: 6/2 Heron Way, Galubel\nAfter the baseline", [("address", "6/2 Heron Way, Galubel")]),
        ("Lane 4 and road 4 are closed for 189 days.", []),
        ("Regards,\nCalmira Kervquist", [("name", "Calmira Kervquist")]),
        ("thanks to Lundaker, Dormira for the lamp", [("name", "Lundaker, Dormira")]),
        ("A reed by the stone, a robin in the marsh, and 77 rules.", []),
        ("mail at noon, dot the i, then read the book", []),
    ],
)
def test_examples(model, text, want):
    assert found(model, text) == want


def test_held_out(model):
    n = model.names
    right = said = true = 0
    for text, truth in pii_training.examples(GIVEN, FAMILY, ["robin", "reed", "stone", "winter"], list(n.heads), list(n.tails), 800, seed=77):
        got = set(model.segments(text))
        right, said, true = right + len(got & truth), said + len(got), true + len(truth)
    assert right / said > 0.97 and right / true > 0.97


def test_marginals_and_best_against_all_segmentations():
    rng = random.Random(1)
    model = pii.Model(pii.Names(set(), set(), {}))
    for _ in range(30):
        spans = sorted({(a, a + rng.randint(1, 4)) for a in (rng.randrange(12) for _ in range(7))}, key=lambda s: s[1])
        spans = [(a, b, "name", [f"f{k}"]) for k, (a, b) in enumerate(spans)]
        model.weights = {f"f{k}": rng.uniform(-2, 2) for k in range(len(spans))}
        total, each = 0.0, [0.0] * len(spans)
        for chosen in itertools.product([0, 1], repeat=len(spans)):
            used = sorted(s[:2] for s, c in zip(spans, chosen) if c)
            if any(x[1] > y[0] for x, y in zip(used, used[1:])):
                continue
            p = math.exp(sum(model.weights[f"f{k}"] for k, c in enumerate(chosen) if c))
            total += p
            each = [e + p * c for e, c in zip(each, chosen)]
        assert model._marginals(spans) == pytest.approx([e / total for e in each])


def test_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "  "), (4, "Dr. Stone signed. Write to a.b@mail.example"), (4, "Dr. Stone signed."), (5, "word " * 20000 + "tel 555-0101")], "doc_id long, text string").selectExpr("*", "1 as kind")
    names = spark.createDataFrame([(n, "given") for n in GIVEN] + [(n, "family") for n in FAMILY] + [(None, "given"), ("Odd", None)], "name_part string, part_kind string")
    got = {tuple(r) for r in pii.personal_data(docs, names).collect()}
    assert got == {(4, "email", "a.b@mail.example"), (4, "name", "Stone"), (5, "phone", "555-0101")}
    masked = sorted((r.doc_id, r.text or "") for r in pii.masked(docs, names).collect())
    assert (4, "Dr. [NAME] signed. Write to [EMAIL]") in masked and len(masked) == 6
    assert pii.personal_data(docs.filter("false"), names).collect() == []
    assert pii.personal_data(docs.filter("doc_id < 4"), names.filter("false")).collect() == []
