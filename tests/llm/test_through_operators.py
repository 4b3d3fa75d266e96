"""What p6_found and p8_found report comes from the drawn sample and mixture; sentence families held out."""

import random

from plumbline.llm import mixing, pii, pii_training, quota_sample
from test_splits_and_samples import _tables


def test_reached_by_the_draw(spark):
    _, corpus, targets, dim, hygiene = _tables(spark)
    for size in (10, 1000, 2500, 100000):
        table = quota_sample.allocation(corpus, targets, dim, hygiene, size)
        got = quota_sample.reached(corpus, table).collect()
        assert {(r.source, r.label) for r in got if r.unmet} == {(r.source, r.label) for r in table.collect() if r.short}
        assert all(r.drawn == r.quota for r in got)


def test_short_sources_through_the_mixture(spark):
    rng = random.Random(6)
    rows = [(k, rng.choice("aaaabbc"), rng.choice([3, 50, 700])) for k in range(900)] + [(2000, "tiny", 40)]
    tokens = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    weights = spark.createDataFrame([("a", 0.4, 1), ("b", 0.3, 4), ("c", 0.2999, 1), ("tiny", 0.0001, 1)], "source string, weight double, max_repeats int")
    for size in (1000, 100000, 10**7):
        plan = mixing.apportion(tokens, weights, size)
        got = {r.source for r in mixing.short_sources(tokens, plan, size).collect()}
        assert got == {r.source for r in plan.collect() if r.short}
        quotas = mixing.shard_quotas(tokens, plan).collect()
        for r in plan.collect():
            mine = [q for q in quotas if q.source == r.source]
            assert sum(q.part for q in mine) == r.blocks and all(q.part <= q.whole * r.max_repeats for q in mine)
        report = {r.source: r for r in mixing.mixture_report(tokens, plan).collect()}
        assert all(0 <= report[s].used_tokens - report[s].blocks < 700 for s in report)
        again = mixing.mixture(tokens.repartition(5), plan)
        assert sorted(again.collect()) == sorted(mixing.mixture(tokens, plan).collect())


def test_stretches_are_drawn_by_seed(spark):
    tokens = spark.range(4000).selectExpr("id as doc_id", "'a' as source", "10 + id % 90 as tokens")
    plan = mixing.apportion(tokens, spark.createDataFrame([("a", 1.0, 1)], "source string, weight double, max_repeats int"), 50000)
    one, two = ({r.doc_id for r in mixing.mixture(tokens, plan, seed=s, stretch=500).collect()} for s in (1, 2))
    assert one != two and len(one & two) < 0.7 * len(one)


def test_whole_families_held_out():
    given, family = ["Brimira", "Calmira", "Dormira", "Brithas", "Calthas", "Dorthas", "Robin", "Reed"], ["Lundaker", "Kervaker", "Ostaker", "Lundquist", "Kervquist", "Ostquist", "Stone"]
    words = ["robin", "reed", "stone"]
    names = pii.Names(set(given), set(family), dict.fromkeys(words, 0.9))
    held = ["mails", "homes", "german", "signing"]
    lists = (given, family, words, list(names.heads), list(names.tails))
    model = pii.Model(names).fit(pii_training.examples(*lists, 5000, families=[f for f in pii_training.FAMILIES if f not in held]))
    right = said = true = 0
    for text, truth in pii_training.examples(*lists, 800, seed=5, families=held):
        got = set(model.segments(text))
        right, said, true = right + len(got & truth), said + len(got), true + len(truth)
    assert right / said > 0.8 and right / true > 0.8, (right, said, true)
