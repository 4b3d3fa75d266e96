import random

from plumbline.llm import mixing


def test_highest_quotients_equal_a_list_of_all():
    rng = random.Random(4)
    for _ in range(300):
        names = [f"s{k}" for k in range(rng.randint(1, 8))]
        weights = {k: rng.choice([0.0, 0.5, 0.25, rng.random(), rng.random() / 100]) for k in names}
        room = {k: rng.choice([0, 1, 7, rng.randint(0, 60), 500]) for k in names}
        total = rng.randint(0, 300)
        every = sorted((-weights[k] / (2 * n - 1), k) for k in names if weights[k] > 0 for n in range(1, room[k] + 1))[:total]
        want = {k: sum(x == k for _, x in every) for k in names}
        got = mixing.highest_quotients(weights, room, total)
        assert {k: got.get(k, 0) for k in names} == want, (weights, room, total)
    big = mixing.highest_quotients({"a": 0.75, "b": 0.25}, {"a": 10**15, "b": 10**15}, 10**12)
    assert big == {"a": 3 * 10**12 // 4, "b": 10**12 // 4}


def test_small_and_short_sources_have_their_part(spark):
    rows = [(k, "large", 100) for k in range(3000)] + [(5000 + k, "small", 10) for k in range(40)] + [(6000 + k, "short", 7) for k in range(50)]
    tokens = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    weights = spark.createDataFrame([("large", 0.7895, 1), ("small", 0.0005, 1), ("short", 0.21, 3)], "source string, weight double, max_repeats int")
    plan = mixing.apportion(tokens, weights, 200000)
    report = {r.source: r for r in mixing.mixture_report(tokens, plan).collect()}
    # `small` is wanted with 100 tokens, as the block once was, and as much again of what `short` leaves
    assert 100 <= report["small"].used_tokens <= 140 and not report["small"].short
    assert report["short"].short and report["short"].used_tokens == 50 * 7 * 3
    assert abs(report["large"].used_tokens - report["large"].blocks) < 100 and sum(r.blocks for r in report.values()) == 200000
