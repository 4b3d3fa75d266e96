import random

import pytest

from plumbline.llm import mixing, quota_sample, splits

DIM = [("plaza", "town"), ("lake", None), ("hill", "lake"), ("lake ", "water"), ("far", "  "), ("Plaza", "Water"), (None, "town"), ("lone", "")]


@pytest.fixture(scope="module")
def dim(spark):
    return spark.createDataFrame(DIM, "name string, family string").selectExpr("*", "1 as label", "2 as a")


def test_related_sources(dim):
    got = {tuple(r) for r in splits.related_sources(dim).collect()}
    assert got == {("hill", "lake"), ("hill", "plaza"), ("lake", "plaza")}


@pytest.mark.parametrize("small", [10**6, 3])
def test_components(spark, small):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(900, k) for k in range(901, 960)] + [(5, 5), (None, 3)] + [(k, k + 1) for k in range(1000, 1060)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    got = {r.node: r.label for r in splits.components(spark.createDataFrame(edges, "x long, y long"), small).collect()}
    assert got == {x: root(x) for x in up}


def test_assign_splits(spark, corpus, corpus_rows, dim, nothing):
    percents = {"train": 80, "validation": 10, "test": 10}
    got = splits.assign_splits(corpus, dim, percents).collect()
    assert len(got) == len(corpus_rows)
    of = {}
    source = {i: (s or "").strip().lower() for i, _, _, s, _ in corpus_rows}
    for r in got:
        if source[r.row_id]:
            of.setdefault(source[r.row_id], set()).add(r.split)
    assert all(len(x) == 1 for x in of.values()) and of["plaza"] == of["lake"] == of["hill"]
    assert splits.assign_splits(nothing, dim, percents).collect() == []
    many = spark.range(20000).selectExpr("id as row_id", "concat('s', id % 3000) as source")
    share = {r["split"]: r["count"] / 20000 for r in splits.assign_splits(many, dim, percents).groupBy("split").count().collect()}
    assert abs(share["train"] - 0.8) < 0.02 and abs(share["test"] - 0.1) < 0.02


def _tables(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice(["a", "a", "a", "a ", "B", "c", None]), rng.choice([0, 1, 1, None, -1])) for k in range(3000)]
    corpus = spark.createDataFrame(rows, "row_id long, source string, label int").selectExpr("*", "7 as quota", "8 as turn")
    targets = spark.createDataFrame(
        [("a", 0, 0.2, 1), ("a", 1, 0.2, 1), ("b", 0, 0.3, 5), ("b", 1, 0.1, 1), ("c", 0, 0.05, 100), ("c", 1, 0.1, 0), ("none", 1, 0.05, 3)],
        "source string, label int, target_share double, min_rows int",
    )
    dim = spark.createDataFrame([("a", "f"), ("b", "f"), ("c", None)], "name string, family string")
    hygiene = spark.createDataFrame([(1, "2026-01-01 00:00:00", 1, "A", 9, 8), (2, "2026-01-02 00:00:00", 1, "a", 4, None), (2, "2026-01-02 00:00:00", 1, "a", 4, None), (3, None, 2, "a", 1, 1)], "run_id long, run_ts string, batch_id int, source string, pos long, neg long").selectExpr("run_id", "cast(run_ts as timestamp) run_ts", "batch_id", "source", "pos", "neg")
    return rows, corpus, targets, dim, hygiene


def test_allocation_and_draw(spark):
    rows, corpus, targets, dim, hygiene = _tables(spark)
    table = quota_sample.allocation(corpus, targets, dim, hygiene, 1000)
    got = {(r.source, r.label): r for r in table.collect()}
    have = {}
    for _, s, y in rows:
        if s and y is not None:
            have[s.strip().lower(), y] = have.get((s.strip().lower(), y), 0) + 1
    assert all(r.available == have.get(k, 0) and r.quota <= r.available for k, r in got.items())
    assert got["c", 0].wanted == 100 and got["none", 1].short and got["b", 0].short == (have["b", 0] < 300)
    assert got["a", 1].counted == 5 and got["a", 0].counted == 1  # the latest run; a null counts nothing
    assert sum(r.quota for r in got.values()) == 1000
    drawn = quota_sample.draw(corpus, table).collect()
    count = {}
    for r in drawn:
        count[r.source, r.label] = count.get((r.source, r.label), 0) + 1
    assert count == {k: r.quota for k, r in got.items() if r.quota} and len({r.row_id for r in drawn}) == len(drawn)
    again = quota_sample.draw(corpus.repartition(7), table).collect()
    assert {r.row_id for r in again} == {r.row_id for r in drawn}


def test_allocation_of_nothing(spark):
    _, corpus, targets, dim, hygiene = _tables(spark)
    empty = quota_sample.allocation(corpus.filter("false"), targets, dim, hygiene, 1000)
    assert all(r.short == (r.wanted > 0) and r.quota == 0 for r in empty.collect())
    assert quota_sample.draw(corpus.filter("false"), empty).collect() == []
    assert quota_sample.allocation(corpus, targets.filter("false"), dim, hygiene, 10).collect() == []


def test_mixture(spark):
    rng = random.Random(9)
    rows = [(k, rng.choice(["a", "a", "a", "b", "c ", None]), rng.choice([0, 5, 40, 100])) for k in range(2000)] + [(5000, "huge", 100000)]
    tokens = spark.createDataFrame(rows, "doc_id long, source string, tokens long").selectExpr("doc_id", "trim(source) as source", "tokens")
    weights = spark.createDataFrame([("a", 0.5, 1), ("B ", 0.3, 2), ("c", 0.1, 5), ("none", 0.1, 3)], "source string, weight double, max_repeats int")
    plan = mixing.apportion(tokens, weights, 60000)
    by = {r.source: r for r in plan.collect()}
    size = {s: sum(t for _, x, t in rows if (x or "").strip() == s) for s in ("a", "b", "c")}
    assert {s: by[s].tokens for s in size} == size and by["none"].short and by["none"].blocks == 0
    assert by["b"].short == (size["b"] * 2 < 0.3 * 60000)
    used = mixing.mixture(tokens, plan).collect()
    cap = {"a": 1, "b": 2, "c": 5}
    assert all(1 <= r.uses <= cap[r.source] and r.tokens > 0 for r in used) and len({r.doc_id for r in used}) == len(used)
    report = {r.source: r for r in mixing.mixture_report(tokens, plan).collect()}
    for s in cap:
        assert abs(report[s].used_tokens - by[s].blocks * by[s].block_tokens) <= 100
    assert abs(sum(r.actual_share for r in report.values()) - 1) < 1e-9
    nothing = mixing.apportion(tokens.filter("false"), weights, 60000)
    assert all(r.blocks == 0 and r.short for r in nothing.collect()) and mixing.mixture(tokens.filter("false"), nothing).collect() == []
