"""Splits in hash order: the graph of the records, hubs in pieces, the walk and its repair."""

import random

from plumbline.llm import splits
from test_splits_and_samples import DIM

PERCENTS = {"train": 80, "validation": 10, "test": 10}


def test_records_make_the_graph(spark, corpus):
    dim = spark.createDataFrame(DIM, "name string, family string")
    assert {tuple(r) for r in splits.related_sources(dim, corpus).collect()} == {("hill", "lake"), ("hill", "plaza"), ("lake", "plaza")}
    got = {r.name: (r.label, r.listed) for r in splits.source_components(dim, corpus).collect()}
    assert got["unknown one"] == ("unknown one", False) and got["plaza"] == ("hill", True)
    rows = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", None), (None, None), ("c", "y")], "author string, site string")
    edges = splits.record_edges(rows, splits.F.concat(splits.F.lit("a:"), "author"), splits.F.concat(splits.F.lit("s:"), "site"))
    label = {r.node: r.label for r in splits.components(edges).collect()}
    assert label["a:a"] == label["a:b"] == label["s:x"] and label["a:c"] == label["s:y"] != label["a:a"] and len(label) == 5


def test_hubs_in_pieces(spark):
    edges = [(0, k) for k in range(1, 300)] + [(300, k) for k in range(301, 420)] + [(5, 302)]
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.label for r in splits.components(df, hub=7).collect()} == {0}
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60, 900)) for _ in range(400)]
    df = spark.createDataFrame(edges, "a long, b long")
    assert sorted(splits.components(df, hub=3).collect()) == sorted(splits.components(df).collect())


def test_walk_and_repair(spark):
    dim = spark.createDataFrame([], "name string, family string")
    sizes = [3000, 900, 800, 700, 600, 500, 500, 400, 300, 300, 250, 250, 200, 200, 100]
    rows = [(i * 10000 + j, f"s{i}") for i, n in enumerate(sizes) for j in range(n)] + [(900000 + k, None) for k in range(100)]
    corpus = spark.createDataFrame(rows, "row_id long, source string").repartition(6)
    report = {r.split: r for r in splits.split_report(corpus, dim, PERCENTS).collect()}
    assert sum(r.rows for r in report.values()) == len(rows) and sum(r.components for r in report.values()) == len(sizes)
    for k, pct in PERCENTS.items():
        assert abs(report[k].rows / len(rows) - pct / 100) < 0.03, report
    got = splits.assign_splits(corpus, dim, PERCENTS)
    count = {r["split"]: r["count"] for r in got.groupBy("split").count().collect()}
    assert count == {k: r.rows for k, r in report.items() if r.rows}
    assert all(r.splits == 1 for r in splits.undivided(corpus, spark.createDataFrame([("S1", "s2"), ("s2", "x")], "name string, family string"), PERCENTS).collect())
    # many small components need no repair
    many = spark.range(20000).selectExpr("id as row_id", "concat('s', id % 4000) as source")
    assert sum(r.moved_rows for r in splits.split_report(many, dim, PERCENTS).collect()) == 0


def test_repair_only_improves():
    got = splits._repaired([("a", "x", 60), ("b", "x", 30)], {"x": 90.0, "y": 10.0}, {"x": 50.0, "y": 50.0}, 0.0)
    assert got == {"b": "y"}
    assert splits._repaired([("a", "x", 90)], {"x": 90.0, "y": 10.0}, {"x": 50.0, "y": 50.0}, 0.0) == {}
