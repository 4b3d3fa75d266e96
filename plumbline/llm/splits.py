"""Problem 4: splits that keep related records together.

The graph has the entities that records name and what a registry says of them. A record links all
entities it names; records with the same entities are one edge, so the graph comes from all rows by an
aggregation with map-side combining, and rows only add to the size of their component.

Connected components by frontier breadth-first search: adjacency lists are hash-partitioned, those of
hubs in pieces, many seeds (the nodes whose hash is least among their neighbours) expand together, a
node takes the label that reaches it first, and labels that collide are edges of a small graph, which one
task merges if its size allows and which is searched in the same way if not.

Components are walked in the order of a seeded hash; a split is closed when its share is reached. What
the walk can't hit, because a component is larger than what a split lacks, is repaired by moving single
components, as long as that brings the shares nearer to the wanted ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.plans.ranking import running_total, shuffled
from plumbline.plans.staging import stage

#: Most collisions of labels that one task merges; beyond it they are searched as a graph of their own.
SMALL = 200_000
#: Neighbours in one piece of an adjacency list; a node with more has several pieces.
HUB = 1_000_000
#: Components of a split and size class that a repair chooses from, the first in hash order.
CHOICES = 32
#: The walk is repaired until no share is off by more than this, if single moves can do it.
TOLERANCE = 0.002


def merged_in_one_task(edges: DataFrame) -> DataFrame:
    """(node, label) of a graph of a checked size."""
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def root(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for b in batches:
            for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist()):
                up.setdefault(x, x)
                up.setdefault(y, y)
                x, y = root(x), root(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
        nodes = list(up)
        kind_ = b.schema.field("a").type if up else pa.null()
        if up:
            yield pa.RecordBatch.from_arrays([pa.array(nodes, kind_), pa.array([root(x) for x in nodes], kind_)], names=["node", "label"])

    return edges.coalesce(1).mapInArrow(run, f"node {kind}, label {kind}")


def components(edges: DataFrame, small: int = SMALL, hub: int = HUB) -> DataFrame:
    """(node, label) for every node of the edges (a, b), label the least node of its component.

    Edges with a null end are left out, loops and repeated edges are harmless; no edges, no rows."""
    a, b = edges.columns
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna()
    pairs = stage(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    both = pairs.filter("a <> b").unionByName(pairs.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    lone = pairs.filter("a = b").select(F.col("a").alias("node"), F.col("a").alias("label"))
    # a hub's adjacency list lies in pieces, and its label goes to each of them
    hubs = both.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") > hub).select(F.col("a").alias("hub"), F.ceil(F.col("n") / hub).alias("pieces"))
    hubs = stage(hubs, "hubs")
    split_up = not hubs.isEmpty()
    lists = both
    if split_up:
        lists = both.join(hubs, both["a"] == hubs["hub"], "left").select("a", "b", F.coalesce(F.pmod(shuffled("b", seed=5), "pieces"), F.lit(0)).alias("piece"))
    turn: Column = F.struct(shuffled("b"), F.col("b"))
    seeds = both.groupBy("a").agg(F.min(turn).alias("least")).filter(F.struct(shuffled("a"), F.col("a")) < F.col("least"))
    labels = frontier = stage(seeds.select(F.col("a").alias("node"), F.col("a").alias("label")), "frontier")
    while not frontier.isEmpty():
        if split_up:
            many = frontier.join(hubs, frontier["node"] == hubs["hub"], "left")
            many = many.select("node", "label", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("pieces") - 1, F.lit(0)))).alias("part"))
            met = lists.join(many, (lists["a"] == many["node"]) & (lists["piece"] == many["part"]))
        else:
            met = lists.join(frontier, lists["a"] == frontier["node"])
        reached = met.groupBy("b").agg(F.min("label").alias("label"))
        frontier = stage(reached.join(labels, reached["b"] == labels["node"], "left_anti").select(F.col("b").alias("node"), "label"), "frontier")
        labels = labels.unionByName(frontier)
    labels = stage(labels, "labels")
    la, lb = labels.toDF("a", "la"), labels.toDF("b", "lb")
    collided = pairs.filter("a <> b").join(la, "a").join(lb, "b").filter("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct()
    collided = stage(collided, "collided")
    # the small graph of labels: one task up to a checked size, beyond it the same search again
    merged = (merged_in_one_task(collided) if collided.count() <= small else components(collided, small, hub)).toDF("of", "to")
    out = labels.join(merged, labels["label"] == merged["of"], "left").select("node", F.coalesce("to", "label").alias("root"))
    out = stage(out.unionByName(lone.join(labels, "node", "left_anti").toDF("node", "root")), "roots")
    least = out.groupBy("root").agg(F.min("node").alias("label"))
    return out.join(least, "root").select("node", "label")


def cleaned(c: Column | str) -> Column:
    """Trimmed of white space and in lower case; null where nothing is left."""
    return F.nullif(F.lower(F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")), F.lit(""))


def record_edges(records: DataFrame, *entities: Column) -> DataFrame:
    """(a, b): the links that records make between the entities they name, each distinct link once. A
    record links the first entity it names with each of the others, and with itself, so that an
    entity no record shares is a node too. Records that name none make no link."""
    named = F.array_compact(F.array(*entities))
    return records.select(named.alias("named")).filter("size(named) > 0").select(F.col("named")[0].alias("a"), F.explode("named").alias("b")).distinct()


def source_components(source_dim: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """(name, label, listed): the cleaned sources of the registry and of the records, the least source
    they belong with, and whether the registry lists them.

    Sources with the same cleaned family belong together; a missing or blank family is the source's
    own name, so a family called after a source holds that source if it has no other family. A source
    that only records name has no family and so its own name as one. Rows without a name are left out."""
    name = cleaned("name")
    rows = source_dim.select(name.alias("name"), F.coalesce(cleaned("family"), name).alias("family")).filter("name is not null")
    # names and families are two kinds of node
    edges = rows.select(F.concat(F.lit("n:"), "name").alias("a"), F.concat(F.lit("f:"), "family").alias("b"))
    listed = rows.select("name").distinct().withColumn("listed", F.lit(True))
    if records is not None:
        named = F.concat(F.lit("n:"), cleaned("source"))
        seen = stage(record_edges(records, named), "entities")
        alone = seen.select("a").distinct().join(listed, F.expr("substr(a, 3) = name"), "left_anti")
        edges = edges.unionByName(seen).unionByName(alone.select("a", F.concat(F.lit("f:"), F.expr("substr(a, 3)")).alias("b")))
    got = components(edges).filter("node like 'n:%'").select(F.expr("substr(node, 3)").alias("name"), F.col("label").alias("of"))
    least = got.groupBy("of").agg(F.min("name").alias("label"))
    return got.join(least, "of").join(listed, "name", "left").select("name", "label", F.coalesce("listed", F.lit(False)).alias("listed"))


def related_sources(source_dim: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """(name_a, name_b), a < b: sources of the registry that must share a split."""
    got = stage(source_components(source_dim, records).filter("listed").select("name", "label"), "sources")
    a, b = got.toDF("name_a", "label"), got.toDF("name_b", "label")
    return a.join(b, "label").filter("name_a < name_b").select("name_a", "name_b")


def _place(key: str, seed: int) -> Column:
    return F.pmod(shuffled(key, seed=seed), F.lit(1 << 40)) / float(1 << 40)


def _within(at: Column, edges: list[tuple[str, float]]) -> Column:
    out = F.lit(edges[-1][0]) if edges else F.lit(None).cast("string")
    for k, end in reversed(edges[:-1]):
        out = F.when(at < end, F.lit(k)).otherwise(out)
    return out


def _repaired(choices: list[tuple[str, str, int]], got: dict[str, float], want: dict[str, float], close: float) -> dict[str, str]:
    """Moves of components (component, split, size) that bring `got` nearer to `want`, each from the
    split with most too much to the one that lacks most."""
    off = {k: got[k] - want[k] for k in want}
    now = {c: [k, n] for c, k, n in choices}
    moved: dict[str, str] = {}
    while max(map(abs, off.values()), default=0) > close:
        best = None
        for over in off:
            for under in off:
                gap = off[over] - off[under]
                for c, (k, n) in now.items():
                    # what the squares of the deviations lose by the move
                    if k == over and n < gap and (best is None or 2 * n * (gap - n) > best[0]):
                        best = (2 * n * (gap - n), c, over, under)
        if best is None:
            break
        _, c, over, under = best
        off[over] -= now[c][1]
        off[under] += now[c][1]
        now[c][0] = moved[c] = under
    return moved


def placed_components(corpus: DataFrame, source_dim: DataFrame, percents: dict[str, int], seed: int = 42, tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame, list[tuple[str, float]]]:
    """The components of the records, (component, n, walked, split, moved): the split that the walk in
    hash order gave and the final one. Then (source, component) of every source, and the upper ends of
    the splits' parts of the rows without a source, each a component of its own.

    A component goes to the split in whose part of the walk its middle falls. The walk and the classes
    of sizes are distributed; the driver sees totals and at most CHOICES components of each split and
    of each of 256 classes of sizes, whatever the number of components."""
    of = source_components(source_dim, corpus)
    sizes = corpus.groupBy(cleaned("source").alias("source")).agg(F.count("*").alias("n"))
    known = sizes.filter("source is not null").join(of, sizes["source"] == of["name"])
    known = stage(known.select("source", F.col("label").alias("component"), "n"), "sizes")
    per = known.groupBy("component").agg(F.sum("n").alias("n")).withColumn("turn", shuffled("component", seed=seed))
    per = stage(running_total(stage(per, "components"), [], "turn", "component", F.col("n")), "walk")
    inside = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    loose = sizes.filter("source is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    whole = sum(percents.values()) or 1
    edges, at = [], 0.0
    for k in percents:
        at += inside * percents[k] / whole
        edges.append((k, at))
    walked = stage(per.select("component", "n", "turn", _within(F.col("running") - F.col("n") / 2, edges).alias("walked")), "walked")
    got = {r["walked"]: float(r["n"]) for r in walked.groupBy("walked").agg(F.sum("n").alias("n")).collect()}
    total = inside + loose
    want = {k: total * v / whole for k, v in percents.items()}
    # rows without a source fill what the components leave
    kind = F.floor(F.log2("n") * 4).cast("int")
    w = Window.partitionBy("walked", "kind").orderBy("turn", "component")
    few = walked.withColumn("kind", kind).withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= CHOICES)
    choices = [(r["component"], r["walked"], r["n"]) for r in few.select("component", "walked", "n").orderBy("turn", "component").collect()]
    start = {k: got.get(k, 0.0) + loose * percents[k] / whole for k in percents}
    moves = _repaired(choices, start, want, tolerance * total)
    fixed = corpus.sparkSession.createDataFrame(list(moves.items()), "component string, to string")
    out = walked.join(F.broadcast(fixed), "component", "left")
    out = stage(out.select("component", "n", "walked", F.coalesce("to", "walked").alias("split"), (F.coalesce("to", "walked") != F.col("walked")).alias("moved")), "placed")
    now = {r["split"]: float(r["n"]) for r in out.groupBy("split").agg(F.sum("n").alias("n")).collect()}
    left = {k: max(want[k] - now.get(k, 0.0), 0.0) for k in percents}
    room = sum(left.values())
    ends, at = [], 0.0
    for k in percents:
        at += left[k] / room if room else percents[k] / whole
        ends.append((k, at))
    return out, known.select("source", "component"), ends


def assign_splits(corpus: DataFrame, source_dim: DataFrame, percents: dict[str, int], seed: int = 42) -> DataFrame:
    """(row_id, split) for every row, sources that belong together in the same split.

    Sources not in the registry are components of their own; a row without a source is one too, and
    these rows fill, in hash order, what the components leave. Repeated rows share a split; an empty
    table gives no rows. The shares are off by less than the largest component."""
    placed, of, ends = placed_components(corpus, source_dim, percents, seed)
    rows = corpus.select(F.col("row_id").cast("long").alias("row_id"), cleaned("source").alias("source"))
    target = of.join(placed, "component").select(F.col("source").alias("of"), F.col("split").alias("to"))
    out = rows.join(target, rows["source"] == target["of"], "left")
    return out.select("row_id", F.coalesce("to", _within(_place("row_id", seed), ends)).alias("split"))


def undivided(corpus: DataFrame, source_dim: DataFrame, percents: dict[str, int], seed: int = 42) -> DataFrame:
    """(name, rows, splits) for each source of the registry: the rows of all sources it belongs with and
    in how many splits they lie, which is one, or none without rows."""
    of = stage(source_components(source_dim, corpus), "related")
    given = assign_splits(corpus, source_dim, percents, seed)
    rows = corpus.select(F.col("row_id").cast("long").alias("row_id"), cleaned("source").alias("name")).dropna().join(given, "row_id")
    per = rows.groupBy("name", "split").agg(F.count("*").alias("n")).join(of, "name").groupBy("label").agg(F.sum("n").alias("rows"), F.count_distinct("split").alias("splits"))
    zero = F.lit(0).cast("long")
    return of.filter("listed").join(per, "label", "left").select("name", F.coalesce("rows", zero).alias("rows"), F.coalesce("splits", zero).alias("splits"))


def split_report(corpus: DataFrame, source_dim: DataFrame, percents: dict[str, int], seed: int = 42) -> DataFrame:
    """(split, wanted_pct, rows, components, moved_components, moved_rows): the shares reached, and how
    many components and their rows a repair took out of the hash order; rows without a source count as
    rows, not as components."""
    placed, of, ends = placed_components(corpus, source_dim, percents, seed)
    rows = corpus.select(F.col("row_id").cast("long").alias("row_id"), cleaned("source").alias("source")).filter("source is null")
    loose = rows.select(_within(_place("row_id", seed), ends).alias("split")).groupBy("split").agg(F.count("*").alias("loose"))
    per = placed.groupBy("split").agg(F.sum("n").alias("n"), F.count("*").alias("components"), F.count_if("moved").alias("moved_components"), F.sum(F.when(F.col("moved"), F.col("n")).otherwise(0)).alias("moved_rows"))
    wanted = corpus.sparkSession.createDataFrame(list(percents.items()), "split string, wanted_pct int")
    zero = F.lit(0).cast("long")
    out = wanted.join(per, "split", "left").join(loose, "split", "left")
    return out.select("split", "wanted_pct", (F.coalesce("n", zero) + F.coalesce("loose", zero)).alias("rows"), *(F.coalesce(c, zero).alias(c) for c in ("components", "moved_components", "moved_rows")))


def split_percents(plan_params: DataFrame) -> dict[str, int]:
    """Proportions of the splits from the five-row parameter table."""
    got = {r["param"]: r["amount"] for r in plan_params.filter("param like 'split%'").collect()}
    return {k: int(got[f"split_{k}_pct"]) for k in ("train", "validation", "test") if got.get(f"split_{k}_pct")}
