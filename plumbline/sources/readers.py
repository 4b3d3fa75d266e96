"""Scans and sinks S01-S15. What is written goes to the session's shared folder."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.plans.ranking import running_by_value
from plumbline.plans.staging import shared_folder
from plumbline.plans.tables import CORPUS_SQL, REGISTRY_SQL, harmonized, rd, registry, table


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows in a stated order."""
    return df.orderBy(*order).limit(n)


def scan_budgets(dim: DataFrame, cap_scale: float, least: float = 0.02) -> DataFrame:
    """(source, budget): how many rows of each source are read: the cap, or the scaled scan if that
    is more."""
    scale = min(1.0, max(2 * cap_scale, least))
    cap = F.greatest(F.lit(1), F.bround(F.col("cap") * cap_scale).cast("long"))
    return dim.select("source", F.greatest(cap, F.bround(F.col("scan") * scale).cast("long")).alias("budget"))


def budgeted_scan(df: DataFrame, budgets: DataFrame) -> DataFrame:
    """Of each source its first rows by place, as many as its budget."""
    placed = running_by_value(df, ["source"], "pos", "row_id", {"nth": F.lit(1)})
    return placed.join(budgets, "source").filter("nth <= budget").drop("nth", "budget")


def split_union(df: DataFrame, split: str, order: list[str], n: int, splits: list[str]) -> DataFrame:
    """The first n rows of each split, one after another."""
    out = None
    for s in splits:
        part = first_rows(df.filter(F.col(split) == s), order, n)
        out = part if out is None else out.unionByName(part)
    return out


def union_then_limit(df: DataFrame, split: str, order: list[str], n: int, splits: list[str]) -> DataFrame:
    """The first n rows of all splits together, earlier splits first."""
    rank = F.coalesce(*(F.when(F.col(split) == s, F.lit(k)) for k, s in enumerate(splits)))
    return df.withColumn("__s", rank).filter("__s is not null").orderBy("__s", *order).limit(n).drop("__s")


def tolerant_union(loaders: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, list[str]]:
    """The union of all sources that can be read, and the names of the others."""
    out, skipped = None, []
    for name, load in loaders.items():
        try:
            part = load()
        except Exception:  # noqa: BLE001 - whatever keeps one source from being read
            skipped.append(name)
            continue
        out = part if out is None else out.unionByName(part)
    return out, skipped


def json_lines_round_trip(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.json(path)
    return df.sparkSession.read.schema(df.schema).json(path)


def csv_round_trip(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Written in order with a header, and read again."""
    path = scratch(df.sparkSession, name)
    df.orderBy(*order).write.option("header", True).option("escape", '"').csv(path)
    return df.sparkSession.read.schema(df.schema).option("header", True).option("escape", '"').csv(path)


def write_vectors(df: DataFrame, name: str) -> DataFrame:
    """Vectors stored as floats with zstd and read as floats."""
    path = scratch(df.sparkSession, name)
    df.withColumn("embedding", F.col("embedding").cast("array<float>")).write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def merged(vectors: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Vectors with labels joined on an explicit id; ids on one side only are an error count."""
    both = vectors.join(labels.withColumn("__right", F.lit(True)), key, "full")
    return both.withColumn("matched", F.col("__right").isNotNull() & F.col(vectors.columns[1]).isNotNull()).drop("__right")


def overwrite_partitions(df: DataFrame, path: str, by: str) -> DataFrame:
    """Each group's partition written anew, other partitions untouched: done twice, it's done once."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    return df.sparkSession.read.parquet(path)


def resumable_write(df: DataFrame, path: str, by: str, most: int | None = None) -> DataFrame:
    """The partitions of `df` written batch by batch: those named in the journal beside them are left as
    they are, the others are written anew, whatever an interrupted run left of them, and named in the
    journal after that. `most` ends a run after that many batches, in their order. Returns what is
    written so far, of finished batches only.

    A run that is repeated reads and writes nothing more. One list of batches comes to the driver."""
    spark = df.sparkSession
    journal = f"{path}/_journal"
    at = spark._jvm.org.apache.hadoop.fs.Path(journal)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    done = spark.read.json(journal, schema=f"`{by}` string") if files.exists(at) else spark.createDataFrame([], f"`{by}` string")
    key = F.col(by).cast("string")
    left = df.filter(F.col(by).isNotNull()).join(done.select(F.col(by).alias("__done")), key == F.col("__done"), "left_anti")
    batches = [r[0] for r in left.select(by).distinct().orderBy(by).collect()]
    now = batches if most is None else batches[:most]
    if now:
        left.filter(F.col(by).isin(now)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(f"{path}/rows")
        # the rows are whole before their batches are named
        spark.createDataFrame([(str(b),) for b in now], f"`{by}` string").coalesce(1).write.mode("append").json(journal)
    if not files.exists(at):
        return df.filter("false")
    finished = spark.read.json(journal, schema=f"`{by}` string").select(F.col(by).alias("__done")).distinct()
    return spark.read.schema(df.schema).parquet(f"{path}/rows").join(finished, key == F.col("__done"), "left_semi")


def log_records(lines: DataFrame, header: str, record: str, fields: list[str]) -> DataFrame:
    """(number, line) of a log to records: the last header above each line is filled down, and the
    groups of a record's pattern become its fields."""
    w = Window.partitionBy("file").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    model = F.last(F.nullif(F.regexp_extract("line", header, 1), F.lit("")), ignorenulls=True).over(w)
    hit = lines.withColumn("model", model).filter(F.col("line").rlike(record))
    return hit.select("file", "model", "number", *(F.regexp_extract("line", record, k + 1).alias(f) for k, f in enumerate(fields)))


def artifact_check(pred: DataFrame) -> DataFrame:
    """(rows, positives, outside): what a packaged predictor must return one 0 or 1 for each row of."""
    return pred.agg(F.count("*").alias("rows"), F.count_if(F.col("pred") == 1).alias("positives"), F.count_if(F.coalesce(~F.col("pred").isin(0, 1), F.lit(True))).alias("outside"))


def _loader(s: SparkSession, d: str, source: str) -> Callable[[], DataFrame]:
    return lambda: harmonized(s, d).filter(F.col("source") == source).select("row_id", "source")


def _missing(s: SparkSession, d: str) -> Callable[[], DataFrame]:
    return lambda: table(s, d, "no_such_table").select("row_id", "source")


def _log(s, d):
    """The runs of source hygiene as a log: a header for each source, a line for each run."""
    h = table(s, d, "source_hygiene").filter("source is not null and pos is not null").distinct()
    head = h.select("source").distinct().select(F.col("source").alias("file"), F.lit(-1).cast("long").alias("number"), F.concat(F.lit("== model "), "source", F.lit(" ==")).alias("line"))
    rows = h.select(F.col("source").alias("file"), F.col("run_id").alias("number"), F.format_string("run %d pos=%d neg=%d", "run_id", "pos", F.coalesce("neg", F.lit(0))).alias("line"))
    return head.unionByName(rows)


def _resumed(s, d):
    """The corpus by extraction batch, written in three runs of which the first two end early."""
    rows = table(s, d, "corpus").select("row_id", "label", "batch_id")
    path = scratch(s, "resumed")
    resumable_write(rows, path, "batch_id", 2)
    resumable_write(rows, path, "batch_id", 3)
    return resumable_write(rows, path, "batch_id").groupBy("batch_id").agg(F.count("*").alias("n"), F.sum("label").alias("labels"))


QUERIES = {
    "s01_scan": lambda s, d: table(s, d, "corpus").filter("label = 1").select("row_id", "split"),
    "s02_first_rows": lambda s, d: first_rows(table(s, d, "corpus").filter("label = 0"), ["pos", "row_id"], 500).select("row_id"),
    "s03_scan_budgets": lambda s, d: scan_budgets(registry(table(s, d, "source_dim")), 0.001),
    "s03_budgeted_scan": lambda s, d: budgeted_scan(harmonized(s, d), scan_budgets(registry(table(s, d, "source_dim")), 0.001)).groupBy("source").agg(F.count("*").alias("n"), F.max("pos").alias("last_pos")),
    "s04_split_union": lambda s, d: split_union(table(s, d, "corpus"), "split", ["pos", "row_id"], 200, ["validation", "test"]).select("row_id", "split"),
    "s05_union_limit": lambda s, d: union_then_limit(table(s, d, "corpus"), "split", ["pos", "row_id"], 400, ["test", "validation"]).select("row_id", "split"),
    "s05_tolerant_union": lambda s, d: tolerant_union({"plaza_remarks": _loader(s, d, "plaza_remarks"), "gone": _missing(s, d), "opal_notes": _loader(s, d, "opal_notes")})[0].groupBy("source").agg(F.count("*").alias("n")),
    "s06_json_lines": lambda s, d: json_lines_round_trip(table(s, d, "corpus").filter("text is not null and label is not null and source is not null").select("row_id", "text", "label", "source"), "lines"),
    "s07_vector_bundle": lambda s, d: write_vectors(table(s, d, "bundle"), "bundle").select("vec_id", "y", rd(F.col("embedding")[0].cast("double"), 4).alias("first_cell")).filter("not isnan(first_cell)"),
    "s08_merge": lambda s, d: merged(table(s, d, "bundle").select("vec_id", "y"), table(s, d, "corpus").select(F.col("row_id").alias("vec_id"), "label"), "vec_id").groupBy("matched").agg(F.count("*").alias("n")),
    "s09_csv": lambda s, d: csv_round_trip(table(s, d, "label_targets"), "targets", ["source", "label"]).select("source", "label", "target_share", "min_rows"),
    "s10_sorted_csv": lambda s, d: csv_round_trip(table(s, d, "mix_weights"), "weights", ["source"]).select("source", rd("weight", 8).alias("weight"), "max_repeats"),
    "s11_partition_sink": lambda s, d: _twice(s, d).groupBy("action").agg(F.count("*").alias("n")),
    "s15_resumed": _resumed,
    "s12_log_records": lambda s, d: log_records(_log(s, d), r"^== model (\S+) ==$", r"^run (\d+) pos=(\d+) neg=(\d+)$", ["run", "pos", "neg"]).select("model", "run", "pos", "neg"),
    "s14_artifact_check": lambda s, d: artifact_check(table(s, d, "bundle").select(F.col("y").alias("pred"))),
}


def _twice(s, d):
    h = table(s, d, "source_hygiene").filter("action is not null")
    path = scratch(s, "partitions")
    overwrite_partitions(h, path, "action")
    return overwrite_partitions(h.filter("action = 'kept'"), path, "action")


SQL = {
    "s01_scan": "SELECT row_id, split FROM corpus WHERE label = 1",
    "s02_first_rows": "SELECT row_id FROM corpus WHERE label = 0 ORDER BY pos, row_id LIMIT 500",
    "s03_scan_budgets": f"WITH {REGISTRY_SQL} SELECT source, greatest(greatest(1, CAST(round_even(cap * 0.001::DOUBLE, 0) AS BIGINT)), CAST(round_even(scan * 0.02::DOUBLE, 0) AS BIGINT)) AS budget FROM reg",
    "s03_budgeted_scan": f"WITH {CORPUS_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pos, row_id) AS nth FROM base) SELECT source, count(*) AS n, max(pos) AS last_pos FROM p WHERE nth <= greatest(greatest(1, CAST(round_even(cap * 0.001::DOUBLE, 0) AS BIGINT)), CAST(round_even(scan * 0.02::DOUBLE, 0) AS BIGINT)) GROUP BY 1",
    "s04_split_union": "(SELECT row_id, split FROM corpus WHERE split = 'validation' ORDER BY pos, row_id LIMIT 200) UNION ALL (SELECT row_id, split FROM corpus WHERE split = 'test' ORDER BY pos, row_id LIMIT 200)",
    "s05_union_limit": "SELECT row_id, split FROM corpus WHERE split IN ('test', 'validation') ORDER BY split, pos, row_id LIMIT 400",
    "s05_tolerant_union": f"WITH {CORPUS_SQL} SELECT source, count(*) AS n FROM base WHERE source IN ('plaza_remarks', 'opal_notes') GROUP BY 1",
    "s06_json_lines": "SELECT row_id, text, label, source FROM corpus WHERE text IS NOT NULL AND label IS NOT NULL AND source IS NOT NULL",
    "s07_vector_bundle": "SELECT vec_id, y, round(embedding[1]::DOUBLE, 4) AS first_cell FROM bundle WHERE NOT isnan(embedding[1])",
    "s08_merge": "SELECT b.vec_id IS NOT NULL AND c.row_id IS NOT NULL AS matched, count(*) AS n FROM bundle b FULL JOIN corpus c ON b.vec_id = c.row_id GROUP BY 1",
    "s09_csv": "SELECT source, label, target_share, min_rows FROM label_targets",
    "s10_sorted_csv": "SELECT source, round(weight, 8) AS weight, max_repeats FROM mix_weights",
    "s11_partition_sink": "SELECT action, count(*) AS n FROM source_hygiene WHERE action IS NOT NULL GROUP BY 1",
    "s15_resumed": "SELECT batch_id, count(*) AS n, CAST(sum(label) AS BIGINT) AS labels FROM corpus WHERE batch_id IS NOT NULL GROUP BY 1",
    "s12_log_records": "SELECT source AS model, CAST(run_id AS VARCHAR) AS run, CAST(pos AS VARCHAR) AS pos, CAST(coalesce(neg, 0) AS VARCHAR) AS neg FROM (SELECT DISTINCT * FROM source_hygiene) WHERE source IS NOT NULL AND pos IS NOT NULL",
    "s14_artifact_check": "SELECT count(*) AS rows, count(*) FILTER (WHERE y = 1) AS positives, count(*) FILTER (WHERE y IS NULL OR y NOT IN (0, 1)) AS outside FROM bundle",
}
