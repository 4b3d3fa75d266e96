"""Streaming forms of the batch operators, X1-X4. Each runs over a directory until it has read what
is there; results and checkpoints lie in the session's shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import cleaned, duplicate_group
from plumbline.operators.ranking_ops import PRIOR, quota
from plumbline.plans.tables import canon_sql, rd, table
from plumbline.sources.readers import scratch


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stream over a table's file or directory."""
    schema = table(spark, sf_dir, name).schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(schema)
    if fs.getFileStatus(path).isDirectory():
        out = reader.parquet(f"{sf_dir}/{name}.parquet")
    else:
        out = reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    # event times must have a zone
    return out.select(*(F.col(f.name).cast("timestamp").alias(f.name) if f.dataType.simpleString() == "timestamp_ntz" else F.col(f.name) for f in schema))


def drained(stream: DataFrame, name: str) -> DataFrame:
    """All that the stream gives for what is there now, read from its sink."""
    spark = stream.sparkSession
    out = scratch(spark, name)
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, f"{name}-state")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def first_seen(stream: DataFrame, text: str, at: str, delay: str) -> DataFrame:
    """One row for each canonical text within the delay; which of several is decided by arrival."""
    keyed = stream.filter(F.col(text).isNotNull()).withColumn("key", duplicate_group(text)).withWatermark(at, delay)
    return keyed.dropDuplicatesWithinWatermark(["key"])


def per_batch(stream: DataFrame, name: str, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`step` applied to each micro-batch as a whole, written once for each batch id."""
    spark = stream.sparkSession
    out = scratch(spark, name)

    def run(df: DataFrame, batch: int) -> None:
        step(df).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    q = stream.writeStream.foreachBatch(run).option("checkpointLocation", scratch(spark, f"{name}-state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)


def drift(stream: DataFrame, at: str, value: str, size: str, delay: str) -> DataFrame:
    """Mean and deviation of a value in tumbling windows."""
    w = stream.withWatermark(at, delay).groupBy(F.window(at, size)).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n", rd("mean", 4).alias("mean"), rd("sd", 4).alias("sd"))


def sliding_counts(stream: DataFrame, at: str, by: str, size: str, step: str, delay: str) -> DataFrame:
    """Rows of each key in sliding windows."""
    w = stream.withWatermark(at, delay).groupBy(F.window(at, size, step), by).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), by, "n")


def _corpus(s, d):
    return stream_of(s, d, "corpus").select("row_id", "text", "added_at", cleaned("source").alias("source"))


def _scores(df: DataFrame) -> DataFrame:
    got = df.filter("embedding is not null and not isnan(embedding[0])").select("vec_id", "y", F.col("embedding")[0].cast("double").alias("score"))
    return quota(got, [], "score", "vec_id", PRIOR).agg(F.count("*").alias("n"), F.sum("pred").alias("positives"))


QUERIES = {
    "x1_first_seen": lambda s, d: drained(first_seen(_corpus(s, d), "text", "added_at", "365 days").select("key", "row_id"), "first-seen").select("key"),
    "x2_batch_quota": lambda s, d: per_batch(stream_of(s, d, "bundle"), "quota", _scores).agg(F.sum("n").alias("n")),
    "x3_drift": lambda s, d: drained(drift(stream_of(s, d, "events"), "ts", "value", "1 day", "1 hour"), "drift"),
    "x4_sliding_budget": lambda s, d: drained(sliding_counts(stream_of(s, d, "ledger").withColumnRenamed("utc", "at"), "at", "owner", "24 hours", "6 hours", "1 hour"), "budget"),
}

SQL = {
    "x1_first_seen": f"SELECT DISTINCT sha1({canon_sql('text')}) AS key FROM corpus WHERE text IS NOT NULL AND added_at IS NOT NULL",
    "x3_drift": "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, count(value) AS n, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS sd FROM events GROUP BY 1 HAVING time_bucket(INTERVAL 1 DAY, any_value(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)",
    "x4_sliding_budget": "SELECT start, owner, count(*) AS n FROM (SELECT owner, time_bucket(INTERVAL 6 HOUR, utc) - k * INTERVAL 6 HOUR AS start FROM ledger, range(0, 4) t(k) WHERE utc IS NOT NULL) WHERE start + INTERVAL 24 HOUR <= (SELECT max(utc) - INTERVAL 1 HOUR FROM ledger) GROUP BY 1, 2",
    "x2_batch_quota": "SELECT CAST(count(*) AS BIGINT) AS n FROM bundle WHERE embedding IS NOT NULL AND NOT isnan(embedding[1])",
}
