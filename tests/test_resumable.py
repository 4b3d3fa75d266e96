"""A sink that goes on where an earlier run ended."""

from plumbline.sources.readers import resumable_write


def test_interrupted_batches_are_written_anew(spark, tmp_path):
    df = spark.range(60).selectExpr("id", "cast(id % 4 as int) as batch", "id * 2 as x")
    path = f"file://{tmp_path}/out"
    assert {r.batch for r in resumable_write(df, path, "batch", 2).collect()} == {0, 1}
    # a run that ended between the rows and the journal left a part of batch 2
    df.filter("batch = 2 and id < 20").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/rows")
    assert {r.batch for r in resumable_write(df.filter("batch < 2"), path, "batch").collect()} == {0, 1}
    got = resumable_write(df, path, "batch").collect()
    assert sorted((r.id, r.batch, r.x) for r in got) == sorted((r.id, r.batch, r.x) for r in df.collect())
    # finished batches stay as they are, and rows without a batch are in none
    other = df.selectExpr("id", "if(id < 8, null, batch) as batch", "x + 1 as x")
    assert sorted(r.x for r in resumable_write(other, path, "batch").collect()) == sorted(r.x for r in df.collect())
    assert resumable_write(df.filter("false"), f"file://{tmp_path}/none", "batch").collect() == []
