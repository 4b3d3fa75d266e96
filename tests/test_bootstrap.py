import hashlib

import numpy as np

from plumbline.operators import ranking_ops, sampling


def test_interval_of_300_resamples(spark, tmp_path):
    values = {k: (k * k) % 17 / 2 for k in range(40)}
    spark.createDataFrame([(k, v) for k, v in values.items()], "doc_id long, quality double").write.parquet(f"{tmp_path}/labels.parquet")
    sha = lambda x: hashlib.sha1(x.encode()).hexdigest()
    row = [values[k] for k in sorted(values, key=lambda k: (sha(f"b:{k}"), k))]
    means = [np.mean([row[int(sha(f"29:{rep}/{nth}")[:12], 16) % 40] for nth in range(1, 41)]) for rep in range(1, 301)]
    got = {r.rep: r["mean"] for r in sampling.QUERIES["d18_bootstrap_whole"](spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(1, 301)) and np.allclose([got[k] for k in range(1, 301)], means, atol=1e-6)
    r = ranking_ops.QUERIES["m15_bootstrap_interval_whole"](spark, str(tmp_path)).first()
    assert np.allclose([r.low, r.high], np.quantile(means, [0.025, 0.975]), atol=2e-6)
