"""Vector statistics and closed-form heads: V01-V17, A01-A06, H01, H02, H04, H05, H10, H11, H14-H16."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import vectors as V
from plumbline.plans.ranking import exact_percentiles
from plumbline.plans.tables import VECTORS_SQL, rd, table, vectors

#: The named transforms of a recipe grid: row scaling, kind of standardizing, components removed.
TRANSFORMS = {
    "raw": (False, None, 0), "std": (False, "train", 0), "l2": (True, None, 0), "l2+std": (True, "train", 0),
    "batchstd": (False, "batch", 0), "l2+batchstd": (True, "batch", 0), "std+abtt1": (False, "train", 1), "std+abtt4": (False, "train", 4),
}


def cells(df: DataFrame, vec: str, *keys: str) -> DataFrame:
    """Long form: (keys, i, x), i from 1."""
    return df.select(*keys, F.posexplode(F.col(vec).cast("array<double>")).alias("i", "x")).withColumn("i", F.col("i") + 1)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    """A list column of these arrays, without making numbers of Python out of them."""
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.zeros(0)))


def _rows_of(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a column as rows, short ones filled up with 0, and where there is a number."""
    n = pa.compute.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    known = ~flat.is_null().to_numpy(zero_copy_only=False)
    values = np.where(known, flat.to_numpy(zero_copy_only=False), 0.0)
    d = int(n.max(initial=0))
    if (n == d).all():
        return values.reshape(len(n), d), known.reshape(len(n), d)
    there = np.arange(d) < n[:, None]
    x, has = np.zeros((len(n), d)), np.zeros((len(n), d), bool)
    x[there], has[there] = values, known
    return x, has


def _widened(x: np.ndarray, d: int) -> np.ndarray:
    return x if len(x) >= d else np.concatenate([x, np.zeros(d - len(x))])


def _merged(a: list, b: list) -> list:
    """Counts, means and sums of squared deviations of two sets of rows together."""
    d = max(len(a[0]), len(b[0]))
    (n, m, q), (k, w, r) = ([_widened(x, d) for x in y] for y in (a, b))
    total = np.maximum(n + k, 1)
    gap = w - m
    return [n + k, m + gap * k / total, q + r + gap * gap * n * k / total]


def _partial_moments(df: DataFrame, vec: str, by: tuple[str, ...], marks: str | None = None) -> DataFrame:
    """(by, n, mean, dev): arrays over the dimensions. A task sends one row for each group it meets, and
    these are merged in two steps, so no vector is ever taken apart into rows. With `marks`, a long, also
    by `mark`: a row counts for each bit that its marks have."""
    src = df.select(*by, F.col(vec).cast("array<double>").alias("__v"), *([F.col(marks).alias("__marks")] if marks else [])).filter("__v is not null")
    fields = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name not in ("__v", "__marks")), *(["mark int"] if marks else [])]
    grouped = by
    if marks:
        by = (*by, "mark")
    ddl = ", ".join([*fields, "n array<double>, mean array<double>, dev array<double>"])
    types: dict[str, pa.DataType] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[tuple, list] = {}
        for b in batches:
            types.update({k: pa.int32() if marks and k == "mark" else b.schema.field(k).type for k in by})
            x, has = _rows_of(b.column("__v"))
            rows: dict[tuple, list[int]] = {}
            for i, k in enumerate(zip(*(b.column(k).to_pylist() for k in grouped)) if grouped else [()] * b.num_rows):
                rows.setdefault(k, []).append(i)
            if marks:
                marked = b.column("__marks").to_numpy()
                bits = range(int(np.bitwise_or.reduce(marked)).bit_length() if len(marked) else 0)
                each = (((*k, bit), np.array(at)[marked[at] >> bit & 1 == 1]) for k, at in rows.items() for bit in bits)
                rows = {k: at for k, at in each if len(at)}
            for k, at in rows.items():
                z, h = x[at], has[at]
                n = h.sum(0).astype(float)
                mean = np.where(h, z, 0).sum(0) / np.maximum(n, 1)
                one = [n, mean, np.where(h, (z - mean) ** 2, 0).sum(0)]
                got[k] = _merged(got[k], one) if k in got else one
        if got:
            yield _moment_rows(got, by, types)

    def add(t: pa.Table) -> pa.Table:
        total = None
        columns = [t.column(c).combine_chunks() for c in ("n", "mean", "dev")]
        for i in range(t.num_rows):
            one = [c[i].values.to_numpy(zero_copy_only=False) for c in columns]
            total = one if total is None else _merged(total, one)
        kept = {c: t.schema.field(c).type for c in t.schema.names if c not in ("n", "mean", "dev")}
        return pa.Table.from_batches([_moment_rows({tuple(t.column(c)[0].as_py() for c in kept): total}, tuple(kept), kept)])

    part = src.mapInArrow(run, ddl).withColumn("__salt", F.pmod(F.spark_partition_id(), F.lit(32)))
    first = part.select(*by, "__salt", "n", "mean", "dev").groupBy(*by, "__salt").applyInArrow(add, ", ".join([*fields, "`__salt` int, n array<double>, mean array<double>, dev array<double>"]))
    return first.drop("__salt").groupBy(*by).applyInArrow(add, ddl)


def _moment_rows(got: dict[tuple, list], by: tuple[str, ...], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = [pa.array([k[j] for k in got], types[c]) for j, c in enumerate(by)]
    columns += [_lists([v[j] for v in got.values()]) for j in range(3)]
    return pa.RecordBatch.from_arrays(columns, names=[*by, "n", "mean", "dev"])


def marked_moments(df: DataFrame, vec: str, group: str, marks: str) -> dict[tuple, tuple[int, np.ndarray, np.ndarray]]:
    """{(group, bit): (rows, means, population deviations)} of the rows whose marks have the bit, in one
    pass; vectors of one length without nulls. On the driver: groups x bits x 2 d numbers."""
    t = _partial_moments(df, vec, (group,), marks).toArrow().combine_chunks()
    n, mean, dev = ([x.values.to_numpy(zero_copy_only=False) for x in t.column(c)] for c in ("n", "mean", "dev"))
    return {(t.column(group)[i].as_py(), t.column("mark")[i].as_py()): (int(n[i][0]), mean[i], np.sqrt(dev[i] / n[i][0])) for i in range(t.num_rows)}


def dim_moments(df: DataFrame, vec: str, *by: str) -> DataFrame:
    """(by, i, n, mean, var, sd) with population variance."""
    m = _partial_moments(df, vec, by).select(*by, F.posexplode(F.arrays_zip("n", "mean", "dev")).alias("i", "c"))
    some = F.col("c.n") > 0
    var = F.when(some, F.col("c.dev") / F.col("c.n"))
    return m.select(*by, (F.col("i") + 1).alias("i"), F.col("c.n").cast("long").alias("n"), F.when(some, F.col("c.mean")).alias("mean"), var.alias("var"), F.sqrt(var).alias("sd"))


def center_and_scale(df: DataFrame, vec: str, *by: str) -> DataFrame:
    """(by, center, scale): means and population deviations as vectors, deviations 1e-6 at least."""
    m = dim_moments(df, vec, *by).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("i", "mean", "sd"))).alias("m"))  # one entry for each dimension
    return m.select(*by, F.transform("m", lambda c: c["mean"]).alias("center"), F.transform("m", lambda c: F.greatest(c["sd"], F.lit(1e-6))).alias("scale"))


def standardize(df: DataFrame, vec: str, moments: DataFrame, *by: str) -> DataFrame:
    """`df` with `vec` centred and scaled by the (one-row, or one row for each `by`) moments."""
    # one row of 2 d numbers is handed to all tasks; those of groups are joined as their size asks
    joined = df.join(moments, list(by)) if by else df.crossJoin(F.broadcast(moments))
    return joined.withColumn(vec, V.standardized(vec, "center", "scale")).drop("center", "scale")


def gram(df: DataFrame, vec: str, *by: str) -> DataFrame:
    """(by, n, s, g): counts, sums and sums of outer products of each group, flattened. A task adds
    up its rows in blocks and sends one partial sum for each group it meets."""
    src = df.select(*by, F.col(vec).cast("array<double>").alias("__v"))
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "__v"), "n long, s array<double>, g array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, list] = {}
        types = None
        for b in batches:
            if not b.num_rows:
                continue
            types = [b.schema.field(k).type for k in by]
            flat = b.column("__v").flatten().to_numpy(zero_copy_only=False)
            x = flat.reshape(b.num_rows, -1)
            keys = list(zip(*(b.column(k).to_pylist() for k in by))) if by else [()] * b.num_rows
            order: dict[tuple, list[int]] = {}
            for i, k in enumerate(keys):
                order.setdefault(k, []).append(i)
            for k, at in order.items():
                z = x[at]
                got = total.setdefault(k, [0, np.zeros(z.shape[1]), np.zeros((z.shape[1], z.shape[1]))])
                got[0] += len(at)
                got[1] += z.sum(0)
                got[2] += z.T @ z
        if total:
            ks = list(total)
            cols = [pa.array([k[j] for k in ks], types[j]) for j in range(len(by))]
            cols += [pa.array([total[k][0] for k in ks], pa.int64())]
            cols += [_lists([total[k][j].ravel() for k in ks]) for j in (1, 2)]
            out = pa.RecordBatch.from_arrays(cols, names=[*by, "n", "s", "g"])
            yield from (out.slice(i, 1) for i in range(len(ks)))

    def add(t: pa.Table) -> pa.Table:
        columns = [pa.array([sum(t.column("n").to_pylist())], pa.int64())]
        for c in ("s", "g"):
            columns.append(_lists([t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1).sum(0)]))
        kept = [c for c in t.schema.names if c not in ("n", "s", "g")]
        return pa.table([*(t.column(c).slice(0, 1).combine_chunks() for c in kept), *columns], names=[*kept, "n", "s", "g"])

    # the tasks' sums are added up whole, in two steps, so no cell of a matrix becomes a row
    part = src.mapInArrow(run, ddl).withColumn("__salt", F.pmod(F.spark_partition_id(), F.lit(32)))
    salted = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "__v"), "`__salt` int, n long, s array<double>, g array<double>"])
    out = part.select(*by, "__salt", "n", "s", "g").groupBy(*by, "__salt").applyInArrow(add, salted).drop("__salt").groupBy(*by).applyInArrow(add, ddl)
    if by:
        return out
    one = df.sparkSession.range(1).select(F.lit(0).alias("__one"))
    none = F.array().cast("array<double>")
    return one.join(out.withColumn("__one", F.lit(0)), "__one", "left").select("n", F.coalesce("s", none).alias("s"), F.coalesce("g", none).alias("g"))


class ClassStats:
    """Sufficient statistics of two classes, on the driver: d and d x d numbers, whatever the rows."""

    def __init__(self, groups: list[tuple[int, int, np.ndarray, np.ndarray]]):
        d = len(groups[0][2]) if groups else 0
        self.n = {0: 0, 1: 0}
        self.s = {0: np.zeros(d), 1: np.zeros(d)}
        self.g = {0: np.zeros((d, d)), 1: np.zeros((d, d))}
        for y, n, s, g in groups:
            self.n[y] += n
            self.s[y] = self.s[y] + np.asarray(s)
            self.g[y] = self.g[y] + np.asarray(g).reshape(d, d)

    @property
    def means(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(self.s[y] / max(self.n[y], 1) for y in (0, 1))

    @property
    def delta(self) -> np.ndarray:
        return self.means[1] - self.means[0]

    def scatter(self) -> np.ndarray:
        m = self.means
        return sum(self.g[y] - self.n[y] * np.outer(m[y], m[y]) for y in (0, 1))

    def covariance(self) -> np.ndarray:
        """Pooled within-class covariance over all rows."""
        return self.scatter() / max(self.n[0] + self.n[1], 1)

    def without(self, other: ClassStats) -> ClassStats:
        """The statistics of the rows that `other` doesn't have."""
        return ClassStats([(y, self.n[y] - other.n[y], self.s[y] - other.s[y], self.g[y] - other.g[y]) for y in (0, 1)])

    def center_and_scale(self) -> tuple[np.ndarray, np.ndarray]:
        """Means and population deviations of both classes together, deviations 1e-6 at least."""
        n = max(self.n[0] + self.n[1], 1)
        center = (self.s[0] + self.s[1]) / n
        return center, np.maximum(np.sqrt(np.maximum(np.diag(self.g[0] + self.g[1]) / n - center * center, 0)), 1e-6)

    def mapped(self, a: np.ndarray, c: np.ndarray) -> ClassStats:
        """The statistics of the rows a @ (v - c)."""
        cross = {y: np.outer(self.s[y], c) for y in (0, 1)}
        return ClassStats([(y, self.n[y], a @ (self.s[y] - self.n[y] * c), a @ (self.g[y] - cross[y] - cross[y].T + self.n[y] * np.outer(c, c)) @ a.T) for y in (0, 1)])

    @classmethod
    def of(cls, df: DataFrame, vec: str = "v", y: str = "y") -> ClassStats:
        return cls([(k[0], *rest) for k, *rest in _statistics(df, vec, y)])

    @classmethod
    def by(cls, df: DataFrame, group: str, vec: str = "v", y: str = "y") -> dict[str, ClassStats]:
        """For each value of a small column, in one pass: groups x classes x d^2 numbers."""
        got: dict[str, list] = {}
        for (k, label), *rest in _statistics(df, vec, group, y):
            got.setdefault(k, []).append((label, *rest))
        return {k: cls(v) for k, v in got.items()}


def _statistics(df: DataFrame, vec: str, *by: str) -> Iterator[tuple]:
    """(key, n, s, g) of each group, the sums as arrays."""
    t = gram(df, vec, *by).toArrow().combine_chunks()
    keys = list(zip(*(t.column(c).to_pylist() for c in by)))
    for i, k in enumerate(keys):
        yield k, t.column("n")[i].as_py(), *(t.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("s", "g"))


def _head(w: np.ndarray, stats: ClassStats) -> tuple[np.ndarray, float]:
    return w, float(-w @ (stats.means[0] + stats.means[1]) / 2)


def shrunk_lda(stats: ClassStats, shrinkage: float) -> tuple[np.ndarray, float]:
    """Weights and intercept of a linear discriminant, the covariance shrunk to its mean variance."""
    c = stats.covariance()
    d = len(c)
    return _head(np.linalg.solve((1 - shrinkage) * c + shrinkage * np.trace(c) / d * np.eye(d), stats.delta), stats)


def mean_difference(stats: ClassStats) -> tuple[np.ndarray, float]:
    return _head(stats.delta, stats)


def fisher(stats: ClassStats, gamma: float = 1e-3) -> np.ndarray:
    """Unit direction with the sample covariance and a small ridge."""
    c = stats.scatter() / (stats.n[0] + stats.n[1] - 2)
    w = np.linalg.solve(c + gamma * (np.trace(c) / len(c) + 1e-12) * np.eye(len(c)), stats.delta)
    return w / np.linalg.norm(w)


def ridge_classifier(stats: ClassStats, alpha: float) -> tuple[np.ndarray, float]:
    """Least squares on labels of -1 and 1 with an unpenalized intercept."""
    n = stats.n[0] + stats.n[1]
    s, g = stats.s[0] + stats.s[1], stats.g[0] + stats.g[1]
    t, xt = stats.n[1] - stats.n[0], stats.s[1] - stats.s[0]
    a = g - np.outer(s, s) / n + alpha * np.eye(len(s))
    w = np.linalg.solve(a, xt - s * t / n)
    return w, float((t - w @ s) / n)


def auto_shrinkage(df: DataFrame, stats: ClassStats, vec: str = "v", y: str = "y") -> float:
    """Shrinkage by Ledoit and Wolf of the pooled within-class covariance: fourth-order sums in one
    pass over the rows, the rest from the statistics."""
    m0, m1 = (V.literal(m.tolist()) for m in stats.means)
    centred = F.when(F.col(y) == 1, V.minus(vec, m1)).otherwise(V.minus(vec, m0))
    sq = F.aggregate(centred, F.lit(0.0), lambda a, x: a + x * x)
    n = stats.n[0] + stats.n[1]
    fourth = df.agg(F.sum(sq * sq).alias("f")).first()["f"]
    c = stats.covariance()
    d = len(c)
    mu = np.trace(c) / d
    delta = ((c - mu * np.eye(d)) ** 2).sum() / d
    beta = min((fourth / n - (c**2).sum()) / d / n, delta)
    return float(beta / delta) if delta > 0 else 1.0


def top_components(second: np.ndarray, k: int) -> np.ndarray:
    """The k leading eigenvectors of a symmetric matrix, k x d, at most d - 1."""
    k = max(0, min(k, len(second) - 1))
    return np.linalg.eigh(second)[1][:, ::-1][:, :k].T


def project_out(df: DataFrame, vec: str, components: np.ndarray) -> DataFrame:
    """`df` with the components removed from `vec`."""
    out = df
    for row in components.tolist():
        c = V.literal(row)
        out = out.withColumn(vec, V.minus(vec, V.scaled(c, V.dot(vec, c))))
    return out


def in_raw_coordinates(w: np.ndarray, b: float, center: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, float]:
    """A head on standardized vectors as one on raw vectors."""
    raw = w / scale
    return raw, float(b - center @ raw)


def check_head(head: dict) -> dict:
    """The head, or an error naming what is missing."""
    for need, part in (("standardize", "center"), ("standardize", "scale")):
        if head.get(need) == "train" and head.get(part) is None:
            raise ValueError(f"a head standardized on training rows needs {part}")
    if head.get("remove_top", 0) and head.get("components") is None:
        raise ValueError("a head that removes components needs them")
    return head


def transform(df: DataFrame, name: str, vec: str = "v", moments: DataFrame | None = None) -> DataFrame:
    """One of TRANSFORMS applied to the rows; with moments of other rows for `train`."""
    l2, standard, remove = TRANSFORMS[name]
    if l2:
        df = df.withColumn(vec, V.row_l2(vec))
    if standard:
        df = standardize(df, vec, moments if standard == "train" and moments is not None else center_and_scale(df, vec))
    if remove:
        r = gram(df, vec).first()
        d = len(r["s"])
        df = project_out(df, vec, top_components(np.array(r["g"]).reshape(d, d) / r["n"], remove))
    return df


def anova_f(df: DataFrame, vec: str, y: str) -> DataFrame:
    """(i, f): the F statistic of each dimension between classes, from class sums."""
    per = dim_moments(df, vec, y).filter("n > 0").select(y, "i", "n", (F.col("mean") * F.col("n")).alias("s"), ((F.col("var") + F.col("mean") * F.col("mean")) * F.col("n")).alias("q"))
    agg = per.groupBy("i").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    between = (F.col("b") - F.col("s") * F.col("s") / F.col("n")) / (F.col("k") - 1)
    within = (F.col("q") - F.col("b")) / (F.col("n") - F.col("k"))
    return agg.select("i", F.try_divide(between, within).alias("f"))


def binned_information(df: DataFrame, vec: str, y: str, bins: int = 16) -> DataFrame:
    """(i, mi): mutual information of each dimension, cut into equal bins of its range, with the class."""
    c = cells(df, vec, y)
    edge = c.groupBy("i").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    joined = c.join(F.broadcast(edge), "i")  # d rows
    b = F.least(F.lit(bins - 1), F.floor(F.coalesce(F.try_divide(F.col("x") - F.col("lo"), F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))), F.lit(0.0)) * bins))
    n = joined.groupBy("i", b.alias("b"), y).agg(F.count("*").alias("n"))
    total = n.groupBy("i").agg(F.sum("n").alias("t"))
    nb = n.groupBy("i", "b").agg(F.sum("n").alias("nb"))
    ny = n.groupBy("i", y).agg(F.sum("n").alias("ny"))
    j = n.join(total, "i").join(nb, ["i", "b"]).join(ny, ["i", y])
    return j.groupBy("i").agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("nb") * F.col("ny")))).alias("mi"))


def robust_moments(df: DataFrame, vec: str) -> DataFrame:
    """(center, scale): medians and interquartile ranges as vectors; a range of 0 counts as 1."""
    m = exact_percentiles(cells(df, vec), ["i"], F.col("x"), {"c": 0.5, "hi": 0.75, "lo": 0.25}).select("i", "c", (F.col("hi") - F.col("lo")).alias("q"))
    one = m.agg(F.sort_array(F.collect_list(F.struct("i", "c", "q"))).alias("m"))  # one entry for each dimension
    return one.select(F.transform("m", lambda r: r["c"]).alias("center"), F.transform("m", lambda r: F.when(r["q"] > 0, r["q"]).otherwise(1.0)).alias("scale"))


def top_features(df: DataFrame, vec: str, y: str, k: int) -> DataFrame:
    """(i, f): the k dimensions that tell classes apart best, the first of equals."""
    return anova_f(df, vec, y).orderBy(F.desc(F.round("f", 9)), "i").limit(k)


# ---- queries -------------------------------------------------------------------------------------
def _v(s, d):
    return vectors(s, d)


def _as_cells(s, w, b):
    return s.createDataFrame([(0, float(b)), *((i + 1, float(x)) for i, x in enumerate(w))], "i int, w double").select("i", rd("w", 5).alias("w"))


def _rows(df: DataFrame, key: str = "vec_id") -> DataFrame:
    return cells(df, "v", key).groupBy(key).agg(rd(F.sum(F.col("x") * F.col("i")), 5).alias("mark"), rd(F.sum("x"), 5).alias("total"))


_MARK = "round(sum(x * i), 5) AS mark, round(sum(x), 5) AS total"
_L2 = "l2 AS (SELECT vec_id, i, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 1e-8) AS x FROM cells)"
_MU = "mu AS (SELECT y, i, avg(x) AS m, count(*) AS n FROM cells GROUP BY 1, 2), dl AS (SELECT i, sum(CASE WHEN y = 1 THEN m ELSE -m END) AS dl, sum(m) / 2 AS mid FROM mu GROUP BY 1)"
_COV = "cv AS (SELECT a.i, b.i AS j, avg((a.x - ma.m) * (b.x - mb.m)) AS c FROM cells a JOIN cells b USING (vec_id) JOIN mu ma ON ma.y = a.y AND ma.i = a.i JOIN mu mb ON mb.y = b.y AND mb.i = b.i GROUP BY 1, 2)"


def _lda_sql(shrink: float, steps: int = 400) -> str:
    """The same solution reached by gradient steps, as SQL has no solver."""
    return f"""WITH RECURSIVE {VECTORS_SQL}, {_MU}, {_COV}, tr AS (SELECT avg(c) AS t FROM cv WHERE i = j),
        m AS (SELECT i, j, {1 - shrink}::DOUBLE * c + CASE WHEN i = j THEN {shrink}::DOUBLE * t ELSE 0 END AS a FROM cv, tr),
        big AS (SELECT max(r) AS r FROM (SELECT i, sum(abs(a)) AS r FROM m GROUP BY 1)),
        mat AS (SELECT list(rw ORDER BY i) AS a FROM (SELECT i, list(a ORDER BY j) AS rw FROM m GROUP BY i)), rhs AS (SELECT list(dl ORDER BY i) AS d FROM dl),
        it AS (SELECT 0 AS k, list_transform(d, lambda z: 0.0::DOUBLE) AS w FROM rhs
               UNION ALL SELECT k + 1, list_transform(range(1, len(w) + 1), lambda q: w[q] + (d[q] - list_dot_product(a[q], w)) / big.r) FROM it, mat, rhs, big WHERE k < {steps}),
        fin AS (SELECT w FROM it WHERE k = {steps})"""


def _solved(parts: str, matrix: str, right: str) -> str:
    """SQL of the solution w of a symmetric system by conjugate gradients: `matrix` gives (i, j, a),
    `right` (i, d)."""
    return f"""WITH RECURSIVE {parts}, m AS ({matrix}), rh AS ({right}),
        mat AS (SELECT list(rw ORDER BY i) AS a FROM (SELECT i, list(a ORDER BY j) AS rw FROM m GROUP BY i)),
        it AS (SELECT 0 AS k, list_transform(d, lambda z: 0.0::DOUBLE) AS x, d AS r, d AS p FROM (SELECT list(d::DOUBLE ORDER BY i) AS d FROM rh)
               UNION ALL
               SELECT k + 1, x, rn, list_transform(range(1, len(rn) + 1), lambda q: rn[q] + be * p[q]) FROM (
                   SELECT k, x, rn, p, CASE WHEN rr > 1e-280 THEN list_dot_product(rn, rn) / rr ELSE 0 END AS be FROM (
                       SELECT k, list_transform(range(1, len(x) + 1), lambda q: x[q] + al * p[q]) AS x, list_transform(range(1, len(r) + 1), lambda q: r[q] - al * ap[q]) AS rn, p, rr FROM (
                           SELECT k, x, r, p, ap, list_dot_product(r, r) AS rr, CASE WHEN list_dot_product(p, ap) > 1e-280 THEN list_dot_product(r, r) / list_dot_product(p, ap) ELSE 0 END AS al FROM (
                               SELECT k, x, r, p, list_transform(range(1, len(p) + 1), lambda q: list_dot_product(a[q], p)) AS ap FROM it, mat WHERE k < 60))))),
        fin AS (SELECT x AS w FROM it WHERE k = 60), sol AS (SELECT CAST(unnest(range(1, len(w) + 1)) AS INTEGER) AS i, unnest(w) AS w FROM fin)"""


_FISHER = _solved(
    f"{VECTORS_SQL}, {_MU}, {_COV}, nn AS (SELECT count(*)::DOUBLE AS n FROM vec), cs AS (SELECT i, j, c * n / (n - 2) AS c FROM cv, nn), tr AS (SELECT avg(c) AS t FROM cs WHERE i = j)",
    "SELECT i, j, c + CASE WHEN i = j THEN 1e-3::DOUBLE * (t + 1e-12::DOUBLE) ELSE 0 END AS a FROM cs, tr", "SELECT i, dl AS d FROM dl",
)
_RIDGE = _solved(
    f"{VECTORS_SQL}, nn AS (SELECT count(*)::DOUBLE AS n, sum(2 * y - 1)::DOUBLE AS t FROM vec), sm AS (SELECT i, sum(x) AS s, sum(x * (2 * y - 1)) AS xt FROM cells GROUP BY 1), gr AS (SELECT a.i, b.i AS j, sum(a.x * b.x) AS g FROM cells a JOIN cells b USING (vec_id) GROUP BY 1, 2)",
    "SELECT gr.i, gr.j, g - a.s * b.s / n + CASE WHEN gr.i = gr.j THEN 1.0::DOUBLE ELSE 0 END AS a FROM gr JOIN sm a ON a.i = gr.i JOIN sm b ON b.i = gr.j, nn", "SELECT i, xt - s * t / n AS d FROM sm, nn",
)
_L2STD = """l2 AS (SELECT vec_id, i, y, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 1e-8) AS x FROM cells),
    zc AS (SELECT vec_id, i, y, (x - avg(x) OVER (PARTITION BY i)) / greatest(stddev_pop(x) OVER (PARTITION BY i), 1e-6) AS x FROM l2)"""
_HEAD = _solved(
    f"{VECTORS_SQL}, {_L2STD}, {_MU.replace('FROM cells', 'FROM zc')}, {_COV.replace('cells', 'zc')}, tr AS (SELECT avg(c) AS t FROM cv WHERE i = j)",
    "SELECT i, j, 0.4::DOUBLE * c + CASE WHEN i = j THEN 0.6::DOUBLE * t ELSE 0 END AS a FROM cv, tr", "SELECT i, dl AS d FROM dl",
)


QUERIES = {
    "v01_row_l2": lambda s, d: _rows(_v(s, d).withColumn("v", V.row_l2("v"))),
    "v02_train_standardize": lambda s, d: _rows(standardize(_v(s, d), "v", center_and_scale(_v(s, d).filter("y = 1"), "v"))),
    "v03_batch_standardize": lambda s, d: _rows(standardize(_v(s, d), "v", center_and_scale(_v(s, d), "v", "family"), "family")),
    "v04_without_top": lambda s, d: _v(s, d).transform(lambda x: transform(x, "std+abtt1")).agg(F.count("*").alias("n"), rd(F.sum(V.dot("v", "v")), 4).alias("energy")),
    "v05_transforms": lambda s, d: s.createDataFrame([(k, a, b or "none", c) for k, (a, b, c) in TRANSFORMS.items()], "name string, row_l2 boolean, standardize string, remove_top int"),
    "v06_robust_scaling": lambda s, d: _rows(standardize(_v(s, d), "v", robust_moments(_v(s, d), "v"))),
    "w06_top_features": lambda s, d: top_features(_v(s, d), "v", "y", 5).select("i", rd("f", 5).alias("f")),
    "v08_anova_f": lambda s, d: anova_f(_v(s, d), "v", "y").select("i", rd("f", 5).alias("f")),
    "v09_information": lambda s, d: binned_information(_v(s, d), "v", "y").select("i", rd("mi").alias("mi")),
    "v10_raw_coordinates": lambda s, d: _v10(s, d),
    "v11_masked_mean": lambda s, d: cells(_v(s, d), "v", "family", "y").filter("y = 1").groupBy("family", "i").agg(rd(F.avg("x")).alias("mean")),
    "v12_last_token": lambda s, d: _v(s, d).groupBy("source").agg(F.max_by("v", "vec_id").alias("v"), F.max("vec_id").alias("vec_id")).select("source", "vec_id", rd(F.col("v")[0]).alias("first_cell")),
    "v13_unit": lambda s, d: _rows(_v(s, d).withColumn("v", V.unit("v"))),
    "v15_norm_profile": lambda s, d: _v(s, d).withColumn("len", V.norm("v")).groupBy("family", "y").agg(rd(F.avg("len")).alias("mean"), rd(F.stddev_samp("len")).alias("sd")),
    "v17_scores": lambda s, d: _v17(s, d),
    "a01_class_means": lambda s, d: dim_moments(_v(s, d), "v", "y").select("y", "i", rd("mean").alias("mean")),
    "a02_covariance": lambda s, d: _matrix(s, ClassStats.of(_v(s, d)).covariance()),
    "a03_mean_eigenvalue": lambda s, d: s.createDataFrame([(float(np.trace(c) / len(c)),) for c in [ClassStats.of(_v(s, d)).covariance()]], "value double").select(rd("value").alias("value")),
    "a04_class_moments": lambda s, d: dim_moments(_v(s, d), "v", "source", "y").select("source", "y", "i", rd("mean").alias("mean"), rd("var").alias("var")),
    "h01_shrunk_lda": lambda s, d: _as_cells(s, *shrunk_lda(ClassStats.of(_v(s, d)), 0.3)),
    "h02_mean_difference": lambda s, d: _as_cells(s, *mean_difference(ClassStats.of(_v(s, d)))),
    "h04_fisher": lambda s, d: _as_cells(s, fisher(ClassStats.of(_v(s, d)), 1e-3), 0.0),
    "h05_unit_difference": lambda s, d: _as_cells(s, (lambda x: x / np.linalg.norm(x))(ClassStats.of(_v(s, d)).delta), 0.0),
    "h10_ridge": lambda s, d: _as_cells(s, *ridge_classifier(ClassStats.of(_v(s, d)), 1.0)),
    "h11_auto_shrinkage": lambda s, d: s.createDataFrame([(auto_shrinkage(_v(s, d), ClassStats.of(_v(s, d))),)], "shrinkage double").select(rd("shrinkage", 5).alias("shrinkage")),
    "h13_most_frequent": lambda s, d: table(s, d, "corpus").filter("label in (0, 1)").agg(F.mode("label", True).alias("y")),
    "h14_fitted_head": lambda s, d: _as_cells(s, *shrunk_lda(ClassStats.of(transform(_v(s, d), "l2+std")), 0.6)),
}


def _matrix(s, m: np.ndarray) -> DataFrame:
    return s.createDataFrame([(i + 1, j + 1, float(x)) for (i, j), x in np.ndenumerate(m)], "i int, j int, c double").select("i", "j", rd("c", 5).alias("c"))


def _v10(s, d):
    v = _v(s, d)
    m = center_and_scale(v, "v").first()
    center, scale = np.array(m["center"]), np.array(m["scale"])
    w, b = mean_difference(ClassStats.of(standardize(v, "v", center_and_scale(v, "v"))))
    return _as_cells(s, *in_raw_coordinates(w, b, center, scale))


def _v17(s, d):
    w, b = mean_difference(ClassStats.of(_v(s, d)))
    return _v(s, d).select("vec_id", rd(V.dot("v", V.literal(w.tolist())) + F.lit(b), 5).alias("score"))


_STD_CELLS = "ms AS (SELECT i, avg(x) AS m, greatest(stddev_pop(x), 1e-6) AS sd FROM cells GROUP BY 1), sdc AS (SELECT vec_id, y, cells.i, (x - m) / sd AS x FROM cells JOIN ms USING (i))"
SQL = {
    "v01_row_l2": f"WITH {VECTORS_SQL}, {_L2} SELECT vec_id, {_MARK} FROM l2 GROUP BY 1",
    "v02_train_standardize": f"WITH {VECTORS_SQL}, ms AS (SELECT i, avg(x) AS m, greatest(stddev_pop(x), 1e-6) AS sd FROM cells WHERE y = 1 GROUP BY 1), z AS (SELECT vec_id, i, (x - m) / sd AS x FROM cells JOIN ms USING (i)) SELECT vec_id, {_MARK} FROM z GROUP BY 1",
    "v03_batch_standardize": f"WITH {VECTORS_SQL}, ms AS (SELECT family, i, avg(x) AS m, greatest(stddev_pop(x), 1e-6) AS sd FROM cells GROUP BY 1, 2), z AS (SELECT vec_id, i, (x - m) / sd AS x FROM cells JOIN ms USING (family, i)) SELECT vec_id, {_MARK} FROM z GROUP BY 1",
    "v05_transforms": "SELECT * FROM (VALUES ('raw', false, 'none', 0), ('std', false, 'train', 0), ('l2', true, 'none', 0), ('l2+std', true, 'train', 0), ('batchstd', false, 'batch', 0), ('l2+batchstd', true, 'batch', 0), ('std+abtt1', false, 'train', 1), ('std+abtt4', false, 'train', 4)) t(name, row_l2, standardize, remove_top)",
    "v08_anova_f": f"WITH {VECTORS_SQL}, p AS (SELECT y, i, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM cells GROUP BY 1, 2), g AS (SELECT i, count(*) AS k, sum(n) AS n, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS b FROM p GROUP BY 1) SELECT CAST(i AS INTEGER) AS i, round(((b - s * s / n) / (k - 1)) / ((q - b) / (n - k)), 5) AS f FROM g",
    "v06_robust_scaling": f"WITH {VECTORS_SQL}, ms AS (SELECT i, quantile_cont(x, 0.5) AS m, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS q FROM cells GROUP BY 1), z AS (SELECT vec_id, i, (x - m) / CASE WHEN q > 0 THEN q ELSE 1 END AS x FROM cells JOIN ms USING (i)) SELECT vec_id, {_MARK} FROM z GROUP BY 1",
    "w06_top_features": f"WITH {VECTORS_SQL}, p AS (SELECT y, i, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM cells GROUP BY 1, 2), g AS (SELECT i, count(*) AS k, sum(n) AS n, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS b FROM p GROUP BY 1), h AS (SELECT CAST(i AS INTEGER) AS dim, ((b - s * s / n) / (k - 1)) / ((q - b) / (n - k)) AS fv FROM g) SELECT dim AS i, round(fv, 5) AS f FROM h ORDER BY round(fv, 9) DESC, dim LIMIT 5",
    "v09_information": f"WITH {VECTORS_SQL}, e AS (SELECT i, min(x) AS lo, max(x) AS hi FROM cells GROUP BY 1), n AS (SELECT cells.i, y, least(15, floor(coalesce((x - lo) / nullif(hi - lo, 0), 0) * 16)) AS b, count(*) AS n FROM cells JOIN e USING (i) GROUP BY ALL), j AS (SELECT *, sum(n) OVER (PARTITION BY i) AS t, sum(n) OVER (PARTITION BY i, b) AS nb, sum(n) OVER (PARTITION BY i, y) AS ny FROM n) SELECT CAST(i AS INTEGER) AS i, round(sum(n::DOUBLE / t * ln(n::DOUBLE * t / (nb * ny))), 6) AS mi FROM j GROUP BY 1",
    "v10_raw_coordinates": f"WITH {VECTORS_SQL}, {_STD_CELLS}, q AS (SELECT i, avg(x) FILTER (WHERE y = 1) - avg(x) FILTER (WHERE y = 0) AS w, (avg(x) FILTER (WHERE y = 1) + avg(x) FILTER (WHERE y = 0)) / 2 AS mid FROM sdc GROUP BY 1), r AS (SELECT i, w / sd AS rw, -w * mid - m * w / sd AS b FROM q JOIN ms USING (i)) SELECT CAST(i AS INTEGER) AS i, round(rw, 5) AS w FROM r UNION ALL SELECT 0, round(sum(b), 5) FROM r",
    "v11_masked_mean": f"WITH {VECTORS_SQL} SELECT family, CAST(i AS INTEGER) AS i, round(avg(x), 6) AS mean FROM cells WHERE y = 1 GROUP BY 1, 2",
    "v12_last_token": f"WITH {VECTORS_SQL} SELECT source, vec_id, round(v[1], 6) AS first_cell FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY vec_id DESC) AS r FROM vec) WHERE r = 1",
    "v13_unit": f"WITH {VECTORS_SQL}, u AS (SELECT vec_id, i, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS x FROM cells) SELECT vec_id, {_MARK} FROM u GROUP BY 1",
    "v15_norm_profile": f"WITH {VECTORS_SQL}, u AS (SELECT family, y, vec_id, sqrt(sum(x * x)) AS len FROM cells GROUP BY 1, 2, 3) SELECT family, y, round(avg(len), 6) AS mean, round(stddev_samp(len), 6) AS sd FROM u GROUP BY 1, 2",
    "v17_scores": f"WITH {VECTORS_SQL}, {_MU}, b AS (SELECT -sum(dl * mid) AS b FROM dl) SELECT vec_id, round(sum(x * dl) + any_value(b), 5) AS score FROM cells JOIN dl USING (i), b GROUP BY 1",
    "a01_class_means": f"WITH {VECTORS_SQL} SELECT y, CAST(i AS INTEGER) AS i, round(avg(x), 6) AS mean FROM cells GROUP BY 1, 2",
    "a02_covariance": f"WITH {VECTORS_SQL}, {_MU}, {_COV} SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(c, 5) AS c FROM cv",
    "a03_mean_eigenvalue": f"WITH {VECTORS_SQL}, {_MU}, {_COV} SELECT round(avg(c), 6) AS value FROM cv WHERE i = j",
    "a04_class_moments": f"WITH {VECTORS_SQL} SELECT source, y, CAST(i AS INTEGER) AS i, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS var FROM cells GROUP BY 1, 2, 3",
    "h01_shrunk_lda": _lda_sql(0.3) + " SELECT CAST(q AS INTEGER) AS i, round(w[q], 5) AS w FROM fin, range(1, 17) t(q) UNION ALL SELECT 0, round(-sum(w[dl.i] * mid), 5) FROM fin, dl",
    "h04_fisher": f"{_FISHER} SELECT i, round(w / (SELECT sqrt(sum(w * w)) FROM sol), 5) AS w FROM sol UNION ALL SELECT 0, 0.0",
    "h10_ridge": f"{_RIDGE} SELECT i, round(w, 5) AS w FROM sol UNION ALL SELECT 0, round((any_value(t) - sum(w * s)) / any_value(n), 5) FROM sol JOIN sm USING (i), nn",
    "h14_fitted_head": f"{_HEAD} SELECT i, round(w, 5) AS w FROM sol UNION ALL SELECT 0, round(-sum(w * mid), 5) FROM sol JOIN dl USING (i)",
    "h11_auto_shrinkage": f"WITH {VECTORS_SQL}, {_MU}, {_COV}, d AS (SELECT max(i)::DOUBLE AS d FROM cv), tm AS (SELECT avg(c) AS t FROM cv WHERE i = j), sq AS (SELECT vec_id, sum((x - m) * (x - m)) AS q FROM cells JOIN mu USING (y, i) GROUP BY 1), f AS (SELECT sum(q * q) AS f, count(*)::DOUBLE AS n FROM sq), e AS (SELECT sum(power(c - CASE WHEN i = j THEN t ELSE 0 END, 2)) / any_value(d) AS delta, sum(c * c) AS c2 FROM cv, tm, d) SELECT round(CASE WHEN delta > 0 THEN least((f / n - c2) / d / n, delta) / delta ELSE 1 END, 5) AS shrinkage FROM e, f, d",
    "h02_mean_difference": f"WITH {VECTORS_SQL}, {_MU} SELECT CAST(i AS INTEGER) AS i, round(dl, 5) AS w FROM dl UNION ALL SELECT 0, round(-sum(dl * mid), 5) FROM dl",
    "h05_unit_difference": f"WITH {VECTORS_SQL}, {_MU}, l AS (SELECT sqrt(sum(dl * dl)) AS l FROM dl) SELECT CAST(i AS INTEGER) AS i, round(dl / l, 5) AS w FROM dl, l UNION ALL SELECT 0, 0.0",
    "h13_most_frequent": "SELECT label AS y FROM corpus WHERE label IN (0, 1) GROUP BY 1 ORDER BY count(*) DESC, label LIMIT 1",
}
