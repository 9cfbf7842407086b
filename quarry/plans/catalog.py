"""Query name -> Spark function (spark, sf_dir), and query name -> SQL over the same tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import vector as V
from quarry.functions.tables import new_path
from quarry.operators import histogram, kmeans, knn, matrix, runlog, svm
from quarry.operators.tiles import TiledMatrix
from quarry.plans.registry import ORACLES, QUERIES, query
from quarry.plans.registry import bigints as _bigints
from quarry.plans.registry import points as _points
from quarry.plans.registry import rounded as _r
from quarry.plans.registry import table as _table
from quarry.plans.sql import BASE, RUNS, lloyd
from quarry.sources import generate, runs as run_source

__all__ = ["ORACLES", "QUERIES"]

# ---------------------------------------------------------------- histograms

_BIN = "case when {x} = 0.6::double then 3 else cast(floor(({x} + 0.6::double) / 0.3::double) as bigint) end"
_HIST = f"select {', '.join(f'({_BIN.format(x=f'v[{i + 1}]')}) b{i}' for i in range(5))}, vec_id % 8 blk from (select vec_id, embedding::double[] v from embeddings) where {' and '.join(f'v[{i + 1}] between -0.6::double and 0.6::double' for i in range(5))}"
_B5 = "b0, b1, b2, b3, b4"


def _five():
    return [F.get("features", F.lit(i)) for i in range(5)]


@query(f"select {_B5}, count(*) cnt from ({_HIST}) group by {_B5}")
def hist_nd(spark, d):
    return _bigints(histogram.histogram(_points(spark, d), _five(), 4, -0.6, 0.6))


@query(
    f"with h as (select {_B5}, count(*) cnt from ({_HIST}) group by {_B5}), g as (select n, n % 4 b0, n // 4 % 4 b1, n // 16 % 4 b2, n // 64 % 4 b3, n // 256 % 4 b4 from (select unnest(range(1024)) n)) "
    "select g.b0, g.b1, g.b2, g.b3, g.b4, coalesce(h.cnt, 0) cnt from g left join h using (b0, b1, b2, b3, b4)"
)
def hist_nd_dense(spark, d):
    return _bigints(histogram.dense(histogram.histogram(_points(spark, d), _five(), 4, -0.6, 0.6), 4))


@query(f"select {_B5}, count(*) cnt from ({_HIST}) group by {_B5}")
def hist_block_partial_merge(spark, d):
    rows = _points(spark, d).withColumn("blk", F.col("row_id") % 8)
    return _bigints(histogram.merged(histogram.histogram(rows, _five(), 4, -0.6, 0.6, by=["blk"])))


_SCALED = "(select (l_quantity - q0) / (q1 - q0) q, (l_discount - d0) / (d1 - d0) d, (l_tax - t0) / (t1 - t0) t from lineitem, (select min(l_quantity) q0, max(l_quantity) q1, min(l_discount) d0, max(l_discount) d1, min(l_tax) t0, max(l_tax) t1 from lineitem))"
_UNIT = "case when {x} = 1 then 3 else cast(floor({x} / 0.25::double) as bigint) end"


@query(f"select b0, b1, b2, count(*) cnt from (select {_UNIT.format(x='q')} b0, {_UNIT.format(x='d')} b1, {_UNIT.format(x='t')} b2 from {_SCALED}) group by 1, 2, 3")
def hist_lineitem_3d(spark, d):
    rows = _table(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax")
    r = rows.agg(*[f(c).alias(f"{c}_{n}") for c in rows.columns for n, f in (("lo", F.min), ("hi", F.max))]).first()
    scaled = [(F.col(c) - r[f"{c}_lo"]) / (r[f"{c}_hi"] - r[f"{c}_lo"]) for c in rows.columns]
    return _bigints(histogram.histogram(rows, scaled, 4))


_CELLS = "select l_orderkey, l_linenumber, [l_quantity, l_discount, l_tax] v from lineitem"


@query(f"with c as ({_CELLS}), m as (select min(list_min(v)) lo, max(list_max(v)) hi from c) select l_orderkey, l_linenumber, round((v[1] - lo) / (hi - lo), 6) q, round((v[2] - lo) / (hi - lo), 6) d, round((v[3] - lo) / (hi - lo), 6) t from c, m")
def minmax_scale_global(spark, d):
    rows = _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array("l_quantity", "l_discount", "l_tax").alias("features"))
    s = generate.min_max_scaled(rows)
    return s.select("l_orderkey", "l_linenumber", *[_r(F.get("features", F.lit(i))).alias(n) for i, n in enumerate("qdt")])


@query("select 96::bigint n, 96::bigint total union all select 192, 192")
def reduction_count_ones(spark, d):
    parts = [spark.range(n).agg(F.count("*").alias("n"), F.sum(F.lit(1).cast("bigint")).alias("total")) for n in (96, 192)]
    return parts[0].unionByName(parts[1])


# ---------------------------------------------------------------- k-means


def _start(points: DataFrame, k: int = 8) -> list[list[float]]:
    return [r["features"] for r in points.where(F.col("row_id") < k).orderBy("row_id").collect()]


@query(lloyd(0) + "select vec_id row_id, k, round(dist, 6) dist from a0")
def kmeans_assign(spark, d):
    p = _points(spark, d)
    return kmeans.assign(p, _start(p)).select("row_id", F.col("k").cast("bigint").alias("k"), _r("dist").alias("dist"))


@query(lloyd(0) + "select k, pos, round(sum(x), 6) sum, count(*) n from e0 group by k, pos")
def kmeans_partial_sum(spark, d):
    p = _points(spark, d)
    s = kmeans.partial_sums(p, _start(p))
    return s.select(F.col("k").cast("bigint").alias("k"), F.col("pos").cast("bigint").alias("pos"), _r("sum").alias("sum"), "n")


def _center_table(spark, centers) -> DataFrame:
    return spark.createDataFrame([(k, j, float(x)) for k, c in enumerate(centers) for j, x in enumerate(c)], "k bigint, pos bigint, x double").select("k", "pos", _r("x").alias("x"))


@query(lloyd(1) + "select k, pos, round(x, 6) x from c1")
def kmeans_step(spark, d):
    p = _points(spark, d)
    start = _start(p)
    return _center_table(spark, kmeans.recompute(kmeans.partial_sums(p, start), start))


@query(lloyd(3) + "select k, pos, round(x, 6) x from c3")
def kmeans_fit_3(spark, d):
    p = _points(spark, d)
    return _center_table(spark, kmeans.KMeans(init=_start(p), max_iter=3).fit(p).centers)


@query(lloyd(1) + "select round(sum(sqrt(s)), 6) shift from (select k, sum((c1.x - c0.x) * (c1.x - c0.x)) s from c0 join c1 using (k, pos) group by k)")
def kmeans_shift(spark, d):
    p = _points(spark, d)
    start = _start(p)
    moved = kmeans.shift(start, kmeans.recompute(kmeans.partial_sums(p, start), start))
    return spark.createDataFrame([(moved,)], "shift double").select(_r("shift").alias("shift"))


def _far(spark, d, empty: str) -> DataFrame:
    p = _points(spark, d)
    start = [*_start(p, 3), [100.0] * 64]
    return _center_table(spark, kmeans.recompute(kmeans.partial_sums(p, start), start, empty))


_FAR = lloyd(1, "select k, pos, x from (select vec_id k, unnest(range(64)) pos, unnest(v) x from pts where vec_id < 3) union all select 3, pos, 100.0::double from (select unnest(range(64)) pos)")


@query(_FAR + "select k, pos, round(x, 6) x from c1")
def kmeans_empty_keep(spark, d):
    return _far(spark, d, "keep")


@query(_FAR + "select k, pos, round(avg(x), 6) x from e0 group by k, pos")
def kmeans_empty_drop(spark, d):
    return _far(spark, d, "drop")


@query(lloyd(0) + "select round(sum(dist * dist), 6) inertia from a0")
def kmeans_inertia(spark, d):
    p = _points(spark, d)
    return kmeans.assign(p, _start(p)).agg(_r(F.sum(F.col("dist") * F.col("dist"))).alias("inertia"))


# ---------------------------------------------------------------- nearest neighbours

_DIST = "sqrt(list_sum(list_transform(range(1, {n} + 1), lambda i: (q.v[i] - f.v[i]) * (q.v[i] - f.v[i]))))"
_KNN = BASE + ", " + f"p as (select q.vec_id query_id, f.vec_id neighbor_id, {_DIST.format(n=64)} dist from pts q, pts f where q.vec_id < 50), r as (select *, row_number() over (partition by query_id order by dist, neighbor_id) rnk from p) "


#: The queries of the searches over whole tables, which have no SQL: a cross product of this size is too slow.
_ASKED = "row_id % 20 = 0"


def _neighbours(spark, d, k: int = 5, asked: str = "row_id < 50") -> DataFrame:
    p = _points(spark, d)
    return knn.NearestNeighbors(k).fit(p).kneighbors(p.where(asked))


def _merged(spark, d, asked: str) -> DataFrame:
    p = _points(spark, d)
    parts = [knn.NearestNeighbors(5).fit(p.where(F.col("row_id") % 4 == b)).kneighbors(p.where(asked)).drop("rank") for b in range(4)]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return knn.merge(whole, 5).select("query_id", "neighbor_id", "dist", "rank")


def _rotated(spark, d, asked: str) -> DataFrame:
    p = _points(spark, d).select("row_id", V.rotate(F.slice("features", 1, 3), _ROTATION).alias("features"))
    return knn.NearestNeighbors(5).fit(p).kneighbors(p.where(asked)).drop("neighbor_id")


def _ranked(df: DataFrame) -> DataFrame:
    cols = [c for c in df.columns if c not in ("rank", "dist")]
    return df.select(*cols, F.col("rank").cast("bigint").alias("rnk"), *([_r("dist").alias("dist")] if "dist" in df.columns else []))


@query(_KNN + "select query_id, neighbor_id, rnk, round(dist, 6) dist from r where rnk <= 5")
def knn_exact(spark, d):
    return _ranked(_neighbours(spark, d))


@query(_KNN + "select query_id, neighbor_id, rnk from r where rnk <= 5")
def knn_ids_only(spark, d):
    p = _points(spark, d)
    return _ranked(knn.NearestNeighbors(5).fit(p).kneighbors(p.where("row_id < 50"), return_distance=False))


@query(_KNN + "select query_id, neighbor_id, rnk, round(dist, 6) dist from r where rnk <= 5")
def knn_block_merge(spark, d):
    return _ranked(_merged(spark, d, "row_id < 50"))


_ROTATION = [[0.36, 0.48, -0.8], [-0.8, 0.6, 0.0], [0.48, 0.64, 0.6]]
_KNN3 = BASE + ", " + f"p as (select q.vec_id query_id, f.vec_id neighbor_id, {_DIST.format(n=3)} dist from pts q, pts f where q.vec_id < 50), r as (select *, row_number() over (partition by query_id order by dist, neighbor_id) rnk from p) "


@query(_KNN3 + "select query_id, rnk, round(dist, 6) dist from r where rnk <= 5")
def knn_rotated(spark, d):
    return _ranked(_rotated(spark, d, "row_id < 50"))


@query()
def knn_exact_whole(spark, d):
    return _ranked(_neighbours(spark, d, asked=_ASKED))


@query()
def knn_ids_only_whole(spark, d):
    return _ranked(_neighbours(spark, d, asked=_ASKED).drop("dist"))


@query()
def knn_block_merge_whole(spark, d):
    return _ranked(_merged(spark, d, _ASKED))


@query()
def knn_rotated_whole(spark, d):
    return _ranked(_rotated(spark, d, _ASKED))


@query(BASE + "select blk, n, coalesce(sum(n) over (order by blk rows between unbounded preceding and 1 preceding), 0)::bigint start from (select vec_id % 8 blk, count(*) n from pts group by 1)")
def row_offsets(spark, d):
    from pyspark.sql import Window

    blocks = _points(spark, d).groupBy((F.col("row_id") % 8).alias("blk")).agg(F.count("*").alias("n"))
    before = Window.orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("bigint"))


@query(BASE + "select vec_id row_id, vec_id % 8 blk, row_number() over (partition by vec_id % 8 order by vec_id) - 1 rn from pts")
def local_row_number(spark, d):
    rows = _points(spark, d).select("row_id", (F.col("row_id") % 8).alias("blk"))
    return runlog.numbered(rows, [F.col("blk"), F.col("row_id")], "rn", ["blk"]).withColumn("rn", F.col("rn") - 1)


# ---------------------------------------------------------------- matrices

_COO = BASE + ", a as (select vec_id i, unnest(range(64)) j, unnest(v) x from pts) "


def _cells(spark, d) -> DataFrame:
    return matrix.coordinates(_points(spark, d)).withColumn("j", F.col("j").cast("bigint"))


@query(_COO + "select j, round(sqrt(sum(x * x)), 6) norm from a group by j")
def col_norms(spark, d):
    return matrix.column_norms(_cells(spark, d)).select("j", _r("norm").alias("norm"))


@query(_COO + "select p.j i, q.j j, round(sum(p.x * q.x), 6) x from a p join a q on p.i = q.i group by 1, 2")
def gram(spark, d):
    g = matrix.gram(_points(spark, d))
    return g.select(F.col("i").cast("bigint").alias("i"), F.posexplode("row").alias("j", "x")).select("i", F.col("j").cast("bigint").alias("j"), _r("x").alias("x"))


@query(_COO + "select p.j i, q.j j, round(sum(p.x * q.x), 6) x from a p join a q on p.i = q.i where p.i < 100 group by 1, 2")
def matmul_small(spark, d):
    c = _cells(spark, d).where("i < 100")
    return matrix.matmul(matrix.transpose(c), c).select("i", "j", _r("x").alias("x"))


@query(ORACLES["gram"])
def matmul_whole(spark, d):
    """By tiles: a coordinate product would make as many rows of each row as it has cells squared."""
    x = TiledMatrix.of_rows(_points(spark, d))
    return x.transpose().matmul(x).cells().select("i", "j", _r("x").alias("x"))


@query(_COO + "select j i, i j, round(x, 6) x from a")
def transpose_coo(spark, d):
    return matrix.transpose(_cells(spark, d)).select("i", "j", _r("x").alias("x"))


@query(_COO + ", z as (select i, j, case when j = 3 then 0 else x end x from a), n as (select j, sqrt(sum(x * x)) norm from z group by j) select i, j, round(case when norm = 0 then (case when i = 0 then 1 else 0 end) else x / norm end, 6) x from z join n using (j)")
def unit_columns(spark, d):
    z = _cells(spark, d).withColumn("x", F.when(F.col("j") == 3, 0.0).otherwise(F.col("x")))
    return matrix.unit_columns(z).select("i", "j", _r("x").alias("x"))


@query(_COO + "select i, j, round(2 * x, 6) x from a")
def block_add(spark, d):
    c = _cells(spark, d)
    return matrix.add(c, c).select("i", "j", _r("x").alias("x"))


@query(BASE + "select count(*) row_count, 2::bigint ndim, count(*) * 64 size, count(*) * 512 nbytes from pts")
def block_shape(spark, d):
    r = _points(spark, d).agg(F.count("*").alias("row_count"), F.sum(F.size("features")).alias("size"))
    return r.select("row_count", F.lit(2).cast("bigint").alias("ndim"), "size", (F.col("size") * 8).alias("nbytes"))


@query(BASE + "select vec_id row_id, round(v[3], 6) x from pts where vec_id between 10 and 19")
def block_slice(spark, d):
    return _points(spark, d).where("row_id between 10 and 19").select("row_id", _r(F.get("features", F.lit(2))).alias("x"))


@query(_COO + "select round(sum(x * x), 6) energy from a")
def svd_energy(spark, d):
    _, s, _ = matrix.svd(_points(spark, d), sort=True)
    return spark.createDataFrame([(float((s**2).sum()),)], "energy double").select(_r("energy").alias("energy"))


def _factors(spark, d, method: str):
    """Rows, u, s and v (an array; 64 columns here) of the decomposition."""
    p = _points(spark, d)
    if method == "gram":
        return p, *matrix.svd(p)
    u, s, v = matrix.panel_svd(p, block=16)
    return p, u, s, np.array([r["features"] for r in v.orderBy("row_id").collect()])


def _recon(spark, d, method: str) -> DataFrame:
    p, u, s, v = _factors(spark, d, method)
    back = (s[:, None] * v.T).tolist()
    both = p.join(u.withColumnRenamed("features", "u"), "row_id")
    diff = V.squared_distance(F.col("features"), V.rotate(F.col("u"), back))
    return both.agg(_r(F.sqrt(F.sum(diff)) + 0.0).alias("error"))


@query("select 0.0::double error")
def svd_recon_error(spark, d):
    return _recon(spark, d, "gram")


@query("select 0.0::double error")
def svd_jacobi_recon_error(spark, d):
    return _recon(spark, d, "jacobi")


def _off_identity(products: DataFrame, method: str, name: str) -> DataFrame:
    """The largest difference of rows (i, row) from the unit matrix."""
    cells = products.select("i", F.posexplode("row").alias("j", "x"))
    return cells.agg(_r(F.max(F.abs(F.col("x") - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)))).alias("error")).select(F.lit(method).alias("method"), F.lit(name).alias("factor"), "error")


@query("select * from (values ('gram', 'u', 0.0::double), ('gram', 'v', 0.0::double), ('jacobi', 'u', 0.0::double), ('jacobi', 'v', 0.0::double)) t(\"method\", factor, error)")
def svd_orthogonality(spark, d):
    out = []
    for method in ("gram", "jacobi"):
        _, u, _, v = _factors(spark, d, method)
        square = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(v.T @ v)], "i int, row array<double>")
        out += [_off_identity(matrix.gram(u), method, "u"), _off_identity(square, method, "v")]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query(_COO + ", g as (select p.j i, q.j j, sum(p.x * q.x) x from a p join a q on p.i = q.i group by 1, 2) select round(sum(x * x), 4) power from g")
def svd_fourth_powers(spark, d):
    """The sum of the fourth powers of the singular values, which only the true ones have."""
    _, s, _ = matrix.panel_svd(_points(spark, d), block=16)
    return spark.createDataFrame([(float((s**4).sum()),)], "power double").select(_r("power", 4).alias("power"))


# ---------------------------------------------------------------- support vector machines


@query(BASE + f"select q.vec_id a, f.vec_id b, round(exp(-0.5::double * pow({_DIST.format(n=64)}, 2)), 6) k from pts q, pts f where q.vec_id < 20 and f.vec_id < 20")
def rbf_kernel(spark, d):
    p = _points(spark, d).where("row_id < 20")
    return svm.kernel_table(p, p, 0.5).select("a", "b", _r("k").alias("k"))


@query()
def rbf_kernel_whole(spark, d):
    p = _points(spark, d)
    return svm.kernel_table(p.where(_ASKED), p, 0.5).select("a", "b", _r("k").alias("k"))


@query(BASE + "select vec_id row_id, round(list_sum(list_transform(range(1, 65), lambda i: v[i] * (i % 5 - 2))) + 0.25::double, 6) score from pts")
def linear_decision(spark, d):
    w = V.literal([(i % 5) - 2 for i in range(1, 65)])
    return _points(spark, d).select("row_id", _r(V.dot(F.col("features"), w) + 0.25).alias("score"))


@query(
    BASE + ", f as (select * from pts where vec_id % 5 <> 0), q as (select * from pts where vec_id % 5 = 0), "
    f"p as (select q.vec_id qid, q.label truth, f.label guess, row_number() over (partition by q.vec_id order by {_DIST.format(n=64)}, f.vec_id) rn from q, f), "
    "c as (select qid, truth, guess, count(*) n from p where rn <= 5 group by all), v as (select qid, truth, guess, row_number() over (partition by qid order by n desc, guess) rn from c) "
    "select truth::bigint \"label\", guess::bigint prediction, count(*) n from v where rn = 1 group by 1, 2"
)
def confusion_matrix(spark, d):
    return svm.confusion(_voted(spark, d))


def _voted(spark, d) -> DataFrame:
    """label and prediction of every fifth row, by the five nearest others."""
    from pyspark.sql import Window

    p = _points(spark, d)
    near = knn.NearestNeighbors(5).fit(p.where("row_id % 5 <> 0")).kneighbors(p.where("row_id % 5 = 0"))
    votes = near.join(p.select(F.col("row_id").alias("neighbor_id"), F.col("label").alias("prediction")), "neighbor_id").groupBy("query_id", "prediction").agg(F.count("*").alias("n"))
    won = votes.withColumn("rn", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), "prediction"))).where("rn = 1")
    return won.join(p.select(F.col("row_id").alias("query_id"), "label"), "query_id").select(F.col("label").cast("bigint").alias("label"), F.col("prediction").cast("bigint").alias("prediction"))


@query()
def svm_ovr_predict(spark, d):
    from pyspark.ml.functions import array_to_vector

    p = _points(spark, d)
    model = svm.one_against_rest(p.where("row_id % 5 <> 0"))
    asked = p.where("row_id % 5 = 0").select("row_id", F.col("label").cast("bigint").alias("truth"), array_to_vector("features").alias("vec"))
    return model.transform(asked).select("row_id", "truth", F.col("prediction").cast("bigint").alias("prediction"))


@query()
def svm_cascade_predict(spark, d):
    p = _points(spark, d)
    model = svm.CascadeSVM(cascade_arity=4, gamma=4.0).fit(p.where("row_id % 5 <> 0"))
    return model.predict(p.where("row_id % 5 = 0")).join(p.select("row_id", F.col("label").alias("truth")), "row_id")


@query("select 1000::bigint n, true as good")
def svm_cascade_accuracy(spark, d):
    """Fifteen clusters of another seed, of which the cascade names at least 19 in 20 rightly."""
    model = svm.CascadeSVM(cascade_arity=4, gamma=0.02, max_iter=2, check_convergence=True).fit(generate.blobs(spark, 1500))
    asked = generate.blobs(spark, 1000, seed=41)
    found = model.predict(asked).join(asked.select("row_id", "label"), "row_id")
    return found.agg(F.count("*").alias("n"), (F.avg((F.col("label") == F.col("prediction")).cast("int")) >= 0.95).alias("good"))


@query(ORACLES["confusion_matrix"].replace("select truth::bigint", "select l.l::bigint").replace("guess::bigint prediction, count(*) n from v where rn = 1 group by 1, 2", "g.l::bigint prediction, count(v.truth) n from (select distinct label l from pts) l cross join (select distinct label l from pts) g left join v on v.rn = 1 and v.truth = l.l and v.guess = g.l group by 1, 2"))
def confusion_dense(spark, d):
    p = _points(spark, d)
    classes = [r["label"] for r in p.select("label").distinct().orderBy("label").collect()]
    return svm.dense_confusion(_voted(spark, d), classes)


@query()
def blobs(spark, d):
    return generate.blobs(spark, 2000)


# The measured seconds of the decomposition by computing units.
@query("select 1::int as units, 297.690502::double as \"seconds\" union all select 4, 312.43694 union all select 8, 305.687114 union all select 24, 632.755799")
def literal_timings(spark, d):
    return generate.seconds_of(spark, {1: 297.690502, 4: 312.43694, 8: 305.687114, 24: 632.755799})


# ---------------------------------------------------------------- run log


def _runs(spark, d) -> DataFrame:
    """A run log made from events: one run a user and event type."""
    e = _table(spark, d, "events")
    t = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "error", 1).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "signup", 3).otherwise(4)
    g = e.groupBy((F.col("user_id") * 10 + t).alias("id")).agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("finish_ts"), F.avg("value").alias("initialization_time"), F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda x: x["value"]).alias("l")
    )
    i = F.col("id")
    w = F.get(F.array(*[F.lit(x).cast("bigint") for x in (1, 2, 4, 8, 16)]), (i % 5).cast("int"))
    g = g.withColumn("nodes", w + 1)
    even = i % 2 == 0
    return g.select(
        "id", "start_ts", "finish_ts", "initialization_time", "nodes",
        F.when(i % 17 == 0, 1).otherwise(0).cast("bigint").alias("tracing"), F.when(i % 3 != 0, 1).otherwise(0).cast("bigint").alias("dataclay"), F.when(i % 19 == 0, F.lit(None)).when(i % 3 == 2, 1).otherwise(0).cast("bigint").alias("use_split"),
        F.when(i % 7 == 0, F.lit(None)).when(i % 7 == 1, 0).otherwise(1).cast("bigint").alias("copy_fit_struct"),
        F.when(even, 64000).otherwise(3072000).cast("bigint").alias("points_per_fragment"), ((F.col("nodes") - 1) * F.when(even, 2304).otherwise(48)).cast("bigint").alias("number_of_fragments"),
        F.when(i % 11 == 0, F.lit(None)).when(i % 13 == 0, F.array().cast("array<double>")).otherwise(F.col("l")).alias("iteration_time"),
    )


_MODE = "case when dataclay = 0 then 'COMPSs' when use_split = 0 then 'dataClay' when use_split = 1 then 'dataClay+split' end"
_PRE = RUNS + f", m as (select *, {_MODE} mode from runs where tracing = 0) "
_LONG = _PRE + ", x as (select m.*, t from m left join lateral (select unnest(iteration_time) t) on true) "
_KEYS = ["mode", "nodes", "points_per_fragment"]
_K = ", ".join(_KEYS)
_WIN = _LONG + f", y as (select *, count(t) over (partition by {_K}) n, row_number() over (partition by {_K} order by t nulls last) rn from x), z as (select *, max(case when rn = n - floor(n * 0.1) then t end) over (partition by {_K}) cap from y), w as (select * replace (case when n >= 5 and t is not null and mode is not null then least(t, cap) else t end as t) from z) "


def _mode(spark, d) -> DataFrame:
    return runlog.with_mode(_runs(spark, d))


def _long(spark, d) -> DataFrame:
    return runlog.exploded(_mode(spark, d), "iteration_time").withColumnRenamed("iteration_time", "t")


def _clamped(spark, d) -> DataFrame:
    return runlog.winsorized(_long(spark, d), "t", _KEYS)


@query(_PRE + "select id, mode from m")
def runlog_mode(spark, d):
    return _mode(spark, d).select("id", "mode")


@query(_PRE + "select id, case when dataclay = 1 and copy_fit_struct is distinct from 0 then 1 else copy_fit_struct end copy_fit_struct from m")
def runlog_default_copy(spark, d):
    return runlog.default_copy(_mode(spark, d)).select("id", F.col("copy_fit_struct").cast("bigint").alias("copy_fit_struct"))


@query(_PRE + "select id, case when dataclay = 1 and copy_fit_struct = 0 then mode || '[no copy]' else mode end mode from m")
def runlog_suffix(spark, d):
    return runlog.with_suffix(runlog.default_copy(_mode(spark, d))).select("id", "mode")


@query(_PRE + "select id, mode || case when dataclay = 1 then (case when use_split = 1 then '[active]' else '[non-active]' end) else '' end mode from m")
def runlog_suffix_active(spark, d):
    rows = _mode(spark, d).drop("copy_fit_struct").withColumn("use_active", F.col("use_split"))
    return runlog.with_suffix(rows).select("id", "mode")


@query(RUNS + "select id from runs where id not in (10, 21, 32, 43)")
def runlog_anti_outliers(spark, d):
    return runlog.without(_runs(spark, d), [10, 21, 32, 43]).select("id")


@query(RUNS + "select id, start_ts from runs where start_ts > timestamp '2024-01-02'")
def runlog_ts_filter(spark, d):
    return _runs(spark, d).where("start_ts > timestamp_ntz'2024-01-02'").select("id", "start_ts")


@query(RUNS + "select id from runs where id < 200 or id > 500")
def runlog_id_ranges(spark, d):
    return _runs(spark, d).where("id < 200 or id > 500").select("id")


@query(RUNS + "select id, nodes from runs where number_of_fragments = 2304 * (nodes - 1) and points_per_fragment = 64000 and nodes <= 9")
def runlog_scaling_filter(spark, d):
    return _runs(spark, d).where("number_of_fragments = 2304 * (nodes - 1) and points_per_fragment = 64000 and nodes <= 9").select("id", "nodes")


@query(RUNS + "select id, nodes, points_per_fragment from runs where copy_fit_struct is distinct from 0 and number_of_fragments < 5000")
def runlog_project(spark, d):
    rows = _runs(spark, d).where(~F.col("copy_fit_struct").eqNullSafe(F.lit(0)) & (F.col("number_of_fragments") < 5000))
    return runlog.keep_columns(rows, ["id", "nodes", "points_per_fragment", "absent"])


@query(RUNS + "select id, nodes - 1 workers from runs")
def runlog_workers(spark, d):
    return _runs(spark, d).select("id", (F.col("nodes") - 1).alias("workers"))


@query(RUNS + "select id, floor(number_of_fragments / 384)::bigint granularity, floor(number_of_fragments / 384)::bigint::varchar || 'x' name from runs")
def runlog_granularity(spark, d):
    g = runlog.granularity(F.col("number_of_fragments"))
    return _runs(spark, d).select("id", g.alias("granularity"), F.format_string("%dx", g).alias("name"))


@query(_LONG + "select id, round(t, 6) t from x")
def runlog_explode(spark, d):
    return _long(spark, d).select("id", _r("t").alias("t"))


@query(RUNS + "select id, round(list_avg(iteration_time), 6) mean, round(list_stddev_pop(iteration_time), 6) std, round(list_min(iteration_time), 6) low from runs where len(iteration_time) > 0")
def runlog_list_stats(spark, d):
    rows = _runs(spark, d).where("size(iteration_time) > 0")
    l, n = F.col("iteration_time"), F.size("iteration_time")
    mean = V.total(l) / n
    var = V.total(F.transform(l, lambda x: (x - mean) * (x - mean))) / n
    return rows.select("id", _r(mean).alias("mean"), _r(F.sqrt(var)).alias("std"), _r(F.array_min(l)).alias("low"))


@query(_WIN + "select id, round(t, 6) t from w")
def runlog_winsorize(spark, d):
    return _clamped(spark, d).select("id", _r("t").alias("t"))


@query(_LONG + f"select {_K}, round(avg(t), 6) t from x where mode is not null group by {_K}")
def runlog_group_mean(spark, d):
    m = runlog.group_mean(_long(spark, d), "t", _KEYS)
    return m.select(*_KEYS, _r("t").alias("t"))


@query(_LONG + "select mode, nodes, round(avg(t), 6) mean, round(stddev_samp(t), 6) std, round(min(t), 6) low, round(max(t), 6) high, count(t) n from x group by 1, 2")
def runlog_agg_multi(spark, d):
    return _long(spark, d).groupBy("mode", "nodes").agg(_r(F.avg("t")).alias("mean"), _r(F.stddev_samp("t")).alias("std"), _r(F.min("t")).alias("low"), _r(F.max("t")).alias("high"), F.count("t").alias("n"))


@query(_LONG + "select mode, round(quantile_cont(t, 0.25), 6) q1, round(quantile_cont(t, 0.5), 6) median, round(quantile_cont(t, 0.75), 6) q3, round(min(t), 6) low, round(max(t), 6) high from x group by 1")
def runlog_quartiles(spark, d):
    q = runlog.quartiles(_long(spark, d), "t", ["mode"])
    return q.select("mode", *[_r(c).alias(c) for c in ("q1", "median", "q3", "low", "high")])


@query(_LONG + ", g as (select unnest([0.0, 10.0, 20.0, 50.0, 100.0]::double[]) x) select mode, g.x x, round(avg(exp(-((g.x - t) / 10) * ((g.x - t) / 10) / 2) / (10 * sqrt(2 * pi()))), 6) density from x, g where t is not null group by 1, 2")
def runlog_kde_grid(spark, d):
    return runlog.density(_long(spark, d), "t", ["mode"], [0, 10, 20, 50, 100], 10.0).select("mode", "x", _r("density").alias("density"))


@query(_PRE + f"select distinct {_K} from m")
def runlog_distinct_configs(spark, d):
    return _mode(spark, d).select(*_KEYS).distinct()


@query(_PRE + "select id, mode, row_number() over (order by mode nulls last, id) rn from m")
def runlog_sorted(spark, d):
    return runlog.numbered(_mode(spark, d).select("id", "mode"), [F.asc_nulls_last("mode"), F.col("id")], "rn")


@query(_LONG + ", g as (select nodes, mode, avg(t) t from x where mode is not null group by 1, 2) select nodes, mode, round(nodes / t, 6) speedup from g")
def runlog_speedup(spark, d):
    g = runlog.group_mean(_long(spark, d), "t", ["nodes", "mode"])
    return g.select("nodes", "mode", _r(F.col("nodes") / F.col("t")).alias("speedup"))


@query(_LONG + ", g as (select nodes, mode, avg(t) t from x where mode is not null group by 1, 2) select g.nodes nodes, g.mode mode, round(b.t / g.t, 6) speedup from g join g b on g.nodes = b.nodes and b.mode = 'COMPSs'")
def runlog_speedup_vs_base(spark, d):
    g = runlog.group_mean(_long(spark, d), "t", ["nodes", "mode"])
    base = g.where(F.col("mode") == "COMPSs").select("nodes", F.col("t").alias("base"))
    return g.join(base, "nodes").select("nodes", "mode", _r(F.col("base") / F.col("t")).alias("speedup"))


# The projected numbers of fit blocks, and of blocks stacked to a structure.
_COST = [(1, 1), (2, 2), (2, 1), (4, 4), (4, 2), (4, 1), (6, 6), (6, 3), (6, 2), (6, 1)]


@query(
    RUNS + ", means as (select nodes m, avg(initialization_time) fit, avg(list_avg(iteration_time)) kn from runs where len(iteration_time) > 0 group by 1), "
    f"plans as (select * from (values {', '.join(f'({n * 2}, {m * 2 + (m * 2) % 2})' for n, m in _COST)}) t(n, m)) "
    "select n::bigint n, m, round(fit * floor(n / m), 6) agg_fit, round(fit, 6) time_fit, round(24 * kn * floor(n / m), 6) agg_kn, round(kn * floor(n / m), 6) time_kn, round(fit + kn * floor(n / m), 6) total, round(100 * fit / (fit + kn * floor(n / m)), 6) ratio from plans join means using (m)"
)
def cost_projection(spark, d):
    rows = _runs(spark, d).where("size(iteration_time) > 0")
    one = rows.select("nodes", "initialization_time", (V.total(F.col("iteration_time")) / F.size("iteration_time")).alias("k"))
    means = one.groupBy(F.col("nodes").alias("m")).agg(F.avg("initialization_time").alias("fit"), F.avg("k").alias("kn"))
    plans = spark.createDataFrame([(n * 2, m * 2) for n, m in _COST], "n bigint, m bigint")
    c = runlog.cost(means, plans)
    return c.select("n", "m", *[_r(x).alias(x) for x in c.columns[2:]])


@query("select w::bigint workers, g::bigint grain, (384 * g)::bigint fragments, (w * 48)::bigint cores from (select unnest([1, 2, 4, 8, 16]) w), (select unnest([1, 4, 16, 48]) g)")
def runlog_param_grid(spark, d):
    w = spark.range(5).select(F.pow(F.lit(2), "id").cast("bigint").alias("workers"))
    return w.select("workers", F.explode(F.array(*[F.lit(x).cast("bigint") for x in (1, 4, 16, 48)])).alias("grain")).select("workers", "grain", (F.col("grain") * 384).alias("fragments"), (F.col("workers") * 48).alias("cores"))


@query(RUNS + "select id, id::varchar job from runs where id % 2 = 0 union all select id, '' from runs where id % 2 <> 0")
def runlog_job_id(spark, d):
    text = F.when(F.col("id") % 2 == 0, F.concat(F.lit("note\nSubmitted batch job "), F.col("id").cast("string"))).otherwise("failed")
    return _runs(spark, d).select("id", runlog.job_id(text).alias("job"))


@query("select user_id id, max(event_id) version, round(arg_max(value, event_id), 6) value from events group by 1")
def runlog_last_write(spark, d):
    e = _table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("version"), "value")
    return run_source.last_write(e).select("id", "version", _r("value").alias("value"))


@query(RUNS + "select id, round(list_sum(iteration_time), 6) total from runs")
def runlog_json_decode(spark, d):
    rows = _runs(spark, d).withColumn("j", F.to_json("iteration_time")).withColumn("l", run_source.decode_seconds("j"))
    return rows.select("id", _r(F.when(F.size("l") > 0, V.total(F.col("l")))).alias("total"))


@query(RUNS + "select id from runs where id % 2 = 0 union all select id from runs where id % 3 = 0")
def union_blocks(spark, d):
    r = _runs(spark, d).select("id")
    return r.where("id % 2 = 0").unionByName(r.where("id % 3 = 0"))


@query(_WIN + f"select mode, nodes - 1 workers, points_per_fragment, round(avg(t), 6) t from w where mode is not null and (number_of_fragments = 2304 * (nodes - 1) or number_of_fragments = 48 * (nodes - 1)) group by 1, 2, 3")
def runlog_pipeline(spark, d):
    w = _clamped(spark, d).where("number_of_fragments in (2304 * (nodes - 1), 48 * (nodes - 1))").withColumn("workers", F.col("nodes") - 1)
    kept = runlog.keep_columns(w, ["mode", "workers", "points_per_fragment", "t"])
    return runlog.group_mean(kept, "t", ["mode", "workers", "points_per_fragment"]).select("mode", "workers", "points_per_fragment", _r("t").alias("t"))


# ---------------------------------------------------------------- run log: summaries, predicates, files

_SMART = RUNS + (
    ", f as (select *, case when id % 4 = 1 then 1 else 0 end reduction, case when len(iteration_time) > 0 then iteration_time end l from runs), "
    "m as (select id, nodes, points_per_fragment, number_of_fragments, reduction, list_min(l) min_time, list_avg(l) mean_time, list_stddev_pop(l) std_time, len(l)::bigint \"count\", "
    "case when dataclay = 0 then 'COMPSs' when coalesce(use_split, 0) <> 0 then 'dC+split' else 'dC' end || case when reduction = 1 then '+reduction' else '' end mode from f) "
)
_SIZES = ["points_per_fragment", "number_of_fragments"]


def _summary(spark, d) -> DataFrame:
    rows = _runs(spark, d).withColumn("reduction", F.when(F.col("id") % 4 == 1, 1).otherwise(0))
    return runlog.list_summary(rows, "iteration_time").withColumn("mode", runlog.short_mode(F.col("reduction")))


@query(_SMART + "select id, mode, round(min_time, 6) min_time, round(mean_time, 6) mean_time, round(std_time, 6) std_time, \"count\" from m")
def runlog_summary(spark, d):
    return _summary(spark, d).select("id", "mode", *[_r(c).alias(c) for c in ("min_time", "mean_time", "std_time")], "count")


@query(_SMART + f"select {', '.join(_SIZES)}, mode, nodes, round(avg(mean_time), 6) mean_time, round(min(min_time), 6) min_time, round(avg(std_time), 6) std_time from m where reduction = 1 group by all")
def runlog_summary_agg(spark, d):
    rows = _summary(spark, d).where("reduction = 1").groupBy(*_SIZES, "mode", "nodes")
    return rows.agg(_r(F.avg("mean_time")).alias("mean_time"), _r(F.min("min_time")).alias("min_time"), _r(F.avg("std_time")).alias("std_time"))


@query(_LONG + "select nodes, mode, round(avg(t), 6) mean, round(avg(t) - 1.96 * stddev_samp(t) / sqrt(count(t)), 6) low, round(avg(t) + 1.96 * stddev_samp(t) / sqrt(count(t)), 6) high from x where mode is not null group by 1, 2")
def runlog_bar_interval(spark, d):
    return runlog.interval(_long(spark, d), "t", ["nodes", "mode"]).select("nodes", "mode", *[_r(c).alias(c) for c in ("mean", "low", "high")])


@query(_LONG + ", s as (select mode, stddev_samp(t) * 0.1::double w from x group by 1), g as (select unnest([0.0, 10.0, 20.0, 50.0, 100.0]::double[]) x) select x.mode mode, g.x x, round(avg(exp(-((g.x - t) / w) * ((g.x - t) / w) / 2) / (w * sqrt(2 * pi()))), 6) density from x join s on x.mode is not distinct from s.mode, g where t is not null group by 1, 2")
def runlog_kde_relative(spark, d):
    return runlog.density(_long(spark, d), "t", ["mode"], [0, 10, 20, 50, 100], 0.1, relative=True).select("mode", "x", _r("density").alias("density"))


#: Names of the analyses' predicates over the sizes of a run, in a form without division.
_PREDICATES = {
    "small": "number_of_fragments = 2304 * (nodes - 1) and points_per_fragment = 64000",
    "big": "number_of_fragments = 48 * (nodes - 1) and points_per_fragment = 64000 * 48",
    "same_total": "number_of_fragments * points_per_fragment = 1179648000",
    "enough": "number_of_fragments >= (nodes - 1) * 2",
    "six_a_worker": "(nodes - 1) * 6 = number_of_fragments",
    "nine_nodes": "nodes = 9 and copy_fit_struct <> 0 and (nodes - 1) * 1000 >= number_of_fragments",
}


@query(RUNS + "select id, " + ", ".join(f"coalesce({p}, false) {n}" for n, p in _PREDICATES.items()) + " from runs")
def runlog_scaling_predicates(spark, d):
    return _runs(spark, d).select("id", *[F.coalesce(F.expr(p), F.lit(False)).alias(n) for n, p in _PREDICATES.items()])


_SUBSETS = {"plain": "dataclay = 0", "persistent": "dataclay = 1", "no_copy": "dataclay = 1 and copy_fit_struct = 0", "copy": "dataclay = 1 and copy_fit_struct = 1"}


@query(_PRE + " union all ".join(f"select '{n}' subset, id, mode from m where {p}" for n, p in _SUBSETS.items()))
def runlog_plot_subsets(spark, d):
    rows, out = _mode(spark, d), None
    for n, p in _SUBSETS.items():
        part = rows.where(p).select(F.lit(n).alias("subset"), "id", "mode")
        out = part if out is None else out.unionByName(part)
    return out


@query(RUNS + "select nodes, count(*) filter (where dataclay = 1 and use_split = 1) n from runs group by 1")
def runlog_mask_count(spark, d):
    return _runs(spark, d).groupBy("nodes").agg(F.count_if((F.col("dataclay") == 1) & (F.col("use_split") == 1)).alias("n"))


@query(RUNS + "select id, lower((dataclay = 1)::varchar) flag, upper((dataclay = 1)::varchar) loud, round(log2(number_of_fragments), 6) depth from runs where number_of_fragments > 0")
def runlog_flags(spark, d):
    flag = (F.col("dataclay") == 1).cast("string")
    return _runs(spark, d).where("number_of_fragments > 0").select("id", F.lower(flag).alias("flag"), F.upper(flag).alias("loud"), _r(F.log2("number_of_fragments")).alias("depth"))


@query(BASE + "select vec_id row_id, pos, round(case when vec_id between 10 and 19 and pos = 2 then 0.5 else x end, 6) x from (select vec_id, unnest(range(64)) pos, unnest(v) x from pts) where vec_id < 10 or vec_id >= 12")
def block_update(spark, d):
    """Rows 10 to 19 get 0.5 in their third column, rows 10 and 11 are deleted."""
    written = matrix.written(_points(spark, d).select("row_id", "features"), "row_id between 10 and 19", 2, 0.5)
    return written.where("not row_id between 10 and 11").select("row_id", F.posexplode("features").alias("pos", "x")).select("row_id", F.col("pos").cast("bigint").alias("pos"), _r("x").alias("x"))


def _benchmark(spark, d) -> DataFrame:
    """A table of timings, appended to a CSV without a header in two writes and read again."""
    e = _table(spark, d, "events")
    rows = e.select((F.col("user_id") % 6 + 1).cast("int").alias("multiplier"), F.col("value").alias("fit"), (F.col("value") * 4).alias("kneighbors"), "event_id")
    path = new_path(spark, "benchmark")
    for part in (0, 1):
        run_source.append_benchmark(rows.where(F.col("event_id") % 2 == part), path)
    return run_source.read_benchmark(spark, path, header=False)


_BENCH = "with means as (select user_id % 6 + 1 m, avg(value) fit, avg(value * 4) kn, count(*) n from events group by 1) "


@query(_BENCH + "select m::int multiplier, round(fit, 6) fit, round(kn, 6) kneighbors, n from means")
def benchmark_csv_means(spark, d):
    return _benchmark(spark, d).groupBy("multiplier").agg(_r(F.avg("fit")).alias("fit"), _r(F.avg("kneighbors")).alias("kneighbors"), F.count("*").alias("n"))


@query(_BENCH + f", plans as (select * from (values {', '.join(str(x) for x in _COST)}) t(n, m)) select plans.n::bigint n, m::bigint m, round(fit * floor(plans.n / m), 6) agg_fit, round(fit, 6) time_fit, round(24 * kn * floor(plans.n / m), 6) agg_kn, round(kn * floor(plans.n / m), 6) time_kn, round(fit + kn * floor(plans.n / m), 6) total, round(100 * fit / (fit + kn * floor(plans.n / m)), 6) ratio from plans join means using (m)")
def benchmark_cost_projection(spark, d):
    means = _benchmark(spark, d).groupBy(F.col("multiplier").cast("bigint").alias("m")).agg(F.avg("fit").alias("fit"), F.avg("kneighbors").alias("kn"))
    c = runlog.cost(means, spark.createDataFrame(_COST, "n bigint, m bigint"))
    return c.select("n", "m", *[_r(x).alias(x) for x in c.columns[2:]])


@query(RUNS + "select id, nodes + case when id % 2 = 0 then 1 else 0 end nodes, initialization_time is not null started from runs")
def runlog_upsert(spark, d):
    """Records appended to a log, half of them again with more nodes; the last write of each is read by the log's schema."""
    path = new_path(spark, "runs")
    rows = _runs(spark, d).withColumn("version", F.lit(1).cast("bigint"))
    run_source.append_runs(rows, path)
    run_source.append_runs(rows.where("id % 2 = 0").withColumns({"nodes": F.col("nodes") + 1, "version": F.lit(2).cast("bigint")}), path)
    log = run_source.read_runs(spark, path)
    return run_source.last_write(log).select("id", "nodes", F.col("initialization_time").isNotNull().alias("started"))


@query("select time_bucket(interval '1 hour', ts) as \"hour\", event_type, count(*) as n from events group by 1, 2")
def windowed_counts(spark, d):
    e = _table(spark, d, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")
