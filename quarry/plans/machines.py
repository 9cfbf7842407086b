"""The cascade SVM scored on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators.svm import CascadeSVM
from quarry.plans.registry import query, table

LEAST = 0.85


@query(
    "with e as (select vec_id, (embedding[1] > 0)::bigint + 2 * (embedding[2] > 0)::bigint quadrant from embeddings where vec_id % 5 = 0) "
    "select quadrant, count(*) n, true as good from e group by quadrant"
)
def svm_cascade_quadrants(spark, d):
    """The quadrant of a vector's first two components, learned from four rows in five and told of the fifth: how many of each, and whether
    at least 85 % of all are told rightly. The table's own labels do not depend on its vectors, so nothing can be learned from them."""
    v = F.col("embedding").cast("array<double>")
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.transform(F.slice(v, 1, 3), lambda x: x * 8).alias("features"), (F.when(v[0] > 0, 1).otherwise(0) + F.when(v[1] > 0, 2).otherwise(0)).alias("label"))
    model = CascadeSVM(cascade_arity=4, gamma=0.5, c=10.0, max_iter=2).fit(rows.where("row_id % 5 <> 0"))
    asked = rows.where("row_id % 5 = 0")
    told = model.predict(asked).join(asked.select("row_id", "label"), "row_id")
    share = told.agg((F.avg((F.col("label") == F.col("prediction")).cast("int")) >= LEAST).alias("good"))
    return told.groupBy(F.col("label").cast("bigint").alias("quadrant")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(share))
