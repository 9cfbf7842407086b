"""K-means, nearest neighbours and the cascade SVM as stages of a Spark ML Pipeline: Params, fit, transform, save and load.

Models keep what grows with the data in tables: the cells of the neighbour index and the support vectors of the
SVM are Parquet, only parameters and centres are in the metadata. transform() appends columns and keeps all others; rows whose
vectors have nulls take no part, as everywhere. A saved neighbour model refers to its cells where fit() wrote them.
"""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasPredictionCol, HasSeed, HasTol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.vector import checked
from quarry.operators import kmeans, spatial, svm


class _Writer(MLWriter):
    """Metadata as Spark's own stages have it, and what the model adds below it."""

    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata={"model": json.dumps(self.instance._kept())})
        self.instance._save_tables(f"{path}/data", self.sparkSession)


class _Reader(MLReader):
    def __init__(self, kind):
        super().__init__()
        self.kind = kind

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.kind._of(json.loads(metadata["model"]), f"{path}/data", self.sparkSession)
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class _SavedModel(Model, MLWritable, MLReadable):
    def write(self) -> MLWriter:
        return _Writer(self)

    def save(self, path: str) -> None:
        self.write().save(path)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)

    @classmethod
    def load(cls, path: str):
        return cls.read().load(path)

    def _save_tables(self, path: str, spark) -> None:
        """Nothing but the metadata."""


class _HasIdCol(Params):
    idCol = Param(Params._dummy(), "idCol", "integer column that tells rows apart", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(idCol="row_id")


class _Stage(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    def _init(self, given: dict) -> None:
        self._set(**{k: v for k, v in given.items() if v is not None})


class _KMeansParams(HasFeaturesCol, HasPredictionCol, HasMaxIter, HasTol, HasSeed):
    k = Param(Params._dummy(), "k", "number of centres", TypeConverters.toInt)
    distanceCol = Param(Params._dummy(), "distanceCol", "column of the distance to the nearest centre", TypeConverters.toString)
    initialCenters = Param(Params._dummy(), "initialCenters", "k centres to start from; else drawn from [0, 1)", TypeConverters.toList)

    def __init__(self):
        super().__init__()
        self._setDefault(k=8, maxIter=10, tol=1e-4, seed=0, predictionCol="prediction", distanceCol="distance")


class KMeansStage(_KMeansParams, _Stage):
    @keyword_only
    def __init__(self, *, k=None, maxIter=None, tol=None, seed=None, initialCenters=None, featuresCol=None, predictionCol=None, distanceCol=None):
        super().__init__()
        self._init(self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> KMeansStageModel:
        init = self.getOrDefault("initialCenters") if self.isDefined("initialCenters") else "random"
        g = self.getOrDefault
        fitted = kmeans.KMeans(g("k"), init, g("maxIter"), g("tol"), g("seed")).fit(dataset, g("featuresCol"))
        return self._copyValues(KMeansStageModel(fitted.centers))


class KMeansStageModel(_KMeansParams, _SavedModel):
    def __init__(self, centers: list[list[float]] | None = None):
        super().__init__()
        self.centers = centers

    def _transform(self, dataset: DataFrame) -> DataFrame:
        g = self.getOrDefault
        return kmeans.assign(dataset, self.centers, g("featuresCol")).withColumnsRenamed({"k": g("predictionCol"), "dist": g("distanceCol")})

    def _kept(self) -> dict:
        return {"centers": self.centers}

    @classmethod
    def _of(cls, kept: dict, path: str, spark) -> KMeansStageModel:
        return cls(kept["centers"])


class _NeighborParams(HasFeaturesCol, _HasIdCol):
    k = Param(Params._dummy(), "k", "number of neighbours", TypeConverters.toInt)
    cellRows = Param(Params._dummy(), "cellRows", "rows of a cell", TypeConverters.toInt)
    neighborsCol = Param(Params._dummy(), "neighborsCol", "column of the neighbours' ids and distances", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(k=5, cellRows=spatial.CELL_ROWS, neighborsCol="neighbors")


class NeighborsStage(_NeighborParams, _Stage):
    @keyword_only
    def __init__(self, *, k=None, cellRows=None, featuresCol=None, idCol=None, neighborsCol=None):
        super().__init__()
        self._init(self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> NeighborsStageModel:
        g = self.getOrDefault
        return self._copyValues(NeighborsStageModel(spatial.SpatialIndex(g("k"), g("cellRows")).fit(dataset, g("idCol"), g("featuresCol"))))


class NeighborsStageModel(_NeighborParams, _SavedModel):
    def __init__(self, index: spatial.SpatialIndex | None = None):
        super().__init__()
        self.index = index

    def _transform(self, dataset: DataFrame) -> DataFrame:
        g = self.getOrDefault
        rows = checked(dataset, self.index.width, g("featuresCol"))
        found = self.index.kneighbors(rows, g("k"), row_id=g("idCol"), features=g("featuresCol"), with_hash=True)
        lists = found.groupBy("query_id", "h").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "neighbor_id", "dist"))), lambda x: F.struct(x["neighbor_id"].alias("id"), x["dist"].alias("dist"))).alias(g("neighborsCol")))
        met = (F.col(g("idCol")).cast("bigint").eqNullSafe(F.col("query_id"))) & (F.xxhash64(g("featuresCol")) == F.col("h"))
        return rows.join(lists, met).drop("query_id", "h")

    def _kept(self) -> dict:
        return {}

    def _save_tables(self, path: str, spark) -> None:
        self.index.save(path, spark)

    @classmethod
    def _of(cls, kept: dict, path: str, spark) -> NeighborsStageModel:
        return cls(spatial.SpatialIndex.load(path, spark))


class _SvmParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasMaxIter, _HasIdCol):
    arity = Param(Params._dummy(), "arity", "groups that merge in a layer of the cascade", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "width of the radial kernel", TypeConverters.toFloat)
    c = Param(Params._dummy(), "c", "bound of the weights", TypeConverters.toFloat)
    checkConvergence = Param(Params._dummy(), "checkConvergence", "end when support vectors stay the same", TypeConverters.toBoolean)

    def __init__(self):
        super().__init__()
        self._setDefault(arity=48, maxIter=5, gamma=1.0, c=1.0, checkConvergence=False)


class CascadeSvmStage(_SvmParams, _Stage):
    @keyword_only
    def __init__(self, *, arity=None, maxIter=None, gamma=None, c=None, checkConvergence=None, featuresCol=None, labelCol=None, predictionCol=None, idCol=None):
        super().__init__()
        self._init(self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> CascadeSvmStageModel:
        g = self.getOrDefault
        fitted = svm.CascadeSVM(g("arity"), g("maxIter"), g("gamma"), g("c"), g("checkConvergence")).fit(dataset, g("idCol"), g("featuresCol"), g("labelCol"))
        return self._copyValues(CascadeSvmStageModel(fitted))


class CascadeSvmStageModel(_SvmParams, _SavedModel):
    def __init__(self, fitted: svm.CascadeSVM | None = None):
        super().__init__()
        self.fitted = fitted

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Rows that share an id must share its vector, as predictions are joined by id."""
        g = self.getOrDefault
        rows = checked(dataset, self.fitted.width, g("featuresCol"))
        made = self.fitted.predict(rows, g("idCol"), g("featuresCol")).groupBy("row_id").agg(F.min("prediction").cast("double").alias(g("predictionCol"))).withColumnRenamed("row_id", "_asked")
        return rows.join(made, F.col(g("idCol")).cast("bigint") == F.col("_asked")).drop("_asked")

    def _kept(self) -> dict:
        return {"classes": self.fitted.classes, "width": self.fitted.width, "gamma": self.fitted.gamma, "n_iter": self.fitted.n_iter}

    def _save_tables(self, path: str, spark) -> None:
        self.fitted.model.write.parquet(path)

    @classmethod
    def _of(cls, kept: dict, path: str, spark) -> CascadeSvmStageModel:
        fitted = svm.CascadeSVM(gamma=kept["gamma"])
        fitted.classes, fitted.width, fitted.n_iter = kept["classes"], kept["width"], kept["n_iter"]
        fitted.model = spark.read.schema("id bigint, v array<double>, w array<double>").parquet(path)
        return cls(fitted)
