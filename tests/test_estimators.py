"""Estimators as pipeline stages: fitted, saved, loaded and asked again with equal answers."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel

from quarry.operators.estimators import CascadeSvmStage, CascadeSvmStageModel, KMeansStage, KMeansStageModel, NeighborsStage, NeighborsStageModel


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(8)
    label = rng.integers(0, 3, 240)
    x = rng.normal(size=(240, 4)) * 0.3 + label[:, None] * [2, 0, 1, 0]
    rows = [(i, [float(v) for v in r], int(y), f"row {i}") for i, (r, y) in enumerate(zip(x, label, strict=True))]
    return spark.createDataFrame([*rows, (900, None, 0, "null"), (901, [None, 1.0, 1.0, 1.0], 1, "part")], "row_id bigint, features array<double>, label int, note string")


def _rows(df):
    return sorted((str(sorted(r.asDict(recursive=True).items())) for r in df.collect()))


@pytest.mark.parametrize(
    ("stage", "kind", "new"),
    [
        (KMeansStage(k=3, initialCenters=[[0.0, 0, 0, 0], [2.0, 0, 1, 0], [4.0, 0, 2, 0]]), KMeansStageModel, {"prediction", "distance"}),
        (NeighborsStage(k=4, cellRows=50), NeighborsStageModel, {"neighbors"}),
        (CascadeSvmStage(gamma=0.5, c=5.0), CascadeSvmStageModel, {"prediction"}),
    ],
)
def test_saved_and_loaded_models_answer_alike(spark, points, tmp_path, stage, kind, new):
    model = stage.fit(points)
    asked = model.transform(points)
    assert set(asked.columns) == {"row_id", "features", "label", "note"} | new
    one = _rows(asked)
    assert len(one) == 240
    model.save(f"{tmp_path}/model")
    loaded = kind.load(f"{tmp_path}/model")
    assert _rows(loaded.transform(points)) == one and loaded.uid == model.uid
    stage.save(f"{tmp_path}/stage")
    again = type(stage).load(f"{tmp_path}/stage")
    assert again.extractParamMap().keys() and _rows(again.fit(points).transform(points)) == one


def test_in_a_pipeline(spark, points, tmp_path):
    stages = [KMeansStage(k=3, seed=1, predictionCol="cluster"), CascadeSvmStage(gamma=0.5, c=5.0)]
    model = Pipeline(stages=stages).fit(points)
    got = model.transform(points)
    assert {"cluster", "distance", "prediction"} <= set(got.columns)
    assert got.where("prediction = label").count() > 0.9 * 240
    model.write().overwrite().save(f"{tmp_path}/pipeline")
    assert _rows(PipelineModel.load(f"{tmp_path}/pipeline").transform(points)) == _rows(got)
