"""The registered queries: name -> Spark function (spark, sf_dir), and name -> SQL over the same tables."""

from quarry.plans import catalog, logs, machines, neighbours, random_columns, resampled, streams, tiled
from quarry.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "catalog", "logs", "machines", "neighbours", "random_columns", "resampled", "streams", "tiled"]
