"""A spatial index for exact k nearest neighbours: a k-d tree over cells of rows that are written once and asked often.

fit() cuts space by the medians of a bounded sample, alternating over the dimensions of largest spread, into
cells of about ``cell_rows`` rows, deals every row to its cell and writes the rows bucketed by cell. Cells
with many rows that no plane can part (equal points) are dealt to parts by a hash of the id. Of the tree only the
cuts and each cell's bounding box, 2 x width numbers a cell and MOST_CELLS cells, are on the driver and in tasks.

kneighbors() sends each query to its own cell first. The distance of the k-th row found there is the bound
within which other cells are visited: those whose box is no further away, found by going down the tree. The fit
rows stay where they are: queries travel to the buckets, and the plan has no exchange of fit rows. Only
cells that more than MOST_QUERIES queries visit are copied, with their queries dealt to the copies.

Results are exact, ties to the lower id. Defined results: rows with a null vector or component take no part, and
vectors of different lengths are an error, as everywhere. Queries equal in id and vector are one query, and one
id with several vectors is several queries. Fit rows that share an id are rows of their own.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.tables import forget, new_path, written
from quarry.functions.vector import batch_matrix, uniform
from quarry.operators.knn import best_of_block

SAMPLE = 262_144
CELL_ROWS = 1024
MOST_CELLS = 65_536
MOST_QUERIES = 65_536
COPY_QUERIES = 16_384
MOST_NUMBERS = 1 << 20

_FOUND = "query_id bigint, h bigint, neighbor_id bigint, dist double"
_ASKED = "id bigint, h bigint, v array<double>, cell int"


class Tree:
    """Cuts in heap order, parts of each leaf, and boxes. Cells are numbered leaf by leaf, part by part."""

    def __init__(self, axes: np.ndarray, cuts: np.ndarray, parts: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None):
        self.axes, self.cuts, self.parts, self.low, self.high = axes, cuts, parts, low, high
        self.first = np.concatenate([[0], np.cumsum(parts)]).astype(np.int64)
        if low is not None:
            self._boxes()

    @staticmethod
    def of_sample(sample: np.ndarray, leaves: int) -> Tree:
        """A balanced tree of ``leaves`` leaves, a power of two, by medians along the dimension of largest spread."""
        inner = leaves - 1
        axes, cuts = np.zeros(inner, np.int64), np.zeros(inner)
        groups = [sample]
        for node in range(inner):
            x = groups[node]
            if len(x):
                axes[node] = int(np.argmax(x.max(axis=0) - x.min(axis=0)))
                cuts[node] = np.median(x[:, axes[node]])
            right = x[:, axes[node]] > cuts[node] if len(x) else np.zeros(0, bool)
            groups += [x[~right], x[right]]
            groups[node] = None
        return Tree(axes, cuts, np.ones(leaves, np.int64))

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node, inner = np.zeros(len(x), np.int64), len(self.axes)
        while inner and node[0] < inner:
            node = 2 * node + 1 + (x[np.arange(len(x)), self.axes[node]] > self.cuts[node])
        return node - inner

    def cell(self, x: np.ndarray, spread: np.ndarray) -> np.ndarray:
        """A row's cell: its leaf's part by a hash."""
        if not len(x):
            return np.zeros(0, np.int64)
        leaf = self.leaf(x)
        return self.first[leaf] + spread % self.parts[leaf]

    def _boxes(self) -> None:
        """Boxes of all nodes, from those of cells; empty ones are infinitely far."""
        leaves, inner = len(self.parts), len(self.axes)
        self.node_low, self.node_high = np.full((inner + leaves, self.low.shape[1]), np.inf), np.full((inner + leaves, self.low.shape[1]), -np.inf)
        leaf = np.repeat(np.arange(leaves), self.parts)
        np.minimum.at(self.node_low, inner + leaf, self.low)
        np.maximum.at(self.node_high, inner + leaf, self.high)
        for node in range(inner - 1, -1, -1):
            self.node_low[node] = np.minimum(self.node_low[2 * node + 1], self.node_low[2 * node + 2])
            self.node_high[node] = np.maximum(self.node_high[2 * node + 1], self.node_high[2 * node + 2])

    @staticmethod
    def _away(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        gap = np.maximum(np.maximum(low - x, x - high), 0)
        return np.sqrt((gap * gap).sum(axis=1))

    def within(self, x: np.ndarray, bound: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, cell) of all cells no further than each query's bound, down the tree, in pieces.

        Pairs of a query and a node are cut in two wherever their vectors would be more than MOST_NUMBERS numbers, so
        that memory doesn't grow with queries x cells. One query's leaf is not cut.
        """
        reach = bound * (1 + 1e-9) + 1e-12 * (1 + np.abs(x).max(axis=1, initial=0))
        inner, most = len(self.axes), max(1, MOST_NUMBERS // max(1, x.shape[1]))
        left = [(np.arange(len(x)), np.zeros(len(x), np.int64))]
        while left:
            query, node = left.pop()
            if not len(node):
                continue
            grown = 2 * len(node) if node[0] < inner else self.parts[node - inner].sum()
            if grown > most and len(node) > 1:
                half = len(node) // 2
                left += [(query[half:], node[half:]), (query[:half], node[:half])]
            elif node[0] < inner:
                query, node = np.repeat(query, 2), (2 * node[:, None] + [1, 2]).ravel()
                near = self._away(x[query], self.node_low[node], self.node_high[node]) <= reach[query]
                left.append((query[near], node[near]))
            else:
                leaf = node - inner
                many = self.parts[leaf]
                query, cell = np.repeat(query, many), np.repeat(self.first[leaf], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                near = self._away(x[query], self.low[cell], self.high[cell]) <= reach[query]
                yield query[near], cell[near]

    def arrays(self) -> dict:
        return {k: None if v is None else v.tolist() for k, v in (("axes", self.axes), ("cuts", self.cuts), ("parts", self.parts), ("low", self.low), ("high", self.high))}


def _plain(tree: Tree) -> tuple:
    return tree.axes, tree.cuts, tree.parts, tree.low, tree.high


class SpatialIndex:
    """fit() writes the cells; kneighbors() asks them as often as wanted; save() and load() keep them for other sessions."""

    def __init__(self, n_neighbors: int = 5, cell_rows: int = CELL_ROWS):
        self.n_neighbors, self.cell_rows = n_neighbors, cell_rows
        self.path: str | None = None
        self.rows = self.buckets = self.width = 0
        self.tree: Tree | None = None
        self.counts: dict[int, int] = {}
        self._name: str | None = None
        self.visits: DataFrame | None = None  # query_id, h, cell of the last kneighbors()

    def fit(self, points: DataFrame, row_id: str = "row_id", features: str = "features") -> SpatialIndex:
        spark = points.sparkSession
        points, self.width = uniform(points.select(F.col(row_id).cast("bigint").alias("id"), F.col(features).alias("v")), "v")
        self.rows = points.count()
        if not self.rows:
            raise ValueError("no points")
        share = min(1.0, 1.5 * SAMPLE / self.rows)
        picked = points.where(F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)) < share * (1 << 30)).select("v").limit(SAMPLE).toArrow()
        leaves = 1 << max(0, math.ceil(math.log2(max(1.0, min(MOST_CELLS, self.rows / self.cell_rows)))))
        sample = batch_matrix(picked["v"]) if picked.num_rows else np.zeros((0, self.width))
        tree = Tree.of_sample(sample, leaves)
        # How full the leaves are, and so the parts of those that no plane can cut; one number a leaf and task.
        full = self._dealt(points, tree).groupBy("cell").count().collect()
        most = 8 * max(self.cell_rows, self.rows // leaves)
        for r in full:
            tree.parts[r["cell"]] = math.ceil(r["count"] / most)
        tree = Tree(tree.axes, tree.cuts, tree.parts)
        cells = int(tree.parts.sum())
        self.buckets = max(1, min(cells, max(int(spark.conf.get("spark.sql.shuffle.partitions")), self.rows >> 20)))
        self.path = new_path(spark, "cells")
        self._name = f"quarry_cells_{uuid.uuid4().hex}"
        dealt = self._dealt(points, tree).repartition(self.buckets, "cell")
        dealt.write.format("parquet").bucketBy(self.buckets, "cell").sortBy("cell").option("path", self.path).saveAsTable(self._name)
        self._read_boxes(spark, tree)
        return self

    @staticmethod
    def _dealt(points: DataFrame, tree: Tree) -> DataFrame:
        plain = _plain(tree)

        def deal(batches):
            own = Tree(*plain)
            for batch in batches:
                cell = own.cell(batch_matrix(batch.column(1)), batch.column(2).to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell, pa.int32())], names=["id", "v", "cell"])

        return points.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(1 << 30)).alias("spread")).mapInArrow(deal, "id bigint, v array<double>, cell int")

    def _read_boxes(self, spark: SparkSession, tree: Tree) -> None:
        width = self.width

        def box(batches):
            low, high, n = {}, {}, {}
            for batch in batches:
                x, cell = batch_matrix(batch.column(0)), batch.column(1).to_numpy()
                for c in np.unique(cell):
                    own = x[cell == c]
                    low[c], high[c] = np.minimum(low.get(c, np.inf), own.min(axis=0)), np.maximum(high.get(c, -np.inf), own.max(axis=0))
                    n[c] = n.get(c, 0) + len(own)
            at = sorted(low)
            vectors = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([low[c] for c in at], vectors), pa.array([high[c] for c in at], vectors), pa.array([n[c] for c in at], pa.int64())], names=["cell", "low", "high", "n"])

        boxes = spark.table(self._name).select("v", "cell").mapInArrow(box, "cell int, low array<double>, high array<double>, n bigint")
        cells = int(tree.parts.sum())
        low, high, self.counts = np.full((cells, width), np.inf), np.full((cells, width), -np.inf), {}
        for r in boxes.collect():  # one row a cell and task
            low[r["cell"]], high[r["cell"]] = np.minimum(low[r["cell"]], r["low"]), np.maximum(high[r["cell"]], r["high"])
            self.counts[r["cell"]] = self.counts.get(r["cell"], 0) + r["n"]
        self.tree = Tree(tree.axes, tree.cuts, tree.parts, low, high)

    def save(self, path: str, spark: SparkSession) -> None:
        """The tree as JSON, one row, beside which the cells stay where they are."""
        kept = {"tree": self.tree.arrays(), "path": self.path, "rows": self.rows, "buckets": self.buckets, "width": self.width, "k": self.n_neighbors, "cell_rows": self.cell_rows, "counts": {str(k): v for k, v in self.counts.items()}}
        spark.createDataFrame([(json.dumps(kept),)], "model string").coalesce(1).write.text(path)

    @staticmethod
    def load(path: str, spark: SparkSession) -> SpatialIndex:
        kept = json.loads(spark.read.text(path).first()[0])
        out = SpatialIndex(kept["k"], kept["cell_rows"])
        out.path, out.rows, out.buckets, out.width = kept["path"], kept["rows"], kept["buckets"], kept["width"]
        out.counts = {int(k): v for k, v in kept["counts"].items()}
        t = kept["tree"]
        out.tree = Tree(np.array(t["axes"], np.int64), np.array(t["cuts"], float), np.array(t["parts"], np.int64), np.array(t["low"], float).reshape(-1, out.width), np.array(t["high"], float).reshape(-1, out.width))
        out._name = f"quarry_cells_{uuid.uuid4().hex}"
        spark.sql(f"create table {out._name} (id bigint, v array<double>, cell int) using parquet clustered by (cell) sorted by (cell) into {out.buckets} buckets location '{out.path}'")
        return out

    def cells(self, spark: SparkSession) -> DataFrame:
        """id, v, cell: the fit rows, bucketed by cell."""
        if self._name is None:
            raise ValueError("not fitted")
        return spark.table(self._name)

    def drop(self, spark: SparkSession) -> None:
        """Delete the cells, for when nothing asks this index, or one saved from it, any more."""
        forget(self.cells(spark))
        spark.sql(f"drop table if exists {self._name}")
        self._name = None

    def kneighbors(self, queries: DataFrame, k: int | None = None, return_distance: bool = True, row_id: str = "row_id", features: str = "features", with_hash: bool = False) -> DataFrame:
        """query_id, rank, neighbor_id, dist. A query that is also a fit row finds itself. with_hash: also h, of the query's vector."""
        k, spark = k or self.n_neighbors, queries.sparkSession
        fit = self.cells(spark)
        if self.rows < k:
            raise ValueError(f"fewer than {k} fit rows")
        asked, width = uniform(queries.select(F.col(row_id).cast("bigint").alias("id"), F.col(features).alias("v")), "v")
        if width not in (0, self.width):
            raise ValueError(f"queries of {width} dimensions, fit rows of {self.width}")
        asked = asked.groupBy("id", F.xxhash64("v").alias("h")).agg(F.any_value("v").alias("v"))
        plain = _plain(self.tree)

        def home(batches):
            tree = Tree(*plain)
            for batch in batches:
                cell = tree.cell(batch_matrix(batch.column(2)), batch.column(1).to_numpy() & 0xFFFF)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], names=["id", "h", "v", "cell"])

        at_home = written(asked.mapInArrow(home, _ASKED), "asked")
        near = written(self._met(fit, at_home, k), "near")
        bound = near.groupBy("query_id", "h").agg(F.when(F.count("*") >= k, F.max("dist")).alias("bound"))
        bounded = at_home.join(bound, (F.col("id") == F.col("query_id")) & (at_home["h"] == bound["h"]), "left").select("id", at_home["h"], "v", "cell", "bound")

        def further(batches):
            tree = Tree(*plain)
            for batch in batches:
                x = batch_matrix(batch.column(2))
                if not len(x):
                    continue
                bound = batch.column(4).to_numpy(zero_copy_only=False).astype(float)
                own = batch.column(3).to_numpy()
                for query, cell in tree.within(x, np.where(np.isnan(bound), np.inf, bound)):
                    other = cell != own[query]
                    at = pa.array(query[other])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at), pa.array(cell[other], pa.int32())], names=["id", "h", "v", "cell"])

        others = written(bounded.mapInArrow(further, _ASKED), "asked")
        self.visits = at_home.unionByName(others).select(F.col("id").alias("query_id"), "h", "cell")
        found = near.unionByName(self._met(fit, others, k))
        best = Window.partitionBy("query_id", "h").orderBy("dist", "neighbor_id")
        out = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", *(["h"] if with_hash else []), "rank", "neighbor_id", "dist")
        return out if return_distance else out.drop("dist")

    def pairs_visited(self) -> int:
        """How many pairs of a query and a fit row the last kneighbors() compared."""
        by_cell = self.visits.groupBy("cell").count().collect()  # one row a cell
        return sum(r["count"] * self.counts.get(r["cell"], 0) for r in by_cell)

    @staticmethod
    def _met(fit: DataFrame, asked: DataFrame, k: int) -> DataFrame:
        """The best k of each query in the cell that it visits. asked: (id, h, v, cell)."""

        def group(a: pa.Table, b: pa.Table) -> pa.Table:
            at, ids, dist = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            if a.num_rows and b.num_rows:
                at, ids, dist = best_of_block(a["id"].to_numpy(), batch_matrix(a["v"]), batch_matrix(b["v"]), k)
            return pa.table({"query_id": b["id"].take(pa.array(at)), "h": b["h"].take(pa.array(at)), "neighbor_id": pa.array(ids, pa.int64()), "dist": pa.array(dist, pa.float64())})

        crowded = {r["cell"]: math.ceil(r["count"] / COPY_QUERIES) for r in asked.groupBy("cell").count().where(F.col("count") > MOST_QUERIES).collect()}
        if not crowded:
            return fit.groupBy("cell").cogroup(asked.groupBy("cell")).applyInArrow(group, _FOUND)
        some = F.col("cell").isin(list(crowded))
        plain = fit.where(~some).groupBy("cell").cogroup(asked.where(~some).groupBy("cell")).applyInArrow(group, _FOUND)
        copies = F.element_at(F.create_map(*[F.lit(x) for c in crowded.items() for x in c]), F.col("cell"))
        left = fit.where(some).withColumn("part", F.explode(F.sequence(F.lit(0), copies - 1)))
        right = asked.where(some).withColumn("part", F.pmod(F.xxhash64("id", "h", F.lit(1)), copies).cast("int"))
        return plain.unionByName(left.groupBy("cell", "part").cogroup(right.groupBy("cell", "part")).applyInArrow(group, _FOUND))
