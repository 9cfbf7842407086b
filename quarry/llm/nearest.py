"""Approximate nearest neighbours for the largest inner product, by score-aware quantisation.

A vector is its nearest coarse centre plus a residual. The residual's length is kept, and the pairs of dimensions
of its direction are quantised to 16 codes each. Codes are chosen by an anisotropic loss: the part of the
residual error that is parallel to the vector, which shifts its inner products with the queries that
matter, weighs ``parallel`` times the rest. Coordinate descent over the pairs chooses the codes, and
weighted least squares moves the code words, both by that loss. Near copies share centre and codes, so that the
estimate can't tell them apart: more than CROWD rows of a shard with the same ones are quantised again
among themselves, DEPTH times at most.

Search scans four-bit tables: each query's inner products with the code words, two codes to a byte,
are looked up and added for every row. The rows of the best estimates, with all that tie at the cut, are ranked
again exactly, in double precision on the original vectors. So is every other row that its own quantisation
error is likely to lift to the k-th exact score: its estimate and LIKELY standard deviations, the
error being the row's lost length in a random direction. Nothing else decides which rows are ranked.

The quantiser is fitted on a bounded sample (SAMPLE rows by a hash of the id). Every row is encoded once
and filed with its four-bit codes and its quantisation error; every query meets every row, in blocks: rows
are dealt to shards and queries to blocks by hash, and each pair of the two is one group of bounded size.
Only each group's best k travel on. Equal vectors in a shard keep their k + 1 least ids, as others can't be
among the nearest. Where rows share an id, as many more are ranked as give k ids.

Defined results: rows without id, with a null, empty or zero vector, or with a null or non-finite
component take no part. An inner product needs vectors of one length: a query meets the rows of its own
length only, each length having a quantiser of its own; more than MOST_WIDTHS lengths raise ValueError. Ties
go to the smaller id. A query without any other row has no result; an empty table gives an empty table.
Rows that repeat id and vector count once. An id with several vectors is as near as its nearest one and
listed once; as a query it asks with the least of them (by first unequal component, shorter first), and
never meets its own id. Numbers that aren't single precision are read, compared and scored in double
precision. Other columns, of whatever name, are ignored.
"""

from __future__ import annotations

import dataclasses
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.storage import saved

SAMPLE = 6000
COARSE = 64
PARALLEL = 4.0
RERANK = 160
SHARD_ROWS = 8192
MOST_SHARDS = 64
LARGE_SHARD = 131072
QUERY_BLOCK = 32768
MOST_WIDTHS = 16
CROWD = 128
CROWD_SAMPLE = 2000
DEPTH = 4
LIKELY = 2.5


@dataclasses.dataclass(frozen=True)
class Quantiser:
    centres: np.ndarray  # (coarse, width)
    words: np.ndarray  # (pairs, 16, 2), for residuals of length 1
    parallel: float


def _lloyd(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.argmax(x @ centres.T - 0.5 * (centres**2).sum(axis=1), axis=1)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.stack([np.bincount(near, x[:, j], len(centres)) for j in range(x.shape[1])], axis=1)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def _even(x: np.ndarray) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, x.shape[1] % 2)))


def _lengths(rest: np.ndarray) -> np.ndarray:
    """Lengths of residuals, in single precision, as they are filed; 1 for those of none."""
    size = np.linalg.norm(rest, axis=1).astype(np.float32).astype(np.float64)
    return np.where(size > 0, size, 1.0)


def assign(x: np.ndarray, q: Quantiser, rounds: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coarse centre, codes (rows, pairs) and residual length of even-width vectors, by coordinate descent on the anisotropic loss."""
    near = np.argmax(x @ q.centres.T - 0.5 * (q.centres**2).sum(axis=1), axis=1)
    rest = x - q.centres[near]
    scale = _lengths(rest)
    rest = (rest / scale[:, None]).reshape(len(x), -1, 2)
    unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).reshape(len(x), -1, 2)
    pairs = rest.shape[1]
    codes = np.empty((len(x), pairs), np.uint8)
    for m in range(pairs):
        codes[:, m] = np.argmin((q.words[m] ** 2).sum(axis=1) - 2 * rest[:, m] @ q.words[m].T, axis=1)
    error = rest - q.words[np.arange(pairs), codes]
    along = (error * unit).sum(axis=(1, 2))
    for _ in range(rounds):
        for m in range(pairs):
            option = rest[:, m, None, :] - q.words[m][None]
            dot = np.einsum("nkd,nd->nk", option, unit[:, m])
            others = along - np.take_along_axis(dot, codes[:, m, None].astype(np.int64), 1)[:, 0]
            cost = (option**2).sum(axis=2) + (q.parallel - 1) * (others[:, None] + dot) ** 2
            codes[:, m] = np.argmin(cost, axis=1)
            along = others + np.take_along_axis(dot, codes[:, m, None].astype(np.int64), 1)[:, 0]
    return near, codes, scale


def fit(sample: np.ndarray, coarse: int = COARSE, parallel: float = PARALLEL, seed: int = 3) -> Quantiser:
    """The quantiser of a bounded sample of vectors."""
    rng = np.random.default_rng(seed)
    x = _even(sample.astype(np.float64))
    centres = _lloyd(x, coarse, 8, rng)
    near = np.argmax(x @ centres.T - 0.5 * (centres**2).sum(axis=1), axis=1)
    rest = x - centres[near]
    rest = (rest / _lengths(rest)[:, None]).reshape(len(x), -1, 2)
    pairs = rest.shape[1]
    words = np.zeros((pairs, 16, 2))
    for m in range(pairs):
        found = _lloyd(rest[:, m], 16, 8, rng)
        words[m, : len(found)] = found
    q = Quantiser(centres, words, parallel)
    unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).reshape(len(x), -1, 2)
    for _ in range(2):
        # Weighted least squares for all code words at once: weights are the identity plus the parallel part.
        _, codes, _ = assign(x, q, 1)
        size = pairs * 16 * 2
        left, right = np.zeros((size, size)), np.zeros(size)
        column = (np.arange(pairs)[None] * 16 + codes) * 2
        for first in range(0, len(x), 1000):
            part = slice(first, first + 1000)
            rows = np.arange(len(x[part]))[:, None]
            spread = np.zeros((len(x[part]), size))
            for d in range(2):
                spread[rows, column[part] + d] = unit[part, :, d]
                np.add.at(right, column[part] + d, rest[part, :, d])
                np.add.at(left, (column[part] + d, column[part] + d), 1.0)
            left += (parallel - 1) * spread.T @ spread
            right += (parallel - 1) * spread.T @ (rest[part] * unit[part]).sum(axis=(1, 2))
        left[np.arange(size), np.arange(size)] += 1e-9
        moved = np.linalg.solve(left, right).reshape(pairs, 16, 2)
        used = np.stack([np.bincount(codes[:, m], minlength=16) for m in range(pairs)]) > 0
        q = Quantiser(centres, np.where(used[:, :, None], moved, q.words), parallel)
    return q


def pack(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes to a byte."""
    codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
    return codes[:, 0::2] | (codes[:, 1::2] << 4)


def tables(queries: np.ndarray, q: Quantiser) -> tuple[np.ndarray, np.ndarray]:
    """For each query: its inner products with the coarse centres, and with each byte's two code words."""
    x = queries.reshape(len(queries), -1, 2)
    one = np.einsum("qmd,mkd->qmk", x, q.words).astype(np.float32)
    one = np.pad(one, ((0, 0), (0, one.shape[1] % 2), (0, 0)))
    both = one[:, 1::2, :, None] + one[:, 0::2, None, :]
    return (queries @ q.centres.T).astype(np.float32), both.reshape(len(queries), both.shape[1], 256)


def encode(rows: np.ndarray, q: Quantiser) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of vectors: coarse centres, packed codes (rows, bytes), lengths of the residuals, and of what quantisation loses of them."""
    x = _even(rows.astype(np.float64))
    near, codes, scale = assign(x, q)
    words = q.words[np.arange(codes.shape[1]), codes].reshape(len(x), -1)
    return near, pack(codes), scale, np.linalg.norm(x - q.centres[near] - scale[:, None] * words, axis=1)


def _distinct(row_ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of rows, of which equal vectors keep the k + 1 least ids. Rows are in the order of ids."""
    _, first, group = np.unique(rows.view(np.dtype((np.void, rows.shape[1] * rows.itemsize))).ravel(), return_index=True, return_inverse=True)
    if len(first) == len(rows):
        return np.arange(len(rows))
    by = np.argsort(group, kind="stable")
    starts = np.concatenate([[0], np.flatnonzero(np.diff(group[by])) + 1])
    place = np.arange(len(by)) - np.repeat(starts, np.diff([*starts, len(by)]))
    return np.sort(by[place <= k])


def segments(rows: np.ndarray, places: np.ndarray, q: Quantiser, encoded, depth: int = DEPTH) -> list:
    """(places, quantiser, centres, packed codes by byte, lengths, losses): rows that more than CROWD share the codes of are quantised again among themselves."""
    near, packed, scale, lost = encoded
    whole = np.ascontiguousarray(np.concatenate([near.astype(np.int32).view(np.uint8).reshape(len(near), -1), packed], axis=1))
    _, group, n = np.unique(whole.view(np.dtype((np.void, whole.shape[1]))).ravel(), return_inverse=True, return_counts=True)
    out, crowds = [], np.flatnonzero(n > CROWD) if depth else []
    alone = np.flatnonzero(~np.isin(group, crowds))
    if len(alone):
        out.append((places[alone], q, near[alone], np.ascontiguousarray(packed[alone].T), scale[alone].astype(np.float32), lost[alone]))
    for g in crowds:
        own = np.flatnonzero(group == g)
        x = rows[places[own]]
        finer = fit(x[:: -(-len(x) // CROWD_SAMPLE)], min(COARSE, -(-len(x) // CROWD)), q.parallel)
        out += segments(rows, places[own], finer, encode(x, finer), depth - 1)
    return out


def search_block(row_ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, q: Quantiser, k: int, rerank: int, encoded=None, count=None):
    """(query_id, vec_id, score) of each query's best k ids of a block: the table scan names the rows that are ranked exactly.

    Queries have distinct ids. encoded: what encode() gives for the rows, where it is at hand. count: a list that gets the
    number of rows ranked exactly for each query.
    """
    encoded = encode(rows, q) if encoded is None else encoded
    order = np.argsort(row_ids, kind="stable")
    order = order[_distinct(row_ids[order], np.ascontiguousarray(rows[order]), k)]
    row_ids, rows, encoded = row_ids[order], np.ascontiguousarray(rows[order]), [x[order] for x in encoded]
    exact = rows.astype(np.float64)
    parts = segments(rows, np.arange(len(rows)), q, encoded)
    lost = np.empty(len(rows))
    for places, *_, own in parts:
        lost[places] = own
    likely = LIKELY * lost / math.sqrt(exact.shape[1])
    out = []
    for begin in range(0, len(queries), 256):
        part = queries[begin : begin + 256].astype(np.float64)
        estimates = np.empty((len(part), len(rows)), np.float32)
        for places, quantiser, near, packed, scale, _ in parts:
            coarse, table = tables(_even(part), quantiser)
            for i in range(len(part)):
                sums = table[i, 0][packed[0]]
                for b in range(1, len(packed)):
                    sums += table[i, b][packed[b]]
                estimates[i, places] = coarse[i][near] + scale * sums
        for i, estimate in enumerate(estimates):
            estimate[row_ids == query_ids[begin + i]] = -np.inf
            most, want, size = int((estimate > -np.inf).sum()), max(rerank, k), np.linalg.norm(part[i])
            while True:
                want = min(want, most)
                cut = np.partition(estimate, len(estimate) - want)[len(estimate) - want] if want else np.inf
                best = np.flatnonzero((estimate >= cut) & (estimate > -np.inf))  # with those that tie at the cut
                score = (exact[best] * part[i]).sum(axis=1)
                ids = _best_ids(row_ids[best], score, k)
                if len(ids) < k and want < most:  # rows that share ids
                    want *= 2
                    continue
                if len(ids) == k:
                    reach = estimate + size * likely
                    best = np.union1d(best, np.flatnonzero((reach >= score[ids[-1]]) & (estimate > -np.inf)))
                    score = (exact[best] * part[i]).sum(axis=1)
                    ids = _best_ids(row_ids[best], score, k)
                break
            if count is not None:
                count.append(len(best))
            out.append((np.full(len(ids), query_ids[begin + i]), row_ids[best][ids], score[ids]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _best_ids(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best ids, each by its best row, best first; ties to the smaller id."""
    order = np.lexsort((ids, -score))
    return order[np.sort(np.unique(ids[order], return_index=True)[1])[:k]]


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(whole.flatten()).reshape(-1, width)


def usable(vectors: DataFrame, vec_id: str, vector: str) -> tuple[DataFrame, dict[int, int]]:
    """Saved rows (id, v) that take part, in the precision they come in, and their number by width."""
    kind = vectors.schema[vector].dataType.simpleString()
    v = F.col(vector).cast("array<float>" if kind == "array<float>" else "array<double>")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = saved(vectors.where(F.col(vec_id).isNotNull() & fine).select(F.col(vec_id).cast("bigint").alias("id"), v.alias("v")), "vectors")
    if not rows.groupBy("id").count().where("count > 1").isEmpty():
        rows = saved(rows.distinct(), "vectors")  # else copies of one row would all meet in one shard
    sizes = rows.groupBy(F.size("v").alias("width")).count().limit(MOST_WIDTHS + 1).collect()
    if len(sizes) > MOST_WIDTHS:
        raise ValueError(f"vectors of more than {MOST_WIDTHS} lengths")
    return rows, {r["width"]: r["count"] for r in sorted(sizes)}


def search(vectors: DataFrame, is_query, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest. is_query: a condition on the column id."""
    rows, widths = usable(vectors, vec_id, vector)
    queries = rows.where(is_query).groupBy("id").agg(F.min(F.struct(F.size("v").alias("width"), "v")).alias("q")).select("id", "q.width", "q.v")
    queries = saved(queries, "queries")
    out = rows.sparkSession.createDataFrame([], "query_id bigint, vec_id bigint, score double")
    for width, n in widths.items():
        own = queries.where(F.col("width") == width).select("id", "v")
        out = out.unionByName(_search(rows.where(F.size("v") == width), n, own, width, k, rerank))
    near = out.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(rows: DataFrame, n: int, queries: DataFrame, width: int, k: int, rerank: int) -> DataFrame:
    """query_id, vec_id, score of each query's best k in every shard of rows of one width."""
    spark = rows.sparkSession
    share = min(1.0, SAMPLE / n)
    h = F.xxhash64("id")
    picked = rows.where(F.pmod(h, F.lit(1_000_000)) < share * 1_000_000).select("id", "v").orderBy(h, "id", "v").limit(2 * SAMPLE).toArrow()
    sample = picked if picked.num_rows else rows.select("id", "v").orderBy(h, "id", "v").limit(SAMPLE).toArrow()
    fitted = fit(_matrix(sample["v"], width))
    # Plain arrays: workers rebuild the quantiser, as they need not have this package.
    model = spark.sparkContext.broadcast((fitted.centres, fitted.words, fitted.parallel))
    shards = max(min(MOST_SHARDS, math.ceil(n / SHARD_ROWS)), math.ceil(n / LARGE_SHARD))
    blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    kind = rows.schema["v"].dataType.simpleString()
    schema = pa.schema([("id", pa.int64()), ("v", pa.list_(pa.float32() if "float" in kind else pa.float64())), ("near", pa.int32()), ("codes", pa.binary()), ("scale", pa.float64()), ("lost", pa.float64())])

    def file(batches):
        q = Quantiser(*model.value)
        for batch in batches:
            if batch.num_rows:
                near, codes, scale, lost = encode(_matrix(batch.column(1), width), q)
                codes = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(schema.field("v").type), pa.array(near.astype(np.int32)), codes, pa.array(scale), pa.array(lost)], schema=schema)

    filed = saved(rows.select("id", "v").mapInArrow(file, f"id bigint, v {kind}, near int, codes binary, scale double, lost double"), "codes")
    # Each row goes to its shard for every block of queries, each query to its block for every shard.
    dealt = filed.select(F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), *filed.columns)
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "id", "v")

    def group(left: pa.Table, right: pa.Table) -> pa.Table:
        out = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if left.num_rows and right.num_rows:
            codes = np.frombuffer(b"".join(left["codes"].to_pylist()), np.uint8).reshape(left.num_rows, -1)
            encoded = (left["near"].to_numpy(), codes, left["scale"].to_numpy(), left["lost"].to_numpy())
            out = search_block(left["id"].to_numpy(), _matrix(left["v"], width), right["id"].to_numpy(), _matrix(right["v"], width), Quantiser(*model.value), k, rerank, encoded)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    return dealt.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(group, "query_id bigint, vec_id bigint, score double")
