"""Random columns by counter: uniform and normal values that are a hash of (row id, column, seed).

They are the same under any partitioning, on any retry and in SQL (the _sql forms), as nothing but the row decides
them. The hash mixes 32 bits at a time within 64-bit integers, so that no product overflows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

# An odd multiplier of good avalanche, and the word size.
MULTIPLIER = 0x45D9F3B
WORD = 0xFFFFFFFF
ROUNDS = 3


def _salt(column: int, seed: int, draw: int) -> int:
    """A 32-bit number for a column, a seed and one of a value's draws."""
    h = (seed * 1_000_003 + column * 8191 + draw * 131 + 7) & WORD
    for _ in range(ROUNDS):
        h = ((h ^ (h >> 16)) * MULTIPLIER) & WORD
    return h


def _word(row: Column, salt: int) -> Column:
    def mixed(h: Column) -> Column:  # a fold, so that h stands once in the expression
        return F.aggregate(F.array_repeat(F.lit(0), ROUNDS), h, lambda h, _: (h.bitwiseXOR(F.shiftright(h, 16)) * F.lit(MULTIPLIER)).bitwiseAND(F.lit(WORD)))

    row = row.cast("bigint")
    low, high = row.bitwiseAND(F.lit(WORD)), F.shiftright(row, 32).bitwiseAND(F.lit(WORD))
    return mixed(mixed(low.bitwiseXOR(F.lit(salt).cast("bigint"))).bitwiseXOR(high))


def uniform(row: Column, column: int = 0, seed: int = 42, draw: int = 0) -> Column:
    """In [0, 1), of 52 bits. row: an integer column that tells rows apart."""
    a, b = _word(row, _salt(column, seed, 2 * draw)), _word(row, _salt(column, seed, 2 * draw + 1))
    return (F.shiftright(a, 6) * F.lit(1 << 26) + F.shiftright(b, 6)) / F.lit(float(1 << 52))


def normal(row: Column, column: int = 0, seed: int = 42) -> Column:
    """Of mean 0 and variance 1, from two uniform draws."""
    return F.sqrt(-2 * F.log(1 - uniform(row, column, seed, 0))) * F.cos(F.lit(2 * math.pi) * uniform(row, column, seed, 1))


def _word_sql(row: str, salt: str) -> str:
    def mixed(h: str) -> str:
        return f"list_reduce([({h})::bigint, {', '.join('0' * ROUNDS)}], lambda h, z: (xor(h, h >> 16) * {MULTIPLIER}) & {WORD})"

    return mixed(f"xor({mixed(f'xor(({row}) & {WORD}, {salt})')}, (({row}) >> 32) & {WORD})")


def uniform_sql(row: str, column: int = 0, seed: int = 42, draw: int = 0) -> str:
    """uniform() in DuckDB SQL."""
    a, b = _word_sql(row, str(_salt(column, seed, 2 * draw))), _word_sql(row, str(_salt(column, seed, 2 * draw + 1)))
    return f"((({a}) >> 6) * {1 << 26} + (({b}) >> 6)) / {float(1 << 52)!r}::double"


def salts(columns: int, seed: int = 42, draw: int = 0) -> list[tuple[int, int]]:
    """The two salts of each of columns 0 .. columns - 1, for SQL over a list of columns."""
    return [(_salt(c, seed, 2 * draw), _salt(c, seed, 2 * draw + 1)) for c in range(columns)]


def uniform_sql_of(row: str, salt_a: str, salt_b: str) -> str:
    return f"((({_word_sql(row, salt_a)}) >> 6) * {1 << 26} + (({_word_sql(row, salt_b)}) >> 6)) / {float(1 << 52)!r}::double"


def uniform_matrix(rows: np.ndarray, columns: int, seed: int = 42, draw: int = 0) -> np.ndarray:
    """uniform() of many rows and columns 0 .. columns - 1 in a task, as a matrix."""
    rows = np.asarray(rows, np.int64).view(np.uint64)[:, None]
    word, by = np.uint64(WORD), np.uint64(MULTIPLIER)

    def mixed(h):
        for _ in range(ROUNDS):
            h = ((h ^ (h >> np.uint64(16))) * by) & word
        return h

    def words(which):
        salt = np.array([_salt(c, seed, 2 * draw + which) for c in range(columns)], np.uint64)[None]
        return mixed(mixed((rows & word) ^ salt) ^ ((rows >> np.uint64(32)) & word))

    return ((words(0) >> np.uint64(6)) * np.uint64(1 << 26) + (words(1) >> np.uint64(6))).astype(np.float64) / float(1 << 52)


def normal_matrix(rows: np.ndarray, columns: int, seed: int = 42) -> np.ndarray:
    """normal() of many rows and columns in a task."""
    return np.sqrt(-2 * np.log(1 - uniform_matrix(rows, columns, seed, 0))) * np.cos(2 * math.pi * uniform_matrix(rows, columns, seed, 1))


def vectors(rows: DataFrame, row_id: str, columns: int, seed: int = 42, kind: str = "uniform", name: str = "random") -> DataFrame:
    """Rows with a column of random vectors by row id: uniform or normal, as uniform() and normal() give them. Null ids get null vectors."""
    make, place = {"uniform": uniform_matrix, "normal": normal_matrix}[kind], rows.columns.index(row_id)

    def draw(batches):
        for batch in batches:
            ids = batch.column(place).cast(pa.int64())
            made = make(ids.fill_null(0).to_numpy(zero_copy_only=False), columns, seed)
            lists = pa.array([v if ok else None for v, ok in zip(made, ids.is_valid().to_pylist(), strict=True)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, name])

    return rows.mapInArrow(draw, StructType([*rows.schema.fields, StructField(name, ArrayType(DoubleType()))]))
