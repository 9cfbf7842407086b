"""The Merkle manifest against brute force on small tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quarry.llm import merkle
from quarry.llm.storage import saved

DDL = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row):
    return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def _root(hashes):
    """The root, and of each leaf its (left, right) upwards."""
    ways, where = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        runs = [hashes[i : i + 8] for i in range(0, len(hashes), 8)]
        for k, at in enumerate(where):
            run = runs[at // 8]
            ways[k].append(("".join(run[: at % 8]), "".join(run[at % 8 + 1 :])))
        hashes, where = [_h(*r) for r in runs], [at // 8 for at in where]
    return hashes[0], ways


def _lower(text):
    return text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def _brute(rows):
    trees = defaultdict(list)
    for r in rows:
        trees[(r[2] is not None, (r[2] or "").encode())].append(r)
    found = {}
    for g in sorted(trees):
        trees[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))
        found[g] = _root([_leaf(r) for r in trees[g]])
    root, upper = _root([found[g][0] for g in sorted(found)])
    out = []
    for g, above in zip(sorted(found), upper, strict=True):
        for r, way in zip(trees[g], found[g][1], strict=True):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            h = _leaf((*r[:4], _lower(r[4])) if hit else r)
            for left, right in way + above:
                h = _h(left, h, right)
            out.append((r[0], _leaf(r), found[g][0], root, _h(*[a + b for a, b in way + above]), h, h == root))
    return Counter(out)


def _rows(df):
    return Counter(tuple(r) for r in df.collect())


def _table(n, seed=3):
    rng = random.Random(seed)
    texts = ["", None, "Some Text", "no capitals", "É 😀 Z", "x" * 70_000 + "Y"]
    ids = [rng.choice([i, i * 1000, -i, (1 << 62) + i]) for i in range(n)]
    return [(i, rng.choice(["web", None]), rng.choice(["en", "en", "en", "é", "", None]), rng.choice([None, 5]), rng.choice(texts)) for i in ids]


def test_manifest_equals_brute_force_with_nulls_ties_and_repeats(spark):
    rows = _table(300)
    rows += [(None, None, None, None, None)] * 3 + [(7, "web", "en", 1, "Same Row")] * 100 + [(7, "web", "en", 1, "other row")] + [(9, "a", "lone", 1, "One Leaf")]
    df = spark.createDataFrame([(*r, 1, "k", "p") for r in rows], DDL + ", rank int, tree string, path string")
    assert _rows(merkle.manifest(df)) == _brute(rows)


def test_one_document_and_one_language_and_none(spark):
    one = [(3, "s", "en", 3, "ABC")]
    assert _rows(merkle.manifest(spark.createDataFrame(one, DDL))) == _brute(one)
    rows = [(i, "s", "en", 3, "ABC") for i in range(65)]
    assert _rows(merkle.manifest(spark.createDataFrame(rows, DDL))) == _brute(rows)
    assert merkle.manifest(spark.createDataFrame([], DDL)).collect() == []


@pytest.mark.parametrize(("bucket", "digits"), [(4, 1), (30, 2), (4096, 3)])
def test_ranks_through_many_levels_of_buckets(spark, bucket, digits):
    rng = random.Random(bucket)
    keys = {("t", f"{rng.choice([i, 1 << 40, i << 30]):016x}{i:04x}"[: rng.choice([20, 20, 20])]) for i in range(400)} | {("u", "ab"), ("u", "abc"), ("u", "")}
    rows = [(t, k, rng.choice([1, 1, 5])) for t, k in sorted(keys)]
    table = saved(spark.createDataFrame(rows, "tree string, key string, n bigint"), "keys")
    got = {(r["tree"], r["key"]): r["start"] for r in merkle.ranked(table, bucket, digits).collect()}
    want, at = {}, Counter()
    for t, k, n in sorted(rows):
        want[t, k] = at[t]
        at[t] += n
    assert got == want


def test_any_tampering_shows(spark):
    rows = [(i, "s", "en", 3, f"Text {i}") for i in range(40)]
    got = {r["doc_id"]: r["verified"] for r in merkle.manifest(spark.createDataFrame(rows, DDL)).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 != 0 for i in range(40)}
    assert spark.range(1).select(merkle.leaf_hash([F.lit(None).cast("string"), F.lit("é")])).first()[0] == _h("-2:é")
