"""The registered queries over whole tables, with production parameters, against brute force."""

import os
import subprocess
import sys
import textwrap
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import language_id, mixing, queries, simhash, sketch, subword_softmax
from tests.llm.test_operators import _slow_print, _slow_spans

REPO = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def _held(i, n, k):
    return zlib.crc32(str(i).encode()) % n == k


def test_queries_and_pipeline_run_where_workers_cannot_import_the_package(tmp_path, sf_dir):
    script = f"""
        import sys
        sys.path.insert(0, {str(REPO)!r})
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()

        def reach(batches):
            import importlib.util
            import pyarrow as pa
            yield pa.RecordBatch.from_pydict({{"found": [importlib.util.find_spec("quarry") is not None]}})

        assert not any(r["found"] for r in spark.range(1).mapInArrow(reach, "found boolean").collect()), "workers can import the package"
        import __spark_entry__
        names = [n for n in __spark_entry__.queries() if n.startswith("op") or n == "pipeline"]
        assert len(names) == 14, names
        for n in names:
            print(n, __spark_entry__.queries()[n](spark, {sf_dir!r}).count())
    """
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    assert len([x for x in done.stdout.splitlines() if x.startswith(("op", "pipeline")) and int(x.split()[1]) > 0]) == 14


def test_language_id(spark, sf_dir, texts):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    encoders = language_id.compressors(queries.language_dictionaries(docs))
    got = {r["doc_id"]: r for r in queries.op1_language_id(spark, sf_dir).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        best, score, _ = language_id.classify(t, encoders)
        assert (got[i]["lang_pred"], got[i]["score"], got[i]["held_out"]) == (best, score, _held(i, 4, 2))
    held = [i for i in texts if _held(i, 4, 2) and lang[i] is not None]
    assert np.mean([got[i]["lang_pred"] == lang[i] for i in held]) >= 0.95


def test_dictionary_is_drawn_from_distinct_texts(spark):
    many = [(i, "der die das und nicht", "de") for i in range(3000)] + [(3000 + i, f"wort{chr(97 + i)} satz{chr(98 + i)} zeile", "de") for i in range(8)]
    model = language_id.train(spark.createDataFrame(many, "doc_id bigint, text string, lang string"))
    assert b"nicht" in model["de"] and all(f"wort{chr(97 + i)} ".encode() in model["de"] for i in range(8))


def test_mixing(spark, sf_dir, texts):
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.op2_mixing(spark, sf_dir).collect()}
    size = {i: len((t or "").encode().split()) for i, t in texts.items()}
    assert {i: r["size"] for i, r in got.items()} == size and all(0 <= r["taken"] <= 3 * r["size"] for r in got.values())
    names = sorted({s for s in source.values() if s is not None}) + [None] * (None in source.values())
    weight = {s: mixing.WEIGHTS[n % 3] for n, s in enumerate(names)}
    whole = {s: sum(size[i] for i in texts if source[i] == s) for s in names}
    target, free = {}, set(names)
    while True:
        level = (sum(whole.values()) - sum(target.values())) / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * level > 3 * whole[s]}
        if not over:
            break
        target |= {s: 3.0 * whole[s] for s in over}
        free -= over
    target |= {s: weight[s] * level for s in free}
    for s in names:
        own = [i for i in texts if source[i] == s]
        assert abs(got[own[0]]["target"] - target[s]) < 1e-6 * max(1, target[s]) and got[own[0]]["source_size"] == whole[s]
        # Rounding is fair: of so few documents the last one, of whatever size, may be taken or not.
        assert abs(sum(got[i]["taken"] for i in own) - target[s]) <= max(0.01 * target[s], max(size[i] for i in own))


def test_mixing_is_near_its_targets_where_sources_have_documents_enough(spark, sf_dir):
    """Within 1 % of every target on the table of fifty documents a source, by the order of meeting alone."""
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    got = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 0.01 * r["target"] for r in got) and len(got) == 20


@pytest.mark.parametrize("settings", [queries.QUALITY, queries.TOXIC])
def test_scorer_equals_the_plain_model(settings):
    rng = np.random.default_rng(1)
    s = subword_softmax.dataclasses.replace(settings, buckets=1 << 12)
    model = subword_softmax.Model(s, rng.normal(size=s.buckets).astype(np.float32), 0.3, 0.2)
    rows = ["a", "One two two three", "x " * 50 + "Ünïcode 日本 <b>", " ".join(f"w{i % 37}" for i in range(900))]
    want = []
    for t in rows:
        at, value = subword_softmax.features(t, s)
        want.append(1 / (1 + np.exp(-(model.bias + float((model.logits[at].astype(float) * value).sum())))))
    assert np.allclose(subword_softmax.Scorer(model).score(rows), want, atol=1e-6)


@pytest.mark.parametrize("name, label, n, k, threshold, errors", [("op3_quality", "quality", 4, 2, 0.7, 0.1), ("op8_toxicity", "toxic", 5, 0, 0.5, 0.25)])
def test_classifiers(spark, sf_dir, texts, name, label, n, k, threshold, errors):
    got = {r["doc_id"]: r for r in queries.QUERIES[name](spark, sf_dir).collect()}
    assert set(got) == set(texts) and all(0 <= r["score"] <= 1 and r["held_out"] == _held(i, n, k) and r["predicted"] == int(r["score"] >= threshold) for i, r in got.items())
    held = [(got[r["doc_id"]]["predicted"], r[label]) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if _held(r["doc_id"], n, k) and r[label] is not None]
    assert np.mean([a != b for a, b in held]) <= errors


def test_long_texts_are_learned_from(spark):
    s = subword_softmax.Settings(documents=60, characters=20_000, epochs=4, buckets=1 << 14, shift=False)
    rows = [(i, ("bad " if i % 2 else "fine ") * 400, i % 2) for i in range(60)]  # all over a hundredth of the characters
    table = spark.createDataFrame(rows, "doc_id bigint, text string, y int")
    model = subword_softmax.train(table.select("doc_id", "text"), table.select("doc_id", "y"), "y", s)
    bad, fine = subword_softmax.Scorer(model).score(["bad", "fine"])
    assert bad > 0.8 and fine < 0.2


def test_personal_data(spark, sf_dir, texts):
    import hashlib

    for r in queries.op5_personal_data(spark, sf_dir).collect():
        spans = _slow_spans(texts[r["doc_id"]] or "")
        told = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(x[3] == k for x in spans) for k in ("email", "ip", "card", "phone")]
        assert set(told.split(",")) - {""} <= set(r["spans"].split(",")) and (r["n_added"] or r["spans"] == told)


def test_contexts_find_unseen_identifiers_among_the_documents_and_nothing_else(spark, sf_dir):
    from quarry.llm import personal_data

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    planted = [(10**9 + i, f"please 2write to u{i}@mail{i % 7}.org or call desk{i % 3} tel: +1 (555) 01{i % 10}-{1000 + i} soon") for i in range(80)]
    unseen = [(2 * 10**9 + i, f"la lo 4write to v{i}(at)mail{i}.org and then desk7 tel: 555.01{i % 10}.{2000 + i} ok") for i in range(10)]
    decoys = [(3 * 10**9 + i, f"note to w{i}x write 12.{i} or la {i}(at) room{i}@ tel 5 desk9 555.019.{3000 + i}") for i in range(10)]
    rows = docs.union(spark.createDataFrame(planted + unseen + decoys, "doc_id bigint, text string"))
    added = {r["doc_id"]: r for r in personal_data.find(rows).where("n_added > 0").collect()}
    assert set(added) == {i for i, _ in unseen}  # recall and precision 1
    for i, t in unseen:
        a, b = t.index("v"), t.index(" and")
        c, d = t.index("555"), t.index(" ok")
        assert added[i]["spans"] == f"email:{a}:{b},phone:{c}:{d}"


def test_nearest_at_size(spark):
    from quarry.llm import nearest

    rng = np.random.default_rng(9)
    x = rng.normal(size=(20_000, 16)).astype(np.float32)
    x[: 6_000] = x[0] + 0.05 * rng.normal(size=(6_000, 16))  # a third of all rows stand close together
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    assert nearest.RERANK < 0.05 * len(x)
    got = {}
    for r in nearest.search(rows, "id % 20 = 0").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    wide, hits = x.astype(float), 0
    for q in range(0, len(x), 20):
        s = wide @ wide[q]
        s[q] = -np.inf
        best = set(np.lexsort((np.arange(len(x)), -s))[:20].tolist())
        hits += len(best & {v for _, v, _ in got[q]})
        assert len(got[q]) == 20
    assert hits >= 0.9 * 20 * len(got) and len(got) == 1000


@pytest.mark.parametrize("kind", ["double", "float"])
def test_nearest_with_repeated_ids_rows_and_widths(spark, kind):
    from quarry.llm import nearest

    rng = np.random.default_rng(3)
    ids = np.concatenate([np.arange(300), [20] * 40, [7] * 30, [40] * 3, np.arange(100)])
    x = rng.normal(size=(len(ids), 7)) * 1e-3
    x[-100:] = x[:100]
    if kind == "float":
        x = x.astype(np.float32).astype(np.float64)
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)] + [(1000, [1.0, 2.0]), (1001, [1.0, 1.0]), (1002, [1e30, 1.0])]
    got = {}
    for r in nearest.search(spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>"), "id % 20 = 0").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in sorted(set(ids.tolist())):
        if q % 20 == 0:
            score = (x * np.array(min(map(tuple, x[ids == q])))).sum(axis=1)
            best = {}
            for i, s in zip(ids.tolist(), score.tolist(), strict=True):
                best[i] = max(best.get(i, -np.inf), s)
            best.pop(q)
            want = sorted(best.items(), key=lambda t: (-t[1], t[0]))[:20]
            assert [(v, s) for _, v, s in sorted(got[q])] == [(v, pytest.approx(s, rel=1e-12, abs=1e-18)) for v, s in want]
    assert [v for _, v, _ in sorted(got[1000])] == [1002, 1001]
    empty = spark.createDataFrame([], f"vec_id bigint, embedding array<{kind}>")
    assert nearest.search(empty, "id % 20 = 0").count() == 0
    with pytest.raises(ValueError, match="lengths"):
        nearest.search(spark.createDataFrame([(i, [1.0] * i) for i in range(1, 30)], f"vec_id bigint, embedding array<{kind}>"), "id % 20 = 0")


def test_fingerprints(spark, sf_dir, texts):
    order = sorted(texts, reverse=True)
    got = {r["doc_id"]: r for r in queries.op7_fingerprints(spark, sf_dir).collect()}
    wrong = []
    for n, i in enumerate(order):
        after = texts[order[(n + 1) % len(order)]] or ""
        own, new, other = (sketch.shingle_hashes(t) for t in (texts[i], sketch.edited(texts[i] or "", after), after))
        assert got[i]["fingerprint"] == sketch.write(sketch.sketch(own)).hex() and got[i]["edited_fingerprint"] == sketch.write(sketch.sketch(new)).hex()
        level, kept = int(sketch.sketch(own)[0]), sketch.sketch(own)[1:]
        assert kept.tolist() == [h for h in own.tolist() if h < 1 << (64 - level)] and (level == sketch.LEAST or len(kept) <= sketch.MOST)
        for name, b in (("near_edited", new), ("near_next", other)):
            true = len(np.intersect1d(own, b)) / min(len(own), len(b)) if len(own) and len(b) else float(len(own) == len(b))
            wrong.append(abs(true - got[i][name]))
    assert np.mean(wrong) < 0.06 and max(wrong) < 0.6


def test_sketches_merge_to_that_of_the_union():
    rng = np.random.default_rng(1)
    for a, b in ((0, 3), (3, 3), (40, 900), (5000, 60), (20, 20), (400, 4000)):
        x, y = (np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in (a, b))
        both, merged = sketch.sketch(np.union1d(x, y)), sketch.merge(sketch.sketch(x), sketch.sketch(y))
        assert both.tolist() == merged.tolist() == sketch.read(sketch.write(merged)).tolist()
    small, large = (np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in (2000, 100_000))
    assert abs(sketch.likeness(sketch.sketch(small), sketch.sketch(np.union1d(large, small[::2]))) - 0.5) < 0.15


def test_simhash(spark, sf_dir, texts):
    got = {r["doc_id"]: r for r in queries.op10_simhash(spark, sf_dir).collect()}
    prints = {i: _slow_print(t) for i, t in texts.items()}
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == prints
    root = {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= simhash.DISTANCE:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    assert {i: r["component_id"] for i, r in got.items()} == {i: top(i) for i in texts}


def test_one_id_or_none_for_many_rows(spark):
    from pyspark.sql import functions as F

    from quarry.llm import token_files

    one = spark.range(60_000).select(F.lit(5).cast("bigint").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("x").alias("source"))
    none = spark.range(40_000).select(F.lit(None).cast("bigint").alias("doc_id"), F.concat(F.lit("w "), F.col("id").cast("string")).alias("text"), F.lit("y").alias("source"))
    rows = one.union(none)
    got = mixing.mix(rows).groupBy("target").agg(F.count("*").alias("n"), F.sum("taken").alias("taken")).collect()
    assert sorted(r["n"] for r in got) == [40_000, 60_000] and all(abs(r["taken"] - r["target"]) <= 3 for r in got)
    sums = {r["source"]: r["count"] for r in mixing.mixed(rows).groupBy("source").count().collect()}
    by = {r["n"]: r["taken"] for r in got}
    assert abs(sums["x"] - by[60_000] / 3) <= 1 and abs(sums["y"] - by[40_000] / 2) <= 1
    assert simhash.keep_first(rows.limit(5000).union(none.limit(5000))).where("doc_id = 5").count() == 1
    files = token_files.write(none, queries.VOCABULARY)
    assert files.select("part").distinct().count() > 1 and token_files.read(files).count() == 40_000


CLASHES = "more _id _h _row _n _copies _copy row none id h t all name salt copies copy clean found_id"


def test_columns_of_any_name_survive(spark, sf_dir):
    from pyspark.sql import functions as F

    from quarry.llm import personal_data

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = queries.language_dictionaries(docs)
    more = docs.union(docs.limit(50)).withColumns({c: F.lit(c) for c in CLASHES.split()}).withColumn("a.b", F.lit(1)).withColumn("m", F.create_map(F.lit("k"), F.col("n_chars")))
    plain, extra = docs.union(docs.limit(50)), [c for c in more.columns if c not in docs.columns]
    for change in (personal_data.redact, simhash.keep_first, mixing.mixed, lambda d: language_id.keep_identified(d, model)):
        got = change(more)
        assert got.dtypes == more.dtypes
        rows = got.collect()
        if change is mixing.mixed:  # its random choices depend on whole rows
            assert {(r["doc_id"], r["text"], r["source"]) for r in rows} <= {(r["doc_id"], r["text"], r["source"]) for r in plain.collect()}
        else:
            assert sorted((r["doc_id"], r["text"] or "") for r in rows) == sorted((r["doc_id"], r["text"] or "") for r in change(plain).collect())
        assert all(r[c] == c for r in rows for c in extra if c not in ("a.b", "m")) and all(r["a.b"] == 1 and set(r["m"]) == {"k"} for r in rows)
    for find in (personal_data.find, simhash.near_duplicates, mixing.mix, sketch.neighbours):
        assert sorted(map(str, find(more).collect())) == sorted(map(str, find(plain).collect()))


def test_rows_alike_but_for_other_columns_are_chosen_alike_in_every_run(spark):
    rows = spark.createDataFrame([(1, "a b c d", "s", f"other{i}") for i in range(40)] + [(2, "e f", "t", "x")], "doc_id bigint, text string, source string, note string")
    for change in (mixing.mixed, simhash.keep_first):
        assert sorted(map(tuple, change(rows).collect())) == sorted(map(tuple, change(rows.repartition(5)).collect()))
