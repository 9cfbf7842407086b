"""Training-data operators against brute force, on a small table with awkward rows."""

import dataclasses
import hashlib
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from quarry.llm import bpe, language_id, mixing, nearest, personal_data, simhash, sketch, storage, subword_softmax, token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"word{i % 977} la {i}" for i in range(20000))
TEXTS = [
    None, "", " \n\t", "a", "Don't stop 12½ ΣΑΣ İ", "mail a.b@c.d.e and +1 (555) 555-5555, 1.2.3.4 or 4111 1111 1111 1111",
    "a@b.c@d.e x@y", "one two three four five six", "one two three four five six", "ONE two three four five six", "<|endoftext|> tail<|startoftext|>", LONG, "😀 日本語 \x1c x",
]
# The base patterns of personal data.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, h string, id string, t string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 == 0 else f"s{i % 3}", len(t or ""), "h", "id", "t") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe_equals_library(docs, empty):
    lib = Tokenizer.from_file(PATH)
    got = {r["doc_id"]: r for r in bpe.round_trip(docs, PATH).collect()}
    for i, t in enumerate(TEXTS):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.round_trip(empty, PATH).count() == 0


def test_every_settled_character_splits_as_the_library_does():
    lib, own = Tokenizer.from_file(PATH), bpe.Encoder(bpe.Vocabulary(PATH))
    texts = [f"x{chr(c)}y 1{chr(c)}" for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000]
    assert [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)] == [x.tolist() for x in own.encode_all(texts)]


def test_token_files_round_trip(docs, empty):
    lib = Tokenizer.from_file(PATH)
    start = 0
    for r in sorted(token_files.read(token_files.write(docs, PATH)).collect(), key=lambda r: r["doc_id"]):
        ids = [*lib.encode(TEXTS[r["doc_id"]] or "", add_special_tokens=False).ids, 1]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_files.read(token_files.write(empty, PATH)).count() == 0


def test_pack_any_values():
    rng = np.random.default_rng(0)
    for v in (np.zeros(0, int), np.array([5]), np.full(300, 7), rng.integers(0, 2**32, 1000), np.where(rng.random(5000) < 0.05, 2**31, rng.integers(0, 9, 5000))):
        image = token_files.pack(v)
        assert (token_files.unpack(image) == v).all()
        assert (token_files.unpack(image, 2, 5) == v[256:640]).all()


def _slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def test_simhash_fingerprints_and_groups(docs, empty, spark):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i]["fingerprint"] == f"{_slow_print(t):016x}"
    assert got[0]["component_id"] == got[1]["component_id"] == got[2]["component_id"] == 0
    assert got[7]["component_id"] == got[8]["component_id"] == got[9]["component_id"] == 7
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_first(docs.union(docs))
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({r["component_id"] for r in got.values()})


def test_links_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 2**63, 12)
    prints = sorted({int(s) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 5))) for s in seeds for _ in range(25)})
    want = {(a, b) for a in prints for b in prints if a < b and bin(a ^ b).count("1") <= 3}
    table = spark.createDataFrame([(p,) for p in prints], "print bigint")
    for crowded in (64, 1):
        monkeypatch.setattr(simhash, "CROWDED", crowded)
        assert {(r["a"], r["b"]) for r in simhash.links(table).collect()} == want
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "a bigint, b bigint")
    assert {(r["node"], r["root"]) for r in simhash.components(chain).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


def test_personal_data_base_spans(docs, empty, spark):
    rows = {r["doc_id"]: r for r in personal_data.find(docs).collect()}
    assert (rows[5]["n_email"], rows[5]["n_ip"], rows[5]["n_card"], rows[5]["n_phone"]) == (1, 1, 1, 1)
    assert rows[6]["spans"] == "email:0:5"
    assert rows[0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert personal_data.find(empty).count() == 0
    clean = {r["doc_id"]: r["text"] for r in personal_data.redact(docs).collect()}
    assert clean[5] == "mail [EMAIL] and [PHONE], [IP] or [CARD]" and clean[0] is None and clean[11] == LONG


def test_personal_data_contexts_find_unseen(spark):
    seeds = [(i, f"note contact via u{i}@mail.org now") for i in range(12)]
    rows = spark.createDataFrame([*seeds, (100, "please contact via u7(at)mail.org now"), (101, "room 4b is free")], "doc_id bigint, text string")
    found = {r["doc_id"]: r for r in personal_data.find(rows).collect()}
    assert found[100]["n_added"] == 1 and found[100]["spans"].startswith("email:19:") and found[101]["n_added"] == 0


@pytest.mark.parametrize("most", [100_000, 0])
def test_mixing_meets_targets(spark, docs, empty, monkeypatch, most):
    monkeypatch.setattr(storage, "MOST_ROWS", most)
    rng = np.random.default_rng(2)
    rows = [(i, "w " * int(rng.integers(0, 60)), None if i % 5 == 4 else f"s{i % 5}" if i % 3 else "s0") for i in range(3000)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix(table).collect()
    assert len(got) == len(rows) and all(r["taken"] <= 3 * r["size"] and r["size"] == len(rows[r["doc_id"]][1].split()) for r in got)
    by = {}
    for r in got:
        by.setdefault(rows[r["doc_id"]][2], []).append(r)
    for own in by.values():
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 60
        assert own[0]["target"] <= 3 * own[0]["source_size"]
    assert abs(sum(v[0]["target"] for v in by.values()) - sum(r["size"] for r in got)) < 1e-6
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(table.repartition(7)).collect()))
    names = [f"s{n:03d}" for n in range(40)]
    many = mixing.targets(spark.createDataFrame([*((s, 10) for s in names), (None, 10)], "source string, size bigint"))
    assert {r["source"]: r["weight"] for r in many.collect()} == {s: float(mixing.WEIGHTS[n % 3]) for n, s in enumerate([*names, None])}
    assert mixing.mix(empty).count() == 0 and mixing.mixed(docs.union(docs)).columns == docs.columns


def test_sketch(docs, empty):
    got = {r["doc_id"]: r for r in sketch.neighbours(docs).collect()}
    n = len(TEXTS)
    for i, t in enumerate(TEXTS):
        t, after = t or "", TEXTS[(i - 1) % n] or ""
        assert got[i]["edited_sha256"] == hashlib.sha256(sketch.edited(t, after).encode()).hexdigest() and got[i]["n_chars"] == len(t)
    assert got[8]["near_next"] == 1.0 and got[7]["fingerprint"] == got[8]["fingerprint"] and got[11]["near_edited"] > 0.4
    assert sketch.neighbours(empty).count() == 0
    a, b = sketch.shingle_hashes(LONG), sketch.shingle_hashes("one two three four five six seven")
    assert (sketch.merge(sketch.sketch(a), sketch.sketch(b)) == sketch.sketch(np.union1d(a, b))).all()


@pytest.mark.parametrize(("sources", "each", "rate"), [(4000, 12, 0.3), (500, 150, 0.7)])
def test_mixing_takes_documents_of_all_sizes_at_one_rate(spark, sources, each, rate):
    """Over many small sources the mean copies by size are the rate, within three and a half standard errors."""
    sizes = [1, 5, 20, 80, 160, 500]
    rows = [(s * each + i, 0, 0, s, sizes[i % len(sizes)], rate) for s in range(sources) for i in range(each)]
    made = mixing.copies(spark.createDataFrame(rows, "id bigint, salt bigint, number bigint, source int, size bigint, rate double")).collect()
    assert len(made) == len(rows) and {r["copies"] for r in made} == {0, 1}
    by_size, words = {}, {}
    for r in made:
        by_size.setdefault(r["size"], []).append(r["copies"])
        words[r["source"]] = words.get(r["source"], 0) + r["size"] * r["copies"]
    for size, got in by_size.items():
        assert abs(np.mean(got) - rate) < 3.5 * np.sqrt(rate * (1 - rate) / len(got)), (size, np.mean(got))
    # a source misses its target by one document at most, and where it has enough of them by a small one
    whole = rate * sum(sizes) * each / len(sizes)
    missed = np.abs(np.array(list(words.values())) - whole)
    assert missed.max() <= max(sizes) and (each < 100 or np.median(missed) <= 1 + 1e-6), (missed.max(), np.median(missed))


def _plain_pivotal(rows, rate, rng):
    """Pivotal rounding, one pair after the other, as the rule has it: copies by place."""
    order = sorted(range(len(rows)), key=lambda i: -rows[i])
    p, out = [rate] * len(rows), [None] * len(rows)
    a = order[0]
    for x in order[1:]:
        up, down = min((1 - p[a]) * rows[a], p[x] * rows[x]), min(p[a] * rows[a], (1 - p[x]) * rows[x])
        moved = up if rng.random() * (up + down) < down else -down
        p[a], p[x] = p[a] + moved / rows[a], p[x] - moved / rows[x]
        done = a if min(p[a], 1 - p[a]) < 1e-9 else x
        out[done], a = round(p[done]), x if done == a else a
    out[a] = int(rng.random() < p[a])
    return out


def test_mixing_is_as_fair_and_closer_than_a_plain_pivotal_loop(spark):
    rng = np.random.default_rng(2)
    sizes = np.exp(rng.normal(4, 1.5, 40)).astype(int) + 1
    rows = [(s * 40 + i, 0, 0, s, int(w), 0.4) for s in range(300) for i, w in enumerate(sizes)]
    made = mixing.copies(spark.createDataFrame(rows, "id bigint, salt bigint, number bigint, source int, size bigint, rate double")).collect()
    got = np.zeros((300, 40))
    for r in made:
        got[r["source"], r["id"] % 40] = r["copies"]
    plain = np.array([_plain_pivotal(sizes, 0.4, rng) for _ in range(300)])
    error = np.sqrt(0.4 * 0.6 / 300)
    assert np.abs(got.mean(axis=0) - 0.4).max() < 3.8 * error and np.abs(plain.mean(axis=0) - 0.4).max() < 3.8 * error
    off = [np.abs(c @ sizes - 0.4 * sizes.sum()).mean() for c in (got, plain)]
    assert off[0] <= off[1]


@pytest.mark.parametrize("unit", [".", "-", "7", "(", "+1-", "a.", "1.", "@", "\u3000", "5) "])
def test_personal_data_in_a_million_characters_of_one_kind(spark, unit):
    long = (unit * 1_000_000)[:1_000_000]
    rows = [(1, long), (2, long[:999_999] + "1"), (3, f"{long} mail me at someone@example.org {long[:1000]}")]
    began = time.time()
    got = {r["doc_id"]: r for r in personal_data.find(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert time.time() - began < 30
    assert got[3]["n_email"] >= 1 and len(got) == 3


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 9)).astype(np.float32)
    x[50:90] = x[40]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000, None), (1001, [0.0] * 9), (1002, [float("nan")] * 9), (1003, [1.0])]
    got = {}
    for r in nearest.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), "id % 20 = 0").collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == set(range(0, 400, 20))
    hits = 0
    for q, found in got.items():
        s = (x.astype(float) * x[q].astype(float)).sum(axis=1)
        want = [i for i in sorted(range(400), key=lambda i: (-s[i], i)) if i != q][:20]
        hits += len(set(want) & {v for v, _ in found.values()})
        assert all(abs(s[v] - score) < 1e-9 for v, score in found.values())
        assert [v for v, _ in (found[k] for k in sorted(found))] == sorted((v for v, _ in found.values()), key=lambda i: (-s[i], i))
    assert hits >= 0.9 * 20 * len(got)


@pytest.mark.parametrize("noise", [1e-3, 1e-2])
def test_nearest_tells_near_copies_apart(noise):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[::3] = x[0] + noise * rng.normal(size=(1000, 16)) / 4
    x, ids = x.astype(np.float32), np.arange(3000)
    asked = ids[::25]
    at, found, _ = nearest.search_block(ids, x, asked, x[asked], nearest.fit(x), 20, nearest.RERANK)
    for i in asked:
        s = (x.astype(float) * x[i].astype(float)).sum(axis=1)
        assert found[at == i].tolist() == [j for j in np.lexsort((ids, -s)) if j != i][:20]


@pytest.mark.parametrize(("noise", "share"), [(0.0, 0.0), (1e-3, 0.34), (1e-2, 0.34), (3e-2, 0.34), (1e-1, 0.6)])
def test_nearest_is_decided_by_the_table_scan(noise, share):
    """On plain and on clustered data under a tenth of all rows is ranked exactly, and recall is 0.9 or more."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(20_000, 32)) / np.sqrt(32)
    near = rng.random(len(x)) < share
    x[near] = x[0] + noise * rng.normal(size=(int(near.sum()), 32)) / np.sqrt(32)
    x, ids = x.astype(np.float32), np.arange(len(x))
    asked, q = ids[::250], nearest.fit(x[rng.permutation(len(x))[: nearest.SAMPLE]])
    best, ranked = {int(i): [] for i in asked}, np.zeros(len(asked))
    for shard in range(3):
        own, count = ids % 3 == shard, []
        for i, j, score in zip(*nearest.search_block(ids[own], x[own], asked, x[asked], q, 20, nearest.RERANK, count=count), strict=True):
            best[int(i)].append((-score, int(j)))
        ranked += count
    assert ranked.max() < 0.1 * len(x)
    hits, wide = 0, x.astype(float)
    for i in asked:
        s = wide @ wide[i]
        s[i] = -np.inf
        hits += len(set(np.lexsort((ids, -s))[:20].tolist()) & {j for _, j in sorted(best[int(i)])[:20]})
    assert hits >= 0.9 * 20 * len(asked)


def test_language(spark, docs, empty):
    words = {"en": "the and of this that with from", "de": "der die und nicht ein sich auch"}
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(words[k].split(), 30)), k) for i in range(200) for k in ("en", "de")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.train(table)
    found = language_id.identify(table, model).join(table.select("doc_id", "lang"), "doc_id").where("lang_pred = lang").count()
    assert found >= 0.9 * 400
    got = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    assert got[0]["lang_pred"] == got[1]["lang_pred"] == "und" and got[0]["rejected"] and 0 <= got[3]["score"] <= 1
    assert language_id.identify(docs, {}).where("lang_pred <> 'und'").count() == 0 and language_id.keep_identified(empty, model).count() == 0


def test_classifier(spark, docs, empty):
    rng = np.random.default_rng(5)
    plain = [f"{a}{b}" for a in ("ta", "lo", "mi", "re") for b in ("na", "so", "ku", "vi")]
    rows = [(i, " ".join([*rng.choice(plain, 20), *(["scoundrel"] if i % 2 else [])]), i % 2) for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, y int")
    s = subword_softmax.Settings(documents=200, epochs=5, buckets=1 << 14, slices=2, shift=False)
    model = subword_softmax.train(table.select("doc_id", "text"), table.select("doc_id", "y"), "y", s)
    got = subword_softmax.score(table, model, 0.5).join(table.select("doc_id", "y"), "doc_id")
    assert got.where("y = predicted").count() >= 290
    assert subword_softmax.Scorer(model).score(["tana scoundrels mina loku"])[0] > subword_softmax.Scorer(model).score(["tana mina loku"])[0]
    assert all(0 <= r["score"] <= 1 for r in subword_softmax.score(docs, model, 0.5).collect()) and subword_softmax.score(empty, model, 0.5).count() == 0
    assert subword_softmax.fit([], [], s).prior == 0.5


def test_a_rare_sign_counts_where_the_rarer_class_has_few_documents():
    rng = np.random.default_rng(6)
    parts = ["na", "so", "ku", "vi", "ta", "lo", "mi", "re", "be", "du"]
    word = lambda: "".join(rng.choice(parts, rng.integers(1, 4)))

    def text(y):
        words = [word() for _ in range(150)]
        for at in rng.integers(0, 150, 3 if y else 0):
            words[at] = f"zura{word()}"
        return " ".join(words)

    s = subword_softmax.Settings(epochs=6, buckets=1 << 16, least=2, doubt=2.0, shift=False)
    y = [int(i % 15 == 0) for i in range(600)]
    model = subword_softmax.fit([text(k) for k in y], y, s)
    held = [int(i % 2) for i in range(100)]
    got = subword_softmax.Scorer(model).score([text(k) for k in held])
    assert sum((x >= 0.5) != k for x, k in zip(got, held, strict=True)) <= 3
    only = [(np.array([1, 2]), np.ones(2)) if i % 2 else (np.array([1]), np.ones(1)) for i in range(40)]
    met = np.bincount(np.concatenate([at for at, _ in only]), minlength=s.buckets)
    weight = subword_softmax.evidence(only, np.arange(40) % 2, met, s)
    assert weight[1] == 0 and weight[2] == 1 and not weight[3:].any()
    assert (subword_softmax.evidence(only[:2], np.zeros(2, int), met, dataclasses.replace(s, doubt=0.0)) == 1).all()


def test_empty_text_scores_the_share_of_all_labels(spark):
    from quarry.llm.queries import TOXIC

    rows = [(i, f"la{i % 7} mo{i % 5}" + (" scoundrel" if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(14000)]
    table = spark.createDataFrame([*rows, (14000, None, None), (14001, " \n", None)], "doc_id bigint, text string, y int")
    s = dataclasses.replace(TOXIC, epochs=1, slices=0)
    model = subword_softmax.train(table.select("doc_id", "text"), table.select("doc_id", "y"), "y", s)
    got = subword_softmax.score(table.where("doc_id >= 14000"), model, 0.5).collect()
    assert [(r["score"], r["predicted"]) for r in got] == [(0.2, 0)] * 2


def _slow_spans(text):
    """The base spans by the contract's own patterns."""
    found = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            found.append((m.start(), rank, m.end(), kind))
    return sorted(found)


def _slow_redacted(text):
    out, at = "", 0
    for start, _, end, kind in _slow_spans(text):
        if start >= at:
            out += text[at:start] + f"[{kind.upper()}]"
        at = max(at, end)
    return out + text[at:]


def _slow_firsts(texts):
    """The least id of each group of linked fingerprints."""
    prints = {i: _slow_print(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sorted(prints):
        for b in sorted(prints):
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= 3:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {top(i) for i in texts}


def test_pipeline_stages_equal_brute_force(spark, sf_dir):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "personal_data", "mixing", "bpe"]
    docs, tables = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        tables.append(docs)
        docs = storage.saved(stage(spark, docs, sf_dir), "stage")
    assert all(t.dtypes == tables[0].dtypes for t in tables)
    start, known, single, clean, mixture = ([r.asDict() for r in t.collect()] for t in tables)
    encoders = language_id.compressors(corpus_pipeline.language_dictionaries(tables[0]))
    margins = {r["doc_id"]: language_id.classify(r["text"], encoders) for r in start}
    want = {i for i, (lang, _, margin) in margins.items() if lang != "und" and margin >= language_id.MIN_MARGIN}
    assert sorted(r["doc_id"] for r in known) == sorted(want) and len(want) > len(start) / 2
    assert sorted(r["doc_id"] for r in single) == sorted(_slow_firsts({r["doc_id"]: r["text"] for r in known}))
    added = {r["doc_id"] for r in personal_data.find(tables[2]).where("n_added > 0").collect()}
    before = {r["doc_id"]: r["text"] for r in single}
    assert len(clean) == len(single) and any(r["text"] != before[r["doc_id"]] for r in clean)
    for r in clean:
        assert r["doc_id"] in added or r["text"] == _slow_redacted(before[r["doc_id"]])
        assert r["n_chars"] == len(r["text"])
    plan = {r["doc_id"]: r for r in mixing.mix(tables[3]).collect()}
    sources = {}
    for r in clean:
        p = plan[r["doc_id"]]
        copies = [m for m in mixture if m["doc_id"] == r["doc_id"]]
        rate = p["target"] / p["source_size"] if p["source_size"] else 0
        assert all(m == r for m in copies) and (not p["size"] or abs(len(copies) - rate) < 1)
        s = sources.setdefault(r["source"], [0, 0, p["target"]])
        s[0], s[1] = s[0] + len(copies) * p["size"], max(s[1], p["size"])
    assert all(abs(taken - target) <= largest for taken, largest, target in sources.values())
    lib = Tokenizer.from_file(PATH)
    ids = [(r["doc_id"], lib.encode(r["text"], add_special_tokens=False).ids) for r in mixture]
    expected = sorted((i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(x, skip_special_tokens=False).encode()).hexdigest()) for i, x in ids)
    assert sorted(map(tuple, docs.collect())) == expected == sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect()))


def test_pipeline_stages_take_awkward_tables(docs, empty, spark, sf_dir):
    import corpus_pipeline

    for table in (docs.union(docs), empty):
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, table, sf_dir)
            assert n == 4 or out.columns == table.columns
            rows = out.count()
            assert rows == 0 if table is empty else rows > 0 or n == 0
