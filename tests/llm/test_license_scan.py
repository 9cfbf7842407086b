"""License scans against brute force: base places by regular expression, notices by trying every place."""

import re
from collections import Counter

import pytest

from quarry.llm import license_scan as ls
from quarry.llm import queries

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def _words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def _base(text):
    words = _words(text)
    found = [(i, label) for phrase, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def _labels(text, weights):
    """Every template at every place; of texts that hold a key phrase's words."""
    words, out = _words(text), set(filter(None, _base(text)[4].split(",")))
    for label, notice, keys in ls.NOTICES:
        template = _words(notice)
        if not all(set(_words(k)) <= set(words) for k in keys):
            continue
        own = [weights[w.encode()] for w in template]
        for s in range(-len(template), len(words)):
            part = words[max(0, s) : s + len(template) + ls.SLACK]
            if not all(f" {' '.join(_words(k))} " in f" {' '.join(part)} " for k in keys):
                continue
            share = sum(x for i, (w, x) in enumerate(zip(template, own, strict=True)) if w in words[max(0, s + i) : max(0, s + i + ls.SLACK + 1)])
            if share >= ls.ACCEPTED * sum(own) - 1e-9:
                out.add(label)
    return ",".join(sorted(out))


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    weights = ls.word_weights(docs)
    got = queries.op13_license_scan(spark, sf_dir).collect()
    assert len(got) == len(text)
    for r in got:
        t = text[r["doc_id"]]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == _base(t)
        assert r["labels"] == _labels(t, weights)
        assert 0 <= r["score"] <= 1 and (r["score"] == 1 or not r["n_base"]) and (r["score"] >= ls.ACCEPTED) == bool(r["labels"])
    assert sum(bool(r["labels"]) for r in got) > 1


def test_notices_are_found_whole_broken_and_changed_but_not_in_fragments(spark, sf_dir):
    prose = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    rows, want = [], {}
    for n, (label, notice, keys) in enumerate(ls.NOTICES):
        broken = " ".join(f"{w}\n * " if i % 7 == 6 else w for i, w in enumerate(notice.split(" ")))
        words = broken.split(" ")
        if len(words) > 16:  # a word too many, but in no key phrase
            tries = [[*words[:i], "so", *words[i:]] for i in range(len(words) // 2, len(words))]
            words = next(w for w in tries if all(f" {' '.join(_words(k))} " in f" {' '.join(_words(' '.join(w)))} " for k in keys))
        rows.append((n, f"{prose[n]}\n{' '.join(words).upper()}\n{prose[n + 1]}"))
        want[n] = label
        rows.append((100 + n, f"{prose[n]} " + " ".join(words[: len(words) // 3]) + f" {prose[n + 1]}"))
        rows.append((200 + n, " ".join(sorted(notice.split(), key=len))))
    rows += [(300 + i, t) for i, t in enumerate(prose)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    weights = ls.word_weights(docs)
    got = {r["doc_id"]: r for r in ls.scan(docs).collect()}
    for n, label in want.items():
        assert label in got[n]["labels"].split(","), (label, got[n]["labels"])
    for i, t in rows:
        assert got[i]["labels"] == _labels(t, weights), (i, got[i]["labels"])
    assert Counter(bool(got[200 + n]["labels"]) for n in want)[False] >= 12


@pytest.mark.parametrize("many", [1, 30_000])
def test_frequent_words_and_awkward_rows(spark, many):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "MIT license"), (5, "mit license " * many + "Apache-License"), (5, "mit license " * many + "Apache-License"), (6, "CC\x00BY éCC by"), (7, "license " * many), (8, "a" * (10 * many) + " cc/by")]
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id bigint, text string, t string, n_words int")
    got = ls.scan(docs).collect()
    assert len(got) == len(rows)
    want = Counter((i, *_base(t)) for i, t in rows)
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == want
    assert ls.scan(docs.limit(0)).collect() == []
