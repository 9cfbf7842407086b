"""Queries against code that shares nothing with the operators but their parameters."""

import hashlib
import unicodedata
import zlib
from collections import defaultdict

import xxhash
import zstandard

from quarry.llm import language_id, queries


def _letters(text):
    out = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text or "").lower().split()
    out = " ".join(out)
    return f" {out} " if any(unicodedata.category(c)[0] == "L" for c in out) else ""


def test_language_is_that_of_the_least_compressed_size(spark, sf_dir):
    """Sizes by fresh compressors over dictionaries made of texts and languages of the learned rows only."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.collect()
    words = queries.language_dictionaries(docs)
    learned = defaultdict(set)
    for r in rows:
        if r["lang"] and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            learned[r["lang"]] |= set(_letters(r["text"]).split())
    for lang, body in words.items():
        whole = body.decode("utf-8", "ignore").split()[1:-1]
        known = sum(w in learned[lang] for w in whole)
        assert known > 0.97 * len(whole)  # a slice may begin or end within a word
    got = {r["doc_id"]: r for r in queries.op1_language_id(spark, sf_dir).collect()}
    for r in rows:
        body = _letters(r["text"]).encode()
        if not body:
            assert (got[r["doc_id"]]["lang_pred"], got[r["doc_id"]]["score"]) == ("und", 0.0)
            continue
        sizes = {}
        for lang, d in words.items():
            c = zstandard.ZstdCompressor(level=language_id.LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes[lang] = sum(len(c.compress(body[i : i + language_id.BLOCK])) for i in range(0, len(body), language_id.BLOCK))
        # a dictionary that is prepared beforehand may cost a few bytes more or less than a fresh one
        assert sizes[got[r["doc_id"]]["lang_pred"]] <= min(sizes.values()) + max(8, 0.004 * min(sizes.values()))


def _shingles(text):
    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_fingerprints_hold_all_hashes_below_their_threshold(spark, sf_dir):
    """Each fingerprint, read digit by digit, is the set of low shingle hashes, and likeness is their shared part of the smaller set."""
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.op7_fingerprints(spark, sf_dir).collect()}
    order = sorted(texts, reverse=True)
    hashes = {i: {xxhash.xxh3_64_intdigest(s, 0) for s in _shingles(t)} for i, t in texts.items()}

    def read(digits):
        if not digits:
            return 0, set()
        assert (len(digits) - 2) % 16 == 0
        return int(digits[:2], 16), {int(digits[i : i + 16], 16) for i in range(2, len(digits), 16)}

    for n, i in enumerate(order):
        level, kept = read(got[i]["fingerprint"])
        assert kept == {h for h in hashes[i] if h < 2 ** (64 - level)} and 0 <= level <= 4
        # the least level that keeps 32 hashes or fewer, or the last
        for less in range(level):
            assert sum(h < 2 ** (64 - less) for h in hashes[i]) > 32
        assert level == 4 or len(kept) <= 32
        j = order[(n + 1) % len(order)]
        most = max(level, read(got[j]["fingerprint"])[0])
        a, b = ({h for h in hashes[k] if h < 2 ** (64 - most)} for k in (i, j))
        if a and b:
            assert abs(got[i]["near_next"] - len(a & b) / min(len(a), len(b))) < 1e-12
        text, after = texts[i], texts[j]
        k = len(text) // 3
        made = text[: len(text) - k] + after[:k]
        assert got[i]["edited_sha256"] == hashlib.sha256(made.encode()).hexdigest() and got[i]["n_chars"] == len(text)
