"""Byte-pair encoding and decoding with a priority queue of merge ranks.

A word's symbols form a doubly linked list; a heap holds each adjacent pair that has a merge rank,
lowest rank and then leftmost first. The popped pair joins if both its symbols are still as they were
when it was pushed, else the entry is stale and skipped; the new symbol pushes its two new pairs.
Decoding concatenates the vocabulary strings of the ids, with the separator that the file's decoder
asks for.

The vocabulary file is one of the "word" kind: NFC, white space to one space, lower case; words,
single digits and runs of symbols by pattern; bytes as visible characters; an end mark on a word's
last symbol. Special tokens are found in the raw text first.

Defined results: null and empty texts give no ids and an empty decoded text. Texts of any length are
read whole; the ids of words and of runs between white space are kept in bounded caches for the task. Equal
texts give equal ids, repeated rows and null ids included. Of pairs of equal rank the leftmost joins first. An
empty table gives an empty table. Other columns, of whatever name, are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.storage import map_batches

CACHE_WORDS = 400_000
CACHE_CHARS = 12_000_000
SLICE_BYTES = 4_000_000
GROUP = 256
GAP = "\n"  # parts runs; no run or word holds it

# Fixed values of the vocabulary's file format: the word pattern, and the code points whose letter
# class and lower case all Unicode versions in use agree on. Other texts are split by the tokenizer file's own rules.
WORD = r"\p{L}+|'(?:s|t|re|ve|m|ll|d)|[^\s\p{L}\p{N}]+|\p{N}"
SETTLED = r"[\u0000-\u001B -ͷ΄-ΡΣ-ԯ֑-ׇא-תؠ-ۿḀ-ỿ‐-‧‰-⁞₠-₿ぁ-ゖァ-ヺ一-龥가-힣]*"

# Where a text has Latin letters, ASCII digits and common signs only, the plain module's faster classes mean the same.
LATIN = r"[\u0000-\u001B\u0020-\u007E¡«»¿À-ÖØ-öø-ɏ‐-‧€]*"
LATIN_WORD = r"[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)|[^\w\s]+(?:_+[^\w\s]*)*|(?:_+[^\w\s]*)+|\d"


def byte_characters() -> list[str]:
    """The visible character that stands for each byte: itself where printable, else the next one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


class Vocabulary:
    """A tokenizer file, read for encoding and decoding."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.path = path
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.separator = "" if spec.get("decoder") else " "
        self.merges = model["merges"]
        shown = byte_characters()
        self.of_byte = [self.ids.get(c) for c in shown]
        self.of_last = [self.ids.get(c + self.end) for c in shown]
        self.word = regex.compile(WORD)
        self.settled = regex.compile(SETTLED)
        self.latin, self.latin_word, self.latin_runs = re.compile(LATIN), re.compile(LATIN_WORD), re.compile(f"{LATIN_WORD}|{GAP}")
        self.specials = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self._rules = None

    @cached_property
    def _ranks(self) -> tuple[dict[int, int], list[int]]:
        """Ranks of pairs, as left * 2**32 + right, and the new symbol by rank; only for those who merge."""
        ranks, made = {}, []
        for rank, pair in enumerate(self.merges):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            ranks[self.ids[a] << 32 | self.ids[b]] = rank
            made.append(self.ids[a + b])
        return ranks, made

    def merge(self, word: str) -> list[int]:
        """Ids of one word by the priority queue."""
        ranks, made = self._ranks
        raw = word.encode("utf-8", "surrogatepass")
        symbols = [i for i in [*(self.of_byte[b] for b in raw[:-1]), self.of_last[raw[-1]]] if i is not None]
        n, rank_of = len(symbols), ranks.get
        rank = [rank_of(a << 32 | b, -1) for a, b in zip(symbols, symbols[1:], strict=False)]  # of the pair that starts here
        rank.append(-1)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [r << 32 | i for i, r in enumerate(rank) if r >= 0]
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            i, best = entry & 0xFFFFFFFF, entry >> 32
            if rank[i] != best:
                continue
            j, new = after[i], made[best]
            symbols[i], symbols[j], rank[j] = new, -1, -1
            after[i] = k = after[j]
            rank[i] = -1
            if k >= 0:
                before[k] = i
                rank[i] = r = rank_of(new << 32 | symbols[k], -1)
                if r >= 0:
                    heapq.heappush(queue, r << 32 | i)
            h = before[i]
            if h >= 0:
                rank[h] = r = rank_of(symbols[h] << 32 | new, -1)
                if r >= 0:
                    heapq.heappush(queue, r << 32 | h)
        return [s for s in symbols if s >= 0]

    def words(self, text: str) -> list[str]:
        """The normalised text's words; special tokens must be out already."""
        if self.latin.fullmatch(text):
            return self.latin_word.findall(unicodedata.normalize("NFC", text).lower())
        if self.settled.fullmatch(text):
            return self.word.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        if self._rules is None:
            from tokenizers import Tokenizer

            self._rules = Tokenizer.from_file(self.path)
        marks = byte_characters()
        back = {c: b for b, c in enumerate(marks)}
        pieces = self._rules.pre_tokenizer.pre_tokenize_str(self._rules.normalizer.normalize_str(text))
        return [bytes(back[c] for c in p).decode("utf-8") for p, _ in pieces]

    def pieces(self, text: str | None):
        """Runs of ordinary text as lists of words, and special tokens as ids."""
        if not text:
            return
        at = 0
        for m in self.specials.finditer(text) if "<|" in text else ():
            if m.start() > at:
                yield self.words(text[at : m.start()])
            yield self.special[m[0]]
            at = m.end()
        if at < len(text):
            yield self.words(text[at:] if at else text)

    def decode(self, ids: list[int]) -> str:
        return self.separator.join(self.strings[i] for i in ids if i in self.strings)


class _Rows:
    """Keys' places, and by place a row of integers; a key that is asked for the first time gets the next place, its row being added afterwards."""

    def __init__(self):
        self.places: defaultdict[str | int, int] = defaultdict(count().__next__)
        self.values, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def place(self, keys: list) -> tuple[np.ndarray, list]:
        """The keys' places, and the keys that have no row yet, in order of place."""
        known = len(self.places)
        found = np.fromiter(map(self.places.__getitem__, keys), np.int64, len(keys))
        return found, list(islice(reversed(self.places), len(self.places) - known))[::-1]

    def add(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.values = np.concatenate([self.values, values])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])

    def take(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows at some places, one after another, and where each begins and the last ends."""
        starts, sizes = self.ends[places], self.ends[places + 1] - self.ends[places]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        return self.values[np.repeat(starts - bounds[:-1], sizes) + np.arange(bounds[-1])], bounds


class Encoder:
    """Encodes texts with bounded caches of runs and words; one a task. by: ids of new words (the queue by default). share: of the caches' and slices' full sizes.

    A text is cut at ASCII white space, which no word or special token holds, and Arrow numbers the
    distinct runs between; only runs new to the task are split into words, and only new words encoded.
    """

    def __init__(self, vocabulary: Vocabulary, by: Callable[[list[str]], list[list[int]]] | None = None, share: float = 1.0):
        self.vocabulary, self.share = vocabulary, share
        self.by = by or (lambda words: [vocabulary.merge(w) for w in words])
        self.clear()

    def clear(self) -> None:
        self.runs, self.words, self.chars = _Rows(), _Rows(), 0
        self.words.place([GAP])
        self.words.add(np.zeros(0, np.int32), np.zeros(1, np.int64))

    def _split(self, runs: list[str]) -> Iterator[list[str | int]]:
        """Words of runs, and special tokens as ids, with GAP after each run."""
        v = self.vocabulary
        for first in range(0, len(runs), GROUP):
            group = runs[first : first + GROUP]
            joined = GAP.join(group)
            if "<|" not in joined and v.latin.fullmatch(joined):
                yield v.latin_runs.findall(joined.lower())
                yield [GAP]
            else:
                for run in group:
                    for p in v.pieces(run):
                        yield [p] if isinstance(p, int) else p
                    yield [GAP]

    def _learn(self, runs: list[str]) -> None:
        """Split new runs into words and add their ids."""
        places, fresh = self.words.place(list(chain.from_iterable(self._split(runs))))
        if fresh:
            if int in set(map(type, fresh)):
                plain = iter(self.by([w for w in fresh if isinstance(w, str)]))
                found = [[w] if isinstance(w, int) else next(plain) for w in fresh]
            else:
                found = self.by(fresh)
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self.words.add(np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum())), sizes)
        ids, bounds = self.words.take(places)
        self.runs.add(ids, np.diff(bounds[np.flatnonzero(places == 0)], prepend=0))
        self.chars += sum(map(len, runs))

    def encode_all(self, texts: pa.Array | list[str | None]) -> Iterator[np.ndarray]:
        """Each text's ids, in order; works on some megabytes of text at a time."""
        if isinstance(texts, list):
            texts = pa.array(texts, pa.large_string())
        total = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(total, total[first] + SLICE_BYTES * self.share)))
            runs = pc.ascii_split_whitespace(pc.fill_null(texts[first:last], ""))
            offsets = runs.offsets.to_numpy().astype(np.int64)
            numbered = runs.flatten().dictionary_encode()
            if len(self.runs.places) > CACHE_WORDS * self.share or self.chars > CACHE_CHARS * self.share:
                self.clear()
            places, fresh = self.runs.place(numbered.dictionary.to_pylist())
            if fresh:
                gc.disable()  # makes many small lists and no cycles; the collector would go through all of them over and over
                try:
                    self._learn(fresh)
                finally:
                    gc.enable()
            ids, bounds = self.runs.take(places[numbered.indices.to_numpy()])
            ends = bounds[offsets - offsets[0]].tolist()
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                yield ids[a:b]
            first = last

    def encode(self, text: str | None) -> list[int]:
        return next(self.encode_all([text])).tolist()


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", share: float = 0.4) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of little-endian unsigned 32-bit ids), decoded_sha256 for every row. share: of a task's full caches."""

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(path), share=share)
        decode = encoder.vocabulary.decode
        for batch in batches:
            sizes, coded, decoded = [], [], []
            for ids in encoder.encode_all(batch.column("t")):
                sizes.append(len(ids))
                coded.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                decoded.append(hashlib.sha256(decode(ids.tolist()).encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], schema=schema)

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("t"))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and its token ids, for use by other jobs."""

    def setup():
        encoder = Encoder(Vocabulary(path))
        return lambda rows: {"doc_id": rows["doc_id"], "ids": [x.tolist() for x in encoder.encode_all(rows["t"])]}

    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("t"))
    return map_batches(rows, setup, schema, "doc_id bigint, ids array<int>")
