"""Supervised subword embeddings with a linear softmax, trained jointly by numpy gradient descent.

A word's features are its hashed self, with ``pairs`` its hashed pair with the word before (a word
2-gram), and the hashed character n-grams of the word with its edges marked. A document is the count-weighted average of the features'
learned vectors; a softmax over two classes reads that average. Vectors and softmax learn together by
stochastic gradient descent with AdaGrad steps, one example at a time. As words share the vectors of their
n-grams, misspelled or unseen words still score.

With ``doubt`` the average is also weighted by how clearly a feature tells the classes of the learned documents
apart. A few rare signs then count against the many n-grams that mean nothing, where the rarer class has few documents.

A repeated word ("x x") hashes its pair under one common symbol, so that repetition itself has a
vector whatever the word: else each repeated word would have to be met in training to count.

The model is linear in the average, so a task keeps one logit for each word and word pair it has met
(a bounded cache) and a document costs one look-up a word.

Defined results: null and empty texts, and those without a word, score the share of class 1 among
all labels given to train(), not among the sample of them that is learned. Whole texts are scored, of any
length. Equal texts get equal scores, repeated rows too. Without labelled rows every score is 0.5. An
empty table gives an empty table. Labels other than 0 and 1, and null ids, teach nothing; an id with
several labels or texts teaches each of them. Other columns, of whatever name, are ignored.
"""

from __future__ import annotations

import dataclasses
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.storage import map_batches, saved

CACHE_WORDS = 300_000


@dataclasses.dataclass(frozen=True)
class Settings:
    """Sizes of the model and of its bounded training sample."""

    lower: bool = True
    pairs: bool = False
    buckets: int = 1 << 20
    width: int = 8
    shortest: int = 3
    longest: int = 5
    documents: int = 6000
    characters: int = 20_000_000
    epochs: int = 10
    least: int = 3
    slices: int = 0
    shift: bool = True
    doubt: float = 0.0
    rate: float = 0.25
    seed: int = 7


@dataclasses.dataclass(frozen=True)
class Model:
    settings: Settings
    logits: np.ndarray  # of each bucket: its vector times the softmax, class 1 less class 0
    bias: float
    prior: float


def words_of(text: str | None, s: Settings) -> list[str]:
    return ((text.lower() if s.lower else text) if text else "").split()


def _spread(h: np.ndarray, s: Settings) -> np.ndarray:
    """Buckets of 64-bit codes."""
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(32))) & np.uint64(s.buckets - 1)).astype(np.int64)


def word_features(words: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of distinct words: their codes, and (owner, bucket) of the whole word and of each marked n-gram."""
    codes = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    chars = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(chars))  # characters from here to the word's end
    owners, buckets = [np.arange(len(words))], [_spread(codes * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1), s)]
    for n in range(s.shortest, s.longest + 1):
        if len(chars) >= n:
            h = np.full(len(chars) - n + 1, n, np.uint64)
            for k in range(n):
                h = h * np.uint64(0x100000001B3) + chars[k : len(chars) - n + 1 + k]
            whole = left[: len(h)] >= n
            owners.append(owner[: len(h)][whole])
            buckets.append(_spread(h[whole] * np.uint64(0x9E3779B97F4A7C15), s))
    return codes, np.concatenate(owners), np.concatenate(buckets)


def pair_buckets(codes: np.ndarray, s: Settings) -> np.ndarray:
    """Of a document's words in order: the bucket of each pair of neighbours, one common to all repeats."""
    before, after = codes[:-1], codes[1:]
    return _spread(np.where(before == after, np.uint64(3), before * np.uint64(0xD6E8FEB86659FD93) + after * np.uint64(0x9E3779B97F4A7C15)), s)


def features(text: str | None, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights of a document; weights sum to 1. Each word spreads one unit over its features."""
    words = words_of(text, s)
    if not words:
        return np.empty(0, np.int64), np.empty(0)
    distinct = {w: i for i, w in enumerate(dict.fromkeys(words))}
    codes, owners, at = word_features(list(distinct), s)
    index = np.fromiter(map(distinct.__getitem__, words), np.int64, len(words))
    value = (np.bincount(index, minlength=len(distinct)) / np.bincount(owners))[owners]
    total = float(len(words))
    if s.pairs and len(words) > 1:
        pairs = pair_buckets(codes[index], s)
        at, value = np.concatenate([at, pairs]), np.concatenate([value, np.ones(len(pairs))])
        total += len(pairs)
    unique, inverse = np.unique(at, return_inverse=True)
    return unique, np.bincount(inverse, value) / total


def slices_of(text: str | None, rng: np.random.Generator, s: Settings) -> list[str]:
    """Random runs of a text's words, as further class-0 examples: what is clean is clean in every part."""
    words = (text or "").split()
    out = []
    for _ in range(s.slices if len(words) > 8 else 0):
        n = int(rng.integers(2, 24))
        first = int(rng.integers(0, max(1, len(words) - n)))
        out.append(" ".join(words[first : first + n]))
    return out


def evidence(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, met: np.ndarray, s: Settings) -> np.ndarray:
    """Weight of each bucket in the average: how far its share of the two classes' examples differs, less s.doubt standard errors.

    What is as common in both classes as chance allows weighs nothing, so that it drowns no rare sign and is not learned
    by heart. Weights have mean 1 over the buckets that are left. With doubt 0 all weigh 1.
    """
    if not s.doubt:
        return np.ones(s.buckets)
    ones = np.bincount(np.concatenate([at for (at, _), k in zip(rows, y, strict=True) if k] or [np.empty(0, np.int64)]), minlength=s.buckets)
    n, n1 = len(y), int(y.sum())
    apart = np.abs(np.log((ones + 1) / (n1 + 2)) - np.log((met - ones + 1) / (n - n1 + 2)))
    error = np.sqrt(1 / (ones + 1) + 1 / (met - ones + 1))
    weight = np.where(met >= s.least, np.maximum(0, apart - s.doubt * error), 0)
    left = weight > 0
    return weight / weight[left].mean() if left.any() else np.ones(s.buckets)


def fit(texts: list[str | None], labels: list[int], s: Settings) -> Model:
    """Joint training; bounded by the sample it is given. Buckets met in fewer than s.least examples score nothing."""
    if not labels:
        return Model(s, np.zeros(s.buckets, np.float32), 0.0, 0.5)
    prior = float(np.mean(labels))
    if prior in (0.0, 1.0):
        return Model(s, np.zeros(s.buckets, np.float32), 50.0 if prior else -50.0, prior)
    rng = np.random.default_rng(s.seed)
    parts = [x for t, k in zip(texts, labels, strict=True) if not k for x in slices_of(t, rng, s)]
    rows = [features(t, s) for t in [*texts, *parts]]
    y = np.array([*labels, *[0] * len(parts)], dtype=np.int64)
    met = np.bincount(np.concatenate([at for at, _ in rows]), minlength=s.buckets)
    weight = np.where(met < s.least, 0, evidence(rows, y, met, s)).astype(np.float32)
    rows = [(at[keep], (value[keep] * weight[at[keep]]).astype(np.float32)[:, None] * s.width) for at, value in rows for keep in [weight[at] > 0]]
    vectors = rng.uniform(-1, 1, (s.buckets, s.width)).astype(np.float32) / s.width
    vectors[weight == 0] = 0
    softmax = rng.normal(0, 0.5, (s.width, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen_v, seen_s, seen_b = np.full((s.buckets, 1), 1e-6, np.float32), np.full(softmax.shape, 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    for epoch in range(s.epochs):
        rate = np.float32(s.rate * (1 - epoch / s.epochs))
        for i in rng.permutation(len(y)):
            at, value = rows[i]
            if not len(at):
                continue
            own = vectors[at]
            hidden = (own * value).sum(axis=0)
            z = hidden @ softmax + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            if abs(p[0]) < 1e-4:
                continue
            step_v, step_s = value * (softmax @ p), np.outer(hidden, p)
            total_v = seen_v[at] + (step_v * step_v).mean(axis=1, keepdims=True)
            seen_v[at] = total_v
            seen_s += step_s**2
            seen_b += p**2
            vectors[at] = own - rate * step_v / np.sqrt(total_v)
            softmax -= rate * step_s / np.sqrt(seen_s)
            bias -= rate * p / np.sqrt(seen_b)
    logits = (vectors @ (softmax[:, 1] - softmax[:, 0])) * s.width * weight
    return Model(s, logits.astype(np.float32), float(bias[1] - bias[0]), prior)


class Scorer:
    """Scores texts with one look-up a word; made once a task."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}
        self.value, self.codes = np.empty(0), np.empty(0, np.uint64)

    def learn(self, words: set[str]) -> None:
        """Give words that are new to this task their logit."""
        fresh = [w for w in words if w not in self.known]
        if not fresh:
            return
        if len(self.known) + len(fresh) > CACHE_WORDS:
            self.known, self.value, self.codes, fresh = {}, np.empty(0), np.empty(0, np.uint64), list(words)
        codes, owners, at = word_features(fresh, self.model.settings)
        own = np.bincount(owners, self.model.logits[at]) / np.bincount(owners)
        self.known |= {w: len(self.value) + i for i, w in enumerate(fresh)}
        self.value, self.codes = np.concatenate([self.value, own]), np.concatenate([self.codes, codes])

    def score(self, texts: list[str | None]) -> list[float]:
        out, s = [], self.model.settings
        for first in range(0, len(texts), 256):
            part = [words_of(t, s) for t in texts[first : first + 256]]
            self.learn(set().union(*part))
            out += [self._score(words) for words in part]
        return out

    def _score(self, words: list[str]) -> float:
        m = self.model
        if not words:
            return m.prior
        index = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        total, n = float(self.value[index].sum()), len(words)
        if m.settings.pairs and n > 1:
            total += float(m.logits[pair_buckets(self.codes[index], m.settings)].sum(dtype=np.float64))
            n += n - 1
        return float(1 / (1 + np.exp(-np.clip(m.bias + total / n, -700, 700))))


def train(docs: DataFrame, labels: DataFrame, label: str, s: Settings, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Fit on a bounded sample of labelled rows, about s.documents of them, with at most s.characters characters.

    Rows are chosen by a hash of their id, at equal shares of the two classes where there are enough,
    else all of the rarer one; with s.shift the bias is set back to the true class share afterwards.
    The model's prior is the true share either way. The chosen ids, twice s.documents at most, are sent
    to the documents, so that texts stay where they are. Of a text over a hundredth of s.characters a part
    of that length is learned, from a place that its hash chooses. Bounds that bind take the rows of least hash, and
    the driver gets s.characters characters at most.
    """
    rows = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n = sum(counts.values())
    share = F.when(F.col("y") == 1, s.documents / 2 / max(1, counts.get(1, 0))).otherwise(s.documents / 2 / max(1, counts.get(0, 0)))
    h = F.xxhash64("id", F.lit(s.seed))
    picked = rows.where(F.pmod(h, F.lit(1_000_000)) < share * 1_000_000).orderBy(h, "id", "y").limit(2 * s.documents)
    most = s.characters // 100
    own = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    start = F.pmod(F.col("h"), F.greatest(F.lit(1), F.length("t") - most + 1)).cast("int") + 1
    part = own.join(F.broadcast(picked), "id").select("h", "y", F.substring("t", start, F.lit(most)).alias("t"))
    part = saved(part.orderBy("h", "y").limit(2 * s.documents).withColumn("i", F.monotonically_increasing_id()), "sample")
    # In the order of another hash, as many as s.characters hold; only these come to the driver.
    turn = Window.orderBy(F.xxhash64("h", "y", F.lit(s.seed)), "i")  # numbers of 2 * s.documents rows at most
    total = F.sum(F.length("t")).over(turn)
    fits = saved(part.select("i", total.alias("total")).where(F.col("total") <= s.characters), "fitting")
    kept = sorted((r["total"], r["t"], r["y"]) for r in part.join(F.broadcast(fits), "i").select("total", "t", "y").collect())
    kept = [(t, y) for _, t, y in kept]
    model = fit([t for t, _ in kept], [y for _, y in kept], s)
    learned = sum(y for _, y in kept) / len(kept) if kept else 0.5
    prior = counts.get(1, 0) / n if n else 0.5
    if s.shift and 0 < prior < 1 and 0 < learned < 1:
        model = dataclasses.replace(model, bias=model.bias + float(np.log(prior / (1 - prior)) - np.log(learned / (1 - learned))))
    return dataclasses.replace(model, prior=prior)


def score(docs: DataFrame, model: Model, threshold: float, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, predicted for every row."""
    # Plain values: workers rebuild the model, as they need not have this package.
    shipped = docs.sparkSession.sparkContext.broadcast((dataclasses.asdict(model.settings), model.logits, model.bias, model.prior))

    def setup():
        settings, logits, bias, prior = shipped.value
        scorer = Scorer(Model(Settings(**settings), logits, bias, prior))

        def work(rows):
            found = scorer.score(rows["t"])
            return {"doc_id": rows["doc_id"], "score": found, "predicted": [int(x >= threshold) for x in found]}

        return work

    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])
    return map_batches(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("t")), setup, schema, "doc_id bigint, score double, predicted int")
