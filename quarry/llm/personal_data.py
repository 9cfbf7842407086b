"""Personal data by bootstrapped contextual extraction, in DataFrame and SQL functions only.

Four fixed patterns find the base spans (e-mail and IP addresses, card and phone numbers); they stay
whatever follows. They also seed the extraction: the one and two words before a seed are lexical
patterns, drawn from the whole text before it, digits as 0. Other tokens with a digit or @ are candidates
for the kinds whose shape they have (SHAPES): near misses of the base patterns, such as an address with
(at) or a number with dots. Patterns and instances form a graph over all documents. In each round a
pattern's confidence in a kind is the confidence of its distinct instances over the number of those that
are seeds or candidates of that kind, smoothed; patterns with enough support that are confident enough
pass it to their instances by noisy-or. After the rounds, candidates that stand under a confident pattern
become spans of its kind.

A pattern must prove itself against look-alikes: where as many numbers fail the card check as pass it
under the same words, none is added, and a text without seeds in its contexts gets its base spans only.

Copies of one passage count once, as an instance counts once under a pattern. Contexts and instances
are aggregated before every shuffle; texts are never shuffled by find(). Tables of patterns go to every
task under a checked size, else they are joined salted, as one pattern may have a large part of all rows.

Defined results: null and empty texts have no spans; the digest is that of the empty string. Texts are
read whole, and base spans may be of any length, added ones of LONGEST code points; a span's places are code points, end exclusive. Rows with equal doc_id and text get the
same spans, null ids included. Of two kinds with equal score the later by name is taken; overlapping base
spans of different kinds all stay. An empty table gives an empty table. Other columns, of whatever name,
are ignored by find() and kept by redact().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.storage import attach, packed, saved

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
CONFIDENT = 0.8
SUPPORT = 5

# The base patterns. Runs are possessive and begin at a run's own start, or where the last match ended,
# which finds the same spans without scanning a long run once for each of its characters.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must hold for the pattern to match, and for the match to be valid; cheaper to look for.
GATES = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"(?:[0-9][\x20-]?){14}", "phone": r"\+[0-9]"}
CHUNK = 256
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
# What a token must look like to be an unseen identifier of a kind: (at) for @, other separators, other lengths. Runs are
# possessive, so that each is gone through once; longer tokens than LONGEST are no identifiers, whatever they hold.
LONGEST = 320
SHAPES = {
    "email": r"(?i)^\W*+[a-z0-9._%+-]++(?:@|[(\[{<](?:at|@)[)\]}>])[a-z0-9-]++(?:(?:\.|[(\[{<](?:dot|\.)[)\]}>])[a-z0-9-]++)*+\W*+$",
    "ip": r"^\W*+[0-9]{1,4}+(?:[.,:_-][0-9]{1,4}+){3}\W*+$",
    "card": r"^\W*+(?:[0-9][._/-]?+){13,21}\W*+$",
    "phone": r"^\W*+(?:[0-9][().+/_-]*+){9,15}\W*+$",
}
_SPAN = "array<struct<start:int,end:int,inst:string,before:string>>"
_TAGGED = "array<struct<start:int,rank:int,end:int,kind:string,inst:string,before:string>>"
_PLACE = "array<struct<start:int,end:int,inst:string,patterns:array<string>,kinds:array<string>>>"
CONTEXT = 60


def _bound(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _placed(pairs: Column) -> Column:
    """Spans of (text since the last match, match, context) triples. Places add up within chunks and then over chunks, so that long lists stay cheap."""
    none = F.array().cast(_SPAN)

    def step(s, x):
        start = s["at"] + F.length(x["g"])
        end = start + F.length(x["h"])
        span = F.struct(start.alias("start"), end.alias("end"), x["h"].alias("inst"), x["before"].alias("before"))
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(span)).alias("out"))

    def chunk(i):
        return F.aggregate(F.slice(pairs, i * CHUNK + 1, CHUNK), F.struct(F.lit(0).alias("at"), none.alias("out")), step)

    def shifted(chunks):
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        offsets = F.aggregate(chunks, start, lambda s, c: F.struct((s["at"] + c["at"]).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

        def shift(c, o):
            return F.transform(c["out"], lambda x: F.struct((x["start"] + o).alias("start"), (x["end"] + o).alias("end"), x["inst"].alias("inst"), x["before"].alias("before")))

        return F.flatten(F.zip_with(chunks, offsets, shift))

    return _bound(F.transform(F.sequence(F.lit(0), ((F.size(pairs) - 1) / CHUNK).cast("int")), chunk), shifted)


def _matches(text: Column, pattern: str, gate: Column) -> Column:
    """Every match of a pattern with its place and the end of the text before it. gate: a cheap test that a match can exist."""

    def tail(pairs, i):
        x = F.get(pairs, i)
        return F.when(i >= 0, F.concat(F.right(x["g"], F.lit(CONTEXT)), F.right(x["h"], F.lit(CONTEXT)))).otherwise("")

    def contexts(pairs):
        """With the end of the text before each match, which may reach back over the two matches before it."""

        def one(x, i):
            before = F.right(F.concat(tail(pairs, i - 2), tail(pairs, i - 1), F.right(x["g"], F.lit(CONTEXT))), F.lit(CONTEXT))
            return F.struct(x["g"].alias("g"), x["h"].alias("h"), before.alias("before"))

        return _bound(F.transform(pairs, one), _placed)

    def pairs(hits):
        return F.filter(F.zip_with(F.split(text, pattern, -1), hits, lambda g, h: F.struct(g.alias("g"), h.alias("h"))), lambda x: x["h"].isNotNull())

    none = F.array().cast(_SPAN)
    found = _bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: F.when(F.size(hits) > 0, _bound(pairs(hits), contexts)).otherwise(none))
    return F.when(gate, found).otherwise(none)


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return hit.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        digits = F.translate(hit, " -", "")
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(F.regexp_replace(hit, "[^0-9]", "")).between(10, 15)
    return F.lit(True)


def _validator(kind: str):
    return lambda x: _valid(kind, x["inst"])


def _tagged(spans: Column, rank: int, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["inst"].alias("inst"), x["before"].alias("before")))


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")


def base_spans(text: Column) -> Column:
    """The base spans by start, then kind as listed."""
    text = F.coalesce(text, F.lit(""))
    found = []
    for rank, kind in enumerate(KINDS):
        found.append(_tagged(F.filter(_matches(text, PATTERNS[kind], text.rlike(GATES[kind])), _validator(kind)), rank, kind))
    return F.array_sort(F.concat(*found)).cast(_TAGGED)


def _lexical(before: Column) -> Column:
    """The patterns of a context: its last word, and its last two, lower-case with digits as 0."""
    words = F.filter(F.split(F.regexp_replace(F.lower(before), "[0-9]", "0"), r"\s+"), lambda w: w != "")
    n = F.size(words)
    one = F.when(n >= 1, F.concat(F.lit("1 "), F.element_at(words, -1)))
    two = F.when(n >= 2, F.concat(F.lit("2 "), F.get(words, n - 2), F.lit(" "), F.get(words, n - 1)))
    return F.array_compact(F.array(one, two))


def _places(spans: Column, kinds) -> Column:
    """Spans with their patterns and the kinds that they are, or could be."""
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["inst"].alias("inst"), _lexical(x["before"]).alias("patterns"), kinds(x).alias("kinds"))).cast(_PLACE)


def _shaped(inst: Column, kind: str) -> Column:
    return (F.length(inst) <= LONGEST) & inst.rlike(SHAPES[kind])


def _could_be(x: Column) -> Column:
    return F.array_compact(F.array(*[F.when(_shaped(x["inst"], k), F.lit(k)) for k in KINDS]))


def _any_shape(inst: Column) -> Column:
    found = _shaped(inst, KINDS[0])
    for k in KINDS[1:]:
        found = found | _shaped(inst, k)
    return found


def extract(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, h (hash of the text), base spans, seeds and candidates with their patterns, of every row; saved, without texts."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("h"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.withColumn("base", base_spans(F.col("t"))).withColumn("tokens", _matches(F.col("t"), _CANDIDATE, F.col("t").rlike("[0-9@]")))
    free = F.filter("tokens", lambda c: ~F.exists("base", lambda s: (s["start"] < c["end"]) & (s["end"] > c["start"])))
    seeds = F.when(F.size("base") > 0, _places(F.col("base"), lambda x: F.array(x["kind"]))).otherwise(F.array().cast(_PLACE))
    other = F.when(F.size("tokens") > 0, _places(F.filter(free, lambda x: _any_shape(x["inst"])), _could_be)).otherwise(F.array().cast(_PLACE))
    return saved(rows.select("doc_id", "h", "base", seeds.alias("seeds"), other.alias("other")), "extracted")


def discover(extracted: DataFrame) -> DataFrame:
    """doc_id, h, more: the spans that confident patterns add, of the rows that have some."""
    spread = F.xxhash64("inst")

    def edges_of(place: str) -> DataFrame:
        rows = extracted.select(F.explode(place).alias("s")).select(F.explode("s.patterns").alias("pattern"), F.col("s.inst").alias("inst"), F.col("s.kinds").alias("kinds"))
        return rows.select("pattern", "inst", F.explode("kinds").alias("kind")).distinct()

    seeds = saved(edges_of("seeds"), "seeds")
    # Only a kind that some seed of a pattern has can be passed on by it.
    useful = saved(seeds.groupBy("pattern").agg(F.collect_set("kind").alias("held")), "useful")
    loose = attach(edges_of("other"), useful, "pattern", spread).where(F.array_contains("held", F.col("kind"))).select("pattern", "inst", "kind")
    edges = saved(seeds.unionByName(loose).distinct(), "pattern_graph")
    sizes = saved(edges.groupBy("pattern", "kind").agg(F.count("*").alias("n")), "pattern_sizes")
    sure = saved(seeds.select("inst", "kind").distinct().withColumn("conf", F.lit(1.0)), "instances")
    instances, strong = sure, None
    for _ in range(ROUNDS):
        mass = edges.join(instances, ["inst", "kind"]).groupBy("pattern", "kind").agg(F.sum("conf").alias("mass"))
        scored = mass.join(sizes, ["pattern", "kind"]).withColumn("score", F.col("mass") / (F.col("n") + 1))
        scored = scored.where((F.col("score") >= CONFIDENT) & (F.col("mass") >= SUPPORT))
        strong = saved(scored.groupBy("pattern").agg(F.map_from_entries(F.collect_list(F.struct("kind", "score"))).alias("scores")), "patterns")
        held = attach(edges, strong, "pattern", spread).withColumn("score", F.col("scores")[F.col("kind")]).where("score is not null")
        passed = held.groupBy("inst", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("score"))))).alias("conf"))
        instances = saved(sure.unionByName(passed).groupBy("inst", "kind").agg(F.max("conf").alias("conf")), "instances")
    others = extracted.select("doc_id", "h", F.explode("other").alias("s")).select("doc_id", "h", "s.start", "s.end", "s.inst", "s.kinds", F.explode("s.patterns").alias("pattern"))
    hits = attach(others, strong, "pattern", F.xxhash64("doc_id", "h", "start")).select("doc_id", "h", "start", "end", "scores", F.explode("kinds").alias("kind"))
    hits = hits.withColumn("score", F.col("scores")[F.col("kind")]).where("score is not null")
    best = hits.groupBy("doc_id", "h", "start", "end").agg(F.max(F.struct("score", "kind")).alias("b")).select("doc_id", "h", "start", "end", "b.kind")
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int") - 1
    spans = best.select("doc_id", "h", F.struct("start", rank.alias("rank"), "end", "kind").alias("s"))
    return saved(spans.groupBy("doc_id", "h").agg(F.collect_set("s").alias("more")), "discovered")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


_PLAIN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _all(base: Column, more: Column) -> Column:
    plain = F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))).cast(_PLAIN)
    return F.array_sort(F.concat(plain, F.coalesce(more.cast(_PLAIN), F.array().cast(_PLAIN))))


def _with_more(rows: DataFrame, more: DataFrame) -> DataFrame:
    """Rows (doc_id, h, ...) with the spans that were added to them; a plain null column if none was at all, so that rows stay where they are."""
    if more.isEmpty():
        return rows.withColumn("more", F.lit(None).cast(_PLAIN))
    found = more.select(F.col("doc_id").alias("found_id"), F.col("h").alias("found_h"), "more")
    return rows.join(found, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("h") == F.col("found_h")), "left").drop("found_id", "found_h")


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base counts), base_sha256, spans, n_added of every row."""
    rows = extract(docs, doc_id, text)
    rows = _with_more(rows.select("doc_id", "h", "base"), discover(rows))
    counts = [_count(k) for k in KINDS]
    added = F.coalesce(F.size("more"), F.lit(0)).cast("bigint").alias("n_added")
    return rows.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(_all(F.col("base"), F.col("more"))).alias("spans"), added)


def _redacted(text: Column, spans: Column) -> Column:
    """The text with each stretch of overlapping spans replaced by the first one's kind in brackets."""

    def step(s, x):
        tag = F.concat(F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(x["start"] >= s["at"], F.concat(s["out"], F.array(tag))).otherwise(s["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(spans, start, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text))))


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, all columns, with every span in the text replaced by its kind; a column n_chars follows the text."""
    rows = docs.select(packed(docs), F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    rows = _with_more(rows, discover(extract(docs, doc_id, text)))
    spans = _all(base_spans(F.col("t")), F.col("more"))
    clean = F.when(F.size(spans) > 0, _redacted(F.col("t"), spans)).otherwise(F.col("t"))
    rows = rows.select("row", clean.alias("clean"))
    own = [F.col("clean").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns]
    if "n_chars" in docs.columns:
        length = F.when(F.col("clean").isNotNull(), F.length("clean").cast("bigint")).otherwise(F.col("row")["n_chars"])
        own[docs.columns.index("n_chars")] = length.alias("n_chars")
    return rows.select(*own)
