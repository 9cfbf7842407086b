"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every document of a source has the same expected number of copies, its source's target over its size.
The whole part is certain; the fraction is rounded so that the words taken stay at the target. A document is paired with all
others of its source, which have one fraction, taken together: mass moves from one side to the other, at random in the
direction but fair in expectation and so that the expected words stay the same, until the document or the rest
has a whole number; then the next largest is paired, with the fraction that the others have by then. First
the documents with over 1 / LARGE of their source's words, fewer than LARGE of them, are paired with the whole rest of
the source; then, in blocks, those that remain, each with the rest of its block. What a block leaves over
is one document, as a rule its smallest. Such residuals go on to the next levels of a reduction tree, in blocks again. Their fractions differ, so there two
documents are a pair, the largest first, and what is left of the two meets the next. The last residual of a source is
rounded at random by its own fraction. Nothing else is: so documents of all sizes are taken at their source's rate,
and a source misses its target by the words of one document, the last.

Blocks are dealt by a hash within the source and hold about BLOCK rows each, so that a source with a
third of all rows is as many groups as it needs; rows that are alike are numbered apart, so that they too
are dealt to many. Documents travel as id, size and fraction, never with their texts. Randomness comes
from hashes of the document and the level, so reruns agree.

Defined results: a null or empty text has size 0, takes 0 words and 0 copies. Null sources form one
source, ordered last. Repeated rows, and rows that share an id or have none, are separate documents; which
of rows alike gets the larger number of copies makes no difference. Documents of equal size meet by id. A
source of size 0 has target 0. An empty table gives an empty table. No document is taken more than CAP
times. Other columns, of whatever name, are ignored by mix() and kept by mixed().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.storage import attach, packed, row_hash, saved

WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK = 64
LARGE = 512
CHUNK = 100_000
_WORD = r"[^\x20\x09-\x0D]+"
_TINY = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, target of each source of a table (source, size).

    One row a source. Sources are numbered by code point, null last, for their weights: within ranges of
    sources, plus the number of those in the ranges before (one row a range). The level at which
    the uncapped ones share what is left is found by repeated sums over sources, until no source is above
    its cap.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    parts = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = saved(by.repartitionByRange(parts, F.asc_nulls_last("source")).withColumn("part", F.spark_partition_id()), "ranged")
    before = ranged.groupBy("part").count().select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_last("source")))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    numbered = ranged.withColumn("number", inside).join(F.broadcast(before), "part").withColumn("number", F.col("number") + F.col("before") - 1)
    weight = F.element_at(cycle, (F.pmod("number", F.lit(len(weights))) + 1).cast("int"))
    listed = saved(numbered.select("source", "source_size", weight.alias("weight")), "sources")
    total = listed.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    most = F.col("source_size") * float(cap)
    level, capped = 0.0, -1
    while True:
        full = most <= F.col("weight") * level
        r = listed.agg(F.coalesce(F.sum(F.when(full, most)), F.lit(0.0)).alias("held"), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("weight"), F.count_if(full).alias("n")).first()
        if r["n"] == capped or not r["weight"]:
            break
        capped, level = r["n"], (total - r["held"]) / r["weight"]
    return listed.withColumn("target", F.least(most, F.col("weight") * F.lit(level)))


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / float(1 << 52)


def _settled(p: Column) -> Column:
    return F.when(p < _TINY, F.lit(0.0)).when(p > 1 - _TINY, F.lit(1.0)).otherwise(p)


def _moved(a: Column, a_size: Column, x: Column, x_size: Column, u: Column) -> Column:
    """Mass in words that goes to a from x: raises a while x falls or x while a falls, whichever bound comes first."""
    up = F.least((1 - a) * a_size, x * x_size)
    down = F.least(a * a_size, (1 - x) * x_size)
    return F.when(u * (up + down) < down, up).otherwise(-down)


def _draw(x: Column, level: int, seed: int) -> Column:
    return _uniform(x["id"], x["salt"], x["number"], x["size"], F.lit(level), F.lit(seed))


def _with_rest(state: Column, x: Column, level: int, seed: int) -> Column:
    """One step of the fold over a block of one fraction: the next largest document is paired with those after it."""
    p, rest = state["p"], state["size"] - x["size"]
    moved = _moved(p, x["size"], p, rest, _draw(x, level, seed))
    own = F.when(rest > 0, _settled(p + moved / x["size"])).otherwise(p)
    others = F.when(rest > 0, _settled(p - moved / rest)).otherwise(p)
    whole = (p == 0) | (p == 1)  # the rest became whole before: x is, too
    mine = x.withField("p", F.when(whole, p).otherwise(own))
    over = ~whole & (own > 0) & (own < 1)
    left = F.when(over, mine).otherwise(state["left"])
    done = F.when(over, state["done"]).otherwise(F.concat(state["done"], F.array(mine)))
    return F.struct(F.when(whole, p).otherwise(others).alias("p"), rest.alias("size"), left.alias("left"), done.alias("done"))


def _with_rests(rows: Column, size: Column, level: int, seed: int) -> Column:
    """p, left, done of rows from the largest, each paired with what is left of ``size`` words of one fraction."""
    start = F.struct(F.get(rows, F.lit(0))["p"].alias("p"), size.alias("size"), F.lit(None).cast(_ITEM).alias("left"), F.array().cast(f"array<{_ITEM}>").alias("done"))
    return F.aggregate(rows, start, lambda s, x: _with_rest(s, x, level, seed))


def _first_block(rows: Column, level: int, seed: int) -> Column:
    met = _with_rests(rows, F.aggregate(rows, F.lit(0).cast("bigint"), lambda s, x: s + x["size"]), level, seed)
    return F.struct(met["left"].alias("left"), met["done"].alias("done"))


def _meet(state: Column, x: Column, level: int, seed: int) -> Column:
    """One step of the fold over a block of residuals: the one so far meets row x; done grows by the settled row."""
    a = state["left"]
    moved = _moved(a["p"], a["size"], x["p"], x["size"], _uniform(a["id"], x["id"], a["salt"], x["salt"], a["number"], x["number"], F.lit(level), F.lit(seed)))
    na, nx = a.withField("p", _settled(a["p"] + moved / a["size"])), x.withField("p", _settled(x["p"] - moved / x["size"]))
    first = (na["p"] == 0) | (na["p"] == 1)
    met = F.struct(F.when(first, nx).otherwise(na).alias("left"), F.concat(state["done"], F.array(F.when(first, na).otherwise(nx))).alias("done"))
    still = (a["p"] == 0) | (a["p"] == 1)  # both got whole at once before: a settles as it is
    return F.when(a.isNull(), F.struct(x.alias("left"), state["done"].alias("done"))).when(still, F.struct(x.alias("left"), F.concat(state["done"], F.array(a)).alias("done"))).otherwise(met)


def _later_block(rows: Column, level: int, seed: int) -> Column:
    start = F.struct(F.lit(None).cast(_ITEM).alias("left"), F.array().cast(f"array<{_ITEM}>").alias("done"))
    return F.aggregate(rows, start, lambda s, x: _meet(s, x, level, seed))


_ITEM = "struct<size:bigint,id:bigint,salt:bigint,number:bigint,p:double,whole:int>"


def copies(sized: DataFrame, seed: int = 11) -> DataFrame:
    """id, salt, number, source, size, copies of every row of a table (id, salt, number, source, size, rate), whose rate is one a source."""
    rate = F.least(F.col("rate"), F.lit(float(CAP)))
    base = sized.withColumn("whole", F.floor(rate + _TINY).cast("int")).withColumn("p", F.greatest(rate - F.col("whole"), F.lit(0.0)))
    base = base.withColumn("p", F.when((F.col("p") < _TINY) | (F.col("size") <= 0), F.lit(0.0)).otherwise(F.col("p")))
    base = base.withColumn("whole", F.when(F.col("size") > 0, F.col("whole")).otherwise(F.lit(0)))
    item = F.struct("size", "id", "salt", "number", "p", "whole").cast(_ITEM).alias("x")
    done = [base.where("p = 0").select("source", item)]
    fractional = saved(base.where("p > 0").select("source", item), "open")
    # Documents of a source's largest sizes, less than LARGE of them, are paired with all the rest of the source.
    total = saved(fractional.groupBy("source").agg(F.sum("x.size").alias("total")), "totals")
    sized_up = attach(fractional, total, "source", F.xxhash64("x.id", "x.salt", "x.number")).withColumn("large", F.col("x.size") * LARGE > F.col("total"))
    large = sized_up.where("large").groupBy("source").agg(F.any_value("total").alias("total"), F.sort_array(F.collect_list("x"), asc=False).alias("rows"))
    large = saved(large.select("source", _with_rests(F.col("rows"), F.col("total"), 0, seed).alias("r")).select("source", "r.p", "r.left", "r.done"), "large")
    done.append(large.select("source", F.explode("done").alias("x")))
    rest = attach(sized_up.where("not large").select("source", "x"), large.select("source", F.col("p").alias("now")), "source", F.xxhash64("x.id", "x.salt", "x.number"), "left")
    rest = saved(rest.select("source", F.col("x").withField("p", F.coalesce("now", "x.p")).alias("x")), "rest")
    done.append(rest.where("x.p = 0 or x.p = 1"))
    after = large.where("left is not null").select("source", F.col("left").alias("x"))
    open_rows, level = rest.where("x.p > 0 and x.p < 1"), 1
    while True:
        counts = saved(open_rows.groupBy("source").agg(F.count("*").alias("n")), "counts")
        if counts.isEmpty() and after is None:
            break
        blocks = counts.select("source", F.ceil(F.col("n") / BLOCK).alias("blocks"))
        dealt = attach(open_rows, blocks, "source", F.xxhash64("x.id", "x.salt", "x.number"))
        dealt = dealt.select("source", F.pmod(F.xxhash64("x.id", "x.salt", "x.number", "x.size", F.lit(level), F.lit(seed)), F.col("blocks")).alias("block"), "blocks", "x")
        rows = F.sort_array(F.collect_list("x"), asc=False)
        settle = _first_block(rows, level, seed) if level == 1 else _later_block(rows, level, seed)
        folded = dealt.groupBy("source", "block").agg(F.any_value("blocks").alias("blocks"), settle.alias("r"))
        # The last residual of a source is rounded by its own fraction.
        left = F.col("r.left")
        rounded = left.withField("p", F.when(_draw(left, level, seed + 1) < left["p"], F.lit(1.0)).otherwise(F.lit(0.0)))
        folded = folded.withColumn("r", F.struct(F.when(F.col("blocks") == 1, rounded).otherwise(left).alias("left"), F.col("r.done").alias("done")))
        folded = saved(folded.select("source", "r.left", "r.done"), "level")
        done.append(folded.select("source", F.explode("done").alias("x")))
        whole = (F.col("left.p") == 0) | (F.col("left.p") == 1)
        done.append(folded.where(whole).select("source", F.col("left").alias("x")))
        open_rows, level = folded.where(~whole).select("source", F.col("left").alias("x")), level + 1
        open_rows, after = open_rows if after is None else open_rows.unionByName(after), None
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("x.id", "x.salt", "x.number", "source", "x.size", (F.col("x.whole") + F.col("x.p").cast("int")).alias("copies"))


def _sized(docs: DataFrame, salt: Column, doc_id: str, text: str, source: str) -> DataFrame:
    """Saved (id, salt, source, size, n): rows that are alike are one row here, n times."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), salt.alias("salt"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    return saved(rows.groupBy("id", "salt", "source", "size").agg(F.count("*").alias("n")), "sized")


def _numbered(sized: DataFrame) -> DataFrame:
    """One row a document again, alike ones with their numbers; more than CHUNK of them are made by several tasks."""
    last = F.floor((F.col("n") - 1) / CHUNK)
    few = sized.where(F.col("n") <= CHUNK).withColumn("chunk", F.lit(0).cast("bigint"))
    many = sized.where(F.col("n") > CHUNK).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).repartition("id", "salt", "source", "size", "chunk")
    first = F.col("chunk") * CHUNK
    return few.unionByName(many).withColumn("number", F.explode(F.sequence(first, F.least(first + CHUNK, "n") - 1))).drop("chunk", "n")


def _taken(sized: DataFrame, shares: DataFrame) -> DataFrame:
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rated = attach(_numbered(sized), shares.select("source", "source_size", "target"), "source", F.xxhash64("id", "salt", "number"))
    return copies(rated.select("id", "salt", "number", "source", "size", rate.alias("rate")))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of every row."""
    sized = _sized(docs, F.lit(0).cast("bigint"), doc_id, text, source)
    shares = targets(sized.select("source", (F.col("size") * F.col("n")).alias("size")))
    found = attach(_taken(sized, shares), shares.drop("weight"), "source", F.xxhash64("id", "salt", "number"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixture itself: every row as often as it is taken, all columns.

    Rows equal in every column share their copies; tasks merge them before the shuffle, the only one of texts.
    """
    sized = _sized(docs, row_hash(docs), doc_id, text, source)
    taken = _taken(sized, targets(sized.select("source", (F.col("size") * F.col("n")).alias("size"))))
    none, name = F.col("id").isNull(), F.coalesce("id", F.lit(0).cast("bigint"))
    total = taken.where("copies > 0").groupBy(none.alias("none"), name.alias("name"), "salt").agg(F.sum("copies").alias("copies"))
    rows = docs.select(packed(docs), F.col(doc_id).cast("bigint").alias("id"), row_hash(docs).alias("salt"))
    one = rows.groupBy(none.alias("none"), name.alias("name"), "salt").agg(F.first("row").alias("row"))
    every = one.join(saved(total, "copies"), ["none", "name", "salt"])
    return every.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select("row.*")
