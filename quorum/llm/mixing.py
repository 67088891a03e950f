"""Mixing sources to target weights, with DataFrame functions only.

Each source's documents are dealt by hash into blocks, a power of two of them. A source takes part with whole passes over all
its blocks, each in another order, and a last, partial pass over its first blocks: the hash has made their order a
random one. The blocks that a source has to give, counted pass by pass, are its quota. A splitting tree halves the range of output shards again and again and draws, at each node, how many blocks of each
source go left: a multivariate hypergeometric draw, so the shards are as if all blocks had been shuffled and dealt. A
shard takes the next blocks of each source's order, disjoint from all others', and shuffles its documents by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, documents, prefix, sized, stored

#: Weights of the sources in order, repeating; what all take, in hundredths of all words; passes over a source at most.
WEIGHTS, PERCENT, MOST_PASSES = (3, 1, 2), 150, 2
BLOCK_WORDS, SHARD_WORDS, SEED = 50_000, 4_000_000, 17
#: Neighbouring blocks, a power of two, whose words are summed before one order goes over all of a source.
RUN_BITS = 12


def _let(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.transform(F.array(value), f)[0]


def _uniform(*keys: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*keys), 11) * F.lit(2.0**-53)


def hypergeometric(k: Column, total: Column, take: Column, u: Column) -> Column:
    """How many of k marked among total are within take drawn ones: the inverse of the distribution function at u.

    Weights follow from one another by their ratio, from one end of a span of twelve standard deviations to the other;
    what lies outside has less weight than a double can tell from none.
    """

    def spans(p):
        lo, hi = F.greatest(F.lit(0).cast("long"), p["n"] + p["k"] - p["t"]), F.least(p["n"], p["k"])
        mode = F.floor((p["n"] + 1) * ((p["k"] + 1) / (p["t"] + 2).cast("double"))).cast("long")
        share = p["k"] / F.greatest(p["t"], F.lit(1).cast("long")).cast("double")
        width = (F.ceil(12 * F.sqrt(p["n"] * share * (1 - share) * (p["t"] - p["n"]) / F.greatest(p["t"] - 1, F.lit(1).cast("long")))) + 12).cast("long")
        return _let(F.struct(p["k"].alias("k"), p["t"].alias("t"), p["n"].alias("n"), F.least(F.greatest(lo, mode - width), hi).alias("a"), F.greatest(F.least(hi, mode + width), lo).alias("b")), choose)

    def choose(p):
        ratio = lambda x: (p["k"] - x).cast("double") * (p["n"] - x) / ((x + 1).cast("double") * (p["t"] - p["k"] - p["n"] + x + 1))
        span = F.sequence(p["a"], p["b"])
        zero = F.lit(0.0)
        whole = F.aggregate(span, F.struct(F.lit(1.0).alias("w"), zero.alias("sum")), lambda s, x: F.struct((s["w"] * ratio(x)).alias("w"), (s["sum"] + s["w"]).alias("sum")))["sum"]
        pick = lambda goal: F.aggregate(span, F.struct(F.lit(1.0).alias("w"), zero.alias("sum"), F.lit(None).cast("long").alias("x")), lambda s, x: F.struct((s["w"] * ratio(x)).alias("w"), (s["sum"] + s["w"]).alias("sum"), F.coalesce(s["x"], F.when(s["sum"] + s["w"] > goal, x)).alias("x")))["x"]
        return F.coalesce(_let(whole * u, pick), p["b"])

    return _let(F.struct(k.cast("long").alias("k"), total.cast("long").alias("t"), take.cast("long").alias("n")), spans)


def sources_to_targets(sizes: DataFrame, weights=WEIGHTS, percent: int = PERCENT, most_passes: int = MOST_PASSES) -> DataFrame:
    """(source, i, source_size, target, passes, rest) of sizes (doc, source, size): one row per source.

    Sources in the order of their code points, a null last, have the weights in turn. They share percent of all words; a
    target stops at most_passes times its source's size and what is above goes to the others by weight. One row per source
    is a mixture's configuration, so it is ordered in one task; documents aren't.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    whole = Window.partitionBy()
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    each = each.withColumn("i", F.row_number().over(by_name) - 1)
    each = each.withColumns({"w": F.get(F.array(*[F.lit(float(x)) for x in weights]), F.col("i") % len(weights)), "cap": F.col("source_size") * float(most_passes), "all": F.sum("source_size").over(whole) * (percent / 100)})
    before = Window.orderBy(F.col("cap") / F.col("w"), "i").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    each = each.withColumn("full", level * F.col("w") >= F.col("cap"))
    shared = (F.col("all") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(whole)) / F.sum(F.when(~F.col("full"), F.col("w"))).over(whole)
    each = each.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", shared * F.col("w"))))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    return each.select("source", "i", "source_size", "target", passes.alias("passes")).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))


def shard_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(i, shard, first, n) of quotas (i, q): which n of source i's blocks, from number first, a shard takes.

    A node of the tree holds only the sources that have blocks left there, so all nodes of a level hold no more than there
    are blocks to give, whatever the number of sources.
    """
    node = quotas.filter("q > 0").agg(F.sort_array(F.collect_list(F.struct("i", "q"))).alias("qs"), F.sum("q").alias("total"))
    node = node.select(F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), "qs", "total", F.col("total").alias("n"))
    slots = lambda s: s * F.floor(F.col("total") / shards) + F.least(s, F.col("total") % shards)  # noqa: E731  of the shards before s
    for level in range((shards - 1).bit_length()):
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("long")
        node = node.withColumn("mid", mid).withColumn("to_left", (slots(F.col("mid")) - slots(F.col("lo"))).cast("long"))
        start = F.struct(F.col("n").alias("t"), F.col("to_left").alias("n"), F.array().cast("array<struct<i:int,q:bigint>>").alias("out"))

        def step(s, x):
            d = hypergeometric(x["q"], s["t"], s["n"], _uniform(F.lit(seed), F.col("lo"), F.col("hi"), x["i"]))
            return _let(d, lambda d: F.struct((s["t"] - x["q"]).alias("t"), (s["n"] - d).alias("n"), F.concat(s["out"], F.array(F.struct(x["i"].alias("i"), d.alias("q")))).alias("out")))

        node = node.withColumn("left", F.when(F.col("hi") - F.col("lo") > 1, F.aggregate("qs", start, step)["out"]))
        rest = F.zip_with("qs", "left", lambda x, y: F.struct(x["i"].alias("i"), (x["q"] - y["q"]).alias("q")))
        some = lambda qs: F.filter(qs, lambda x: x["q"] > 0)
        part = lambda lo, hi, qs, n: F.struct(lo.alias("lo"), hi.alias("hi"), some(qs).alias("qs"), n.cast("long").alias("n"))
        c = F.col
        halves = F.when(c("left").isNull(), F.array(part(c("lo"), c("hi"), c("qs"), c("n")))).otherwise(F.array(part(c("lo"), c("mid"), c("left"), c("to_left")), part(c("mid"), c("hi"), rest, c("n") - c("to_left"))))
        node = node.select("total", F.explode(halves).alias("h")).select("total", "h.*")
        if level % 5 == 4:
            node = node.repartition("lo")
    each = node.select(F.col("lo").alias("shard"), F.explode("qs").alias("x")).select(F.col("x.i").alias("i"), "shard", F.col("x.q").alias("n"))
    before = Window.partitionBy("i").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return each.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))


def _permuted(block: Column, bits: Column, *keys: Column) -> Column:
    """The place of a block, a number of so many bits, in an order that keys choose: one-to-one steps of shifts and odd factors."""
    half = F.greatest(F.floor(bits / 2), F.lit(1)).cast("int")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
    draw = lambda n, most: F.xxhash64(F.lit(n), *keys).bitwiseAND(most)
    fold = lambda x: _let(x, lambda y: y.bitwiseXOR(F.call_function("shiftright", y, half)))
    odd = lambda n: draw(n, F.lit((1 << 20) - 1)).bitwiseOR(F.lit(1))
    x = fold((fold(block) * odd(1)).bitwiseAND(mask))
    return (x * odd(2) + draw(3, mask)).bitwiseAND(mask)


def last_pass(blocks: DataFrame, spec: DataFrame) -> DataFrame:
    """(i, whole, room) of blocks (i, block, words): how many of its first blocks a source's last pass takes whole, and the words that it takes of the next; null if of none.

    Runs of blocks are summed first, so an order over all of a source is one of runs, and then of the blocks of one run.
    """
    rest = sized(spec.select("i", "rest", "blocks"), 50_000)
    upto = lambda order: F.sum("words").over(Window.partitionBy("i").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    run = F.shiftright("block", RUN_BITS)
    runs = blocks.groupBy("i", run.alias("run")).agg(F.sum("words").alias("words")).withColumn("upto", upto("run")).join(rest, "i")
    cut = stored(runs.filter((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") <= F.col("rest"))).select("i", "run", (F.col("rest") - (F.col("upto") - F.col("words"))).alias("left")), "cut-runs")
    inside = blocks.withColumn("run", run).join(sized(cut, 50_000), ["i", "run"]).withColumn("upto", upto("block"))
    inside = inside.filter((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("words") <= F.col("left"))).select("i", F.col("block").alias("whole"), (F.col("left") - (F.col("upto") - F.col("words"))).alias("room"))
    out = spec.select("i", "rest", "blocks").join(sized(stored(inside, "cut-blocks"), 50_000), "i", "left")
    some = F.col("rest") > 0
    return out.select("i", F.when(some, F.coalesce("whole", "blocks")).otherwise(0).cast("long").alias("whole"), F.when(some & (F.col("room") > 0), F.col("room")).alias("room"))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", weights=WEIGHTS, percent: int = PERCENT, most_passes: int = MOST_PASSES, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """docs and size, source_size, target and copies, named with common.prefix(docs); copies: an array of (pass, shard), one for each time the mix takes the row.

    The size is the number of words. Null and empty texts have none and are taken with their block; a null source is one of
    its own; rows with one id and text are taken alike; extra columns pass through, whatever their names. Only the last
    block of a partial pass is taken in part: its documents in random order while they fit, and then the one that comes
    nearest to what is left. All draws come from hashes of ids, texts and the seed, so reruns agree. A source has as many
    blocks as its words need, however many; there are as many shards.
    """
    pre = prefix(docs)
    c = lambda name: F.col(pre + name)
    key, within = (F.xxhash64(F.lit(seed + k), docs[id_col], docs[text]) for k in (0, 1))
    size = F.coalesce(F.regexp_count(docs[text], F.lit(WORD)), F.lit(0)).cast("long")
    sizes = stored(docs.select(docs[source].alias("source"), key.alias("key"), within.alias("h"), size.alias("size")), "sizes")
    spec = sources_to_targets(sizes, weights, percent, most_passes)
    bits = F.when(F.col("source_size") > block_words, F.ceil(F.log2(F.col("source_size") / block_words))).otherwise(0).cast("int")
    spec = stored(spec.withColumn("bits", bits).withColumn("blocks", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits"))), "sources")
    spec_of = sized(spec.withColumnRenamed("source", "source2"), 50_000)
    dealt = sizes.join(spec_of, F.col("source").eqNullSafe(F.col("source2"))).select("i", F.pmod("key", "blocks").alias("block"), "h", "size")
    blocks = stored(dealt.groupBy("i", "block").agg(F.sum("size").alias("words")), "blocks")

    # what the last pass takes of the block that it takes in part
    last = last_pass(blocks, spec)
    last = stored(last, "last-passes")
    part = last.filter("room IS NOT NULL").select("i", F.col("whole").alias("block"), "room")
    inside = Window.partitionBy("i").orderBy("h").rangeBetween(Window.unboundedPreceding, 0)
    within_part = dealt.join(sized(part, 50_000), ["i", "block"]).withColumn("upto", F.sum("size").over(inside))
    fits = F.col("upto") <= F.col("room")
    cut = within_part.groupBy("i").agg(F.max(F.when(fits, F.struct("upto", "h"))).alias("cut"), F.first("room").alias("room"))
    cut = cut.select("i", F.col("cut.h").alias("until"), (F.col("room") - F.coalesce(F.col("cut.upto"), F.lit(0))).alias("gap"))
    more = within_part.join(cut.select("i", "gap"), "i").filter(~fits & (F.col("size") < 2 * F.col("gap"))).groupBy("i").agg(F.min_by("h", F.struct(F.abs(F.col("size") - F.col("gap")), F.col("h"))).alias("also"))
    cut = cut.join(more, "i", "left").select("i", "until", "also")

    # blocks numbered pass by pass, and the shards that take them
    given = stored(spec.join(sized(last, 50_000), "i").join(sized(stored(cut, "cuts"), 50_000), "i", "left"), "given")  # a row per source, as all of these
    quotas = given.select("i", (F.col("passes") * F.col("blocks") + F.col("whole") + F.col("room").isNotNull().cast("long")).alias("q"))
    total = (spec.agg(F.sum("target")).first()[0] or 0.0) / shard_words
    taken = shard_quotas(quotas, max(1, round(total)), seed + 3).filter("n > 0").select("i", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("t"))
    numbered = blocks.select("i", "block").join(sized(given, 50_000), "i").select("i", "block", "bits", "blocks", "passes", "whole", F.explode(F.sequence(F.lit(0).cast("long"), "passes")).alias("pass"), (F.col("room").isNotNull() & (F.col("block") == F.col("whole"))).alias("cut"))
    full = F.col("pass") < F.col("passes")
    place = F.when(full, _permuted(F.col("block"), F.col("bits"), F.lit(seed + 4), F.col("i"), F.col("pass"))).otherwise(F.col("block"))
    numbered = numbered.filter(full | (F.col("block") < F.col("whole")) | F.col("cut")).select("i", "block", "pass", (F.col("pass") * F.col("blocks") + place).alias("t"), (~full & F.col("cut")).alias("cut"))
    each = lambda some: F.sort_array(F.collect_list(F.when(some, F.struct("pass", "shard"))))  # noqa: E731  as many as there are passes
    copies = stored(numbered.join(taken, ["i", "t"]).groupBy("i", "block").agg(each(~F.col("cut")).alias("whole"), each(F.col("cut")).alias("part")), "copies")

    spec_of = sized(given.select(F.col("source").alias(pre + "source"), *[F.col(x).alias(pre + x) for x in ("i", "source_size", "target", "blocks", "until", "also")]), 50_000)
    df = docs.withColumns({pre + "key": key, pre + "h": within, pre + "size": size}).join(spec_of, docs[source].eqNullSafe(c("source")))
    df = df.withColumn(pre + "block", F.pmod(c("key"), c("blocks")))
    of_block = copies.select(*[F.col(x).alias(pre + "c_" + x) for x in copies.columns])
    df = df.join(sized(of_block, 200_000), (c("i") == c("c_i")) & (c("block") == c("c_block")), "left")
    in_part = F.coalesce(c("h") <= c("until"), F.lit(False)) | F.coalesce(c("h") == c("also"), F.lit(False))
    none = F.array().cast("array<struct<pass:bigint,shard:bigint>>")
    all_copies = F.concat(F.coalesce(c("c_whole"), none), F.when(in_part, F.coalesce(c("c_part"), none)).otherwise(none))
    return df.select(*docs.columns, c("size"), c("source_size"), c("target"), all_copies.alias(pre + "copies"))


def mixed_documents(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """The mix: docs' rows as often as they are taken; a shard lies whole in one partition, shuffled by itself. Rows are as mix_plan says."""
    pre = prefix(docs)
    copies = mix_plan(docs, seed=seed, **options).select(*docs.columns, F.explode(pre + "copies").alias(pre + "copy"))
    mix = copies.withColumn(pre + "place", F.xxhash64(F.lit(seed + 5), pre + "copy.pass", F.col(options.get("id_col", "doc_id")), F.col(options.get("text", "text"))))
    return mix.repartition(F.col(pre + "copy.shard")).sortWithinPartitions(pre + "copy.shard", pre + "place").select(*docs.columns)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = mix_plan(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return df.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
                     (F.col("__size") * F.size("__copies")).cast("long").alias("taken"), F.array_join(F.transform("__copies", lambda c: c["shard"].cast("string")), ",").alias("shards"))
