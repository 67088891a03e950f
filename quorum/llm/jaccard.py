"""Exact join of sets of word shingles by Jaccard similarity, with skipping by the relations of sets.

Equal sets are one class. Prefixes of each set in one global order (rare shingles first) are dealt by shingle; in each
list, sorted by size, blocks whose sizes or positions can't reach the threshold are skipped. In a long list sets are first
compared with a leader: those similar to it take over its answers, and only pairs of sets that are still in different
components are looked at again: first each with some members of the largest component, then with the few that are nearest
to it, and what is still apart then with all that sizes and sketches allow. So no link that could join two components
stays unseen, and no list of near copies is expanded into all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, most_frequent, prefix, sized, stored
from .components import components
from .words import _STEP, mixed, set_fingerprint, shingle_sets

#: Shingles with known frequency, at most; all others count as rare. The order of a prefix needn't be exact.
MOST_FREQUENT = 100_000
#: Shingles that a task counts at once, and how often one has to occur among them to be reported.
COUNT_AT_ONCE, LEAST_COUNT = 2_000_000, 4
#: Lists of up to so many sets are compared pair by pair, longer ones through a leader.
SHORT_LIST = 3
#: Members of a list's largest component with which sets outside it are compared, before all are.
LEADERS = 16
#: Lists that a row names.
FIRST_LISTS = 8
#: Rows of a list that one task takes at once; a shingle that may be in more is dealt over several tasks.
LIST_ROWS = 100_000
#: Sets of a list that ask and sets that are asked, in one task: longer lists are cut into blocks, and pairs of blocks dealt.
ASKING, ASKED = 1024, 4096
#: Elements of a set that count as a row of a block: a block holds fewer of the larger sets.
ELEMENTS = 8192
#: Sets that a set is compared with, the nearest by their sketches, before it is with all that these don't rule out.
NEAREST = 8
#: Fingerprints that a task remembers so as not to tell a set twice.
REMEMBERED = 1_000_000


def _rows(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)


def sketch(s: np.ndarray) -> bytes:
    """A bit for each of 2n to 4n classes of hashes by their low bits, n the set's size, that holds an element."""
    bits = max(3, int(2 * len(s) - 1).bit_length())
    out = np.zeros(1 << bits, np.uint8)
    out[(s & np.uint64((1 << bits) - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """A sketch, or some as rows, brought to fewer classes: one less bit of the hash lays its halves upon each other."""
    while bits.shape[-1] > size:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


def most_overlap(x: np.ndarray, n, y: np.ndarray, m):
    """At most so many elements are in both sets (rows of x, a set y): a class where only one has any holds one of its own."""
    size = min(x.shape[-1], y.shape[-1])
    x, y = folded(x, size), folded(y, size)
    return np.minimum(n - np.bitwise_count(x & ~y).sum(axis=-1, dtype=np.int64), m - np.bitwise_count(y & ~x).sum(axis=-1, dtype=np.int64))


def set_table(docs: DataFrame, k: int, id_col: str, text: str, row: str | None = None) -> DataFrame:
    """(doc, row, n, fp, bits): the size, fingerprint and sketch of each row's set, and the row's number if there is a column row of them. A stored table."""

    def sizes(batches):
        for b in batches:
            n, fp, bits = [], [], []
            for s in shingle_sets(b.column(1), k):
                n.append(len(s))
                fp.append(set_fingerprint(s) if len(s) else None)
                bits.append(sketch(s) if len(s) else None)
            yield _rows(["doc", "row", "n", "fp", "bits"], b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(fp, pa.int64()), pa.array(bits, pa.binary()))

    number = F.col(row) if row else F.lit(None).cast("long")
    return stored(docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text).alias("t"), number.alias("row")).mapInArrow(sizes, "doc long, row long, n long, fp long, bits binary"), "sets")


def frequent_shingles(docs: DataFrame, k: int, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, of up to MOST_FREQUENT shingles that tasks have met often, and their counts."""

    def count(batches):
        some: list[np.ndarray] = []
        held = 0

        def flush():
            h, n = np.unique(np.concatenate(some), return_counts=True)
            often = n >= LEAST_COUNT
            return _rows(["g", "c"], h[often].view(np.int64), n[often])

        for b in batches:
            for s in shingle_sets(b.column(0), k):
                some.append(s)
                held += len(s)
                if held >= COUNT_AT_ONCE:
                    yield flush()
                    some, held = [], 0
        if held:
            yield flush()

    met = docs.select(F.col(text).alias("t")).mapInArrow(count, "g long, c long").groupBy("g").agg(F.sum("c").alias("c"))
    top = most_frequent(stored(met, "frequent"), "c", MOST_FREQUENT).toPandas()
    g, c = top["g"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64)
    order = np.argsort(g)
    return g[order], c[order]


def least_overlap(a, b, percent: int):
    """Shared elements that sets of these sizes need for the threshold."""
    return -(-percent * (a + b) // (100 + percent))


def prefixes(docs: DataFrame, frequent, k: int, percent: int, text: str, list_rows: int = LIST_ROWS) -> DataFrame:
    """(l, g, fp, n, at): for each set the shingles g of its probing prefix; at: the place of the shingle in it; l: the part of g's list that the set is in, g itself if that has but one."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def emit(batches):
        hot, count = shared.value
        parts = -(-count // list_rows)
        seen: set[int] = set()  # equal sets of one task are told once
        for b in batches:
            if len(seen) > REMEMBERED:
                seen.clear()
            ls, gs, fps, ns, ats = [], [], [], [], []
            for s in shingle_sets(b.column(0), k):
                if not len(s) or (fp := set_fingerprint(s)) in seen:
                    continue
                seen.add(fp)
                n = len(s)
                p = n - -(-percent * n // 100) + 1
                if len(hot):
                    i = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
                    known = hot[i] == s
                    order = np.lexsort((s, np.where(known, count[i], 0)))[:p]
                    s, split = s[order], np.where(known, parts[i], 1)[order].astype(np.uint64)
                    part = mixed(np.array([fp], np.int64).view(np.uint64)) % split
                    ls.append(np.where(split > 1, mixed(s + (part + np.uint64(1)) * _STEP), s))
                else:
                    s = s[:p]
                    ls.append(s)
                gs.append(s)
                fps.append(np.full(p, fp, np.int64))
                ns.append(np.full(p, n, np.int32))
                ats.append(np.arange(p, dtype=np.int32))
            if gs:
                yield _rows(["l", "g", "fp", "n", "at"], *(np.concatenate(x).view(np.int64) for x in (ls, gs)), *map(np.concatenate, (fps, ns, ats)))

    return docs.select(F.col(text).alias("t")).mapInArrow(emit, "l long, g long, fp long, n int, at int")


def _may(n, at, i, j, percent):
    """Which of the pairs (i, j), n[i] <= n[j], their sizes and the places of a common element don't rule out."""
    need = least_overlap(n[i], n[j], percent)
    return (100 * n[i] >= percent * n[j]) & (np.minimum(n[i] - at[i], n[j] - at[j]) >= need) & (at[i] <= n[i] - least_overlap(n[i], n[i], percent))


def _lists(batches):
    """Columns (l, g, fp, n, ...) of batches sorted by l and fp in blocks that hold whole lists of equal l: without equal sets, and without lists of one that are all of g; and their starts and ends."""
    held = None
    for b in _then_none(batches):
        x = None if b is None else [b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)]
        x = held if b is None else x if held is None else [np.concatenate(p) for p in zip(held, x, strict=True)]
        if x is None or not len(x[0]):
            continue
        cut = len(x[0]) if b is None else int(np.searchsorted(x[0], x[0][-1], "left"))
        held, x = [c[cut:] for c in x], [c[:cut] for c in x]
        for only in (lambda l, g, fp: np.r_[True, (l[1:] != l[:-1]) | (fp[1:] != fp[:-1])], lambda l, g, fp: np.r_[False, l[1:] == l[:-1]] | np.r_[l[1:] == l[:-1], False] | (l != g)):  # noqa: E741
            x = [c[only(*x[:3])] for c in x] if len(x[0]) else x
        if len(x[0]):
            starts = np.flatnonzero(np.r_[True, x[0][1:] != x[0][:-1]])
            yield x, starts, np.r_[starts[1:], len(x[0])]


def _then_none(batches):
    yield from batches
    yield None


def _starred(fp, n, percent):
    """Pairs of a list, sorted by size: each set with the leader of its block of similar sizes and with that of the one before."""
    a, b, start, before = [], [], 0, None
    rank = mixed(fp.view(np.uint64))
    while start < len(n):
        end = int(np.searchsorted(n, n[start] * 100 // percent, "right"))
        leader = start + int(np.argmin(rank[start:end]))
        for lead in (leader, before):
            if lead is not None:
                rest = np.arange(start, end)
                rest = rest[(rest != lead) & (100 * np.minimum(n[rest], n[lead]) >= percent * np.maximum(n[rest], n[lead]))]
                a.append(np.full(len(rest), fp[lead]))
                b.append(fp[rest])
        before, start = leader, end
    return np.concatenate(a), np.concatenate(b)


def candidates(rows: DataFrame, percent: int) -> DataFrame:
    """(g, a, b, n): pairs to compare, with g null; and, with b null, the sets of each different long list g. A stored table."""
    names, kinds = ["g", "a", "b", "n"], "g long, a long, b long, n long"

    def pairs(batches):
        told: set[int] = set()  # lists of the same sets are told once a task
        for (l, g, fp, n, at), starts, ends in _lists(batches):  # noqa: E741
            if len(told) > REMEMBERED:
                told.clear()
            n, at, size, part = n.astype(np.int64), at.astype(np.int64), ends - starts, (l != g)[starts]
            a, b = [], []
            for i, j in ((0, 1), (0, 2), (1, 2)):
                s = starts[(size > j) & (size <= SHORT_LIST)]
                ok = _may(n, at, s + i, s + j, percent)
                a.append(fp[s[ok] + i])
                b.append(fp[s[ok] + j])
            long = size > SHORT_LIST
            even = long & (100 * n[starts] >= percent * n[ends - 1])
            rank = mixed(fp.view(np.uint64))
            if even.any():
                lead = np.minimum.reduceat(rank, starts)
                lists = np.repeat(np.arange(len(starts)), size)
                leader = np.zeros(len(starts), np.int64)
                leads = rank == lead[lists]
                leader[lists[leads]] = fp[leads]
                rest = even[lists] & ~leads
                a.append(leader[lists[rest]])
                b.append(fp[rest])
            for k in np.flatnonzero(long & ~even):
                p, q = _starred(fp[starts[k] : ends[k]], n[starts[k] : ends[k]], percent)
                a.append(p)
                b.append(q)
            both = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
            if len(both):
                yield _rows(names, pa.nulls(len(both), pa.int64()), both[:, 0], both[:, 1], pa.nulls(len(both), pa.int64()))
            mark = np.where(part, g[starts], np.add.reduceat(rank, starts).view(np.int64))
            for k in np.flatnonzero(long | part):  # of a list in parts all sets are told, under its own name
                if part[k] or (m := int(mark[k])) not in told:
                    if not part[k]:
                        told.add(m)
                    yield _rows(names, np.full(size[k], mark[k]), fp[starts[k] : ends[k]], pa.nulls(int(size[k]), pa.int64()), n[starts[k] : ends[k]])

    return stored(rows.repartition("l").sortWithinPartitions("l", "n", "fp").mapInArrow(pairs, kinds), "candidates")


def dealt_pairs(rows: DataFrame, percent: int, asking: int = ASKING, asked: int = ASKED) -> DataFrame:
    """(a, b, asker, near), a < b: pairs of sets in a list that sizes and sketches don't rule out: one that asks and one that is asked, with other labels; and how similar they are at most.

    rows: (g, fp, n, label, bits, gs, asks, is_asked, n_asks, n_asked); the last two are numbers of such rows in g. Lists are cut into blocks by hash, and pairs of blocks
    are dealt, so a list of whatever length goes to as many tasks as it needs. gs: lists of a set; a pair is told by the
    first that both have, or, if none of these is common, by each common list.
    """
    h = F.xxhash64(F.lit(7), F.col("fp"))
    i_of, j_of = (F.greatest(F.ceil(F.col(n) / size), F.lit(1)).cast("long") for n, size in (("n_asks", asking), ("n_asked", asked)))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    columns = ["g", "fp", "n", "label", "bits", "gs"]
    ask = rows.filter("asks").select(*columns, "asks", F.lit(True).alias("asking"), F.pmod(h, i_of).alias("i"), all_of(j_of).alias("j"))
    give = rows.filter("is_asked").select(*columns, "asks", F.lit(False).alias("asking"), all_of(i_of).alias("i"), F.pmod(h, j_of).alias("j"))
    both = ask.union(give).select(F.xxhash64("g", "i", "j").alias("l"), *columns, "asks", "asking")

    def pairs(batches):
        for (_, g, f, n, label, bits, gs, asks, asking_), starts, ends in _whole_lists(batches):
            a, b, asker, near = [], [], [], []
            for s, e in zip(starts, ends, strict=True):
                q, p = s + np.flatnonzero(asking_[s:e]), s + np.flatnonzero(~asking_[s:e].astype(bool))
                if not len(q) or not len(p):
                    continue
                k, sizes = n[p].astype(np.int64), np.array([len(bits[x]) for x in p])
                held = {z: (at := np.flatnonzero(sizes == z), np.frombuffer(b"".join(bits[p[at]]), np.uint8).reshape(-1, z)) for z in np.unique(sizes)}
                lists_of = {x: frozenset(gs[x].tolist()) for x in (*q, *p)}
                for j in q:
                    m = int(n[j])
                    for at, x in held.values():
                        ok = (label[p[at]] != label[j]) & (100 * np.minimum(k[at], m) >= percent * np.maximum(k[at], m)) & (~asks[p[at]].astype(bool) | (f[p[at]] < f[j]))
                        i = np.flatnonzero(ok)
                        if len(i):
                            most = most_overlap(x[i], k[at[i]], np.frombuffer(bits[j], np.uint8), m)
                            i, most = (y[most >= least_overlap(k[at[i]], m, percent)] for y in (i, most))
                        if len(i):
                            first = [min(lists_of[y] & lists_of[j], default=g[j]) == g[j] for y in p[at[i]]]
                            i, most = i[first], most[first]
                            asker.append(np.full(len(i), f[j]))
                            near.append(most / (k[at[i]] + m - most))
                            a.append(np.minimum(f[p[at[i]]], f[j]))
                            b.append(np.maximum(f[p[at[i]]], f[j]))
            if a:
                told = [np.concatenate(x) for x in (a, b, asker, near)]
                yield _rows(["a", "b", "asker", "near"], *told)

    found = both.repartition("l").sortWithinPartitions("l").mapInArrow(pairs, "a long, b long, asker long, near double")
    return found.distinct()


def _whole_lists(batches):
    """Columns of sorted batches in blocks that hold whole lists of an equal first column, and their starts and ends."""
    held = None
    for b in _then_none(batches):
        x = None if b is None else [b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)]
        x = held if b is None else x if held is None else [np.concatenate(p) for p in zip(held, x, strict=True)]
        if x is None or not len(x[0]):
            continue
        cut = len(x[0]) if b is None else int(np.searchsorted(x[0], x[0][-1], "left"))
        held, x = [c[cut:] for c in x], [c[:cut] for c in x]
        if len(x[0]):
            starts = np.flatnonzero(np.r_[True, x[0][1:] != x[0][:-1]])
            yield x, starts, np.r_[starts[1:], len(x[0])]


def residual(long: DataFrame, labels: DataFrame, classes: DataFrame, percent: int, leaders: int | None) -> DataFrame:
    """(a, b, asker, near): pairs of sets of long lists (g, fp, n) in different components that sizes and sketches don't rule out.

    Sets outside a list's largest component ask: with leaders, so many members of that component, in lists where it has twice
    as many; else all other sets.
    """
    rows = long.distinct().join(labels, long["fp"] == labels["node"], "left").select("g", "fp", "n", F.coalesce("component", "fp").alias("label"))
    rows = stored(rows, "labelled")
    weight = F.greatest(F.count("*"), F.ceil(F.sum("n") / ELEMENTS)).cast("long")  # in rows of a block
    shares = rows.groupBy("g", "label").agg(F.count("*").alias("c"), weight.alias("w")).groupBy("g").agg(F.count("*").alias("labels"), F.sum("w").alias("size"), F.max(F.struct("c", "label", "w")).alias("most"))
    split = shares.filter((F.col("labels") > 1) & (F.col("most.c") >= (0 if leaders is None else 2 * leaders))).select(F.col("g").alias("g2"), F.col("most.label").alias("largest"), (F.col("size") - F.col("most.w")).alias("n_asks"), "size")
    rows = rows.join(sized(stored(split, "split-lists"), 500_000), F.col("g") == F.col("g2")).drop("g2")
    asks = F.col("label") != F.col("largest")
    if leaders is None:
        rows = rows.select("*", asks.alias("asks"), F.lit(True).alias("is_asked"), F.col("size").alias("n_asked"))
    else:
        place = F.row_number().over(Window.partitionBy("g").orderBy(F.xxhash64(F.lit(9), "fp"), "fp"))  # each task keeps so many a list before any are dealt
        chosen = rows.filter(~asks).withColumn("place", place).filter(F.col("place") <= leaders).drop("place")
        rows = rows.filter(asks).select("*", F.lit(True).alias("asks"), F.lit(False).alias("is_asked"), F.lit(leaders).alias("n_asked")).union(chosen.select("*", F.lit(False), F.lit(True), F.lit(leaders)))
    rows = stored(rows, "asking")
    lists = rows.groupBy(F.col("fp").alias("fp2")).agg(F.slice(F.array_sort(F.collect_set("g")), 1, FIRST_LISTS).alias("gs"))
    lists = lists.join(classes.select(F.col("fp").alias("fp3"), "bits"), F.col("fp2") == F.col("fp3"))
    return dealt_pairs(rows.join(lists, F.col("fp") == F.col("fp2")), percent)


def possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b): those of the pairs whose sketches don't rule them out. A stored table."""

    def check(batches):
        for b in batches:
            cols = [b.column(c).to_pylist() for c in range(2, 6)]
            keep = [bool(most_overlap(np.frombuffer(x, np.uint8), n, np.frombuffer(y, np.uint8), m) >= least_overlap(n, m, percent)) for x, n, y, m in zip(*cols, strict=True)]
            yield _rows(["a", "b"], *[b.column(c).filter(pa.array(keep, pa.bool_())) for c in (0, 1)])

    side = lambda s: classes.select(F.col("fp").alias(s), F.col("bits").alias(f"bits_{s}"), F.col("n").alias(f"n_{s}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "bits_a", "n_a", "bits_b", "n_b")
    return stored(both.mapInArrow(check, "a long, b long"), "pairs")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int, id_col: str, text: str) -> DataFrame:
    """(a, b): those of the stored pairs whose sets reach the threshold; b's set goes to a's. A stored table."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct().join(classes.select("fp", "doc"), "fp")
    wanted = stored(wanted.select(F.col("doc").alias("__doc")).distinct(), "wanted")
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text).alias("t")).join(sized(wanted, 2_000_000), F.col("doc").eqNullSafe(F.col("__doc")), "left_semi")

    def sets(batches):
        seen: set[int] = set()
        for b in batches:
            fps, out = [], []
            for s in shingle_sets(b.column(0), k):
                if len(s) and (fp := set_fingerprint(s)) not in seen:
                    seen.add(fp)
                    fps.append(fp)
                    out.append(s.tobytes())
            yield _rows(["fp", "s"], pa.array(fps, pa.int64()), pa.array(out, pa.binary()))

    def similar(batches):
        for b in batches:
            keep = []
            for s, t in zip(b.column(2), b.column(3), strict=True):
                s, t = np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(t.as_buffer(), np.uint64)
                i = np.minimum(np.searchsorted(s, t), len(s) - 1)
                both = int((s[i] == t).sum())
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield _rows(["a", "b"], *[b.column(c).filter(pa.array(keep, pa.bool_())) for c in (0, 1)])

    held = stored(texts.select("t").mapInArrow(sets, "fp long, s binary"), "shingles")
    members = held.join(sized(pairs, 500_000), held["fp"] == pairs["b"]).select("a", "b", F.col("s").alias("t"))
    leaders = held.join(sized(stored(pairs.select("a").distinct(), "leaders"), 500_000).withColumnRenamed("a", "__a"), F.col("fp") == F.col("__a"), "left_semi").select(F.col("fp").alias("a"), "s")
    both = members.join(leaders.hint("merge"), "a").select("a", "b", "s", "t")
    return stored(both.mapInArrow(similar, "a long, b long").distinct(), "links")


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after more links (a, b): only the components that they join are gone through. A stored table."""
    of = lambda c: labels.select(F.col("node").alias(f"n{c}"), F.col("component").alias(f"l{c}"))
    between = links.join(of("a"), F.col("a") == F.col("na"), "left").join(of("b"), F.col("b") == F.col("nb"), "left")
    between = stored(between.select("a", "b", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb")), "edges")
    moved = components(between.select(F.col("la").alias("a"), F.col("lb").alias("b"))).select(F.col("node").alias("old"), F.col("component").alias("new"))
    every = labels.union(between.select(F.explode(F.array(F.struct("a", "la"), F.struct(F.col("b").alias("a"), F.col("lb").alias("la")))).alias("x")).select("x.a", "x.la")).distinct()
    return stored(every.join(moved, F.col("component") == F.col("old"), "left").select("node", F.coalesce("new", "component").alias("component")), "labels")


def linked_sets(docs: DataFrame, k: int, percent: int, id_col: str, text: str, row: str | None = None, list_rows: int = LIST_ROWS) -> DataFrame:
    """(doc, row, n, fp, label): each row's set and the least fingerprint that links reach from it; both null without a set."""
    sets = set_table(docs, k, id_col, text, row)
    classes = stored(sets.filter("n > 0").groupBy("fp").agg(F.min("doc").alias("doc"), F.first("n").alias("n"), F.first("bits").alias("bits")), "classes")
    found = candidates(prefixes(docs, frequent_shingles(docs, k, text), k, percent, text, list_rows), percent)
    pairs = stored(found.filter("g IS NULL").select("a", "b").distinct(), "pairs")
    links = verified(possible(pairs, classes, percent), classes, docs, k, percent, id_col, text)
    labels = components(links)
    long = found.filter("g IS NOT NULL").select("g", F.col("a").alias("fp"), "n")
    told = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    def after(pairs: DataFrame) -> DataFrame:
        """The labels after those of the stored pairs that link."""
        links = None if pairs.isEmpty() else verified(pairs, classes, docs, k, percent, id_col, text)
        return labels if links is None or links.isEmpty() else _joined(labels, links)

    new = stored(residual(long, labels, classes, percent, LEADERS).select("a", "b").distinct().join(told, ["a", "b"], "left_anti"), "pairs")
    labels, told = after(new), told.union(new)
    place = F.row_number().over(Window.partitionBy("asker").orderBy(F.desc("near"), "a", "b"))
    left = stored(residual(long, labels, classes, percent, None).join(told, ["a", "b"], "left_anti").withColumn("place", place), "left")
    # a set that links at all mostly does so with one of its nearest; then most of its other pairs are within a component
    labels = after(stored(left.filter(F.col("place") <= NEAREST).select("a", "b").distinct(), "pairs"))
    of = lambda c: labels.select(F.col("node").alias(f"n{c}"), F.col("component").alias(f"l{c}"))
    rest = left.filter(F.col("place") > NEAREST).select("a", "b").distinct().join(of("a"), F.col("a") == F.col("na"), "left").join(of("b"), F.col("b") == F.col("nb"), "left")
    labels = after(stored(rest.filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b"), "pairs"))
    return sets.join(labels, F.col("fp") == F.col("node"), "left").select("doc", "row", "n", "fp", F.coalesce("component", "fp").alias("label"))


def similar_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text", list_rows: int = LIST_ROWS) -> DataFrame:
    """(doc, n_shingles, component): one row per row of docs; component: the smallest id that links reach.

    Sets link when 100 * shared >= percent * union. Null and empty texts have no set and link with nothing; equal sets always
    link; rows with one id and other texts are told apart by their sets; a null id is the smallest of none: a component
    of null ids alone is null. Extra columns of docs aren't read. Components need no pair within one that is known already;
    similar_pairs has all pairs.
    """
    found = stored(linked_sets(docs, k, percent, id_col, text, list_rows=list_rows), "linked")
    least = found.filter("n > 0").groupBy(F.col("label").alias("label2")).agg(F.min("doc").alias("component"), F.count("*").alias("c")).filter("c > 1")
    out = found.join(sized(stored(least, "components"), 2_000_000), F.col("label") == F.col("label2"), "left")
    return out.select("doc", F.col("n").alias("n_shingles"), F.when(F.col("c") > 1, F.col("component")).otherwise(F.col("doc")).alias("component"))


def kept_documents(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each group of linked rows of docs one: that with the least id, a null one last, and of equal ids the first read.

    Rows are told apart by their place, not by their id: repeated rows are one group, rows with one id and other texts
    aren't. Rows without words are groups of their own. The columns are those of docs, whatever their names.
    """
    number = prefix(docs) + "row"
    docs_ = stored(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    found = stored(linked_sets(docs_, k, percent, id_col, text, number).filter("n > 0").select("doc", "row", "label"), "linked")
    first = found.groupBy(F.col("label").alias("label2")).agg(F.min(F.struct(F.col("doc").isNull(), "doc", "row")).alias("first"), F.count("*").alias("c")).filter("c > 1")
    first = sized(stored(first.select("label2", F.col("first.row").alias("keep")), "first-rows"), 2_000_000)
    gone = found.join(first, F.col("label") == F.col("label2")).filter("row <> keep").select(F.col("row").alias(number + "2"))
    return docs_.join(sized(stored(gone, "near-duplicates"), 2_000_000), F.col(number) == F.col(number + "2"), "left_anti").select(*docs.columns)


def similar_pairs(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text", asking: int = ASKING, asked: int = ASKED) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs (a, b), a < b, of fingerprints of different sets that link, all of them; members (doc, n, fp): each row's set. Stored tables.

    Equal sets are one, so copies aren't expanded into pairs. Null and empty texts have the fingerprint null and are in no
    pair. Near copies are: a group of n different ones may have n * n / 2 links, which is what is asked for here.
    """
    members = set_table(docs, k, id_col, text)
    classes = stored(members.filter("n > 0").groupBy("fp").agg(F.min("doc").alias("doc"), F.first("n").alias("n"), F.first("bits").alias("bits")), "classes")
    rows = stored(prefixes(docs, frequent_shingles(docs, k, text), k, percent, text).select("g", "fp").distinct(), "prefixes")
    size = rows.groupBy(F.col("g").alias("g2")).agg(F.count("*").cast("int").alias("size")).filter("size > 1")
    none = F.array().cast("array<bigint>")
    rows = rows.join(size, F.col("g") == F.col("g2")).join(classes.withColumnRenamed("fp", "fp2"), F.col("fp") == F.col("fp2"))
    rows = rows.select("g", "fp", "n", F.col("fp").alias("label"), "bits", none.alias("gs"), F.lit(True).alias("asks"), F.lit(True).alias("is_asked"), F.col("size").alias("n_asks"), F.col("size").alias("n_asked"))
    pairs = stored(dealt_pairs(rows, percent, asking, asked).select("a", "b").distinct(), "pairs")
    return verified(pairs, classes, docs, k, percent, id_col, text), members.select("doc", "n", "fp")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(documents(spark, sf_dir)).select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


OP9_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM pair JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) m ON m.a = d.doc_id"""
