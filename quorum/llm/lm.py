"""Scoring texts with an n-gram model kept as an Elias-Fano trie, in shards.

The model has two levels: all words, and all pairs of neighbours that occur. Words are 64-bit hashes; each shard numbers
its own. Pointers from level one into level two, and the followers of each word, are monotone sequences in Elias-Fano
form; what a pair's probability, interpolated with absolute discounting, is above the backed-off one is a byte that numbers
the entries of a code book. A shard's levels are mapped and searched in that form. Pairs are dealt over shards by their first word, those of very frequent first words by both; a
shard's levels are bytes of a table, and what a shard is asked meets it there in sorted order. Counts of frequent words
are held by tasks, all others join by a shuffle.
"""

from __future__ import annotations

import mmap
import tempfile
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, most_frequent, stored
from .words import _STEP, chunks, mixed

_U = np.uint64
#: Words whose counts tasks hold; tokens that a task counts at once; tokens of the corpus to a shard, while there are few and
#: at most; the number of shards up to which they are few, and the least.
VOCABULARY, AT_ONCE, SHARD_TOKENS, MOST_TOKENS, FEW_SHARDS, LEAST_SHARDS = 1 << 18, 1_500_000, 2_000_000, 8_000_000, 4096, 64
#: Texts that a task remembers so as not to ask for one twice.
REMEMBERED = 1_000_000
#: The token that ends each text, and stands before it.
END = int(mixed(np.array([0x5EED], np.uint64))[0])


def _batch(names, *columns):
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)


class EliasFano:
    """A sequence of whole numbers that never falls: low bits packed, high bits as a unary bit vector.

    It is read where its bytes lie: an element is a select of the high bits and a few bytes of the low ones. What is held
    besides is the number of ones before each word of 64 high bits.
    """

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        v = values.astype(np.uint64)
        n, most = len(v), int(v[-1]) if len(v) else 0
        low = max(0, ((most + 1) // max(n, 1)).bit_length() - 1)
        bits = ((v[:, None] >> np.arange(low, dtype=np.uint64)) & _U(1)).astype(np.uint8)
        high = np.zeros(((most >> low) + n + 64) // 64 * 64, np.uint8)
        high[(v >> _U(low)).astype(np.int64) + np.arange(n)] = 1
        lows = np.packbits(bits.ravel(), bitorder="little").tobytes()
        return np.array([n, low, len(lows)], "<i8").tobytes() + lows + bytes(-len(lows) % 8 + 8) + np.packbits(high, bitorder="little").tobytes()

    def __init__(self, data):
        self.n, self.low, size = np.frombuffer(data, "<i8", 3).tolist()
        cut = 24 + size + -size % 8 + 8
        self.lows = np.ndarray((cut - 31,), "<u8", data, 24, (1,))  # at each byte the eight from there on
        self.words = np.frombuffer(data, "<u8", offset=cut)
        self.ones = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]
        self.zeros = 64 * np.arange(len(self.ones)) - self.ones

    def _low(self, i: np.ndarray) -> np.ndarray:
        at = i * self.low
        return ((self.lows[at >> 3] >> (at & 7).astype(np.uint64)) & _U((1 << self.low) - 1)).astype(np.int64)

    def _select(self, k: np.ndarray, before: np.ndarray, flip: int) -> np.ndarray:
        """Places of the k-th ones, or zeros if the words are flipped, counted from 0: the word by what is before it, then by halves."""
        at = np.searchsorted(before, k, "right") - 1
        word, left, place = self.words[at] ^ _U(flip), k - before[at], at * 64
        for half in (32, 16, 8, 4, 2, 1):
            n = np.bitwise_count(word & _U((1 << half) - 1)).astype(np.int64)
            over = left >= n
            left, place, word = left - n * over, place + half * over, np.where(over, word >> _U(half), word)
        return place

    def get(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        return ((self._select(i, self.ones, 0) - i) << self.low) | self._low(i)

    def find(self, x: np.ndarray) -> np.ndarray:
        """The places of the values x in a sequence that rises throughout, or -1: their successors, by halves, among those with the same high bits, which lie between two zeros."""
        out = np.full(len(x), -1, np.int64)
        high = x >> self.low
        some = np.flatnonzero((x >= 0) & (high < self.zeros[-1]))
        high, want = high[some], x[some] & ((1 << self.low) - 1)
        flip = (1 << 64) - 1
        begin = np.where(high > 0, self._select(np.maximum(high - 1, 0), self.zeros, flip) + 1, 0)
        ones = self.words[begin >> 6] >> (begin & 63).astype(np.uint64)
        ones = np.bitwise_count(ones & ~(ones + _U(1))).astype(np.int64)  # from begin on, as far as the word goes
        lo = begin - high
        end = lo + ones
        cut = np.flatnonzero((begin & 63) + ones == 64)
        end[cut] = self._select(high[cut], self.zeros, flip) - high[cut]
        hi = end.copy()
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < want[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
        there = np.flatnonzero(lo < end)
        there = there[self._low(lo[there]) == want[there]]
        out[some[there]] = lo[there]
        return out


class Trie:
    """The pairs of one shard: pointers by first word, followers relative to their context, and probability codes."""

    @staticmethod
    def encode(first: np.ndarray, second: np.ndarray, logs: np.ndarray, words: int) -> dict[str, bytes]:
        """first, second: sorted pairs of word numbers; logs: their probabilities' logarithms."""
        pointers = np.searchsorted(first, np.arange(words + 1))
        last = np.r_[first[1:] != first[:-1], True]
        tops = np.cumsum(np.where(last, second + 1, 0))  # a context's followers, counted from 1, go on from where the one before has ended
        values = second + 1 + np.r_[0, tops[:-1]]
        book = np.unique(np.quantile(logs, np.linspace(0, 1, 256))) if len(logs) else np.zeros(1)
        codes = np.clip(np.searchsorted((book[1:] + book[:-1]) / 2, logs), 0, len(book) - 1).astype(np.uint8)
        return {"pointers": EliasFano.encode(pointers), "followers": EliasFano.encode(values), "codes": codes.tobytes(), "book": book.tobytes()}

    def __init__(self, pointers, followers, codes, book):
        """The levels' bytes go to a file without a name, from which they are mapped: pages that no question touches need no memory."""
        levels = (pointers, followers, codes, book)
        ends = np.cumsum([len(x) + -len(x) % 8 for x in levels]).tolist()
        with tempfile.TemporaryFile() as f:
            for x in levels:
                f.write(x)
                f.write(bytes(-len(x) % 8))
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        at = memoryview(self.map)
        self.pointers, self.followers = EliasFano(at[: ends[0]]), EliasFano(at[ends[0] : ends[1]])
        self.codes, self.book = np.frombuffer(at, np.uint8, len(codes), ends[1]), np.frombuffer(at, np.float64, offset=ends[2])

    def find(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which sorted pairs there are, and their logarithms: the follower, raised to its context's base, is looked for in the context's range."""
        if not len(first):
            return np.zeros(0, bool), np.zeros(0)
        fresh = np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])]
        f, s = first[fresh], second[fresh]
        new = np.r_[True, f[1:] != f[:-1]]
        lo, hi = self.pointers.get(f[new]), self.pointers.get(f[new] + 1)
        base = np.where(lo > 0, self.followers.get(np.maximum(lo, 1) - 1), 0)
        context = np.cumsum(new) - 1
        at = self.followers.find(base[context] + s + 1)
        at[at >= hi[context]] = -1
        at = at[np.cumsum(fresh) - 1]
        found = at >= 0
        return found, self.book[self.codes[at[found]]]


def token_chunks(texts):
    """(rows from, to, tokens, offsets): hashes of words and an end for each text of a column, some texts at a time."""
    for i, j, h, at in chunks(texts):
        off = at + np.arange(len(at))
        out = np.full(off[-1], END, np.uint64)
        ends = np.zeros(off[-1], bool)
        ends[off[1:] - 1] = True
        out[~ends] = h
        yield i, j, out, off


def _packed(codes: np.ndarray) -> bytes:
    """Sorted whole numbers as compressed differences, byte by byte of all of them."""
    d = np.diff(codes.astype(np.uint64), prepend=_U(0))
    return zlib.compress(d.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpacked(data) -> np.ndarray:
    d = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T
    return np.cumsum(np.ascontiguousarray(d).view(np.uint64).ravel(), dtype=np.uint64)


def unigrams(train: DataFrame) -> DataFrame:
    """(w, c): how often each token occurs in the one column of train. A stored table."""

    def count(batches):
        held, size = [], 0

        def told():
            w, c = np.unique(np.concatenate(held), return_counts=True)
            return _batch(["w", "c"], w.view(np.int64), c)

        for b in batches:
            for _, _, tokens, _ in token_chunks(b.column(0)):
                held.append(tokens)
                size += len(tokens)
                if size >= AT_ONCE:
                    yield told()
                    held, size = [], 0
        if held:
            yield told()

    return stored(train.mapInArrow(count, "w long, c long").groupBy("w").agg(F.sum("c").alias("c")), "unigrams")


def _used(n: int, *places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of n places occur, and for these their numbers among those that do; for others the numbers are undefined."""
    if n > 16 * len(places[0]):
        used = np.unique(np.concatenate(places))
    else:
        there = np.zeros(n, bool)
        for x in places:
            there[x] = True
        used = np.flatnonzero(there)
    number = np.empty(n, np.int64)
    number[used] = np.arange(len(used))
    return used, number


def _closed(model, words: np.ndarray, at: tuple[np.ndarray, np.ndarray], first: np.ndarray, second: np.ndarray) -> tuple[bytes, bytes]:
    """Pairs of places in sorted words, themselves sorted, as bytes: the words that occur, and the pairs as their numbers. at: model.places(words)."""
    used, number = _used(len(words), first, second)
    return model.listed(words[used], at[0][used], at[1][used]), _packed((number[first] * len(used) + number[second]).view(np.uint64))


def _opened(model, words, pairs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted words of pairs, and the places of the pairs' first and second words in them; the pairs are sorted."""
    w, p = model.unlisted(words), _unpacked(pairs)
    first = p // _U(len(w))
    return w, first.view(np.int64), (p - first * _U(len(w))).view(np.int64)


class Model:
    """What every task needs of the model, of bounded size: the totals, and the counts of the most frequent words. All others have theirs in a table."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, n: int, v: int, once: int, twice: int):
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order].astype(np.float64)
        self.n, self.v = n, v
        self.discount = once / (once + 2 * twice) if once and twice else 0.5
        self.followers = np.zeros(len(words))  # how many different words follow each
        self.pair_discount = 0.5

    def places(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which tokens are frequent words, and all tokens' places among these."""
        i = np.minimum(np.searchsorted(self.words, tokens), len(self.words) - 1)
        return self.words[i] == tokens, i

    def places_of_text(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for tokens as they follow in texts, many of them often: each different one is looked for once."""
        number, different = pd.factorize(tokens)
        hot, i = self.places(different)
        return hot[number], i[number]

    def word_p(self, counts):
        return np.maximum(counts - self.discount, self.discount * 1e-9) / self.n

    def listed(self, words: np.ndarray, hot: np.ndarray, places: np.ndarray) -> bytes:
        """Sorted words, and their places as found, as bytes: the frequent ones by their places, all others whole."""
        places = _packed(places[hot])
        return np.array([len(words), len(places)], "<i8").tobytes() + np.packbits(hot).tobytes() + places + words[~hot].tobytes()

    def unlisted(self, data: bytes) -> np.ndarray:
        n, size = np.frombuffer(data, "<i8", 2).tolist()
        cut = 16 + (n + 7) // 8
        hot = np.unpackbits(np.frombuffer(data, np.uint8, cut - 16, 16), count=n).astype(bool)
        words = np.empty(n, np.uint64)
        words[hot] = self.words[_unpacked(data[cut : cut + size]).astype(np.int64)]
        words[~hot] = np.frombuffer(data[cut + size :], np.uint64)
        return words

    def shard(self, words: np.ndarray, at: tuple[np.ndarray, np.ndarray], first: np.ndarray, second: np.ndarray, shards: int) -> np.ndarray:
        """The shards of pairs of places in words, whose own places are at: by a pair's first word, so that all that follows this is in one shard; by both where the first has more than an eighth of a shard."""
        hot, i = at
        split = hot & (self.counts[i] * 8 * shards > self.n)
        shard = (mixed(words) % _U(shards)).astype(np.int64)[first]
        both = np.flatnonzero(split[first])
        shard[both] = (mixed(mixed(words[first[both]] * _STEP + words[second[both]])) % _U(shards)).astype(np.int64)
        return shard


class Pairs:
    """The pairs of neighbours of some texts, each token's with the one before it, as places in the texts' sorted words."""

    def __init__(self, held: list[tuple[np.ndarray, np.ndarray]]):
        """held: the tokens of whole texts, and which of them begin one."""
        tokens, begins = (np.concatenate(x) for x in zip(*held, strict=True))
        number, words = pd.factorize(np.r_[_U(END), tokens])  # an end stands before the first
        order = np.argsort(words)
        self.words = words[order]
        self.size = len(words)
        place = np.empty(self.size, np.int64)
        place[order] = np.arange(self.size)
        place = place[number]
        self.numbers = np.where(begins, place[0], place[:-1]) * self.size + place[1:]

    def by_shard(self, numbers: np.ndarray, model: Model, shards: int):
        """(shard, places of its pairs, their words and their pairs as bytes) for sorted numbers."""
        first = numbers // self.size
        second = numbers - first * self.size
        places = model.places(self.words)
        shard = model.shard(self.words, places, first, second, shards)
        order = np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(shards + 1))
        for s in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            at = order[cuts[s] : cuts[s + 1]]
            yield s, at, *_closed(model, self.words, places, first[at], second[at])


def _begins(off: np.ndarray) -> np.ndarray:
    begins = np.zeros(off[-1], bool)
    begins[off[:-1]] = True  # each text has a token, its end
    return begins


def _binary(x: bytes) -> pa.Array:
    return pa.array([x], pa.binary())


def pair_counts(train: DataFrame, model, shards: int) -> DataFrame:
    """(shard, words, pairs, counts, once, twice): all pairs that occur, sorted, and how many occur once and twice. Stored."""

    def count(batches):
        held, size = [], 0

        def told():
            found = Pairs(held)
            pairs, c = np.unique(found.numbers, return_counts=True)
            for s, at, w, p in found.by_shard(pairs, model.value, shards):
                yield _batch(["shard", "words", "pairs", "counts"], [s], _binary(w), _binary(p), _binary(zlib.compress(c[at].astype("<u4").tobytes(), 1)))

        for b in batches:
            for _, _, tokens, off in token_chunks(b.column(0)):
                held.append((tokens, _begins(off)))
                size += len(tokens)
                if size >= AT_ONCE:
                    yield from told()
                    held, size = [], 0
        if held:
            yield from told()

    def merge(batches):
        at, held = None, []

        def sums():
            words = np.unique(np.concatenate([w for w, *_ in held]))
            size, numbers = len(words), []
            for w, first, second, _ in held:
                place = np.searchsorted(words, w)
                numbers.append(place[first] * size + place[second])
            numbers = np.concatenate(numbers)  # sorted runs, one of each part
            order = np.argsort(numbers, kind="stable")
            pairs = numbers[order]
            starts = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])
            c = np.add.reduceat(np.concatenate([h[3] for h in held])[order], starts, dtype=np.int64)
            first = pairs[starts] // size
            return words, first, pairs[starts] - first * size, c

        def told():
            words, first, second, c = sums()
            return _batch(["shard", "words", "pairs", "counts", "once", "twice"], [at], *map(_binary, _closed(model.value, words, model.value.places(words), first, second)), _binary(zlib.compress(c.astype("<i8").tobytes(), 1)), [int((c == 1).sum())], [int((c == 2).sum())])

        for b in batches:
            for s, w, p, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if s != at and held:
                    yield told()
                    held = []
                at = s
                held.append((*_opened(model.value, w, p), np.frombuffer(zlib.decompress(c), "<u4")))
                if len(held) > 64:
                    held = [sums()]
        if held:
            yield told()

    parts = train.mapInArrow(count, "shard long, words binary, pairs binary, counts binary")
    merged = parts.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(merge, "shard long, words binary, pairs binary, counts binary, once long, twice long")
    return stored(merged, "pairs")


def _number_of_shards(n: int) -> int:
    """As many as the corpus needs: a shard has a bounded number of tokens whatever the corpus."""
    return max(LEAST_SHARDS, min(FEW_SHARDS, -(-n // SHARD_TOKENS)), -(-n // MOST_TOKENS))


def train_model(train: DataFrame, vocabulary: int = VOCABULARY):
    """(model, words, tries): words has (w, c, followers), a row per word; tries has (shard, contexts, words, pointers, followers, codes, book). Stored tables; model and tries are None without a token.

    vocabulary: how many words' counts tasks hold, at most; the results don't depend on it.
    """
    spark = train.sparkSession
    known = unigrams(train)
    n, v, once, twice = known.agg(F.sum("c"), F.count("*"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    if not n:
        return None, known.withColumn("followers", F.lit(0).cast("long")), None
    is_end = F.col("w") == int(np.array([END], np.uint64).view(np.int64)[0])
    top = stored(known.filter(is_end).union(most_frequent(known.filter(~is_end), "c", vocabulary)), "frequent")
    held = top.toPandas()
    model = Model(held["w"].to_numpy(np.int64).view(np.uint64), held["c"].to_numpy(), n, v, once, twice)
    words_of = spark.sparkContext.broadcast(model)
    shards = _number_of_shards(n)
    counted = pair_counts(train, words_of, shards)
    once, twice = counted.agg(F.sum("once"), F.sum("twice")).first()
    model.pair_discount = once / (once + 2 * twice) if once and twice else 0.5

    def kinds(batches):
        for b in batches:
            for w, p in zip(*(x.to_pylist() for x in b.columns), strict=True):
                words, first, _ = _opened(words_of.value, w, p)
                first, c = np.unique(first, return_counts=True)
                yield _batch(["__w", "f"], words[first].view(np.int64), c)

    followers = counted.select("words", "pairs").mapInArrow(kinds, "__w long, f long").groupBy("__w").agg(F.sum("f").alias("followers"))
    words = stored(known.join(followers, F.col("w") == F.col("__w")).select("w", "c", "followers"), "words")  # each word is followed by one or an end
    held = words.join(F.broadcast(top.select("w")), "w", "left_semi").toPandas()
    model.followers = held.sort_values("w", key=lambda w: w.to_numpy(np.int64).view(np.uint64))["followers"].to_numpy(np.float64)
    shared = spark.sparkContext.broadcast(model)

    def rare(batches):
        for b in batches:
            for shard, w, p in zip(*(x.to_pylist() for x in b.columns), strict=True):
                words, _, second = _opened(shared.value, w, p)
                second = words[_used(len(words), second)[0]]
                second = second[~shared.value.places(second)[0]]
                yield _batch(["shard", "__w"], np.full(len(second), shard), second.view(np.int64))

    def tries(batches):
        m, at, held, pairs = shared.value, None, [], None

        def told():
            listed, first, second, c = pairs
            w, of = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.uint64), np.zeros(0))
            order = np.argsort(w)
            w, of = w[order], of[order]

            contexts, starts, f = np.unique(first, return_index=True, return_counts=True)
            contexts = listed[contexts]
            hot, i = of_contexts = m.places(contexts)
            total = np.where(hot, m.counts[i], np.add.reduceat(c, starts))
            back_off = m.pair_discount * np.where(hot, m.followers[i], f) / total
            x = np.repeat(np.arange(len(contexts)), f)

            used, number = _used(len(listed), second)
            words, y = listed[used], number[second]
            hot, i = of_words = m.places(words)
            count = m.counts[i]
            if len(w):
                count = np.where(hot, count, of[np.minimum(np.searchsorted(w, words), len(w) - 1)])
            p = m.word_p(count)[y]
            gain = np.log10((c - m.pair_discount) / total[x] + back_off[x] * p) - np.log10(back_off[x] * p)
            t = Trie.encode(x, y, gain, len(contexts))
            return _batch(["shard", "contexts", "words", *t], [at], _binary(m.listed(contexts, *of_contexts)), _binary(m.listed(words, *of_words)), *map(_binary, t.values()))

        for b in batches:
            shard, ws, cs = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True])
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if shard[i] != at:
                    if pairs is not None:
                        yield told()
                    at, held, pairs = int(shard[i]), [], None
                if b.column(3)[i].is_valid:
                    pairs = (*_opened(m, b.column(3)[i].as_py(), b.column(4)[i].as_py()), np.frombuffer(zlib.decompress(b.column(5)[i].as_py()), "<i8"))
                    i += 1
                if i < j:
                    held.append((ws[i:j].astype(np.int64).view(np.uint64), cs[i:j].astype(np.float64)))
        if pairs is not None:
            yield told()

    asked = counted.select("shard", "words", "pairs").mapInArrow(rare, "shard long, __w long").join(words, F.col("w") == F.col("__w"))
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(x) for x in names]
    both = counted.select("shard", *[F.lit(0).cast("long").alias(x) for x in ("w", "c")], "words", "pairs", "counts").union(asked.select("shard", "w", "c", *none("binary", "words", "pairs", "counts")))
    both = both.repartition(shards, "shard").sortWithinPartitions("shard", F.col("words").isNull())
    encoded = both.mapInArrow(tries, "shard long, contexts binary, words binary, pointers binary, followers binary, codes binary, book binary")
    return model, words, stored(encoded, "tries")


def pair_gains(texts: DataFrame, model, shards: int, tries: DataFrame) -> DataFrame:
    """(print, gain): for each different text by what its pairs in the tries raise its score above the backed-off one."""

    def ask(batches):
        seen: set[int] = set()
        held, marks, size, parts = [], [], 0, 0  # a text told twice counts once, as equal texts gain the same

        def told():
            nonlocal parts
            found, rows = Pairs([h[:2] for h in held]), np.concatenate([r for *_, r in held])
            order = np.argsort(found.numbers)
            rows, part = rows[order], (TaskContext.get().partitionId() << 24) + parts
            parts += 1
            prints = _binary(np.array(marks, "<i8").tobytes())  # with the part's first shard, and no other
            for s, at, w, p in found.by_shard(found.numbers[order], model.value, shards):
                yield _batch(["shard", "part", "a", "b", "c", "d", "e", "f"], [s], [part], _binary(w), _binary(p), _binary(zlib.compress(rows[at].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)), prints, pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()))
                prints = pa.nulls(1, pa.binary())

        for b in batches:
            for _, _, tokens, off in token_chunks(b.column(0)):
                if len(seen) > REMEMBERED:
                    seen.clear()
                prints = text_prints(tokens, off)
                fresh = np.array([p not in seen and not seen.add(p) for p in prints.tolist()], bool)
                if fresh.any():
                    lengths = np.diff(off)
                    rows = np.repeat(np.where(fresh, np.cumsum(fresh) - 1 + len(marks), -1).astype(np.int32), lengths)
                    held.append((tokens[rows >= 0], _begins(off)[rows >= 0], rows[rows >= 0]))
                    marks.extend(prints[fresh].tolist())
                    size += int(lengths[fresh].sum())
                    if size >= AT_ONCE:
                        yield from told()
                        held, marks, size = [], [], 0
        if held:
            yield from told()

    names_out = ["part", "row", "print", "gain"]

    def answer(batches):
        trie, at = None, None
        for b in batches:
            for s, part, *x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if part is None:
                    contexts, words, trie, at = model.value.unlisted(x[0]), model.value.unlisted(x[1]), Trie(*x[2:]), s
                    continue
                if x[3] is not None:
                    prints = np.frombuffer(x[3], "<i8")
                    yield _batch(names_out, np.full(len(prints), part), np.arange(len(prints)), prints, np.zeros(len(prints)))
                if at != s:
                    continue
                rows = np.ascontiguousarray(np.frombuffer(zlib.decompress(x[2]), np.uint8).reshape(4, -1).T).view("<u4").ravel()
                w, first, second = _opened(model.value, x[0], x[1])
                i, j = np.minimum(np.searchsorted(contexts, w), len(contexts) - 1), np.minimum(np.searchsorted(words, w), len(words) - 1)
                may = (contexts[i] == w)[first] & (words[j] == w)[second]
                found, gains = trie.find(i[first[may]], j[second[may]])
                has, row = np.unique(rows[may][found], return_inverse=True)
                if len(has):
                    yield _batch(names_out, np.full(len(has), part), has.astype(np.int64), pa.nulls(len(has), pa.int64()), np.bincount(row, gains, len(has)))

    names = "shard long, part long, a binary, b binary, c binary, d binary, e binary, f binary"
    asked = texts.mapInArrow(ask, names)
    levels = tries.select("shard", F.lit(None).cast("long").alias("part"), *[F.col(x).alias(y) for x, y in zip(("contexts", "words", "pointers", "followers", "codes", "book"), "abcdef", strict=True)])
    met = levels.union(asked).repartition(shards, "shard").sortWithinPartitions(F.col("shard"), F.asc_nulls_first("part"))
    gains = met.mapInArrow(answer, "part long, row long, print long, gain double")
    of_rows = gains.groupBy("part", "row").agg(F.sum("gain").alias("gain"), F.max("print").alias("print"))
    return stored(of_rows.groupBy("print").agg(F.max("gain").alias("gain")), "gains")


def text_prints(tokens: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each text's tokens in order."""
    place = np.arange(len(tokens), dtype=np.uint64) - np.repeat(off[:-1], np.diff(off)).astype(np.uint64)
    return mixed(np.add.reduceat(mixed(tokens + place * _STEP), off[:-1])).view(np.int64)


def scored(docs: DataFrame, held_out, id_col: str = "doc_id", text: str = "text", vocabulary: int = VOCABULARY) -> DataFrame:
    """(doc, held_out, n_tokens, n_known, train_tokens, base_score, score): one row per row of docs; the model learns from rows where the column held_out is false.

    Null and empty texts are an end alone. Rows count as often as they occur, whatever their ids; extra columns aren't read.
    Without a row to learn from all tokens are unknown, N and V are 0, and the score is the base score.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), held_out.alias("held_out"), F.col(text).alias("t"))
    model, known, tries = train_model(rows.filter(~F.col("held_out")).select("t"), vocabulary)
    if model is None:
        model = Model(np.array([END], np.uint64), np.array([0]), 0, 0, 0, 0)
    shared = spark.sparkContext.broadcast(model)
    whole = model.n + 0.1 * (model.v + 1)

    def first(batches):
        m = shared.value
        base = np.log10((m.counts + 0.1) / whole) if m.n else np.zeros(1)
        score = np.log10(m.word_p(m.counts)) + np.log10(m.pair_discount * m.followers / m.counts) if m.n else np.zeros(1)
        for b in batches:
            for i, j, tokens, off in token_chunks(b.column(2)):
                hot, places = m.places_of_text(tokens)
                at = off[:-1]
                tail = np.r_[0, np.cumsum(~hot)][off].astype(np.int32)
                sums = lambda x: np.add.reduceat(np.where(hot, x[places], 0), at)
                yield _batch(["doc", "held_out", "print", "n_tokens", "n_known", "base", "score", "others"], b.column(0)[i:j], b.column(1)[i:j], text_prints(tokens, off), np.diff(off), sums((m.counts > 0).astype(np.int64)), sums(base), sums(score), pa.ListArray.from_arrays(pa.array(tail), pa.array(tokens[~hot].view(np.int64))))

    kinds = "doc long, held_out boolean, print long, n_tokens long, n_known long, base double, score double, others array<long>"
    each = stored(rows.mapInArrow(first, kinds).withColumn("row", F.monotonically_increasing_id()), "scores")
    # a text's words and its end are also what comes before its words and its end: each token gives its own logarithm and its back-off's
    c, zero = F.col("c"), F.lit(0)
    own = F.when(c.isNull(), F.log10(F.lit(model.discount * max(model.v, 1) / max(model.n, 1)))).otherwise(F.log10((c - model.discount) / max(model.n, 1)) + F.log10(model.pair_discount * F.col("followers") / c))
    others = each.select("row", F.explode("others").alias("__w")).join(known, F.col("__w") == F.col("w"), "left")
    more_base = F.log10((F.coalesce(c, zero) + 0.1) / whole)
    others = others.groupBy("row").agg(F.count("c").alias("more_known"), F.sum(more_base).alias("more_base"), F.sum(own if model.n else more_base).alias("more_score"))
    out = each.drop("others").join(others, "row", "left")
    if tries is not None:
        gains = pair_gains(rows.select("t"), shared, _number_of_shards(model.n), tries)
        out = out.join(gains.withColumnRenamed("print", "__print"), F.col("print") == F.col("__print"), "left")
    else:
        out = out.withColumn("gain", F.lit(0.0))
    return out.select("doc", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", zero)).alias("n_known"), F.lit(int(model.n)).cast("long").alias("train_tokens"),
                      (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("more_score", F.lit(0.0)) + F.coalesce("gain", F.lit(0.0))).alias("score"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    return scored(docs, held_out).withColumnRenamed("doc", "doc_id")
