"""Phrase collocation mining: phrases of two and three words, grown best first under admissible score bounds.

A phrase's score is that of its lowest-scoring cut: floor(10^6 a a / (l r)), where a, l and r count the phrase,
its first words and the rest. In a phrase of three words, a is no larger than the counts of its first and of its
last two words. So its cut after the first word gives at most 10^6 c / f, where c counts its first two words and f
its first; in the same way, the other cut is bounded by its last two words and its last. These bounds need counts
of pairs only. So words are counted, then pairs, and pairs are a frontier, expanded in waves, best bound first. A
wave lowers each language's threshold t to the score of a further pair, and counts every phrase of three words whose
both bounds reach t, or that holds a pair whose score does (which decides whether that pair survives). A language is
settled as soon as its wanted number of surviving scores of t and more are known, or its frontier is empty: nothing
unexpanded can reach t, so ties at the last place are in too.

Counting is done in tasks over slices of text and summed by Spark. What a pass may leave out (rare words, pairs
that can't matter) is told by a Bloom filter of fixed size; a false hit only counts a phrase too much.

Defined cases: a null text has no words, a null language is ``und``; repeated rows count; languages without a
candidate give no row, and an empty table gives none; further columns don't matter. Counts may have 15 digits; more
are an error in Spark, never a wrong score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haplolake.llm.ragged import offsets_of, slices, utf8_bytes
from haplolake.llm.storage import drop, written

#: What ends a piece of text, and what parts words in it.
PIECE_ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
NO_LANGUAGE = "und"
#: Text bytes that a task counts at once, and rows in a batch that it sends.
SLICE_BYTES, BATCH_ROWS = 2_000_000, 50_000
#: Binary logarithm of a filter's bits: 4 MiB, whatever the table's size.
FILTER_BITS = 25
#: Pairs of each language above the first threshold, in multiples of the wanted phrases, and by how much each wave has more.
FIRST, MORE = 2, 4

_KIND = np.zeros(256, dtype=np.uint8)
_KIND[list(BLANKS)], _KIND[list(PIECE_ENDS)] = 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def _hashes(strings: pa.Array) -> np.ndarray:
    """A 64-bit hash of every string."""
    data, offs = utf8_bytes(strings)
    n = np.diff(offs)
    power = np.cumprod(np.full(int(n.max(initial=0)), 0x100000001B3, dtype=np.uint64))
    value = (data.astype(np.uint64) + np.uint64(1)) * power[np.arange(len(data)) - np.repeat(offs[:-1], n)]
    total = np.append(np.uint64(0), np.cumsum(value))
    return _mixed(total[offs[1:]] - total[offs[:-1]])


def _together(first: np.ndarray, *rest: np.ndarray) -> np.ndarray:
    for h in rest:
        first = _mixed(first * np.uint64(0x9E3779B97F4A7C15) + h)
    return first


class Sieve:
    """Bloom filter over (language, words...). Without bits it lets everything through."""

    def __init__(self, bits: np.ndarray | Broadcast | None = None) -> None:
        self._bits = bits

    @property
    def bits(self) -> np.ndarray | None:
        return self._bits.value if isinstance(self._bits, Broadcast) else self._bits

    @staticmethod
    def _spots(h: np.ndarray) -> np.ndarray:
        return np.concatenate([h >> np.uint64(64 - FILTER_BITS), (h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - FILTER_BITS)]).astype(np.int64)

    def holds(self, h: np.ndarray) -> np.ndarray:
        bits = self.bits
        if bits is None:
            return np.ones(len(h), dtype=bool)
        spots = self._spots(h)
        hit = (bits[spots >> 6] >> (spots & 63).astype(np.uint64)) & np.uint64(1) == 1
        return hit[: len(h)] & hit[len(h) :]

    @classmethod
    def of(cls, keys: DataFrame, *words: str) -> Sieve:
        """The filter of all rows' language and words: bits are set in tasks, merged by Spark, and of fixed size on the driver."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                spots = np.sort(cls._spots(_together(*(_hashes(c) for c in batch.columns))))
                if len(spots):
                    slot = spots >> 6
                    head = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
                    bits = np.bitwise_or.reduceat(np.uint64(1) << (spots & 63).astype(np.uint64), head)
                    yield pa.RecordBatch.from_arrays([pa.array(slot[head]), pa.array(bits.view(np.int64))], names=["slot", "bits"])

        marked = keys.select("lang", *words).mapInArrow(run, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
        out = np.zeros(1 << (FILTER_BITS - 6), dtype=np.uint64)
        out[marked.column("slot").to_numpy()] = marked.column("bits").to_numpy().view(np.uint64)
        # Shared, so that a worker holds one copy for all of its tasks.
        return cls(keys.sparkSession.sparkContext.broadcast(out))


class _Slice:
    """Words of some documents: numbers that tell (language, word) apart, pieces, names and hashes."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        data, offs = utf8_bytes(batch.column("text"))
        kind = _KIND[data]
        word = kind == 0
        begin = word.copy()
        begin[1:] &= ~word[:-1]
        inner = offs[(offs > 0) & (offs < len(data))]
        begin[inner] = word[inner]
        starts = np.flatnonzero(begin)
        doc = np.searchsorted(offs, starts, side="right") - 1
        # Four bytes are enough: an Arrow string array has less than 2^31 of them.
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[starts] + doc
        lengths = np.add.reduceat(word, starts, dtype=np.int64) if len(starts) else starts
        cuts = np.append(0, np.cumsum(lengths))
        raw = _LOWER[data[word]]
        del kind, word, begin
        strings = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(cuts.tobytes()), pa.py_buffer(raw.tobytes())).dictionary_encode()
        lang = pc.fill_null(batch.column("lang"), NO_LANGUAGE).cast(pa.large_string()).dictionary_encode()
        n = max(1, len(strings.dictionary))
        key = lang.indices.to_numpy().astype(np.int64)[doc] * n + strings.indices.to_numpy()
        distinct, self.number = np.unique(key, return_inverse=True)
        self.langs = lang.dictionary.take(pa.array(distinct // n))
        self.names = strings.dictionary.take(pa.array(distinct % n))
        self.lang_hash = _hashes(lang.dictionary)[distinct // n]
        self.hash = _hashes(strings.dictionary)[distinct % n]

    def counted(self, key: np.ndarray, parts: Callable[[np.ndarray], tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        """Rows (language, words..., n) of the distinct keys; parts(keys) gives the words' numbers."""
        distinct, n = np.unique(key, return_counts=True)
        for at in range(0, len(distinct), BATCH_ROWS):
            words = parts(distinct[at : at + BATCH_ROWS])
            columns = [self.langs.take(pa.array(words[0])), *(self.names.take(pa.array(w)) for w in words)]
            names = ["lang", "w1", "w2", "w3"][: len(columns)]
            yield pa.RecordBatch.from_arrays([*(c.cast(pa.string()) for c in columns), pa.array(n[at : at + BATCH_ROWS].astype(np.int64))], names=[*names, "n"])

    def pairs(self, words: Sieve) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs in a piece whose words pass: their keys; for each place, whether a pair begins there, and which."""
        size = np.int64(len(self.langs))
        good = words.holds(_together(self.lang_hash, self.hash))[self.number]
        here = np.zeros(len(self.number), dtype=bool)
        here[:-1] = (self.piece[1:] == self.piece[:-1]) & good[1:] & good[:-1]
        at = np.flatnonzero(here)
        distinct, which = np.unique(self.number[at] * size + self.number[np.minimum(at + 1, len(here) - 1)], return_inverse=True)
        index = np.zeros(len(here), dtype=np.int64)
        index[at] = which
        return distinct, here, index


def _pass(docs: DataFrame, n_words: int, count: Callable[[_Slice], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Counts by (lang, words...): in tasks by slice, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                yield from count(_Slice(part))

    words = [f"w{i + 1}" for i in range(n_words)]
    schema = ", ".join(f"{c} string" for c in ["lang", *words]) + ", n long"
    return docs.mapInArrow(run, schema).groupBy("lang", *words).agg(F.sum("n").alias("n"))


def count_words(docs: DataFrame) -> DataFrame:
    """lang, w1, n of all words."""
    return _pass(docs, 1, lambda s: s.counted(s.number, lambda k: (k,)))


def count_pairs(docs: DataFrame, words: Sieve) -> DataFrame:
    """lang, w1, w2, n of the pairs in a piece both of whose words pass the filter."""

    def count(s: _Slice) -> Iterator[pa.RecordBatch]:
        size = max(1, len(s.langs))
        distinct, here, index = s.pairs(words)
        return s.counted(distinct[index[here]], lambda k: (k // size, k % size))

    return _pass(docs, 2, count)


def count_triples(docs: DataFrame, words: Sieve, frequent: Sieve, prefixes: Sieve, suffixes: Sieve, judged: Sieve) -> DataFrame:
    """lang, w1, w2, w3, n of the phrases made of two frequent pairs, the first of them in prefixes and the second in suffixes, or one in judged."""

    def count(s: _Slice) -> Iterator[pa.RecordBatch]:
        size = max(1, len(s.langs))
        pair, here, index = s.pairs(words)
        a, b = pair // size, pair % size
        h = _together(s.lang_hash[a], s.hash[a], s.hash[b])
        often, first, last, own = (x.holds(h) for x in (frequent, prefixes, suffixes, judged))
        at = np.flatnonzero(here[:-1] & here[1:])
        x, y = index[at], index[at + 1]
        good = often[x] & often[y] & (first[x] & last[y] | own[x] | own[y])
        return s.counted(x[good] * size + b[y[good]], lambda k: (a[k // size], b[k // size], k % size))

    return _pass(docs, 3, count)


def _score(a: str, left: str, right: str) -> F.Column:
    exact = [f"CAST({c} AS DECIMAL(15, 0))" for c in (a, left, right)]
    return F.expr("(CAST(1000000 AS DECIMAL(7, 0)) * ({0} * {0})) div ({1} * {2})".format(*exact))


def _thresholds(pairs: DataFrame, rank: int) -> DataFrame:
    """For each language the score of its pair of this rank, 0 if it has fewer."""
    best = Window.partitionBy("lang").orderBy(F.desc("score"))
    first = pairs.withColumn("_k", F.row_number().over(best)).filter(F.col("_k") <= rank)
    return first.groupBy("lang").agg(F.when(F.count(F.lit(1)) == rank, F.min("score")).otherwise(F.lit(0)).cast("long").alias("t"))


def mine_phrases(docs: DataFrame, top: int = 2000, min_count: int = 10, share: int = 50, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n (words of the language), score.

    A phrase of two words is left out if one of three that holds it and occurs min_count times or more makes up at least ``share`` percent of it.
    """
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    words = written(count_words(rows), "words")
    often = words.filter(F.col("n") >= min_count)
    word_sieve = Sieve.of(often, "w1")
    counted = count_pairs(rows, word_sieve).filter(F.col("n") >= min_count)
    left = often.select("lang", "w1", F.col("n").alias("l"))
    right = often.select("lang", F.col("w1").alias("w2"), F.col("n").alias("r"))
    scored = counted.withColumnRenamed("n", "a").join(left, ["lang", "w1"]).join(right, ["lang", "w2"])
    bounds = (F.expr(f"(1000000 * CAST(a AS DECIMAL(15, 0))) div CAST({c} AS DECIMAL(15, 0))").alias(name) for c, name in (("l", "as_prefix"), ("r", "as_suffix")))
    pairs = written(scored.select("lang", "w1", "w2", "a", "l", "r", _score("a", "l", "r").alias("score"), *bounds), "pairs")
    pair_sieve = Sieve.of(pairs, "w1", "w2")
    rank, found, state = FIRST * top, None, None
    while True:
        goal = _thresholds(pairs, rank)
        if state is None:
            state = written(goal.withColumn("settled", F.lit(False)), "thresholds")
        else:
            now = goal.withColumnRenamed("t", "lower").join(state, "lang")
            state = written(now.select("lang", F.when(F.col("settled"), F.col("t")).otherwise(F.col("lower")).alias("t"), "settled"), "thresholds")
        frontier = pairs.join(state.filter(~F.col("settled")), "lang")
        sieves = [Sieve.of(frontier.filter(F.col(c) >= F.col("t")), "w1", "w2") for c in ("as_prefix", "as_suffix", "score")]
        wave = count_triples(rows, word_sieve, pair_sieve, *sieves).filter(F.col("n") >= min_count)
        # A phrase that is met again in a later wave was counted in full both times.
        merged = wave if found is None else found.unionByName(wave).dropDuplicates(["lang", "w1", "w2", "w3"])
        found = written(merged, "triples")
        alive = written(_survivors(pairs, found, state, share), "survivors")
        reached = alive.groupBy("lang").agg(F.count(F.lit(1)).alias("k"))
        settled = F.col("settled") | (F.col("t") <= 0) | (F.coalesce("k", F.lit(0)) >= top)
        state = written(state.join(reached, "lang", "left").select("lang", "t", settled.alias("settled")), "thresholds")
        if state.filter(~F.col("settled")).isEmpty():
            break
        drop(alive)
        rank *= MORE
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = alive.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _survivors(pairs: DataFrame, triples: DataFrame, state: DataFrame, share: int) -> DataFrame:
    """lang, phrase, a, l, r, score of the phrases that reach their language's threshold and aren't dropped."""
    head = pairs.select("lang", "w1", "w2", F.col("a").alias("head"), F.col("l").alias("l1"))
    tail = pairs.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("tail"), F.col("r").alias("r2"))
    three = triples.withColumnRenamed("n", "a").join(head, ["lang", "w1", "w2"]).join(tail, ["lang", "w2", "w3"])
    three = three.withColumns({"s1": _score("a", "l1", "tail"), "s2": _score("a", "head", "r2")})
    low = F.col("s1") <= F.col("s2")
    pick = lambda x, y: F.when(low, F.col(x)).otherwise(F.col(y))
    long = three.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", pick("l1", "head").alias("l"), pick("tail", "r2").alias("r"), pick("s1", "s2").alias("score"))
    held = triples.select("lang", "w1", "w2", "n").unionByName(triples.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), "n"))
    held = held.groupBy("lang", "w1", "w2").agg(F.max("n").alias("longer"))
    two = pairs.join(held, ["lang", "w1", "w2"], "left").filter(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True)))
    short = two.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", "score")
    return short.unionByName(long).join(state.select("lang", "t"), "lang").filter(F.col("score") >= F.col("t")).drop("t")
