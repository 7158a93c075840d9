"""Near-duplicate classes by weighted minwise hashing (BagMinHash), banding and exact verification.

A document is the multiset of its shingles (five neighbouring words; words are runs of characters other
than ASCII white space, compared as they are). Two documents are near if their weighted Jaccard
similarity, sum of minima over sum of maxima of the shingles' counts, is at least the threshold.

Signature. The weight axis of every shingle is cut into the intervals [0,1), [1,2), [2,4), [4,8), ...;
each carries a Poisson process of points in time whose rate is its length, and every point has a slot
and a place within its interval, all from hashes of the shingle. A document with weight w sees the
points below w; the earliest one in each slot is its signature. Two signatures agree in a slot with
probability equal to the weighted Jaccard similarity. Time is only followed to where all slots are
full, so a shingle costs about one point, and a weight its logarithm.

Search. Documents with equal multisets are folded into one node first. Nodes that agree in all rows of
a band share a bucket. Each node is compared with the head of its buckets, the node with most partners.
A head with many partners is met in several tasks, as many as its buckets' sizes ask for.
Nodes of buckets in which the others are still in different components are then compared with each
other, in blocks of bounded total length; this is the only step that may grow with the square of a group, and
only of the part of it that is not near its heads. Pairs within a component need no comparison: they
can't change a class. Comparison is exact, on the multisets. A pair at the threshold shares no bucket with probability
(1 - threshold^rows)^bands, 3e-5 for the default 20 bands of 4 rows.

Defined cases: null and wordless texts are near to nothing, each its own class; texts of one to four
words are one shingle; a null id sorts first and is reported as null; rows that share an id are judged
by their own texts; an empty table gives an empty result. Texts are whole, and there is no cap on
buckets or partners. Other columns are not carried, whatever their names. Since ids may be null or
shared, a class is told by its component, and a row by its id and the hash of its text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haplolake.llm.graph import components
from haplolake.llm.ragged import offsets_of, ragged_index, slices, utf8_bytes
from haplolake.llm.storage import drop, written

SHINGLE_WORDS, THRESHOLD, BANDS, ROWS = 5, 0.8, 20, 4
SLICE_BYTES = 2_000_000
#: Shingles of a block when the undecided nodes of a cluster are compared, and partners of a head in one task, both in the mean.
BLOCK_SHINGLES, HEAD_PARTNERS = 1_000_000, 2000
_NULL_ID = -(1 << 63)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Well-spread 64-bit hash of 64-bit values."""
    x = x + np.uint64((salt * 0xA24BAED4963EE407 + 0x9FB21C651E98DF25) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of a ragged byte column, and how many words each text has before and in it (offsets)."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    head = ~space
    head[1:] &= space[:-1]
    inner = offsets[1:-1][offsets[1:-1] < len(data)]
    head[inner] = ~space[inner]
    tail = ~space
    tail[:-1] &= space[1:] | head[1:]
    start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    size = 1 << max(10, (len(data) + 1).bit_length())  # few sizes, so that the powers are kept
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(int(_ODD), size)[: len(data)], out=total[1:])
    h = mixed((total[end] - total[start]) * _powers(int(_ODD_INVERSE), size)[start])
    return h, np.searchsorted(start, offsets).astype(np.int64)


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes with repeats, as a ragged column."""
    h, at = word_hashes(data, offsets)
    n = np.diff(at)
    count = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    to = offsets_of(count)
    doc = np.repeat(np.arange(len(n)), count)
    first = np.arange(to[-1]) - to[:-1][doc] + at[:-1][doc]
    used = np.minimum(n, words)[doc]
    out = used.astype(np.uint64)
    padded = np.concatenate([h, np.zeros(words, np.uint64)])
    for j in range(words):
        out = np.where(j < used, mixed(out * _ODD + padded[first + j]), out)
    return out, to


def bags(data: np.ndarray, offsets: np.ndarray, words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) with weights: text index, hash, weight; and the number of shingles of each text."""
    h, to = shingles(data, offsets, words)
    doc = np.repeat(np.arange(len(to) - 1), np.diff(to))
    _, first, weight = np.unique(h + mixed(doc.astype(np.uint64)), return_index=True, return_counts=True)
    return doc[first], h[first], weight, np.diff(to)


def bag_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, slots: int) -> np.ndarray:
    """Signatures (n_docs x slots) of weighted sets: the time of the earliest point in each slot; inf for empty sets."""
    levels = 1 + np.ceil(np.log2(weight)).astype(np.int64)
    source = np.repeat(np.arange(len(doc)), levels)
    level = np.arange(len(source)) - np.repeat(offsets_of(levels)[:-1], levels)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    rate = np.where(level == 0, 1, low).astype(np.float64)
    share = (weight[source] - low) / rate  # of the interval that lies below the weight
    owner, seed = doc[source], mixed(element[source] + level.astype(np.uint64) * _ODD, 1)
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    out = np.full((n_docs, slots), np.inf)
    with np.errstate(divide="ignore"):
        horizon = slots / total * (np.log(slots) + 10)
    todo = np.arange(len(owner))
    while len(todo):
        now, time, k = todo, np.zeros(len(todo)), 0
        while len(now):
            x = mixed(seed[now], 2 + k)
            time = time - np.log((x >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / rate[now]
            going = time <= horizon[owner[now]]
            now, time, x = now[going], time[going], x[going]
            y = mixed(x, 1)
            seen = (y >> np.uint64(40)).astype(np.float64) * 2.0**-24 < share[now]
            slot = ((y & np.uint64((1 << 32) - 1)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)
            np.minimum.at(out.reshape(-1), owner[now[seen]] * slots + slot[seen], time[seen])
            k += 1
        short = np.isinf(out).any(axis=1) & (total > 0)  # rarely, a slot got no point yet
        horizon[short] *= 2
        todo = todo[short[owner[todo]]]
    return out


def _sign(bands: int, rows: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                data, offs = utf8_bytes(part.column("text"))
                doc, element, weight, n = bags(data, offs, words)
                times = bag_minhash(doc, element, weight, len(n), bands * rows)
                keys = np.zeros((len(n), bands), dtype=np.uint64)
                for r in range(rows):
                    keys = mixed(keys * _ODD + times[:, r::rows].copy().view(np.uint64))
                keys = mixed(keys + np.arange(bands, dtype=np.uint64))
                # Digest of the multiset, whatever its order: sums of two hashes of its members.
                sums = [np.zeros(len(n), dtype=np.uint64) for _ in range(2)]
                for i, s in enumerate(sums):
                    np.add.at(s, doc, mixed(element, 90 + i) * weight.astype(np.uint64))
                full = pa.array(n == 0)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * bands, pa.int32()), pa.array(keys.reshape(-1).view(np.int64)), mask=full)
                yield pa.RecordBatch.from_arrays([part.column("k"), part.column("h"), pa.array(n, pa.int64()), *(pa.array(s.view(np.int64)) for s in sums), lists], names=["k", "h", "n", "d1", "d2", "bands"])

    return run


def _members(words: int):
    """Hashes of a text's shingles in which the second, third, ... use of one differ: sets whose overlap is the multisets'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                data, offs = utf8_bytes(part.column("text"))
                h, to = shingles(data, offs, words)
                doc = np.repeat(np.arange(len(to) - 1), np.diff(to))
                order = np.lexsort((h, doc))
                d, x = doc[order], h[order]
                new = np.ones(len(x), dtype=bool)
                new[1:] = (d[1:] != d[:-1]) | (x[1:] != x[:-1])
                use = np.arange(len(x)) - np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
                x = np.where(use > 0, mixed(x + use.astype(np.uint64) * _ODD), x)
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.ListArray.from_arrays(pa.array(to, pa.int32()), pa.array(x.view(np.int64)))], names=["node", "members"])

    return run


def _near(pairs: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """Of the pairs (a, b, salt), those whose multisets are near, with their similarity. A node's members are sent once for each salt as ``a`` and once a pair as ``b``."""
    heads = pairs.select("a", "salt").distinct().join(members.select(F.col("node").alias("a"), F.col("members").alias("_a")), "a")
    with_b = pairs.join(members.select(F.col("node").alias("b"), F.col("members").alias("_b")), "b")
    shared = with_b.join(heads, ["a", "salt"]).select("a", "b", F.size(F.array_intersect("_a", "_b")).alias("s"), (F.size("_a") + F.size("_b")).alias("n"))
    return shared.filter(F.col("s") >= threshold * (F.col("n") - F.col("s")) - 1e-9).select("a", "b", (F.col("s") / (F.col("n") - F.col("s"))).alias("similarity"))


def _overlapping(threshold: float):
    """Near pairs of different components between two blocks (or within one): shared members are counted
    through the second block's inverted index, one array operation for each node of the first."""

    def run(table: pa.Table) -> pa.Table:
        part, node, c = (table.column(x).to_numpy() for x in ("part", "node", "c"))
        lists = table.column("members").combine_chunks()
        at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        size = np.diff(at)
        left, right = np.flatnonzero(part == part.min()), np.flatnonzero(part == part.max())
        owner = np.repeat(np.arange(len(right)), size[right])
        member = flat[ragged_index(at[:-1][right].astype(np.int64), size[right].astype(np.int64))]
        order = np.argsort(member, kind="stable")
        known, first = np.unique(member[order], return_index=True)
        owner, ends = owner[order], np.append(first, len(member))
        a, b, near = [], [], []
        for i in left:
            wanted = flat[at[i] : at[i + 1]]
            k = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
            k = k[known[k] == wanted]
            shared = np.bincount(owner[ragged_index(ends[k], ends[k + 1] - ends[k])], minlength=len(right))
            every = size[i] + size[right] - shared
            hit = np.flatnonzero((shared >= threshold * every - 1e-9) & (c[right] != c[i]))
            a.append(np.full(len(hit), node[i]))
            b.append(node[right[hit]])
            near.append(shared[hit] / every[hit])
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "similarity": np.concatenate(near)})

    return run


def _compare_undecided(undecided: DataFrame, members: DataFrame, threshold: float, block: int) -> DataFrame:
    """Links (a, b) across components among the nodes of buckets that are still torn.

    undecided: bucket, node, n, c. Nodes that hang together by such buckets are a cluster; a cluster is dealt
    into blocks of about ``block`` shingles, and every two blocks are compared in a task of their own. No pair becomes
    a row unless it is near.
    """
    nodes = undecided.select("node", "n", "c").distinct()
    heads = undecided.groupBy("bucket").agg(F.min("node").alias("first"))
    together = components(undecided.join(heads, "bucket").select(F.col("node").alias("a"), F.col("first").alias("b")))
    placed = nodes.join(together.select("node", F.col("component").alias("cluster")), "node")
    blocks = placed.groupBy("cluster").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks"))
    dealt = placed.join(blocks, "cluster").withColumn("part", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # A node goes to the pairs (its block, j) for all j, as the smaller or the larger of the two.
    other = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = other.select("cluster", F.least("part", "j").alias("lo"), F.greatest("part", "j").alias("hi"), "part", "node", "c")
    return pairs.join(members, "node").groupBy("cluster", "lo", "hi").applyInArrow(_overlapping(threshold), "a long, b long, similarity double")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, words: int = SHINGLE_WORDS, block: int = BLOCK_SHINGLES) -> DataFrame:
    """For every row: id, class_id (least id of its class of near-duplicates), component (names the class alone), text_hash,
    links, partner_id, partner_hash and similarity.

    Classes are closed under nearness. links counts the verified near texts of other multisets that the row was compared
    with, and they hold each class together; partner is the nearest of them, by id and text hash, or the first row with
    the same multiset (similarity 1) if the row isn't that one itself. A wordless row has no component; it is a class of
    its own. A row without links or copies has no partner.
    """
    text = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("k"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    signed = written(text.withColumn("h", _text_hash("text")).mapInArrow(_sign(bands, rows, words), "k long, h long, n long, d1 long, d2 long, bands array<long>"), "signatures")
    full = signed.filter("n > 0")
    # Each multiset is a node, told by the least row that has it (id and text hash).
    folded = full.groupBy("d1", "d2", "n").agg(F.min(F.struct("k", "h")).alias("first")).select("d1", "d2", "n", F.col("first.k").alias("first"), F.col("first.h").alias("h"))
    # Of multisets whose rows share an id, the first is named by the id, the others by their digests.
    ids = folded.groupBy("first").agg(F.count(F.lit(1)).alias("uses"), F.min(F.struct("d1", "d2", "n")).alias("own")).filter("uses > 1").select(F.col("first").alias("_id"), "own")
    name = F.when(F.col("_id").isNull() | (F.struct("d1", "d2", "n") == F.col("own")), F.col("first")).otherwise(-F.shiftrightunsigned(F.xxhash64("d1", "d2"), 1))
    nodes = written(folded.join(ids, F.col("first") == F.col("_id"), "left").withColumn("node", name).drop("_id", "own"), "nodes")

    digest = ["d1", "d2", "n"]
    on = [full[c] == nodes[c] for c in digest] + [full["k"] == nodes["first"], full["h"] == nodes["h"]]
    chosen = full.join(nodes, on).select("node", full["n"], "bands").dropDuplicates(["node"])
    buckets = chosen.select("node", "n", F.explode("bands").alias("bucket"))
    sizes_of = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = written(buckets.join(sizes_of, "bucket"), "buckets")
    # The head of a bucket is the node with most partners over all its buckets: an original rather than a copy.
    partners = shared.groupBy(F.col("node").alias("_node")).agg(F.sum("size").alias("partners"))
    heads = shared.join(partners, F.col("node") == F.col("_node")).groupBy(F.col("bucket").alias("_bucket")).agg(F.max(F.struct("partners", (-F.col("node")).alias("node"))).alias("h"))
    crowded = written(shared.join(heads.select("_bucket", (-F.col("h.node")).alias("head")), F.col("bucket") == F.col("_bucket")).drop("_bucket"), "buckets")

    ends = crowded.filter("node <> head").select(F.explode(F.array("node", "head")).alias("node")).distinct()
    wanted = ends.join(nodes, "node").select("node", F.col("first").alias("k"), "h")
    # Every member of a crowded bucket may be compared later, so their multisets are kept. Copies of one text under one id count once.
    texts = text.withColumn("h", _text_hash("text")).join(wanted, ["k", "h"]).select("node", "text").mapInArrow(_members(words), "node long, members array<long>")
    members = written(texts.dropDuplicates(["node"]), "members")

    def fits(a: str, b: str) -> F.Column:
        """Sizes alone allow the threshold."""
        return F.least(a, b) >= threshold * F.greatest(a, b) - F.lit(1e-9)

    sizes = nodes.select(F.col("node").alias("head"), F.col("n").alias("head_n"))
    salt = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / HEAD_PARTNERS)).cast("int")
    first = crowded.filter("node <> head").groupBy("head", "node", "n").agg(F.max("size").alias("size")).join(sizes, "head").filter(fits("n", "head_n"))
    links = written(_near(first.select(F.col("head").alias("a"), F.col("node").alias("b"), salt.alias("salt")), members, threshold), "near")

    # Buckets whose other nodes are still in different components: what the first comparisons can't tell.
    found = components(links)
    open_ = crowded.filter("node <> head AND size > 2").join(found, "node", "left").select("bucket", "node", "n", F.coalesce("component", "node").alias("c"))
    torn = open_.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi")
    undecided = written(open_.join(torn.select("bucket"), "bucket"), "undecided")
    drop(shared, crowded)
    if not undecided.isEmpty():
        more = _compare_undecided(undecided, members, threshold, block)
        links = written(links.unionByName(more), "near")
        found = components(links)
    drop(undecided, members)
    # Two heads may have been compared from both sides, and a pair in several blocks' clusters: each counts once.
    met = links.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other"), "similarity"), F.struct(F.col("b").alias("node"), F.col("a").alias("other"), "similarity"))).alias("e")).select("e.*").dropDuplicates(["node", "other"])
    nearest = met.groupBy("node").agg(F.count(F.lit(1)).alias("links"), F.max(F.struct("similarity", (-F.col("other")).alias("other"))).alias("best")).select("node", "links", (-F.col("best.other")).alias("_other"), "best.similarity")
    who = nodes.select(F.col("node").alias("_other"), F.col("first").alias("partner"), F.col("h").alias("partner_h"))
    named = nodes.join(found, "node", "left").withColumn("c", F.coalesce("component", "node")).join(nearest.join(who, "_other"), "node", "left")
    least = named.groupBy("c").agg(F.min("first").alias("class"))
    classes = named.join(least, "c").select("d1", "d2", "n", "class", "c", F.coalesce("links", F.lit(0)).alias("links"), "partner", "partner_h", "similarity", "first", F.col("h").alias("first_h"))
    copy = (F.col("k") != F.col("first")) | (F.col("h") != F.col("first_h"))
    own = lambda c, same: F.when(copy, same).otherwise(F.col(c)).alias(c)
    out = signed.join(classes, ["d1", "d2", "n"], "left").select("k", F.coalesce("class", "k").alias("class"), "c", "h", F.coalesce("links", F.lit(0)).alias("links"), own("partner", F.col("first")), own("partner_h", F.col("first_h")), own("similarity", F.lit(1.0)))
    given = lambda c: F.when(F.col(c) != _NULL_ID, F.col(c))
    return out.select(given("k").alias(id_col), given("class").alias("class_id"), F.col("c").alias("component"), F.col("h").alias("text_hash"), "links", given("partner").alias("partner_id"), F.col("partner_h").alias("partner_hash"), "similarity")


def _text_hash(text_col: str) -> F.Column:
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def keep_first(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each class, of its least id and then text hash, and every wordless row; columns are kept as they are."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("k")
    heads = classes.filter("component IS NOT NULL").groupBy("component").agg(F.min(F.struct(key, F.col("text_hash").alias("h"))).alias("head")).select("head.*")
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), key, _text_hash(text_col).alias("h"), text.rlike(r"[^\x09-\x0D\x20]").alias("wordy"))
    order = Window.partitionBy("k", "h").orderBy(F.lit(0))  # what is left are copies of one text under one id
    once = rows.filter("wordy").join(heads, ["k", "h"]).withColumn("nth", F.row_number().over(order)).filter("nth = 1")
    return once.select("row.*").unionByName(rows.filter("NOT wordy").select("row.*"))
