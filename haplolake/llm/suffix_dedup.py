"""Removal of repeated substrings by suffix arrays: later copies go, the first one stays.

A byte is removed if a string of ``min_bytes`` bytes that covers it also starts earlier: in a document
with a smaller id, or before it in the same document. Strings are judged on the input; a match may
overlap itself; matches never cross documents.

One suffix array over a whole corpus does not fit a task, so equal strings are brought together first.

1. Every string of ``min_bytes`` bytes has an anchor, its k-gram of least hash (the first on a tie).
   Equal strings have equal anchors at equal places. Tasks list the anchors of their documents, about
   one in 35 bytes. Anchors that occur once in the whole corpus can't lie in a repeated string.
   A task sends a k-gram to where it is counted at most twice, however often it meets it, so that a
   count gets no more rows than there are tasks; further places are known to be repeated and stay spread.
2. Documents with repeated anchors are written once, with their anchors' positions; all others are done.
   A document is told by a hash of its id and text here, so texts that share an id are kept apart.
3. Around every repeated anchor the context that such strings can span is cut out, and contexts are
   shuffled by the anchor. Equal contexts are folded to the earliest, in the task that cuts them and
   again after the shuffle: a context with an earlier equal is removed whole.
4. The different contexts of an anchor go into one suffix array, over their whole length. Along suffix
   order, the previous and the next smaller position (document, then start) of a suffix are the earlier
   ones that share most with it, and the longer of the two common prefixes is its longest previous
   factor. Where that is min_bytes or more, as many bytes from there have an earlier copy.
5. Removed ranges come together per document, are merged and cut out.

Defined cases: a null text is the empty one. A null id sorts before all others. Rows that share an id
are ordered by a hash of their text; rows that repeat id and text count as one document, and each gets
the same result. Texts of any length are processed whole. An empty table gives an empty result. Other
columns are not carried by remove_repeats (join the result by id), and kept in one struct by cut_texts,
so no name can clash.

What meets in one task is the set of different surroundings of one k-gram, in batches of whole groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haplolake.llm.ragged import offsets_of, ragged_index, slices, utf8_bytes
from haplolake.llm.storage import written

SLICE_BYTES = 2_000_000
_CHUNK = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_NULL_ID = -(1 << 63)


def anchor_length(min_bytes: int) -> int:
    """Bytes of an anchor: long enough to be rare by chance, short enough that anchors are sparse."""
    if min_bytes < 16:
        raise ValueError("min_bytes must be 16 or more")
    return max(8, min_bytes * 8 // 25)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of data[i : i + k] for every i with that many bytes."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), out=total[1:])
    return _mixed((total[k:] - total[:n]) * _powers(_BASE_INVERSE, n))


def anchors(data: np.ndarray, offsets: np.ndarray, min_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``data`` and hashes of the anchors of all strings that lie within one text."""
    k = anchor_length(min_bytes)
    width = min_bytes - k + 1
    found, hashes = [], []
    for at in range(0, max(0, len(data) - min_bytes + 1), _CHUNK):
        h = gram_hashes(data[at : at + _CHUNK + min_bytes - 1], k)
        least = (h >> np.uint64(20) << np.uint64(20)) | np.arange(len(h), dtype=np.uint64)
        span = 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if width > span:
            least = np.minimum(least[: span - width], least[width - span :])
        start = np.arange(at, at + len(least))
        inside = start + min_bytes <= offsets[np.searchsorted(offsets, start, side="right")]
        pos = (least[inside] & np.uint64((1 << 20) - 1)).astype(np.int64)
        pos = np.unique(pos[np.flatnonzero(np.diff(pos, prepend=-1))])
        found.append(pos + at)
        hashes.append(h[pos])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    pos, first = np.unique(np.concatenate(found), return_index=True)
    return pos, np.concatenate(hashes)[first]


class Met:
    """How often k-grams were met in a task: not at all, once, or more often."""

    def __init__(self, most: int = 1 << 22) -> None:
        self.known, self.often, self.most = np.zeros(0, np.uint64), np.zeros(0, bool), most

    def times(self, grams: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Times (up to 2) that sorted distinct grams were met before; they are then met ``count`` times more."""
        if len(self.known) > self.most:  # forget, so that memory is bounded: a gram is then counted anew
            self.known, self.often = self.known[:0], self.often[:0]
        at = np.minimum(np.searchsorted(self.known, grams), max(0, len(self.known) - 1))
        old = self.known[at] == grams if len(self.known) else np.zeros(len(grams), bool)
        before = np.where(old, 1, 0)
        before[old] += self.often[at[old]]
        self.often[at[old]] = True
        new = grams[~old]
        place = np.searchsorted(self.known, new)
        self.known, self.often = np.insert(self.known, place, new), np.insert(self.often, place, count[~old] > 1)
        return before


def _list_anchors(min_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = Met()
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                data, offs = utf8_bytes(part.column("text"))
                pos, h = anchors(data, offs, min_bytes)
                doc = np.searchsorted(offs, pos, side="right") - 1
                key = part.column("r").to_numpy()[doc]
                grams, first, back, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                before = met.times(grams, count)
                # The first of a slice goes to its count, unless two went there already; the others need none.
                counted = (first[back] == np.arange(len(h))) & (before[back] < 2)
                spread = _mixed(key.astype(np.uint64) * _BASE + pos.astype(np.uint64))
                known = (count + before)[back] > 1
                yield pa.RecordBatch.from_arrays([pa.array(np.where(counted, h, spread).view(np.int64)), pa.array(key), pa.array((pos - offs[doc]).astype(np.int32)), pa.array(known)], names=["route", "r", "pos", "known"])

    return run


_CONTEXT = "route long, lead int, context binary, k long, t long, a int, b int"


def _merge(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of the ranges [a, b) of each document that overlap or touch."""
    if not len(doc):
        return doc, a, b
    order = np.lexsort((a, doc))
    doc, a, b = doc[order], a[order].astype(np.int64), b[order].astype(np.int64)
    reach = np.maximum.accumulate(b + doc * (1 << 40)) - doc * (1 << 40)  # largest end so far in the same document
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (a[1:] > reach[:-1])
    heads = np.flatnonzero(new)
    return doc[heads], a[heads], reach[np.append(heads[1:], len(doc)) - 1]


def _documents(k: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each row's document in id order, and a row of each document."""
    order = np.lexsort((t, k))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (k[order][1:] != k[order][:-1]) | (t[order][1:] != t[order][:-1])
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank, order[new]


def _firsts(group: np.ndarray, lead: np.ndarray, context: pa.Array, order_key: np.ndarray) -> np.ndarray:
    """For every context, the row of the earliest equal one of its group."""
    same = context.dictionary_encode().indices.to_numpy().astype(np.int64)
    order = np.lexsort((order_key, lead, same, group))
    g, s, x = group[order], same[order], lead[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (g[1:] != g[:-1]) | (s[1:] != s[:-1]) | (x[1:] != x[:-1])
    first = np.empty(len(order), dtype=np.int64)
    first[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    return first


def _batch(route, lead, context, k, t, a, b) -> pa.RecordBatch:  # noqa: ANN001
    return pa.RecordBatch.from_arrays([pa.array(route.view(np.int64)), pa.array(lead.astype(np.int32)), context, pa.array(k), pa.array(t), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=["route", "lead", "context", "k", "t", "a", "b"])


def _cut_contexts(min_bytes: int):
    gram = anchor_length(min_bytes)
    side = min_bytes - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES // 4):
                data, offs = utf8_bytes(part.column("text"))
                lists = part.column("pos")
                n = np.diff(lists.offsets.to_numpy())
                doc = np.repeat(np.arange(len(n)), n)
                pos = lists.flatten().to_numpy().astype(np.int64) + offs[:-1][doc]
                fits = pos + gram <= offs[1:][doc]  # should hashes of two rows collide, places may lie beyond a text
                doc, pos = doc[fits], pos[fits]
                a, b = np.maximum(offs[:-1][doc], pos - side), np.minimum(offs[1:][doc], pos + gram + side)
                long = b - a >= min_bytes
                doc, pos, a, b = doc[long], pos[long], a[long], b[long]
                if not len(pos):
                    continue
                h = _hash_at(data, pos, gram)
                at = offsets_of(b - a)
                context = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(pos), [None, pa.py_buffer(at), pa.py_buffer(data[ragged_index(a, b - a)])]).cast(pa.binary())
                k, t = part.column("k").to_numpy()[doc], part.column("t").to_numpy()[doc]
                rank, sample = _documents(k, t)
                first = _firsts(h.view(np.int64), pos - a, context, rank * (1 << 40) + pos - offs[doc])
                own = (first == np.arange(len(first))) | ((rank[first] == rank) & (pos - offs[doc] == (pos - offs[doc])[first]))
                own_once = first == np.arange(len(first))
                keep = np.flatnonzero(own_once)
                a, b, pos = a - offs[doc], b - offs[doc], pos - offs[doc]
                yield _batch(h[keep], (pos - a)[keep], context.take(pa.array(keep)), k[keep], t[keep], a[keep], b[keep])
                d, x, y = _merge(rank[~own], a[~own], b[~own])
                if len(d):
                    dk, dt = k[sample][d], t[sample][d]
                    yield _batch(_mixed(dk.astype(np.uint64) * _BASE + x.astype(np.uint64)), np.full(len(d), -1), pa.nulls(len(d), pa.binary()), dk, dt, x, y)

    return run


def _hash_at(data: np.ndarray, pos: np.ndarray, k: int) -> np.ndarray:
    """gram_hashes at some positions, over chunks."""
    out = np.zeros(len(pos), dtype=np.uint64)
    order = np.argsort(pos, kind="stable")
    cuts = np.searchsorted(pos[order], np.arange(0, len(data) + _CHUNK, _CHUNK))
    for i, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        if hi > lo:
            rows = order[lo:hi]
            out[rows] = gram_hashes(data[i * _CHUNK : (i + 1) * _CHUNK + k - 1], k)[pos[rows] - i * _CHUNK]
    return out


def _words(data: np.ndarray) -> np.ndarray:
    """Big-endian words of the 8 bytes from every position on; zeros follow the last byte."""
    word = np.zeros(len(data) + 8, dtype=np.uint64)
    word[: len(data)] = data
    for half in (1, 2, 4):
        shifted = np.zeros_like(word)
        shifted[:-half] = word[half:]
        word = (word << np.uint64(8 * half)) | shifted
    return word[: len(data)]


class SuffixArray:
    """Suffixes of several texts, joined in ``data``, each up to the end of its own text.

    room[i]: bytes from i to that end. Ranks by prefixes of 8, 24, 72, ... bytes come from three ranks of
    the length before; a suffix that ends within a prefix comes before those that go on.
    """

    def __init__(self, data: np.ndarray, room: np.ndarray) -> None:
        self.room, self.word = room, _words(data)
        end = np.minimum(room, 8)
        # Bytes beyond the end of a text are taken out of the word; its length tells it from zero bytes.
        self.word &= ~np.uint64(0) << (np.uint64(8) * (8 - end).astype(np.uint64))
        self.levels = [(8, self._ranked((self.word, end)))]
        longest = int(room.max(initial=0))
        while self.levels[-1][0] < longest:
            length, rank = self.levels[-1]
            self.levels.append((3 * length, self._ranked((rank, self._later(rank, length), self._later(rank, 2 * length)))))
        self.rank = self.levels[-1][1]

    def _later(self, rank: np.ndarray, step: int) -> np.ndarray:
        """Rank (from 1) of the suffix that starts ``step`` further on, 0 beyond the end."""
        out = np.zeros(len(rank), dtype=np.int64)
        at = np.flatnonzero(self.room > step)
        out[at] = rank[at + step] + 1
        return out

    @staticmethod
    def _ranked(keys: tuple[np.ndarray, ...]) -> np.ndarray:
        """Dense rank by the keys, the first being the most significant."""
        if len(keys) == 3 and len(keys[0]) < 1 << 21:
            return np.unique((keys[0] << 42) | (keys[1] << 21) | keys[2], return_inverse=True)[1]
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(order), dtype=bool)
        for k in keys:
            new[1:] |= k[order][1:] != k[order][:-1]
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.cumsum(new)
        return rank

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at a[i] and b[i]."""
        out = np.zeros(len(a), dtype=np.int64)
        todo = np.arange(len(a))
        most = np.minimum(self.room[a], self.room[b])
        for length, rank in self.levels[::-1]:
            for _ in range(2):
                todo = todo[most[todo] - out[todo] >= length]
                x, y = a[todo] + out[todo], b[todo] + out[todo]
                out[todo[rank[x] == rank[y]]] += length
            todo = np.arange(len(a))
        todo = np.flatnonzero(out < most)
        differ = self.word[a[todo] + out[todo]] ^ self.word[b[todo] + out[todo]]
        same = np.zeros(len(todo), dtype=np.int64)
        for n in range(1, 8):
            same += differ >> np.uint64(64 - 8 * n) == 0
        out[todo] = np.minimum(out[todo] + same, most[todo])
        return out


def smaller_neighbours(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place, the nearest places before and after it that hold a smaller key; -1 where there is none."""

    def before(x: np.ndarray) -> np.ndarray:
        to = np.arange(len(x)) - 1
        todo = np.flatnonzero(to >= 0)
        while len(todo := todo[x[to[todo]] >= x[todo]]):
            to[todo] = to[to[todo]]  # all between hold keys that are no smaller
            todo = todo[to[todo] >= 0]
        return to

    after = before(key[::-1])[::-1]
    return before(key), np.where(after >= 0, len(key) - 1 - after, -1)


def longest_previous_factors(suffixes: SuffixArray, at: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For the suffixes that start at ``at``, the greatest length shared with one of a smaller key (its position).

    In suffix order that one is the previous or the next with a smaller key: all between have larger ones.
    """
    order = np.lexsort((key, suffixes.rank[at]))
    start = at[order]
    out = np.zeros(len(at), dtype=np.int64)
    for near in smaller_neighbours(key[order]):
        some = np.flatnonzero(near >= 0)
        out[order[some]] = np.maximum(out[order[some]], suffixes.common(start[some], start[near[some]]))
    return out


def _repeated_in(table: pa.Table, min_bytes: int) -> tuple[np.ndarray, ...]:
    """Ranges (k, t, a, b) to remove, from whole groups of contexts."""
    route, lead, k, t, a, b = (table.column(c).to_numpy().astype(np.int64) for c in ("route", "lead", "k", "t", "a", "b"))
    rank, sample = _documents(k, t)
    given = lead < 0
    rows = np.flatnonzero(~given)
    context = table.column("context").take(pa.array(rows)).combine_chunks()
    doc, pos = rank[rows], (a + lead)[rows]
    first = _firsts(route[rows], lead[rows], context, doc * (1 << 40) + pos)
    copy = (doc[first] != doc) | (pos[first] != pos)
    out = [(rank[given], a[given], b[given]), (doc[copy], a[rows][copy], b[rows][copy])]
    single = first == np.arange(len(first))
    _, group, size = np.unique(route[rows][single], return_inverse=True, return_counts=True)
    chosen = np.flatnonzero(single)[size[group] > 1]
    if len(chosen):
        picked = context.take(pa.array(chosen)).cast(pa.large_binary())
        n = (b - a)[rows][chosen]
        data = np.frombuffer(picked.buffers()[2], dtype=np.uint8)[: n.sum()]
        at = offsets_of(n)
        owner = np.repeat(np.arange(len(n)), n)
        room = at[1:][owner] - np.arange(len(data))
        suffix = np.flatnonzero(room >= min_bytes)
        start = a[rows][chosen][owner[suffix]] + suffix - at[:-1][owner[suffix]]
        key = doc[chosen][owner[suffix]] * (1 << 40) + start
        factor = longest_previous_factors(SuffixArray(data, room), suffix, key)
        hit = factor >= min_bytes
        out.append((key[hit] >> 40, start[hit], start[hit] + factor[hit]))
    d, x, y = _merge(*(np.concatenate(c) for c in zip(*out, strict=True)))
    return k[sample][d], t[sample][d], x, y


def _find_repeats(min_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(parts: list[pa.Table]) -> Iterator[pa.RecordBatch]:
            if parts and sum(len(p) for p in parts):
                k, t, a, b = _repeated_in(pa.concat_tables(parts), min_bytes)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(t), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=["k", "t", "a", "b"])

        held: list[pa.Table] = []
        for batch in batches:
            if not len(batch):
                continue
            # Rows come sorted by route; the last route may go on in the next batch.
            route = batch.column("route").to_numpy()
            cut = int(np.searchsorted(route, route[-1]))
            table = pa.Table.from_batches([batch])
            if cut:
                yield from done([*held, table.slice(0, cut)])
                held = []
            elif held and held[-1].column("route")[0].as_py() != route[0]:
                yield from done(held)
                held = []
            held.append(table.slice(cut))
        yield from done(held)

    return run


def _without(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """Byte lengths; remaining bytes with their offsets; merged ranges (row, a, b) that went."""
    data, offs = utf8_bytes(part.column("text"))
    lists = part.column("spans").cast(pa.large_list(part.column("spans").type.value_type))
    n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    doc, a, b = _merge(np.repeat(np.arange(len(n)), n), flat.field("a").to_numpy(), flat.field("b").to_numpy())
    mark = np.zeros(len(data) + 1, dtype=np.int8)
    np.add.at(mark, a + offs[doc], 1)
    np.add.at(mark, b + offs[doc], -1)
    gone = np.cumsum(mark[:-1]) > 0
    left = np.concatenate([[0], np.cumsum(~gone)])[offs].astype(np.int64)
    return np.diff(offs), data[~gone], left, (doc, a, b)


def _cut_out():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                size, data, left, (doc, a, b) = _without(part)
                count = np.bincount(doc, minlength=len(size))
                spans = pa.ListArray.from_arrays(pa.array(offsets_of(count), pa.int32()), pa.StructArray.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"]))
                kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(left), pa.py_buffer(data)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(size, pa.int64()), pa.array(size - np.diff(left), pa.int64()), pa.array(count, pa.int64()), spans, kept], names=["id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    return run


def _cut_strings():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                _, data, left, _ = _without(part)
                raw = data.tobytes()
                texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(left[:-1].tolist(), left[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), part.column("row")], names=["text", "row"])

    return run


_SPANS = "array<struct<a:long,b:long>>"


def _judged(docs: DataFrame, id_col: str, text_col: str, min_bytes: int, carried: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows without repeated anchors; and the others with the ranges to remove. Both have id, text and the carried columns in ``row``."""
    text: Column = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    row = F.struct(*(docs[c] for c in carried)) if carried else F.lit(None).cast("struct<x:int>")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("k"), text.alias("text"), row.alias("row"))
    rows = rows.withColumn("t", F.xxhash64("text")).withColumn("r", F.xxhash64("k", "t"))
    listed = rows.select("r", "text").mapInArrow(_list_anchors(min_bytes), "route long, r long, pos int, known boolean")
    counted = listed.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("route"))).filter("known OR n > 1")
    found = counted.groupBy("r").agg(F.collect_set("pos").alias("pos"))  # a set: copies of a row list the same places
    placed = written(rows.join(found, "r", "left").select("id", "k", "t", "text", "pos", "row"), "suffix-dedup")

    suspects = placed.filter("pos IS NOT NULL")
    contexts = suspects.select("k", "t", "text", "pos").mapInArrow(_cut_contexts(min_bytes), _CONTEXT)
    grouped = contexts.repartition("route").sortWithinPartitions("route")
    ranges = grouped.mapInArrow(_find_repeats(min_bytes), "k long, t long, a int, b int")
    spans = ranges.groupBy("k", "t").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    return placed.filter("pos IS NULL").select("id", "text", "row"), suspects.join(spans, ["k", "t"], "left").select("id", "text", "spans", "row")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = 100) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, spans (array of removed byte ranges [a, b)) and kept (remaining bytes) of every row."""
    clean, suspects = _judged(docs, id_col, text_col, min_bytes, [])
    schema = f"id long, n_bytes long, n_removed long, n_spans long, spans {_SPANS}, kept binary"
    cut = suspects.select("id", "text", "spans").mapInArrow(_cut_out(), schema)
    zero = F.lit(0).cast("long")
    whole = clean.select("id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.array().cast(_SPANS).alias("spans"), F.col("text").cast("binary").alias("kept"))
    return whole.unionByName(cut).withColumnRenamed("id", id_col)


def cut_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = 100) -> DataFrame:
    """docs with all columns, the repeats cut out of the text column. Where a cut splits a character, U+FFFD stands for its rest."""
    carried = [c for c in docs.columns if c != text_col]
    clean, suspects = _judged(docs, id_col, text_col, min_bytes, carried)
    schema = suspects.select(F.lit("").alias("text"), "row").schema
    cut = suspects.select("text", "spans", "row").mapInArrow(_cut_strings(), schema)
    both = clean.select("text", "row").unionByName(cut)
    return both.select(*(F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))
