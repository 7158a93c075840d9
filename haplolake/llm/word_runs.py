"""Periodic runs of words: maximal repetitions of every document, by Lyndon roots from Baier's grouping.

The first phase of Baier's suffix sorter groups positions by their longest Lyndon prefix, so that it gives the
Lyndon array at once. It is run under the order of word numbers and under its reverse: every run has a root
that is the longest Lyndon word at its place under one of them. Each root is extended by longest common
extensions to both sides; what is at least two periods long is a run, and the root's length its smallest
period. Roots inside a run that was found with the same period are not extended again.

Every word of a run of at least m words lies in some m // 2 words in a row that occur twice in the document, so
stretches without such words hold no run, bound none, and are left out first; that drops no run.

Defined cases: a null text has no words; texts are never cut; runs don't cross documents; null and repeated ids
and repeated rows give one row each; an empty table gives none; further columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haplolake.llm.ragged import offsets_of, slices

#: Fixed value: what counts as a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Shortest run, in words.
MIN_LENGTH = 12
#: Text bytes that a task handles at once.
SLICE_BYTES = 4_000_000
#: Extensions up to this many words are found for all roots together.
NEAR = 48


def lyndon_array(order: list[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at each position, by Baier's grouping from the highest group down."""
    n = len(order)
    place = sorted(range(n), key=order.__getitem__)
    at, group, size = [0] * n, [0] * n, [0] * n
    start = 0
    for k, i in enumerate(place):
        if k and order[i] != order[place[k - 1]]:
            start = k
        at[i], group[i] = k, start
        size[start] += 1
    length, before = [1] * n, [-1] * n
    end = n
    while end:
        start = group[place[end - 1]]
        members = sorted(place[start:end])
        unit = length[members[0]]
        followers: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and group[p] >= start:  # everything between p and before[p] is in p's group or a higher one
                p = before[p]
            before[i] = p
            if p >= 0:
                followers[p] = followers.get(p, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for p, times in followers.items():
            moved.setdefault((-times, group[p]), []).append(p)
        for times, old in sorted(moved):  # those with more followers end up in higher groups
            chosen = moved[times, old]
            size[old] -= len(chosen)
            new = old + size[old]
            to = new + len(chosen)
            for p in chosen:
                to -= 1
                other, hole = place[to], at[p]
                place[to], place[hole] = p, other
                at[p], at[other] = to, hole
                group[p] = new
                length[p] -= times * unit
            size[new] = len(chosen)
        end = start
    return length


def _repeated(words: np.ndarray, part: np.ndarray, span: int) -> np.ndarray:
    """Which words lie in some ``span`` words in a row that the same part holds twice. Equal hashes may keep too much, never too little."""
    n = len(words) - span + 1
    if n < 2:
        return np.zeros(len(words), dtype=bool)
    h = part[:n].astype(np.uint64)
    for k in range(span):
        h = (h ^ (h >> np.uint64(29)) ^ words[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    inside = np.flatnonzero(part[:n] == part[span - 1 :])
    order = inside[np.argsort(h[inside], kind="stable")]
    same = np.zeros(len(order) + 1, dtype=bool)
    same[1:-1] = h[order[1:]] == h[order[:-1]]
    twice = order[same[1:] | same[:-1]]
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + span, -1)
    return np.cumsum(edge[:-1]) > 0


def _common(words: np.ndarray, a: np.ndarray, b: np.ndarray, room: np.ndarray, step: int) -> np.ndarray:
    """Number of equal words from a and from b on, in steps of +1 or -1, up to room."""
    out = np.zeros(len(a), dtype=np.int64)
    left = np.flatnonzero(room > 0)
    while len(left):
        done = out[left] * step
        left = left[words[a[left] + done] == words[b[left] + done]]
        out[left] += 1
        left = left[out[left] < room[left]]
    return out


def _far(words: np.ndarray, a: int, b: int, room: int, step: int) -> int:
    """As _common for one pair, in ever longer blocks."""
    got, block = 0, 64
    while got < room:
        m = min(block, room - got)
        x, y = a + step * got, b + step * got
        if step > 0:
            differ = words[x : x + m] != words[y : y + m]
        else:
            differ = words[x - m + 1 : x + 1][::-1] != words[y - m + 1 : y + 1][::-1]
        first = int(differ.argmax())
        if differ[first]:
            return got + first
        got += m
        block *= 2
    return got


def find_runs(words: np.ndarray, doc: np.ndarray, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of every run of at least min_length words, by start, then period. doc numbers each word's document, ascending."""
    kept, part = np.arange(len(words)), doc
    span = max(1, min_length // 2)
    while len(kept):
        good = _repeated(words[kept], part, span)
        if good.all():
            break
        kept, part = kept[good], part[good]
        part = np.cumsum(np.append(True, (np.diff(kept) > 1) | (part[1:] != part[:-1]))) if len(kept) else part
    if not len(kept):
        return (np.zeros(0, dtype=np.int64),) * 3
    heads = np.flatnonzero(np.append(True, (np.diff(kept) > 1) | (part[1:] != part[:-1])))
    lo = kept[heads]
    n = np.diff(np.append(heads, len(kept)))
    root, period, low, high = [], [], [], []
    for s, m in zip(lo.tolist(), n.tolist(), strict=True):
        local = np.unique(words[s : s + m], return_inverse=True)[1]
        for order in (local, -local):
            root.append(np.arange(s, s + m))
            period.append(np.array(lyndon_array(order.tolist()), dtype=np.int64))
            low.append(np.full(m, s))
            high.append(np.full(m, s + m))
    root, period, low, high = map(np.concatenate, (root, period, low, high))
    ok = high - low >= 2 * period
    root, period, low, high = root[ok], period[ok], low[ok], high[ok]
    after, before = high - root - period, root - low
    right = _common(words, root, root + period, np.minimum(after, NEAR), 1)
    left = _common(words, root - 1, root + period - 1, np.minimum(before, NEAR), -1)
    cut = ((right == NEAR) & (after > NEAR)) | ((left == NEAR) & (before > NEAR))
    found = np.column_stack([root - left, period + left + right, period])[~cut]
    found = found[found[:, 1] >= np.maximum(min_length, 2 * found[:, 2])]
    runs = set(map(tuple, found.tolist()))
    reach: dict[tuple[int, int], int] = {}  # end of the last stretch with this period
    which = np.flatnonzero(cut)
    for k in which[np.argsort(root[which], kind="stable")].tolist():
        i, p = int(root[k]), int(period[k])
        key = (int(low[k]), p)
        if i + p <= reach.get(key, -1):
            continue
        right_k = _far(words, i, i + p, int(after[k]), 1)
        left_k = _far(words, i - 1, i + p - 1, int(before[k]), -1)
        reach[key] = i + p + right_k
        if p + left_k + right_k >= max(min_length, 2 * p):
            runs.add((i - left_k, p + left_k + right_k, p))
    table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 3)
    table = table[np.lexsort((table[:, 2], table[:, 0]))]
    return table[:, 0], table[:, 1], table[:, 2]


def word_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """One row per document: id, runs (array of start, length, period in words, by start, then period), collapsed (the
    text's words, joined by one blank, without those that a run holds after its first period)."""
    word = re.compile(WORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "_text", SLICE_BYTES):
                lists = [word.findall(t) if t else [] for t in rows.column("_text").to_pylist()]
                offs = offsets_of(np.array([len(x) for x in lists], dtype=np.int64))
                flat = pa.array([w for x in lists for w in x], pa.string())
                words = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
                doc = np.repeat(np.arange(len(lists)), np.diff(offs))
                start, length, period = find_runs(words, doc, min_length)
                owner = doc[start]
                of_doc = offsets_of(np.bincount(owner, minlength=len(lists)))
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(edge, start + period, 1)
                np.add.at(edge, start + length, -1)
                kept = np.cumsum(edge[:-1]) == 0
                left = offsets_of(np.add.reduceat(np.append(kept, 0), offs[:-1]) * (np.diff(offs) > 0)) if len(lists) else offs
                texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), flat.filter(pa.array(kept))), " ")
                fields = [pa.array(start - offs[owner]), pa.array(length), pa.array(period)]
                runs = pa.ListArray.from_arrays(pa.array(of_doc, pa.int32()), pa.StructArray.from_arrays(fields, names=["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays([rows.column("_id"), runs, texts], names=[id_col, "runs", "collapsed"])

    kept = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return kept.mapInArrow(run, f"`{id_col}` long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def longest_run(runs: str = "runs") -> F.Column:
    """The run of greatest length; ties go to the smallest start, then period. Null if there is none."""
    return F.array_max(F.transform(runs, lambda r: F.struct(r["length"], -r["start"], -r["period"], r["start"], r["period"])))
