"""Byte-level BPE: backtracking encoder and offset-table decoder.

The encoder takes, at each position of a word, the longest vocabulary entry that starts there (an
Aho-Corasick automaton over the reversed entries, run over the reversed word, reports it for every
position in one pass). An entry is accepted if the pair it forms with its predecessor is one that the
merges themselves would leave standing (pair-compatibility table); otherwise the next shorter entry is
tried, and if there is none the predecessor is taken back. Positions from which no accepted
continuation exists are marked, so every word takes linear time, and the only sequence in which all
neighbours are compatible is the one that the merges give. All words of a batch advance together in
numpy, each distinct word once. Decoding gathers bytes through an offset table.

Defined cases: a null text has no tokens; the empty text has no tokens; texts are never cut; a string
equal to a special token is that token, as in the public library; repeated texts repeat results.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haplolake.llm.ragged import offsets_of, ragged_index, ragged_take, slices

#: Fixed value of the vocabulary's byte-level pre-tokenizer.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A blank next to white space or at an end: such texts aren't cut at blanks before the pattern is applied.
_SPACE = "[\\t-\\r\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_LOOSE_BLANK = f" {_SPACE}|{_SPACE} |^ | $"
_NEVER = np.int64(1) << 40
#: Text bytes that a task encodes at once.
SLICE_BYTES = 6_000_000


def _byte_symbols() -> dict[str, int]:
    """Characters by which byte-level vocabularies write bytes: printable Latin-1 as is, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BpeCodec:
    """Encoder and decoder for a byte-level BPE vocabulary file (JSON)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = _byte_symbols()
        vocab = {bytes(chars[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        merges = [tuple(bytes(chars[c] for c in x) for x in (m.split(" ") if isinstance(m, str) else m)) for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        # Symbols in order of creation: single bytes, then one per merge.
        made = [bytes([b]) for b in range(256)] + [a + b for a, b in merges]
        symbol = {t: i for i, t in enumerate(made)}
        if len(symbol) != len(made):
            raise ValueError("a vocabulary entry that two merges produce isn't supported")
        self.ids = np.array([vocab[t] for t in made], dtype=np.int32)
        self.left = np.array([*range(256), *(symbol[a] for a, _ in merges)], dtype=np.int64)
        self.right = np.array([*range(256), *(symbol[b] for _, b in merges)], dtype=np.int64)
        self.size = np.array([len(t) for t in made], dtype=np.int64)
        self.shorter = np.array([next((symbol[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in symbol), -1) for t in made], dtype=np.int64)
        self._merge_table()
        self._automaton(made)
        self._memo_key = np.full(1 << 20, -1, dtype=np.int64)
        self._memo_ok = np.zeros(1 << 20, dtype=bool)
        texts = {i: t for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        n = max(texts) + 1
        self.decode_table = self._table([texts.get(i, b"") for i in range(n)])
        self.decimal_table = self._table([b"%d," % i for i in range(n)])
        self.words = regex.compile(WORD_PATTERN)
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    @staticmethod
    def _table(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(entries), dtype=np.uint8), offsets_of(np.array([len(e) for e in entries]))

    # ---- tables

    @staticmethod
    def _slot(key: np.ndarray, bits: int) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    def _merge_table(self) -> None:
        """Open-addressing table from a pair of symbols to the symbol that they merge into."""
        self._merge_bits = 18
        key = (self.left[256:] << 17) | self.right[256:]
        self._merge_key = np.full((1 << self._merge_bits) + 64, -1, dtype=np.int64)
        self._merge_to = np.zeros(len(self._merge_key), dtype=np.int64)
        self._probes, todo, slot = 0, np.arange(len(key)), self._slot(key, self._merge_bits)
        while len(todo):
            self._probes += 1
            free = self._merge_key[slot[todo]] < 0
            put = todo[free]
            self._merge_key[slot[put]] = key[put]
            self._merge_to[slot[put]] = put + 256
            todo = todo[self._merge_key[slot[todo]] != key[todo]]
            slot[todo] += 1

    def _merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 17) | b
        slot = self._slot(key, self._merge_bits)
        out = np.full(len(key), _NEVER, dtype=np.int64)
        todo = np.arange(len(key))
        for _ in range(self._probes):
            got = self._merge_key[slot[todo]]
            hit = got == key[todo]
            out[todo[hit]] = self._merge_to[slot[todo[hit]]]
            todo = todo[~hit & (got >= 0)]
            if not len(todo):
                break
            slot[todo] += 1
        return out

    def _automaton(self, made: list[bytes]) -> None:
        """Dense Aho-Corasick automaton over the reversed entries; best[state] is the longest entry that ends there."""
        children: list[dict[int, int]] = [{}]
        entry = [-1]
        for sym, t in enumerate(made):
            at = 0
            for c in reversed(t):
                nxt = children[at].get(c)
                if nxt is None:
                    nxt = children[at][c] = len(children)
                    children.append({})
                    entry.append(-1)
                at = nxt
            entry[at] = sym
        go = np.zeros((len(children), 256), dtype=np.int32)
        best = np.array(entry, dtype=np.int32)
        fail = [0] * len(children)
        level = [0]
        while level:
            nxt = []
            for at in level:
                row = go[at]
                if at:
                    row[:] = go[fail[at]]
                for c, to in children[at].items():
                    fail[to] = int(row[c]) if at else 0
                    row[c] = to
                    if best[to] < 0:
                        best[to] = best[fail[to]]
                    nxt.append(to)
            level = nxt
        self._go, self._best = go, best

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the merges leave the neighbours a, b standing; looked up in a table that fills itself."""
        key = (a << 17) | b
        slot = self._slot(key, 20)
        ok = self._memo_ok[slot]
        miss = np.flatnonzero(self._memo_key[slot] != key)
        if len(miss):
            new, back = np.unique(key[miss], return_inverse=True)
            fresh = self._judge(new >> 17, new & ((1 << 17) - 1))
            ok[miss] = fresh[back]
            at = self._slot(new, 20)
            self._memo_key[at] = new  # of two pairs in one slot, numpy keeps the last in both tables
            self._memo_ok[at] = fresh
        return ok

    def _judge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Undo, from the last one back, the merges that made a's right edge and b's left edge; no merge across may come first."""
        ok = np.ones(len(a), dtype=bool)
        todo, limit = np.arange(len(a)), np.full(len(a), _NEVER, dtype=np.int64)
        a, b = a.copy(), b.copy()
        while len(todo):
            bad = self._merged(a, b) < limit
            ok[todo[bad]] = False
            go_on = ~bad & (np.maximum(a, b) >= 256)
            todo, a, b = todo[go_on], a[go_on], b[go_on]
            late = a > b
            limit = np.where(late, a, b + 1)
            a, b = np.where(late, self.right[a], a), np.where(late, b, self.left[b])
        return ok

    # ---- encoding

    def encode_words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of every word of a ragged byte column, as a ragged column."""
        n = offsets[1:] - offsets[:-1]
        longest = np.zeros(len(data), dtype=np.int64)
        order = np.argsort(-n, kind="stable")
        ends, state = offsets[1:][order], np.zeros(len(n), dtype=np.int64)
        alive = np.searchsorted(-n[order], -np.arange(1, (n.max() if len(n) else 0) + 1), side="right")
        for step, m in enumerate(alive):
            at = ends[:m] - 1 - step
            state[:m] = self._go[state[:m], data[at]]
            longest[at] = self._best[state[:m]]
        # One slot more than bytes for each word, for the position at its end.
        base = offsets[:-1] + np.arange(len(n))
        token = np.zeros(len(data) + len(n), dtype=np.int64)
        came = np.zeros(len(data) + len(n), dtype=np.int64)
        dead = np.zeros(len(data) + len(n), dtype=bool)
        word = np.flatnonzero(n > 0)
        pos, tok = base[word].copy(), longest[offsets[:-1][word]]
        while len(word):
            end = pos + self.size[tok]
            good = ~dead[end]
            paired = np.flatnonzero(good & (pos > base[word]))
            if len(paired):
                good[paired] = self.compatible(token[came[pos[paired]]], tok[paired])
            g = np.flatnonzero(good)
            token[pos[g]] = tok[g]
            came[end[g]] = pos[g]
            pos[g] = end[g]
            over = np.zeros(len(word), dtype=bool)
            over[g] = pos[g] == base[word[g]] + n[word[g]]
            more = g[~over[g]]
            tok[more] = longest[pos[more] - word[more]]
            f = np.flatnonzero(~good)
            less = self.shorter[tok[f]]
            down, back = f[less >= 0], f[less < 0]
            tok[down] = less[less >= 0]
            dead[pos[back]] = True
            pos[back] = came[pos[back]]
            tok[back] = token[pos[back]]
            left = ~over
            word, pos, tok = word[left], pos[left], tok[left]
        starts = np.zeros(len(token), dtype=bool)
        at = base[n > 0]
        stop = (base + n)[n > 0]
        while len(at):
            starts[at] = True
            at = at + self.size[token[at]]
            on = at < stop
            at, stop = at[on], stop[on]
        seen = np.zeros(len(token) + 1, dtype=np.int64)
        np.cumsum(starts, out=seen[1:])
        return self.ids[token[starts]], offsets_of(seen[base + n] - seen[base])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of every text, as a ragged column; special tokens are recognised."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        if self._special is None:
            return self._encode_plain(texts)
        holds = pc.match_substring_regex(texts, "|".join(map(regex.escape, self.special)))
        if not pc.any(holds).as_py():
            return self._encode_plain(texts)
        parts = [self._special.split(t) if h else [t] for t, h in zip(texts.to_pylist(), holds.to_pylist(), strict=True)]
        flat = [x for p in parts for x in p]
        marked = np.array([i % 2 for p in parts for i in range(len(p))], dtype=bool)
        ids, offs = self._encode_plain(pa.array(["" if m else x for x, m in zip(flat, marked, strict=True)], pa.large_string()))
        n = offs[1:] - offs[:-1]
        n = np.where(marked, 1, n)
        out = np.zeros(n.sum(), dtype=np.int32)
        to = offsets_of(n)
        own = np.repeat(marked, n)
        out[~own] = ids
        out[own] = [self.special[x] for x, m in zip(flat, marked, strict=True) if m]
        return out, to[offsets_of(np.array([len(p) for p in parts]))]

    def _encode_plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        # A blank between two other characters always begins a word, so texts are first cut there and each
        # distinct piece is handled once.
        loose = pc.match_substring_regex(texts, _LOOSE_BLANK).to_numpy(zero_copy_only=False)
        whole = np.flatnonzero(loose)
        lists = pc.split_pattern(pc.if_else(pa.array(loose), "", texts), " ")
        heads = lists.offsets.to_numpy()
        flat = lists.flatten()
        first = np.zeros(len(flat), dtype=bool)
        first[heads[:-1] - heads[0]] = True
        rest = flat.filter(pa.array(~first)).dictionary_encode()
        starts = flat.filter(pa.array(first)).dictionary_encode()
        strings = lambda column: column.to_numpy(zero_copy_only=False).tolist()
        pieces = [f" {x}" for x in strings(rest.dictionary)] + strings(starts.dictionary) + strings(texts.take(pa.array(whole)))
        n_rest, n_starts = len(rest.dictionary), len(starts.dictionary)
        code = np.empty(len(flat), dtype=np.int64)
        code[~first] = rest.indices.to_numpy()
        code[first] = starts.indices.to_numpy() + n_rest
        code[(heads[:-1] - heads[0])[whole]] = n_rest + n_starts + np.arange(len(whole))
        words: list[str] = []
        counts = np.empty(len(pieces), dtype=np.int64)
        for i, x in enumerate(pieces):
            if x[1:].isalpha() and (x[0] == " " or x[0].isalpha()):
                words.append(x)
                counts[i] = 1
            elif x[:1] == " " and x[-1] in ".,;:!?" and x[1:-1].isalpha():
                words += (x[:-1], x[-1])
                counts[i] = 2
            else:
                found = self.words.findall(x)
                words += found
                counts[i] = len(found)
        distinct = pa.array(words, pa.large_string()).dictionary_encode()
        d = distinct.dictionary
        offs = np.frombuffer(d.buffers()[1], dtype=np.int64)[: len(d) + 1] if len(d) else np.zeros(1, np.int64)
        data = np.frombuffer(d.buffers()[2], dtype=np.uint8)[: offs[-1]] if len(d) and offs[-1] else np.zeros(0, np.uint8)
        ids, of_word = self.encode_words(data, offs)
        ids, of_use = ragged_take(ids, of_word, distinct.indices.to_numpy().astype(np.int64))
        ids, of_text = ragged_take(ids, of_use[offsets_of(counts)], code)
        return ids, of_text[heads - heads[0]]

    # ---- decoding

    def gather(self, table: tuple[np.ndarray, np.ndarray], ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Table entries of the ids of every list, joined: a ragged byte column."""
        data, offs = table
        size = (offs[1:] - offs[:-1])[ids]
        return data[ragged_index(offs[:-1][ids], size)], offsets_of(size)[offsets]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of the token lists; bytes that aren't UTF-8 become U+FFFD."""
        data, offs = self.gather(self.decode_table, ids, offsets)
        raw = data.tobytes()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]


@lru_cache(maxsize=2)
def codec(path: str) -> BpeCodec:
    """The codec of a vocabulary file; each Python worker builds it once."""
    return BpeCodec(path)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ids (array<int>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for part in slices(batch, "_text", SLICE_BYTES):
                ids, offs = c.encode(part.column("_text"))
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids, pa.int32()))], names=[id_col, "ids"])

    kept = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return kept.mapInArrow(run, f"`{id_col}` long, ids array<int>")


def decode_documents(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per token list: id, text. A null list is the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            lists = batch.column("_ids").cast(pa.large_list(pa.int32()))
            n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            texts = c.decode(lists.flatten().to_numpy(zero_copy_only=False), offsets_of(n))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(texts, pa.string())], names=[id_col, "text"])

    kept = tokens.select(F.col(id_col).cast("long").alias("_id"), F.col(ids_col).cast("array<int>").alias("_ids"))
    return kept.mapInArrow(run, f"`{id_col}` long, text string")


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each whole text and decode it again: id, n_tokens, ids_sha256, decoded_sha256.

    Only digests leave the task; use encode_documents and decode_documents for the ids and texts themselves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for part in slices(batch, "_text", SLICE_BYTES):
                ids, offs = c.encode(part.column("_text"))
                data, at = c.gather(c.decimal_table, ids, offs)
                raw = memoryview(data)
                listed = [hashlib.sha256(raw[a : max(a, b - 1)]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                decoded = [hashlib.sha256(t.encode("utf-8")).hexdigest() for t in c.decode(ids, offs)]
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(offs[1:] - offs[:-1], pa.int64()), pa.array(listed, pa.string()), pa.array(decoded, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kept = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return kept.mapInArrow(run, f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string")
