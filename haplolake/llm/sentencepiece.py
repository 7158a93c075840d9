"""Merge-type subword pieces with byte fallback: exact encoding by backtracking, decoding by offset table.

Such a vocabulary has no list of merges: two neighbours merge whenever their joined string is a piece,
best score first, then leftmost, however the two came about. Merges inside a piece don't see what is beyond
it, and which of two neighbouring pieces merges next doesn't depend on third ones. So a sequence of pieces is
the one that the merges give if, and only if, every two neighbours stay apart when their joined string is
merged anew (adjacent-token check by re-merging, kept in a table). The encoder takes the longest piece
at each position (Aho-Corasick over the reversed pieces, over the reversed text), then the next shorter one
if the check fails, then steps back; a field of bits marks positions from which nothing works, so a
chunk takes linear time. Pieces hold blanks at their start only, hence texts are cut before blanks and each
distinct chunk of a batch is encoded once.

Defined cases: null and empty texts have no ids; texts are never cut; a blank goes before every other text; the
blank's own sign U+2581 in a text is a blank, also after decoding, as in the public library; names of
control pieces in a text are ordinary text; characters outside the vocabulary become bytes; null and repeated
ids and repeated rows give one row each; an empty table gives none; further columns don't matter.
"""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from haplolake.llm.bpe import BpeCodec
from haplolake.llm.ragged import offsets_of, ragged_take, slices

#: Fixed value: the sign that vocabulary files write for a blank.
BLANK = "▁"
#: Text bytes that a task encodes at once.
SLICE_BYTES = 6_000_000

codecs.register_error("each-byte", lambda e: ("�" * (e.end - e.start), e.end))


class PieceCodec(BpeCodec):
    """Encoder and decoder for a vocabulary file of merge-type pieces. Only the file's entries come from the public library."""

    def __init__(self, path: str) -> None:
        file = SentencePieceProcessor(model_file=path)
        every = range(file.vocab_size())
        name = [file.id_to_piece(i) for i in every]
        byte_id = {int(name[i][1:-1], 16): i for i in every if file.is_byte(i)}
        plain = [i for i in every if not (file.is_byte(i) or file.is_control(i) or file.is_unknown(i))]
        if len(byte_id) != 256 or any(BLANK in name[i].lstrip(BLANK) for i in plain):
            raise ValueError("needs byte fallback, and blanks only at the start of pieces")
        self.score = {name[i].replace(BLANK, " "): file.get_score(i) for i in plain}
        if not {c for t in self.score for c in t} <= set(self.score):
            raise ValueError("every character of a piece must be a piece")
        id_of = {t: i for t, i in zip(self.score, plain, strict=True)}
        # Single bytes first: those that are no character of the vocabulary stand for themselves. Pieces that
        # merging never makes can't be in a result.
        self._text: list[str | None] = [chr(b) if b < 128 and chr(b) in id_of else None for b in range(256)]
        self._text += [t for t in id_of if len(t.encode()) > 1 and self.merged(t) == [t]]
        made = [bytes([b]) for b in range(256)] + [t.encode() for t in self._text[256:]]
        symbol = {t: i for i, t in enumerate(made)}
        self.ids = np.array([id_of[t] if t else byte_id[i] for i, t in enumerate(self._text)], dtype=np.int32)
        self.size = np.array([len(t) for t in made], dtype=np.int64)
        self.shorter = np.full(len(made), -1, dtype=np.int64)
        for i, t in enumerate(self._text):
            starts = (symbol.get(t[:n].encode()) for n in range(len(t) - 1, 0, -1)) if t else ()
            self.shorter[i] = next((s for s in starts if s is not None), -1)
        self._automaton(made)
        self._memo_key = np.full(1 << 20, -1, dtype=np.int64)
        self._memo_ok = np.zeros(1 << 20, dtype=bool)
        self.hidden = np.array([file.is_control(i) for i in every])
        self._begins = np.array([name[i].startswith(BLANK) for i in every])
        raw = {i: bytes([b]) for b, i in byte_id.items()} | {i: t.encode() for t, i in id_of.items()}
        self.decode_table = self._table([raw.get(i, b"" if self.hidden[i] else " ⁇ ".encode()) for i in every])
        self.decimal_table = self._table([b"%d," % i for i in every])

    def merged(self, text: str) -> list[str]:
        """The pieces of a short string by the merges themselves: best score first, then leftmost."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _judge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether two neighbours come apart again when their joined string is merged; bytes never merge."""
        ok = np.ones(len(a), dtype=bool)
        for k, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            left, right = self._text[i], self._text[j]
            if left is not None and right is not None:
                ok[k] = self.merged(left + right) == [left, right]
        return ok

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of every text, as a ragged column."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.replace_substring(texts, BLANK, " ")
        texts = pc.replace_substring_regex(texts, r"\A([\s\S])", r" \1")
        _, offs, data = texts.buffers()
        offs = np.frombuffer(offs, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if not len(texts) or offs[0] == offs[-1]:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, dtype=np.int64)
        raw = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]]
        offs = offs - offs[0]
        # A chunk begins at a blank after anything else, and with every text.
        begins = raw == 32
        begins[1:] &= raw[:-1] != 32
        begins[offs[:-1][offs[1:] > offs[:-1]]] = True
        cuts = np.append(np.flatnonzero(begins), len(raw))
        chunks = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.tobytes()), pa.py_buffer(raw.tobytes()))
        distinct = chunks.dictionary_encode()
        d = distinct.dictionary
        d_offs = np.frombuffer(d.buffers()[1], dtype=np.int64)[: len(d) + 1]
        ids, of_chunk = self.encode_words(np.frombuffer(d.buffers()[2], dtype=np.uint8)[: d_offs[-1]], d_offs)
        ids, of_use = ragged_take(ids, of_chunk, distinct.indices.to_numpy().astype(np.int64))
        return ids, of_use[np.searchsorted(cuts, offs)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of the id lists, without the blank that encoding puts before; bytes that aren't UTF-8 become U+FFFD each."""
        data, offs = self.gather(self.decode_table, ids, offsets)
        shown = np.flatnonzero(~self.hidden[ids])
        first = np.searchsorted(shown, offsets)
        some = first[1:] > first[:-1]
        skip = np.zeros(len(offsets) - 1, dtype=np.int64)
        skip[some] = self._begins[ids[shown[first[:-1][some]]]]
        raw = data.tobytes()
        return [raw[a:b].decode("utf-8", "each-byte") for a, b in zip((offs[:-1] + skip).tolist(), offs[1:].tolist(), strict=True)]


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    """The codec of a vocabulary file; each Python worker builds it once."""
    return PieceCodec(path)


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
    """One row per id list: id, text. A null list is the empty text."""

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
    """Encode each whole text and decode it again: id, n_tokens, ids_sha256, decoded_sha256. Only digests leave the task."""

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
