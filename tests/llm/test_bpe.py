import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from haplolake.llm import bpe, packing, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = ["", " ", "  a", "a  b", "a ", "\n\n x", "it's we'll 'tis", "<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "ß　x", "\xa0\x85y", "\x1c \x1d", "日本語 テスト", "🎉🎉 a", "x" * 3000, " " * 3000 + "x", "ab" * 2000, "²Ⅷ½ 12a", "\x00\x01", "don't.\nDo", "a.b,c; d! e?"]


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60) | st.text(" \n\tab'the.<|endoftext|>é1", max_size=60), max_size=8))
def test_encoder_equals_library(texts):
    import pyarrow as pa

    ids, offs = bpe.codec(PATH).encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert ids[offs[i] : offs[i + 1]].tolist() == ids_of(t)
    assert bpe.codec(PATH).decode(ids, offs) == texts


def test_round_trip_over_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(ODD)] + [(20_000, None), (None, "a b"), (5, "twice"), (5, "twice")], "doc_id long, text string")
    rows = docs.unionByName(extra)
    want = Counter((r.doc_id, len(i := ids_of(r.text)), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(i, skip_special_tokens=False).encode()).hexdigest()) for r in rows.collect())
    assert Counter(tuple(r) for r in bpe.round_trip_digests(rows, PATH).collect()) == want
    back = bpe.decode_documents(bpe.encode_documents(extra, PATH), PATH)
    assert Counter(tuple(r) for r in back.collect()) == Counter((r.doc_id, r.text or "") for r in extra.collect())


def test_decoding_bytes_that_are_not_utf8():
    c = bpe.codec(PATH)
    lone = [int(i) for i in range(256) if bytes(c.decode_table[0][c.decode_table[1][i] : c.decode_table[1][i + 1]]) == b"\xff"]
    assert c.decode(np.array(lone * 2), np.array([0, 2])) == ["��"]


def corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = [(10_000 + i, t) for i, t in enumerate(ODD)] + [(20_000, None), (None, "a b"), (5, "twice"), (5, "twice")]
    return docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"))


@pytest.mark.parametrize("group_docs", [50, 100_000])
def test_packing(spark, group_docs):
    rows = corpus(spark)
    got = packing.pack(rows, PATH, group_docs=group_docs).collect()
    want = defaultdict(list)
    for r in rows.collect():
        want[r.doc_id].append([*ids_of(r.text), 0])
    pieces = defaultdict(list)
    for p in got:
        pieces[p.doc_id, p.doc_tokens].append(p)
    total = sum(len(d) for ds in want.values() for d in ds)
    assert sum(p.length for p in got) == total
    for doc_id, docs in want.items():
        have = Counter((p.start, p.length, p.ids_crc32) for d in {len(d) for d in docs} for p in pieces[doc_id, d])
        expect = Counter()
        for d in docs:
            for p in {(p.start, p.length) for p in pieces[doc_id, len(d)]}:
                expect[(*p, zlib.crc32(np.array(d[p[0] : sum(p)], "<u4").tobytes()))] += 1
        assert have == expect
    sequences = defaultdict(list)
    for p in got:
        sequences[p.sequence_id].append((p.offset, p.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    if group_docs > 1000:
        assert sum(len(s) > 0 for s in sequences.values()) * 1024 <= total * 1.05 + 1024


def test_first_fit_decreasing_against_plain_search():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 7, 300):
        sizes = rng.integers(1, 100, n)
        bins, offsets = packing.first_fit_decreasing(sizes, 100)
        room, want = [], np.zeros(n, dtype=int)
        for i in np.argsort(-sizes, kind="stable"):
            b = next((b for b, r in enumerate(room) if r >= sizes[i]), len(room))
            if b == len(room):
                room.append(100)
            room[b] -= sizes[i]
            want[i] = b
        assert bins.tolist() == want.tolist()
        for b in set(bins.tolist()):
            spans = sorted((offsets[i], sizes[i]) for i in np.flatnonzero(bins == b))
            assert all(a + s == c for (a, s), (c, _) in zip(spans, spans[1:])) and spans[0][0] == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(none, PATH).count() == 0
    assert bpe.round_trip_digests(none, PATH).count() == 0
    assert token_counts.context_limits(token_counts.length_histogram(none, PATH)).count() == 0


@pytest.mark.parametrize("by", [None, "source"])
def test_token_counts(spark, by):
    rng = random.Random(0)
    data = [(i, " ".join(["word"] * rng.randint(0, 40)), rng.choice(["a", "b", None])) for i in range(300)] + [(999, None, "a"), (1000, "x " * 3000, "b")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    h = token_counts.length_histogram(docs, PATH, by=by)
    if by:
        h = h.withColumnRenamed("group", by)
    limits = token_counts.context_limits(h, by, block=7)
    groups = defaultdict(list)
    for _, t, s in data:
        groups[s if by else None].append(len(ids_of(t)))
    want = {}
    for g, lengths in groups.items():
        for n in set(lengths):
            want[g, n] = (lengths.count(n), n * lengths.count(n), sum(x >= n for x in lengths), sum(x for x in lengths if x >= n), sum(min(x, n) for x in lengths), sum(lengths), round(sum(x <= n for x in lengths) / len(lengths), 9))
    got = {(r[by] if by else None, r.n_tokens): (r.n_docs, r.tokens, r.docs_at_least, r.tokens_at_least, r.truncated_total, r.corpus_tokens, round(r.share_that_fits, 9)) for r in limits.collect()}
    assert got == want
    if not by:
        lengths = groups[None]
        assert token_counts.truncated_total(limits, 13).first()[0] == sum(min(x, 13) for x in lengths)
        q = token_counts.length_quantiles(limits, [0.5, 1.0]).first()
        assert q["q1"] == max(lengths) and sum(x <= q["q0.5"] for x in lengths) >= len(lengths) / 2
    assert sorted(r.n_tokens for r in token_counts.token_lengths(docs, PATH).collect()) == sorted(len(ids_of(t)) for _, t, _ in data)
