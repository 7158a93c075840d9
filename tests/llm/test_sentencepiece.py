import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from haplolake.llm import queries, sentencepiece

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = SentencePieceProcessor(model_file=PATH)
ODD = ["", " ", "  a", "a  b", "a ", "\n\n x", "▁", "▁▁ a▁b", "<s>", "</s><unk>", "<0x41>", "日本語 テスト", "🎉🎉 a", "x" * 3000, " " * 3000 + "x", "x" + " " * 37, "ab" * 2000, "²Ⅷ½ 12a", "\x00\x01", "don't.\nDo", "ß　x", "\xa0\x85y", "¶日"]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(doc_id, text):
    ids = LIBRARY.encode(text or "")
    return doc_id, len(ids), digest(",".join(map(str, ids))), digest(LIBRARY.decode(ids))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60) | st.text(" ▁\n\tab'theinrs.é1日", max_size=60), max_size=8))
def test_encoder_equals_library(texts):
    c = sentencepiece.codec(PATH)
    ids, offs = c.encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert ids[offs[i] : offs[i + 1]].tolist() == LIBRARY.encode(t)
    assert c.decode(ids, offs) == [LIBRARY.decode(LIBRARY.encode(t)) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 31_999) | st.integers(0, 300), max_size=30))
def test_decoder_equals_library_on_any_ids(ids):
    c = sentencepiece.codec(PATH)
    assert c.decode(np.array(ids, dtype=np.int64), np.array([0, len(ids)])) == [LIBRARY.decode(ids)]


def test_round_trip_over_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(ODD)] + [(20_000, None), (None, "a b"), (5, "twice"), (5, "twice")], "doc_id long, text string")
    rows = docs.unionByName(extra)
    got = sentencepiece.round_trip_digests(rows.selectExpr("*", "1 as ids", "'x' as n_tokens"), PATH)
    assert Counter(tuple(r) for r in got.collect()) == Counter(expected(*r) for r in rows.collect())
    back = sentencepiece.decode_documents(sentencepiece.encode_documents(extra, PATH), PATH)
    assert Counter(tuple(r) for r in back.collect()) == Counter((r.doc_id, (r.text or "").replace("▁", " ")) for r in extra.collect())
    assert sentencepiece.round_trip_digests(extra.limit(0), PATH).count() == 0


def test_registered_query_equals_library(spark):
    d = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    assert {tuple(r) for r in queries.op13_sentencepiece(spark, d).collect()} == {expected(*r) for r in rows}
