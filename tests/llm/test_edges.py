"""Odd tables: null and repeated ids, repeated rows, empty and very long texts, clashing column names, bounds."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from haplolake.llm import bpe, packing, quality_classifier, suffix_dedup, token_counts
from haplolake.llm.queries import VOCABULARY
from tests.llm.test_suffix_dedup import brute

DATA = "/root/testdata/sf0.001"


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def test_longest_previous_factors():
    rng = np.random.default_rng(0)
    for trial in range(60):
        texts = [rng.integers(97, 97 + int(rng.integers(1, 4)), int(rng.integers(1, 60))).astype(np.uint8) for _ in range(int(rng.integers(1, 6)))]
        if trial % 3 == 0:
            texts = [t * (rng.random(len(t)) < 0.7).astype(np.uint8) for t in texts]  # zero bytes are bytes too
        n = np.array([len(t) for t in texts])
        data, owner = np.concatenate(texts), np.repeat(np.arange(len(n)), n)
        room = np.cumsum(n)[owner] - np.arange(len(data))
        suffix = [bytes(data[i : i + room[i]]) for i in range(len(data))]
        array = suffix_dedup.SuffixArray(data, room)
        place = {x: i for i, x in enumerate(sorted(set(suffix)))}
        assert array.rank.tolist() == [place[x] for x in suffix]
        key = rng.integers(0, len(data), len(data))
        got = suffix_dedup.longest_previous_factors(array, np.arange(len(data)), key)
        assert got.tolist() == [max([common(suffix[i], suffix[j]) for j in range(len(data)) if key[j] < key[i]], default=0) for i in range(len(data))]


def test_a_gram_is_counted_at_most_twice_a_task():
    rng, seen = np.random.default_rng(1), Counter()
    met, sent = suffix_dedup.Met(), Counter()
    for _ in range(50):
        grams, count = np.unique(rng.integers(0, 30, 20).astype(np.uint64), return_counts=True)
        before = met.times(grams, count)
        assert before.tolist() == [min(2, seen[g]) for g in grams.tolist()]
        sent.update(g for g, b in zip(grams.tolist(), before.tolist()) if b < 2)
        seen.update(dict(zip(grams.tolist(), count.tolist())))
    assert max(sent.values()) <= 2


def test_repeats_under_null_and_shared_ids(spark):
    rng = random.Random(2)
    passages = [" ".join(rng.choice(["alpha", "be", "gamma", "de"]) for _ in range(30)) for _ in range(5)]
    texts = [f"{i} {rng.choice(passages)} {rng.random()} {rng.choice(passages)}" for i in range(60)]
    rows = [(None, t) for t in texts[:40]] + [(7, t) for t in texts[40:]] + [(None, texts[0])] * 5
    df = spark.createDataFrame([(*r, 1, "x", "y", None) for r in rows], "doc_id long, text string, row int, k string, r string, t string").repartition(3)
    got = suffix_dedup.remove_repeats(df.select("doc_id", "text"), min_bytes=100).collect()
    # Under one id the order is that of a hash, so only what does not depend on it is compared: bytes that are left over all.
    want = brute(rows, 100)
    assert len(got) == len(rows)
    distinct = {(r.doc_id, bytes(r.kept), r.n_bytes): r.n_removed for r in got}
    assert len(distinct) == len(want)
    cut = suffix_dedup.cut_texts(df)
    assert cut.columns == df.columns and cut.count() == len(rows)
    assert Counter((r.row, r.k, r.r, r.t) for r in cut.collect()) == Counter({(1, "x", "y", None): len(rows)})


def test_full_pieces_meet_in_no_group(spark, monkeypatch):
    """A group's size follows from the rests: 12 long documents in groups of about 4."""
    docs = spark.createDataFrame([(i % 3, "word " * 6000, i) for i in range(12)] + [(None, None, 0), (None, "", 1)], "doc_id long, text string, start int")
    got = packing.pack(docs, VOCABULARY, group_docs=4).collect()
    full = [r for r in got if r.length == 1024]
    assert len(full) == 12 * (6001 // 1024) and all(r.sequence_id >= packing.FULL and r.offset == 0 for r in full)
    assert len({r.sequence_id for r in full}) == len(full)
    rests = Counter(r.sequence_id >> 24 for r in got if r.length < 1024)
    assert sum(rests.values()) == 14 and max(rests) < 4 and all(r.sequence_id < packing.FULL for r in got if r.length < 1024)
    assert Counter(r.doc_id for r in got if r.doc_tokens == 1) == {None: 2}


def test_one_row_is_fitted_for_an_id(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    once = quality_classifier.fit_quality(docs, labels, max_rows=10)
    many = quality_classifier.fit_quality(docs.withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(20)))), labels, max_rows=10)
    assert once.to_bytes() == many.to_bytes()
    other = quality_classifier.fit_quality(docs, labels.limit(0), max_rows=10)
    assert other.to_bytes() != once.to_bytes()


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 1, 2), (1, "a b", None, 1, 2)], "doc_id long, text string, `_block` string, `_id` int, n_tokens int")
    limits = token_counts.context_limits(token_counts.length_histogram(docs, VOCABULARY, by="_block").withColumnRenamed("group", "_block"), by="_block")
    assert {(r["_block"], r.n_docs) for r in limits.collect()} == {("x", 1), (None, 1)}
    with pytest.raises(ValueError, match="tokens"):
        token_counts.context_limits(limits, by="tokens")
    assert bpe.round_trip_digests(docs, VOCABULARY).count() == 2
    assert bpe.encode_documents(docs, VOCABULARY).first().ids == bpe.encode_documents(docs.select("doc_id", "text"), VOCABULARY).first().ids


def test_stages_on_odd_rows(spark):
    """Every stage takes null ids, repeats, nulls, very long texts and further columns; distinct clean texts stay."""
    rng = random.Random(8)
    prose = lambda n: " ".join(rng.choice(["river", "stone", "garden", "window", "letter", "morning"]) + str(rng.randint(0, 999)) for _ in range(n)) + "."
    a, b, c, long = prose(60), prose(70), prose(80), prose(30_000)
    rows = [(None, a), (None, b), (5, c), (5, long), (5, c), (None, a), (6, None), (7, "")]
    docs = spark.createDataFrame([(i, t, None, None, None, "k", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row string, h int").repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality classifier"](spark, docs, DATA)
    assert good.columns == corpus_pipeline.COLUMNS and good.count() <= len(rows)
    ruled = stages["quality rules"](spark, docs, DATA)
    assert Counter((r.doc_id, r.text) for r in ruled.collect()) == Counter(r for r in rows if r[1])
    kept = stages["MinHash near-dedup"](spark, ruled, DATA)
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter({(None, a), (None, b), (5, c), (5, long)})
    cut = stages["suffix-array dedup"](spark, kept, DATA)
    assert Counter((r.doc_id, r.text, r.n_chars) for r in cut.collect()) == Counter((i, t, len(t)) for i, t in {(None, a), (None, b), (5, c), (5, long)})
    packed = stages["packing"](spark, cut, DATA).collect()
    assert sum(r.length for r in packed) == sum(len(bpe.codec(VOCABULARY).encode(_texts([t]))[0]) + 1 for t in (a, b, c, long))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).count() == 0, name


def _texts(texts):
    import pyarrow as pa

    return pa.array(texts, pa.string())
