"""The classifier on held-out rows, and the whole pipeline against brute force on the smallest tables."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from haplolake.llm import quality_classifier, quality_rules, queries
from tests.llm.test_minhash import brute as near_classes
from tests.llm.test_suffix_dedup import brute as without_repeats

DATA = "/root/testdata/sf0.001"


def test_interactions_by_sum_of_squares():
    rng = np.random.default_rng(0)
    m = quality_classifier.FactorisationMachine(rng.normal(size=quality_classifier.N_FEATURES), rng.normal(size=(quality_classifier.N_FEATURES, quality_classifier.FACTORS)), 0.3)
    feature, value = np.array([5, 9, 700, 8300]), np.array([0.5, 1.0, 0.2, 0.7])
    pairs = sum(m.v[feature[i]] @ m.v[feature[j]] * value[i] * value[j] for i in range(4) for j in range(i))
    want = m.bias + m.w[feature] @ value + pairs
    got = m.logits(np.zeros(4, dtype=int), feature, value, 1)[0][0]
    assert got == pytest.approx(want)
    assert quality_classifier.FactorisationMachine.from_bytes(m.to_bytes()).logits(np.zeros(4, dtype=int), feature, value, 1)[0][0] == pytest.approx(want)


def plain_hash(x, salt=0):
    """The hash of a 64-bit number that features are named by, in plain integers."""
    m = (1 << 64) - 1
    x = (x + salt * 0xA24BAED4963EE407 + 0x9FB21C651E98DF25) & m
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & m
    x = (x ^ x >> 27) * 0x94D049BB133111EB & m
    return x ^ x >> 31


def plain_score(model, text, n_chars):
    """Score of one text: words by a pattern, counts by a dictionary, every pair of features by itself."""
    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    count, some = Counter(words), max(len(words), 1)
    name = lambda w: plain_hash(sum((b + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, b in enumerate(w)) % (1 << 64))
    x = Counter()
    for w, n in count.items():
        x[name(w) % quality_classifier.WORD_BUCKETS, w] += 0.5 * math.sqrt(n / some)
    of = lambda chars: sum(raw.count(c) for c in chars)
    upper, lower = len(re.findall(rb"[A-Z]", raw)), len(re.findall(rb"[a-z]", raw))
    stats = [
        of(bytes([c]) for c in b"#*$%&|<>@^~=+_\\{}[]") / some, of([b"|"]) / some, upper / max(upper + lower, 1), of([b"!"]) / some, of([b".", b","]) / some,
        len(re.findall(rb"[0-9]", raw)) / max(len(raw), 1), of([b"\n"]) / some, len(count) / some, sum(a == b for a, b in zip(words, words[1:])) / some, max(count.values(), default=0) / some,
        sum(map(len, words)) / some / 16, math.log2(1 + len(words)) / 8, math.log2(1 + max(len(text or "") if n_chars is None else n_chars, 0)) / 8, len(re.findall(rb"[\x00-\x08\x0E-\x1F]", raw)) / max(len(raw), 1),
    ]
    for i, v in enumerate(stats):
        bin_ = min(max(int(math.log2(1 + 64 * v) * 3), 0), quality_classifier.BINS - 1)
        x[quality_classifier.WORD_BUCKETS + i * quality_classifier.BINS + bin_, None] = 0.5
    feature, value = np.array([f for f, _ in x]), np.array(list(x.values()))
    between = model.v[feature] @ model.v[feature].T * np.outer(value, value)
    z = model.bias + model.w[feature] @ value + np.triu(between, 1).sum()
    return 1 / (1 + math.exp(-min(max(z, -40), 40)))


def plain_scores(spark, folder):
    """Rows of documents with their plain scores, by the model that the query fits."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality_classifier.fit_quality(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return [(r, plain_score(model, r.text, r.n_chars)) for r in docs.collect()]


def test_query_against_plain_scores(spark):
    """Every row of the query: the pair sum by itself, from features taken out one text at a time."""
    got = {r.doc_id: r for r in queries.op4_quality_classifier(spark, DATA).collect()}
    want = plain_scores(spark, DATA)
    assert len(got) == len(want)
    for r, score in want:
        assert got[r.doc_id].score == pytest.approx(score, abs=1e-9)
        assert got[r.doc_id].predicted == int(score >= 0.3)


def test_classifier_on_rows_held_out(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = queries.op4_quality_classifier(spark, folder)
    rows = scored.join(labels, "doc_id").filter("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.9
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored.collect())


def test_scores_of_odd_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = quality_classifier.fit_quality(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    odd = spark.createDataFrame([(1, None, None, "x"), (None, "", 3, None), (3, "\x00", -5, "x"), (3, "a " * 90000, None, "x"), (3, "a", 1, "x"), (3, "a", 1, "x")], "doc_id long, text string, n_chars long, score string")
    got = quality_classifier.score_quality(odd, model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    kept = quality_classifier.keep_good(odd, model)
    assert kept.columns == odd.columns
    none = quality_classifier.fit_quality(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in quality_classifier.score_quality(odd, none).collect()} == {1.0}
    assert quality_classifier.score_quality(odd.limit(0), model).count() == 0
    # Labels of rows that are held out change nothing; nor do language and source.
    labels = spark.read.parquet(f"{DATA}/labels.parquet").withColumn("quality", F.when(quality_classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality_classifier.fit_quality(docs.withColumn("lang", F.lit("q")), labels).to_bytes() == model.to_bytes()


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality classifier"](spark, docs, DATA)
    want = {r.doc_id for r, score in plain_scores(spark, DATA) if score >= 0.3}
    assert {r.doc_id for r in good.collect()} == want and good.columns == docs.columns

    ruled = stages["quality rules"](spark, good, DATA)
    ledger = {r.doc_id: r.failures for r in quality_rules.ledger(docs).collect()}
    assert {r.doc_id for r in ruled.collect()} == {i for i in want if ledger[i] & quality_rules.POLICIES[quality_rules.CURRENT] == 0}

    kept = stages["MinHash near-dedup"](spark, ruled, DATA)
    rows = [(r.doc_id, r.text) for r in ruled.collect()]
    heads = {c for _, c in near_classes(rows)}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(heads) and kept.columns == docs.columns

    cut = stages["suffix-array dedup"](spark, kept, DATA)
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    left = {i: k.decode("utf-8", "replace") for (i, _), (_, _, k) in without_repeats(rows, 100).items()}
    got = cut.collect()
    assert {r.doc_id: r.text for r in got} == left and all(r.n_chars == len(r.text) for r in got)
    assert {r.doc_id: (r.lang, r.source) for r in got} == {r.doc_id: (r.lang, r.source) for r in docs.collect() if r.doc_id in left}

    # Packing, by the public library: every id of every kept text once, in gapless sequences of at most 1024.
    library = Tokenizer.from_file(queries.VOCABULARY)
    ids = {i: [*library.encode(t, add_special_tokens=False).ids, 0] for i, t in left.items()}
    packed = corpus_pipeline.run(spark, DATA).collect()
    spans, sequences = {i: [] for i in ids}, {}
    for p in packed:
        own = ids[p.doc_id][p.start : p.start + p.length]
        assert p.doc_tokens == len(ids[p.doc_id]) and p.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
        spans[p.doc_id].append((p.start, p.start + p.length))
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.offset + p.length))
    whole = lambda parts: all(x[1] == y[0] for x, y in zip([(0, 0), *sorted(parts)], sorted(parts)))
    assert all(whole(x) and max(b for _, b in x) == len(ids[i]) for i, x in spans.items())
    assert all(whole(x) and max(b for _, b in x) <= 1024 for x in sequences.values())


def test_clean_documents_stay(spark):
    """Labelled good documents are kept by the rules and by the classifier."""
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").filter("quality = 1")
    rules = queries.op6_quality_rules(spark, folder).join(labels, "doc_id").collect()
    lost = [r for r in rules if not r.kept and not r.base_failed]
    assert len(lost) <= 0.01 * len(rules)


def test_every_oracle_matches(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    for name, sql in queries.ORACLES.items():
        df = queries.QUERIES[name](spark, DATA)
        found = con.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(names) == sorted(df.columns)
        assert Counter(tuple(r[c] for c in names) for r in df.collect()) == Counter(found.fetchall())
