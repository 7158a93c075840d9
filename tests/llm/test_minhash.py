import random
from collections import Counter

import numpy as np
import pytest

from haplolake.llm import minhash as M
from haplolake.llm.graph import components


def bag(text):
    w = (text or "").split()
    return Counter([tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else ([tuple(w)] if w else []))


def similarity(a, b):
    low, high = sum((a & b).values()), sum((a | b).values())
    return low / high if high else 0.0


def brute(docs):
    bags = [bag(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if similarity(bags[i], bags[j]) >= 0.8:
                parent[root(i)] = root(j)
    key = lambda i: -(1 << 63) if docs[i][0] is None else docs[i][0]
    return Counter((docs[i][0], docs[min((j for j in range(len(docs)) if root(j) == root(i)), key=key)][0]) for i in range(len(docs)))


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(300)]
    docs = []
    for i in range(40):
        docs.append([rng.choice(vocab) for _ in range(rng.choice([3, 6, 40, 200]))])
    for i in range(60):
        base = list(rng.choice(docs[:40]))
        for _ in range(rng.randint(0, 6)):
            base[rng.randrange(len(base))] = rng.choice(vocab)
        docs.append(base)
    docs.append(["x"] * 50)
    docs.append(["x"] * 55)
    docs.append(["x"] * 200)
    rows = [(i, " ".join(w), "src") for i, w in enumerate(docs)]
    rows += [(200, "", "a"), (201, None, "a"), (202, " \n ", None), (None, rows[0][1], None), (5, rows[5][1], "a"), (7, rows[50][1], "b"), (8, "one two", "x"), (203, "one\ttwo", "x")]
    got = M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, k string").repartition(3)).collect()
    assert Counter((r.doc_id, r.class_id) for r in got) == brute([(i, t) for i, t, _ in rows])


@pytest.mark.parametrize("block", [2000, 500_000])
def test_many_far_copies_of_one_text(spark, block):
    """Copies at all distances from an original: most aren't near it, but some near each other."""
    rng = random.Random(9)
    original = [f"w{i}" for i in range(120)]
    docs, last = [original], original
    for i in range(150):
        last = list(last if i % 3 else original)
        for _ in range(rng.randint(1, 6)):
            last[rng.randrange(120)] = f"x{rng.randint(0, 500)}"
        docs.append(last)
    rows = [(i, " ".join(w)) for i, w in enumerate(docs)]
    got = M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), block=block).collect()
    want = brute(rows)
    assert Counter((r.doc_id, r.class_id) for r in got) == want
    assert 5 < len({c for _, c in want}) < 140


def check_links(rows, got):
    """Every partner is near, as near as is said, and the links join each class's texts."""
    by_hash = {}
    for r in got:
        by_hash.setdefault((r.doc_id, r.text_hash), r)
    texts = {(r.doc_id, r.text_hash): t for r, t in zip(sorted(got, key=lambda r: r.doc_id), [t for _, t in sorted(rows)])}
    near = lambda a, b: similarity(bag(a), bag(b))
    for r in got:
        mine = texts[r.doc_id, r.text_hash]
        others = [bag(t) for _, t in rows if bag(t) != bag(mine) and near(t, mine) >= 0.8 - 1e-9]
        different = {frozenset(o.items()) for o in others}
        assert r.links <= len(different) and (r.links > 0) == bool(different)
        if r.partner_id is None:
            assert not different and r.similarity is None
        else:
            assert r.similarity == pytest.approx(near(mine, texts[r.partner_id, r.partner_hash])) and r.similarity >= 0.8 - 1e-9
            assert by_hash[r.partner_id, r.partner_hash].component == r.component


def test_verified_partners_and_links(spark):
    rng = random.Random(5)
    rows, vocab = [], [f"w{i}" for i in range(400)]
    for i in range(120):
        words = [rng.choice(vocab) for _ in range(100)] if i % 10 == 0 else list(rows[i - i % 10][1].split())
        for _ in range(rng.randint(0, 4) if i % 10 else 0):
            words[rng.randrange(100)] = rng.choice(vocab)
        rows.append((i, " ".join(words)))
    rows += [(500 + i, rows[i][1]) for i in range(0, 120, 7)] + [(900, "")]
    got = M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    check_links(rows, got)
    assert any(r.links > 1 for r in got) and any(r.similarity == 1.0 for r in got) and any(r.partner_id is None for r in got)


def test_links_of_one_large_cluster(spark, monkeypatch):
    """Thousands of near copies of one text, a head that is split over tasks: links count every copy that was verified."""
    monkeypatch.setattr(M, "HEAD_PARTNERS", 50)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 2000):
        words = list(base)
        words[rng.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert {r.class_id for r in got.values()} == {0} and all(r.links >= 1 for r in got.values())
    assert max(r.links for r in got.values()) > 1900
    for r in rng.sample(list(got.values()), 200):
        assert r.similarity == pytest.approx(similarity(bag(rows[r.doc_id][1]), bag(rows[r.partner_id][1]))) and r.similarity >= 0.8


def test_registered_query_against_brute_force(spark, tmp_path):
    from haplolake.llm import queries

    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op8_minhash(spark, "/root/testdata/sf0.001").collect()
    assert Counter((r.doc_id, r.class_id) for r in got) == brute(rows)
    check_links(rows, got)


def test_empty_table(spark):
    assert M.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("weights", [([1, 1, 1, 0], [1, 1, 0, 1]), ([5, 3, 0, 1], [2, 7, 1, 1]), ([100, 1, 30, 0], [60, 1, 50, 9])])
def test_signatures_are_unbiased(weights):
    a, b = np.array(weights)
    hits, slots, runs = 0, 64, 200
    for run in range(runs):
        element = M.mixed(np.arange(4, dtype=np.uint64) + np.uint64(run * 4), 5)
        doc = np.repeat([0, 1], 4)
        w = np.concatenate([a, b])
        on = w > 0
        s = M.bag_minhash(doc[on], np.tile(element, 2)[on], w[on], 2, slots)
        hits += (s[0] == s[1]).sum()
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs(hits / (slots * runs) - want) < 0.02


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 4), (4, 4), (7, None), (5, 6), (6, 3), (10, 11), (11, 12), (12, 13), (13, 9)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 1, 6: 1, 4: 4, 9: 4, 10: 4, 11: 4, 12: 4, 13: 4}


def test_keep_first(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "s"), (2, "a b c d e f", "t"), (1, "a b c d e f", "s"), (None, "z", None)], "doc_id long, text string, source string")
    kept = M.keep_first(docs, M.near_duplicates(docs)).collect()
    assert sorted((r.doc_id or 0, r.source or "") for r in kept) == [(0, ""), (1, "s")]


def test_keep_first_of_unlike_texts_under_one_id(spark):
    """A row stays for every class, whether its id is null, shared or its own; wordless rows all stay."""
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(12)) for x in "abcde")
    rows = [(None, a), (None, b), (None, c), (3, c), (5, d), (5, e), (9, e), (9, d), (7, d), (None, ""), (None, None), (5, " "), (5, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    classes = M.near_duplicates(docs)
    kept = Counter((r.doc_id, r.text) for r in M.keep_first(docs, classes).collect())
    assert kept == Counter([(None, a), (None, b), (None, c), (5, d), (5, e), (None, ""), (None, None), (5, " "), (5, " ")])
    named = classes.filter("component IS NOT NULL").select("component", "text_hash").distinct().collect()
    assert len(named) == len({r.component for r in named}) == len({r.text_hash for r in named}) == 5
