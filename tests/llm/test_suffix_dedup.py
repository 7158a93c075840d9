import random

import numpy as np
import pytest

from haplolake.llm import suffix_dedup as S


def brute(docs, m):
    """docs: list of (id, text) -> {(id, text): (n_removed, n_spans, kept)}"""
    rows = sorted({(-(1 << 63) if i is None else i, (t or "")) for i, t in docs}, key=lambda r: (r[0], r[1]))
    seen, out = set(), {}
    for i, t in rows:
        raw = t.encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - m + 1):
            w = raw[s : s + m]
            if w in seen:
                gone[s : s + m] = True
            seen.add(w)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i, t] = (int(gone.sum()), runs, bytes(np.frombuffer(raw, np.uint8)[~gone]))
    return out


def check(spark, docs, m):
    got = S.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3), min_bytes=m).collect()
    want = brute([(i, t) for i, t, _ in docs], m)
    assert len(got) == len(docs)
    have = sorted((-(1 << 63) if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got)
    expect = sorted((-(1 << 63) if i is None else i, len((t or "").encode()), *want[-(1 << 63) if i is None else i, t or ""]) for i, t, _ in docs)
    assert have == expect
    for r in got:
        assert sum(s.b - s.a for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans


@pytest.mark.parametrize("m", [20, 100])
def test_against_brute_force(spark, m):
    rng = random.Random(m)
    words = ["the", "of", "ouèle", "thnt", "er", "ß", "\x00", "and\n", "aaaa", "ing"]
    passages = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(4)]
    docs = []
    for i in range(60):
        parts = [rng.choice(passages)[rng.randint(0, 30) :] if rng.random() < 0.4 else " ".join(rng.choice(words) + str(rng.randint(0, 40)) for _ in range(20)) for _ in range(rng.randint(0, 5))]
        docs.append((i, " ".join(parts), "s"))
    docs += [(100, docs[3][1], "s"), (101, docs[3][1], "s"), (102, "a" * 500, "s"), (103, "ab" * 300, "s"), (104, "a" * 99, "s"), (105, "", "s"), (106, None, "s"), (None, docs[5][1], None)]
    docs += [docs[7], docs[7], (108, "", None)]
    check(spark, docs, m)


def test_empty_table(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_smaller_neighbours():
    key = np.array([5, 3, 3, 9, 1, 7, 2])
    before, after = S.smaller_neighbours(key)
    assert before.tolist() == [-1, -1, -1, 2, -1, 4, 4]
    assert after.tolist() == [1, 4, 4, 4, -1, 6, -1]


def test_anchor_is_found_for_every_window(spark):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 101, 3000).astype(np.uint8)
    offs = np.array([0, 1200, 1210, 3000])
    pos, _ = S.anchors(data, offs, 100)
    k = S.anchor_length(100)
    for a, b in zip(offs[:-1], offs[1:]):
        for s in range(a, b - 99):
            assert ((pos >= s) & (pos + k <= s + 100)).any()
