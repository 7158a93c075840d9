import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from haplolake.llm import queries, word_runs


def suffix_smaller_next(s):
    out = []
    for i in range(len(s)):
        j = i + 1
        while j < len(s) and s[j:] > s[i:]:
            j += 1
        out.append(j - i)
    return out


def brute(w, m):
    """All runs by period: stretches that agree with themselves one period later, without a smaller period."""
    runs = set()
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            x = w[i : j + p]
            if j - i >= p and len(x) >= m and not any(x[q:] == x[:-q] for q in range(1, p)):
                runs.add((i, len(x), p))
            i = max(j, i) + 1
    return sorted(runs, key=lambda r: (r[0], r[2]))


def some_words(rng):
    k, n = rng.randint(0, 3), rng.randint(0, 45)
    s = [rng.randint(0, k) for _ in range(n)]
    if rng.random() < 0.5:
        unit = [rng.randint(0, k) for _ in range(rng.randint(1, 8))]
        s = s[: rng.randint(0, 10)] + (unit * 9)[:n] + s[:5]
    return s


def test_lyndon_arrays_and_runs():
    rng = random.Random(0)
    for _ in range(1500):
        s = some_words(rng)
        assert word_runs.lyndon_array(s) == suffix_smaller_next(s)
        for m in (2, 5, 12):
            assert list(zip(*(x.tolist() for x in word_runs.find_runs(np.array(s, dtype=np.int64), np.zeros(len(s), int), m)))) == brute(s, m)


def test_runs_never_cross_documents():
    rng = random.Random(1)
    texts = [some_words(rng) for _ in range(80)] + [[1, 2] * 10, [1, 2] * 10]
    n = [len(t) for t in texts]
    start, length, period = word_runs.find_runs(np.array([x for t in texts for x in t]), np.repeat(np.arange(len(n)), n))
    base = np.cumsum([0, *n])
    got = Counter(zip(start.tolist(), length.tolist(), period.tolist()))
    assert got == Counter((int(base[i]) + s, k, p) for i, t in enumerate(texts) for s, k, p in brute(t, 12))


@pytest.mark.parametrize("unit", [1, 2, 1000])
def test_long_runs(unit):
    w = np.concatenate([[7000], np.tile(np.arange(unit), 60_000 // unit), [7001]])
    assert [x.tolist() for x in word_runs.find_runs(w, np.zeros(len(w), int))] == [[1], [60_000 // unit * unit], [unit]]


def expected(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w, 12)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return doc_id, len(runs), *best, sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


def test_registered_query_against_brute_force(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join("abcdefgh"[x] for x in some_words(rng))) for i in range(150)]
    rows += [(i, " ".join(rng.choice(["the", "of", "a", "b"]) + str(rng.randint(0, 9)) for _ in range(rng.randint(1, 300)))) for i in range(150, 250)]
    rows += [(None, "x y z"), (None, None), (900, None), (901, ""), (902, "\t \n"), (903, "\xa0 a\x1cb \xa0 a\x1cb " * 9), (904, "a b " * 3000), (5, "twice " * 20), (5, "twice " * 20)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, runs int, h string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op12_word_runs(spark, str(tmp_path)).collect()
    assert Counter(tuple(r) for r in got) == Counter(expected(*r) for r in rows)
    assert got[0].__fields__ == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert word_runs.word_runs(docs.limit(0)).count() == 0


def test_registered_query_on_the_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [r for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect() if len(r.text or "") < 4000]
    got = {r.doc_id: tuple(r) for r in queries.op12_word_runs(spark, d).collect()}
    assert len(rows) > 100 and all(got[r.doc_id] == expected(*r) for r in rows)
