import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from haplolake.llm import collocations, queries


def brute(rows, top, min_count, share):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in (1, 2, 3):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, f in counts.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        longer = Counter()
        for p, a in cand.items():
            if len(p) == 3:
                for part in (p[:2], p[1:]):
                    longer[part] = max(longer[part], a)
        kept = []
        for p, a in cand.items():
            if len(p) == 2 and longer[p] and 100 * longer[p] >= share * a:
                continue
            cuts = [(1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        for i, (s, a, phrase, left, right) in enumerate(sorted(kept)[:top]):
            out.add((lang, i + 1, phrase.decode(), -a, left, right, totals[lang], -s))
    return out


def some_rows(rng, n):
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "de", "", None])
        words = [rng.choice(["The", "of", "and", "New", "York", "City", "é", "\xa0x", "ÄB"]) if rng.random() < 0.7 else f"w{int(rng.expovariate(0.05))}" for _ in range(rng.randint(0, 120))]
        text = "".join(w + rng.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "!? "]) for w in words)
        rows.append((lang, text + (" san francisco bay" * rng.randint(0, 2) + " los angeles." if rng.random() < 0.5 else "")))
    return rows + [("en", None), (None, None), ("xx", "only few words"), ("de", "a " * 4000), ("en", "A.A"), ("en", "same row twice same row"), ("en", "same row twice same row")]


@pytest.mark.parametrize("top", [1, 5, 40, 2000])
def test_against_brute_force(spark, monkeypatch, top):
    monkeypatch.setattr(collocations, "SLICE_BYTES", 3000)
    rng = random.Random(top)
    rows = some_rows(rng, 250)
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "lang string, text string, n int, w1 string").repartition(5)
    got = collocations.mine_phrases(docs, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {tuple(r) for r in got.collect()} == brute(rows, top, 10, 50)


def test_a_second_wave_is_made_where_pairs_are_dropped(spark):
    """All the best pairs are parts of longer phrases: the first threshold isn't reached by enough survivors."""
    rows = [("en", " ".join(f"a{i} b{i} c{i}." for i in range(12))) for _ in range(10)] + [("en", f"p q{i}. z q{i}.") for i in range(60) for _ in range(12)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    for top in (4, 11, 12, 13, 30):
        assert {tuple(r) for r in collocations.mine_phrases(docs, top=top).collect()} == brute(rows, top, 10, 50)


def test_empty_table_and_filter(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert collocations.mine_phrases(none).count() == 0
    keys = spark.createDataFrame([("en", f"w{i}", "x") for i in range(500)] + [("", "a", "é")], "lang string, w1 string, w2 string")
    sieve = collocations.Sieve.of(keys, "w1", "w2")
    h = lambda rows: collocations._together(*(collocations._hashes(pa.array(c)) for c in zip(*rows)))
    assert sieve.holds(h([("en", f"w{i}", "x") for i in range(500)] + [("", "a", "é")])).all()
    assert np.mean(sieve.holds(h([("de", f"w{i}", "x") for i in range(500)]))) < 0.02


def test_registered_query_equals_its_sql(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{d}/documents.parquet')")
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({queries.ORACLES['op11_collocations']})").fetchall()
    assert {tuple(r) for r in queries.op11_collocations(spark, d).select(*names).collect()} == set(want)
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("lang", "text").collect()]
    assert set(want) == brute(rows, 2000, 10, 50)
