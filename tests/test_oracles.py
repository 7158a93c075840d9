"""Every query on the reference's operators against its SQL twin, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from haplolake.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    return con


def plain(rows):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "NULL"
        return f"{float(v):.8g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(cell(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_twin(spark, sql, name):
    df = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    con = sql.execute(registry.ORACLES[name])
    names = [d[0] for d in con.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    want = [tuple(r[names.index(c)] for c in order) for r in con.fetchall()]
    got = [tuple(r[c] for c in order) for r in df.collect()]
    assert plain(got) == plain(want)


def test_every_query_has_a_twin():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


def test_nothing_but_the_entry_knows_the_llm_subpackage():
    root = Path(registry.__file__).parents[1]
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "haplolake.llm" not in f.read_text()


def test_entry_module_needs_no_session():
    import subprocess
    import sys

    root = Path(registry.__file__).parents[2]
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"
    assert int(subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout) > 100
