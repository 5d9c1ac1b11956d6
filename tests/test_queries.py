"""Every registered query against its DuckDB SQL; those without SQL have tests of their own."""

import glob
import os

import duckdb
import pytest

from tandem.plans.oracles import ORACLE_SQL
from tandem.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def canonical(rows):
    return sorted(repr(tuple(round(v, 7) + 0.0 if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLE_SQL:
        assert got
        return
    found = db.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = [tuple(r[names.index(c)] for c in df.columns) for r in found.fetchall()]
    assert canonical(got) == canonical(want)


def test_fits_do_not_read_texts_again(spark):
    """What a query of many fits returns is computed from stored features, not from the texts, which are read once."""
    files = QUERIES["baseline_matrix"](spark, SF).inputFiles()
    assert files and not any("documents" in f for f in files)
