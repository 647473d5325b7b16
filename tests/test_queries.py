"""Every registered query against its SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from crossgrain.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()
KINDS = {"string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE", "date": "DATE", "boolean": "BOOLEAN", "int": "INTEGER"}


@pytest.fixture(scope="session")
def sql(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f).removesuffix('.parquet')} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 9) + 0.0 if isinstance(v, float) else v


#: What SQL has no words for: other tests hold these against plain versions.
WITHOUT_SQL = {
    "E9_hierarchical_book", "G24_probabilistic_sharpe", "M3_pair_tests", "M5_calibrated_out_of_sample", "M5_isotonic_calibration", "M7_boosted_trees",
    "M8_permutation_importance", "M9_rank_ic_boosting", "M10_walk_forward", "M11_sweep", "P4_seeded_symbols", "W13_adx",
}
#: Nothing qualifies among the ten symbols of the smallest tables.
EMPTY = {"M1_neutralized_exposures"}


def test_every_other_query_has_sql():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_is_its_sql(spark, sql, sf, name):
    df = QUERIES[name](spark, sf)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    assert bool(got) is (name not in EMPTY)
    if name in WITHOUT_SQL:
        return
    rel = sql.sql(ORACLES[name])
    assert sorted(rel.columns) == names
    assert {c: KINDS.get(t, t) for c, t in df.dtypes} == dict(zip(rel.columns, map(str, rel.types)))
    place = [rel.columns.index(c) for c in names]
    assert got == sorted((tuple(plain(r[i]) for i in place) for r in rel.fetchall()), key=repr)
