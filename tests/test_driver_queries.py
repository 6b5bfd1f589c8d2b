import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from glyphweave.plans import driver_queries as dq, network_queries as nq, operator_queries as oq

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents benchmark labels pages conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(pdf):
    cols = sorted(pdf.columns)
    clean = lambda x: "" if pd.isna(x) else repr(float(x)) if isinstance(x, (int, float)) or hasattr(x, "dtype") else str(x)
    return cols, sorted(tuple(clean(x) for x in r) for r in pdf[cols].itertuples(index=False))


@pytest.mark.parametrize("name", ["lexicon_build", "affix_split", "vocab_ids", "prefix_suffix_match", "period_rank", "temporal_chain", "same_period_variants", "canonical_spelling", "ego_k2", "ancestry_path", "connected_components", "redundant_edge_cleanup", "keyword_search", "upsert_latest", "training_pairs", "tree_from_depth"])
def test_against_sql(spark, db, name):
    assert rows(dq.QUERIES[name](spark, SF).toPandas()) == rows(db.sql(dq.ORACLE[name]).df())


@pytest.mark.parametrize("name", list(oq.QUERIES))
def test_operators_against_sql(spark, db, name):
    assert rows(oq.QUERIES[name](spark, SF).toPandas()) == rows(db.sql(oq.ORACLE[name]).df())


@pytest.mark.parametrize("name", list(nq.QUERIES))
def test_networks_against_sql(spark, db, name):
    assert rows(nq.QUERIES[name](spark, SF).toPandas()) == rows(db.sql(nq.ORACLE[name]).df())


def test_contract(spark):
    made = [m.QUERIES for m in (dq, oq, nq)]
    assert set(entry.oracle_sql()) <= set(entry.queries()) and all(set(m.QUERIES) == set(m.ORACLE) for m in (dq, oq, nq)) and sum(map(len, made)) == len(set().union(*made))
    assert entry.entry(spark).count() > 0
