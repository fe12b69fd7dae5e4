import glob
import os

import duckdb
import pandas as pd
import pytest

from loomgraph.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
#: One or two of each group; the driver compares all of them.
CHOSEN = ["bgp_chain", "optional_group", "class_closure", "exists_minus", "correlated_not_exists", "correlated_exists", "exists_in_or", "nested_not_exists", "subselect_join", "join_after_optional", "ancestors_of_bindings", "class_instances", "distinct_pairs", "resolve_terms", "label_of", "missing_labels", "chunk_corpus", "document_frequency", "lcs_match", "assemble_budget", "retrieval_metrics", "rules_verdict", "rate_threshold", "compare_adjacent", "interest_difference", "quota_fill", "penalty_amounts", "carried_over_questions", "temporal_validity", "ntriples_round_trip"]


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("float"):
            df[c] = df[c].round(6)
    df = df.astype(str).replace({"None": "~", "nan": "~", "<NA>": "~"})
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, tables, name):
    pd.testing.assert_frame_equal(plain(QUERIES[name](spark, SF).toPandas()), plain(tables.execute(ORACLE_SQL[name]).df()))


def test_all_have_sql_but_a_few():
    assert set(QUERIES) - set(ORACLE_SQL) == {"khop_units", "ontology_context", "scenario_metrics", "compact_units", "variant_pick"}
