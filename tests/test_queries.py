"""Every query against its SQL."""

import pytest
from conftest import SMALL
from oracle import compare, database

from gritstone.plans.registry import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con():
    return database(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SMALL), ORACLE_SQL[name], con) == ""


#: Queries that SQL cannot express, each with a test of its own in test_more.py or test_operators.py.
TESTED_ALONE = {"average_linkage", "embed_texts", "hdbscan_grid", "lda_doc_topics", "lda_final", "lda_grid", "lda_topics", "pca_reduce", "reduce_set", "quick_silhouette", "sv1_fraction", "text_sample", "umap_reduce"}


def test_every_query_has_sql_or_a_test_of_its_own():
    assert set(QUERIES) - set(ORACLE_SQL) == TESTED_ALONE


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
