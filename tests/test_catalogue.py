"""Registered queries against their SQL on the smallest tables, and the contract of the entry file."""
import os

import duckdb
import pytest

import __spark_entry__ as entry
from attestra import session
from workbench import catalog, run_queries, workload

SF = "/root/testdata/sf0.001"
QUICK = ["subject_profile", "kappa_pairs", "overlap_matrix", "polarity_conflicts_top", "decode_groups", "freshness", "drift", "trust_coverage", "audit_subjects",
         "anchor_validation", "rejected_rows", "uploaded_claim_rows", "citations", "multi_label_column", "joined_validation", "claims_page"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in workload.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    assert run_queries.compare(df.collect(), df.columns, con, entry.oracle_sql()[name]) == "ok"


def test_entry_and_registration(spark):
    assert entry.entry(spark).columns == ["outcome", "n", "share"]
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalog.COVERS) == set(catalog.QUERIES)


def test_tasks_do_not_grow_with_the_tables(spark):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64MB")
    if os.path.isdir(SF):
        catalog.QUERIES["corpus_table"](spark, SF)
        assert all(spark.conf.get(k) == v for k, v in session.SIZES.items())
    many = workload.dealt(spark.range(7 * workload.ROWS_PER_TASK - 5))
    assert many.rdd.getNumPartitions() == max(7, spark.sparkContext.defaultParallelism) and many.count() == 7 * workload.ROWS_PER_TASK - 5
