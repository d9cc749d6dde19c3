"""Every registered query against its SQL on the smallest tables."""

import glob
import os

import pytest
from oracle_check import compare

from scriptorium.plans.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


#: Measures that SQL lacks and recursive steps; their operators are tested by brute force in the other modules.
NO_SQL = {"a10_tei_sentences", "c08_pack_blocks", "d01_best_match", "d02_resolve_claims", "d03_sequence_diff",
          "d04_link_notions", "d09_resolve_title", "d10_match_page", "tei_to_chunks", "u01_ratio", "u03_fuzzy_ratios"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name not in SQL:
        assert name in NO_SQL
        QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
        return
    ok, note = compare(spark, con, QUERIES[name], SQL[name], SF)
    assert ok, note


def test_every_check_has_a_query():
    assert set(SQL) <= set(QUERIES)
