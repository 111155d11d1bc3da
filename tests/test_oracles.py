"""Every query of the engine's own operators against its SQL twin, and the others for rows."""

import duckdb
import pytest

from tessera.plans.registry import ORACLE_SQL, QUERIES
from tests.conftest import assert_same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(name, spark, duck, sf_dir):
    assert_same(QUERIES[name](spark, sf_dir), duck, ORACLE_SQL[name])
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_runs(name, spark, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    assert df.columns
    df.collect()
    spark.catalog.clearCache()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_grep_hunks_ends_lines_at_line_feeds_only(spark, tmp_path):
    texts = ["the\rend of", "a\nthe\u2028of\nb\nc", "the of\r", "the of\nthe of", "the\nof", "", None]
    spark.createDataFrame([(i, t, "en", "src1") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute("SET threads = 1")  # the SQL leaves a tie open where both lines of a file match
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("grep_hunks", "grep_page"):
        assert QUERIES[name](spark, str(tmp_path)).count() == 4
        assert_same(QUERIES[name](spark, str(tmp_path)), con, ORACLE_SQL[name])
