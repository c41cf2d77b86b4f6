"""The SQL of the corpus operators, and stages of the pipeline against plain versions."""

import duckdb
import pytest

pytest.importorskip("walkloom.llm")
import corpus_pipeline  # noqa: E402
from tests.test_oracles import TABLES, D, rows  # noqa: E402
from walkloom.llm import queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_operator_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    assert rows(queries.QUERIES[name](spark, D).toPandas()) == rows(con.execute(queries.ORACLES[name]).df())


def test_stages(spark, tmp_path):
    item = " ".join(f"item{k}" for k in range(30))
    spark.createDataFrame([(8, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    same = " ".join(f"word{k}" for k in range(80))
    found = [(1, f"x {item}", "en", "a", 0), (2, same, "en", "a", 0), (3, same, "de", "b", 0), (None, f"x {item}", "en", "a", 0), (4, None, "en", "a", 0), (5, "", "en", "a", 0)]
    docs = spark.createDataFrame(found, "doc_id long, text string, lang string, source string, n_chars long")

    def ids(df):
        assert df.columns == docs.columns
        return sorted(((r["doc_id"] is None, r["doc_id"] or 0) for r in df.collect()))

    leaks = ids(corpus_pipeline.drop_leaks(spark, docs, str(tmp_path)))
    assert leaks == [(False, 2), (False, 3), (False, 4), (False, 5), (True, 0)]
    near = ids(corpus_pipeline.keep_one_of_group(spark, docs, str(tmp_path)))
    assert (True, 0) in near and (False, 1) in near and sum(x in near for x in ((False, 2), (False, 3))) == 1
    lines = corpus_pipeline.drop_lines(spark, docs, str(tmp_path))
    assert lines.columns == docs.columns and lines.count() == len(found)
