"""Queries against their own SQL on odd rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.queries import QUERIES, SQL


def both(spark, tmp_path, query, **tables):
    """Sorted rows of a query and of its SQL; tables are DataFrames by name."""
    con = duckdb.connect()
    for name, df in tables.items():
        df.coalesce(2).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    out = QUERIES[query](spark, str(tmp_path))
    found = con.execute(SQL[query])
    at = [out.columns.index(d[0]) for d in found.description]
    assert len(at) == len(out.columns)
    key = lambda r: [(x is None, x) for x in r]
    return sorted(([r[i] for i in at] for r in out.collect()), key=key), sorted((list(r) for r in found.fetchall()), key=key)


def test_page_plain_text_follows_its_sql(spark, tmp_path):
    texts = ["<p>a &amp; b &amp", "x &copy y &#65; &eacute; &amp;lt; &amp;copy;", "a\u2009b\u00a0\u3000c\x0bd\x85e", None, "", "<script>x</script> &nbsp;<b>z</b> &quot"]
    pages = spark.createDataFrame(list(enumerate(texts)), "page_id long, html string").withColumn("url", F.lit("u"))
    got, want = both(spark, tmp_path, "page_plain_text", pages=pages)
    assert got == want and len(got) == 6


def test_plain_text_decodes_what_html_does(spark):
    row = spark.createDataFrame([("x &copy y &#65; &eacute; &amp;lt; a\u2009b &amp",)], "html string")
    assert row.select(T.plain_text(F.col("html"))).first()[0] == "x © y A é &lt; a b &"


ODD = ["a, b and c. (The end!)) Of it?  ", None, "", " \t\n ", "Nation of the runner, slowly. " * 3, "été Éa ２３ x1 — «y» a b c", "z" * 50 + " . . ! ) next", "the\fof\r\n\r\nthe  "]


def odd(spark):
    docs = [(i, t, "en", f"src{i % 2}", len(t or "")) for i, t in enumerate(ODD)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("query", ["tokenize_documents", "phrase_decisions", "phrase_spans", "phrase_lines", "boundary_scores", "boundary_differences", "tree_nodes", "tree_edges"])
def test_odd_texts_follow_the_sql(spark, tmp_path, query):
    got, want = both(spark, tmp_path, query, documents=odd(spark))
    assert got == want and got


@pytest.mark.parametrize("query, most", [("boundary_differences", 1), ("phrase_spans", 1), ("phrase_lines", 1), ("tree_edges", 1), ("tree_nodes", 1)])
def test_tokens_are_sorted_once_and_never_kept(spark, tmp_path, query, most):
    """Several sorts and windows in one task are what ran out of memory."""
    odd(spark).write.parquet(f"{tmp_path}/documents.parquet")
    plan = QUERIES[query](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [doc_id") <= most and "ExistingRDD" not in plan
