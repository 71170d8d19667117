"""A key that holds a third of all rows: plans keep it out of single tasks, and results stay whole."""

import contextlib
import io

from pyspark.sql import functions as F

from papyrine.catalog import QUERIES
from papyrine.operators import matching, queues, upsert
from papyrine.operators.common import key_set

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("simple")
    return out.getvalue()


def hot_log(spark, n=6000):
    doi = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("d"), F.col("id") % 500))
    return spark.range(n).select(
        "id", doi.alias("doi"), F.lit("download_pdf").alias("stage"), F.lit("unavailable").alias("status")
    )


def test_anti_join_side_is_combined_first(spark):
    """The log's hot key reaches the join as one row per task."""
    p = plan(key_set(hot_log(spark), "doi"))
    assert p.count("HashAggregate") == 2 and p.index("Exchange") > p.index("HashAggregate")
    articles = spark.createDataFrame([("hot", "t", "a", 2000, "j"), ("zz", "t", "a", 2000, "j")], "doi string, title string, authors string, year int, journal_name string")
    pages = spark.createDataFrame([("hot", "u"), ("zz", "u")], "doi string, page_url string")
    files = spark.createDataFrame([], "doi string")
    assert [r.doi for r in queues.fallback_queue(articles, pages, files, hot_log(spark)).collect()] == ["hot"]


def test_many_changes_of_one_key(spark):
    current = spark.createDataFrame([("hot", "old", "x")], "doi string, title string, authors string")
    current = current.withColumn("created_at", F.current_timestamp()).withColumn("updated_at", F.current_timestamp())
    changes = hot_log(spark).select("doi", F.concat(F.lit("t"), "id").alias("title"), F.lit("y").alias("authors"), F.col("id").alias("ord"))
    got = {r.doi: r.title for r in upsert.upsert_articles(current, changes, F.current_timestamp()).collect()}
    assert got["hot"] == "t5997" and len(got) == 1 + 500


def test_copies_of_one_title(spark):
    """A third of the articles and of the records share one title: all of them are matched."""
    title = F.when(F.col("id") % 3 == 0, F.lit("The cost of capital")).otherwise(F.concat(F.lit("Paper number x"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")))
    articles = spark.range(900).select(F.concat(F.lit("a"), "id").alias("doi"), title.alias("title"))
    records = spark.range(900).select(F.col("id").alias("pos"), title.alias("title"))
    for budget in (50, 10**9):
        found = matching.title_match(articles, records, 99.0, 8, pair_budget=budget)
        hot = found.join(articles.filter("title = 'The cost of capital'"), "doi")
        assert hot.count() == 300 and hot.filter("pos = 0 and match_score = 100").count() == 300
        assert found.count() == 900


def test_no_products(spark):
    """No registered query has a product of two tables; only ungrouped totals, which are one row, meet every row."""
    for name, query in QUERIES.items():
        if "stream" in name or name == "scan_metadata":
            continue
        lines = plan(query(spark, FOLDER)).splitlines()
        assert not [x for x in lines if "CartesianProduct" in x], name
        for i, line in enumerate(lines):
            if "BroadcastNestedLoopJoin" in line:
                depth = line.index("BroadcastNestedLoopJoin")
                exchange = next(x for x in lines[i + 1 :] if "BroadcastExchange" in x and x.index("BroadcastExchange") == depth + 3)
                below = [x for x in lines[lines.index(exchange, i) + 1 :] if not ("Project" in x or "Filter" in x)][0]
                assert "Aggregate(keys=[]" in below, (name, below)
