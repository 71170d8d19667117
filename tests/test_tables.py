"""Mutations, keys, numbering, verification and the page index on small hand-made tables."""

import pytest
from pyspark.sql import functions as F

from papyrine.operators import constraints, keys, maintenance, queues, site, stats, upsert, verify
from papyrine.operators.common import maybe_limit, spread_rank

T0, T1 = "2024-01-01", "2024-02-01"


def ts(text):
    return F.lit(text).cast("timestamp")


@pytest.fixture
def pages(spark):
    df = spark.createDataFrame(
        [("a", "u", None, True, "p"), ("b", None, "", None, None), ("c", "v", "text", False, None)],
        "doi string, page_url string, abstract string, pdf_downloaded boolean, pdf_file_path string",
    )
    return df.withColumn("scraped_at", ts(T0))


def test_fill_abstract(spark, pages):
    new = spark.createDataFrame([("a", "old", 1), ("a", "A", 2), ("b", "B", 1), ("c", "C", 1), ("d", "D", 1)], "doi string, abstract string, ord int")
    for force, c_text, c_month in ((False, "text", 1), (True, "C", 2)):
        got = {r.doi: r for r in upsert.fill_abstract(pages, new, ts(T1), force).collect()}
        assert [got[d].abstract for d in "abcd"] == ["A", "B", c_text, "D"]
        assert [got[d].scraped_at.month for d in "abcd"] == [2, 2, c_month, 2]
        assert got["a"].page_url == "u" and got["d"].page_url is None
    once = upsert.fill_abstract(pages, new, ts(T1))
    assert sorted(map(tuple, upsert.fill_abstract(once, new, ts(T1)).drop("scraped_at").collect())) == sorted(map(tuple, once.drop("scraped_at").collect()))


def test_reset_downloads(spark, pages):
    keyed = spark.createDataFrame([("a",), ("a",), ("x",)], "doi string")
    got = {r.doi: (r.pdf_downloaded, r.pdf_file_path) for r in upsert.reset_downloads(pages, keyed).collect()}
    assert got == {"a": (False, None), "b": (None, None), "c": (False, None)}


def test_article_upsert_keeps_the_rest(spark):
    current = spark.createDataFrame([("a", "T", "X", 2000, "i")], "doi string, title string, authors string, year int, journal_issn string")
    current = current.withColumn("created_at", ts(T0)).withColumn("updated_at", ts(T0))
    new = spark.createDataFrame([("a", "T2", "Y", 2010, "j"), ("b", "N", "Z", 2011, "k")], "doi string, title string, authors string, year int, journal_issn string")
    got = {r.doi: r for r in upsert.upsert_articles(current, new, ts(T1)).collect()}
    assert tuple(got["a"])[1:5] == ("T2", "Y", 2000, "i") and got["a"].created_at.month == 1 and got["a"].updated_at.month == 2
    assert tuple(got["b"])[1:5] == ("N", "Z", 2011, "k") and got["b"].created_at.month == 2


def test_delete_and_constraints(spark, pages):
    articles = spark.createDataFrame([("a",), ("b",), ("b",)], "doi string")
    left, kept = upsert.delete_cascade(articles, pages, spark.createDataFrame([("b",), ("b",)], "doi string"))
    assert left.count() == 1 and sorted(r.doi for r in kept.collect()) == ["a", "c"]
    report = constraints.report(
        [("a", "unique", constraints.unique(articles, "doi")), ("p", "null", constraints.not_null(pages, "page_url")), ("p", "fk", constraints.references(pages, articles, "doi"))]
    )
    assert [r.violations for r in report.collect()] == [1, 1, 1]


def test_spread_rank_is_a_plain_rank(spark):
    """A hot group and NULL keys get the ranks one window would give."""
    from pyspark.sql import Window

    df = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") % 7 > 0, F.concat(F.lit("k"), F.col("id") % 5)).alias("g"), F.md5(F.col("id").cast("string")).alias("d")
    )
    plain = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy("d")))
    for digits in (1, 3):
        assert sorted(map(str, spread_rank(df, ["g"], F.col("d"), digits=digits).collect())) == sorted(map(str, plain.collect()))
    numbered = [r["rank"] for r in spread_rank(df, [], F.col("d")).collect()]
    assert sorted(numbered) == list(range(1, 3001))


def test_append_ids(spark):
    current = spark.createDataFrame([(7, "a")], "id long, doi string")
    rows = spark.createDataFrame([("b",), ("c",)], "doi string")
    assert sorted(r.id for r in upsert.append_with_ids(current, rows, F.md5("doi")).collect()) == [7, 8, 9]
    assert [r.id for r in upsert.append_with_ids(current.limit(0), rows.limit(1), F.md5("doi")).collect()] == [1]


def allocate(spark, records, published=(), written=()):
    queue = spark.createDataFrame(records, "doi string, authors string, year int, title string")
    pub = spark.createDataFrame(list(published), "doi string, bib_key string")
    wrt = spark.createDataFrame([(w,) for w in written], "key string")
    return {r.doi: r.bib_key for r in keys.assign_bib_keys(queue, pub, wrt).collect()}


def test_keys(spark):
    many = [(f"d{i}", "Ball", 2020, "Tax") for i in range(40)]
    got = allocate(spark, many, written=["ball2020taxc", "ball2020tax30"])
    assert len(set(got.values())) == 40 and "ball2020taxc" not in got.values() and "ball2020tax30" not in got.values()
    letters = {k for k in got.values() if k.rstrip("0123456789") == k}
    assert len(letters) == 25 and "ball2020tax31" in got.values()
    # A second run keeps every key and goes on without a clash.
    again = allocate(spark, many + [("e1", "Ball", 2020, "Tax")], published=got.items(), written=["ball2020taxc", "ball2020tax30"])
    assert all(again[d] == k for d, k in got.items()) and again["e1"] not in got.values()
    # One base equals another base plus a letter.
    clash = allocate(spark, [("a", "X", 2020, "pap"), ("b", "X", 2020, "pap"), ("c", "X", 2020, "papb"), ("d", "X", 2020, "papb")])
    assert len(set(clash.values())) == 4 and {clash["a"], clash["b"]} == {"x2020pap", "x2020papc"}


def test_verify_borders(spark):
    cases = [(s, f) for s in (55.0, 56.0, 87.0, 88.0) for f in (0.0, 0.49, 0.5)]
    rows = spark.createDataFrame([(f"{s:g}/{f:g}", "t", s, f) for s, f in cases] + [("none", None, None, None)], "doi string, text string, title_score double, author_frac double")
    first = {r.doi: r.s for r in rows.select("doi", verify.first_decision(F.col("text"), F.col("title_score"), F.col("author_frac")).alias("s")).collect()}
    assert {d for d, s in first.items() if s == "match"} == {"88/0.5"}
    assert {d for d, s in first.items() if s == "mismatch"} == {"55/0"}
    assert first["none"] == "unreadable" and first["56/0"] == first["88/0.49"] == "gray"
    raw = spark.createDataFrame(
        [("56/0", '{"match": true, "confidence": 0.7, "reason": "y"}'), ("87/0", '{"match": false, "confidence": 0.7, "reason": "n"}'), ("87/0.5", '{"match": true, "confidence": 0.69, "reason": "?"}'), ("88/0", '{"match": true}'), ("88/0.5", '{"match": false, "confidence": 1, "reason": "late"}')],
        "doi string, verdict string",
    )
    got = {r.doi: r for r in verify.verify(rows, verify.parse_verdicts(raw), "m").collect()}
    assert (got["56/0"].verify_status, got["87/0"].verify_status, got["87/0.5"].verify_status, got["88/0"].verify_status) == ("match", "mismatch", "uncertain", "uncertain")
    assert got["88/0.5"].verify_status == "match" and got["88/0.5"].verify_reason == "Title 88, authors 50%"
    assert got["87/0.5"].verify_model == "m" and (got["88/0"].verify_reason, got["88/0"].verify_method) == ("LLM call failed", "llm")
    assert got["none"].verify_reason == "No extractable text" and got["none"].verify_score is None


def test_counts(spark):
    df = spark.createDataFrame([("ok",), ("bad",), ("odd",)], "s string")
    assert {r.outcome: r.n for r in stats.outcome_counts(df, "s", ["ok", "never"]).collect()} == {"ok": 1, "never": 0, "failed": 2}
    best = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 7.0), ("a", 3, 7.0), ("b", 1, 0.0)], "doi string, pos int, s double")
    assert {r.doi: r.pos for r in stats.best_candidate(best, "doi", F.col("s"), F.col("pos")).collect()} == {"a": 2, "b": 1}
    assert maybe_limit(df, 0).count() == maybe_limit(df, None).count() == 3 and maybe_limit(df, 2).count() == 2


def test_author_wildcards(spark):
    df = spark.createDataFrame([("a", "t", "A_B", 2000, None), ("b", "t", "AxB\\", 2001, None)], "doi string, title string, authors string, year int, journal_name string")
    assert [r.doi for r in queues.search_author(df, "a_b").collect()] == ["b", "a"]
    assert [r.doi for r in queues.search_author(df, "b\\").collect()] == ["b"]


def test_index_files(spark, tmp_path):
    pages = spark.createDataFrame(
        [("J", 2001, "B", "k2", "X", "flagged"), ("J", 2002, "C", "k3", "X", "ingested"), ("I", 2001, "A", "k1", "X", "ingested"), (None, 2001, "Z", "k4", "X", "ingested")],
        "journal_name string, year int, title string, bib_key string, authors string, status string",
    )
    site.write_lines(site.index_by_journal(pages), str(tmp_path / "j"), "journal")
    text = "".join(p.read_text() for p in sorted((tmp_path / "j").glob("part-*")))
    want = "# Papers by journal||## I||- [A](../sources/k1.md) (X, 2001)||## J||- [C](../sources/k3.md) (X, 2002)|- [B](../sources/k2.md) (X, 2001) ⚑||"
    assert text == want.replace("|", "\n")
    assert [r.line for r in site.page_lines(site.index_by_journal(pages.limit(0)), "journal").collect()] == ["# Papers by journal", "", "_No papers ingested yet._", ""]
    site.write_lines(site.index_by_year(pages), str(tmp_path / "y"), "year")
    years = [line for p in sorted((tmp_path / "y").glob("part-*")) for line in p.read_text().splitlines() if line.startswith("##")]
    assert years == ["## 2002", "## 2001"]
    concepts = spark.createDataFrame([("c/x.md", "# Topic\nsources/k1.md sources/k9.md"), ("c/y.md", "nothing")], "path string, content string")
    page = [r.line for r in site.page_lines(site.index_by_topic(pages, concepts), "topic").collect()]
    assert page[:9] == ["# Papers by topic", "", "## [Topic](../concepts/x.md)", "", "- [A](../sources/k1.md) (X, 2001)", "", "## [y](../concepts/y.md)", "", "_No ingested sources linked yet._"]
    assert page[9:14] == ["", "## Unclassified", "", "_Ingested but not yet linked from any concept page._", ""] and page[14].startswith("- [C]") and len(page) == 18
    lines = [(r.section, r.line) for r in site.index_by_topic(pages, concepts).collect()]
    assert lines[:2] == [("Topic", "- [A](../sources/k1.md) (X, 2001)"), ("y", "_No ingested sources linked yet._")]
    assert [s for s, _ in lines[2:]] == ["Unclassified"] * 3 and lines[2][1].startswith("- [C]")


def test_bad_pages(spark):
    stored = spark.createDataFrame([("a", "p1"), ("b", "p2"), ("c", "p3")], "doi string, path string")
    found = spark.createDataFrame([("p1", "x" * 10), ("p2", "x" * 50), ("p9", "é" * 5)], "path string, html string")
    got = {r.path: r.page_status for r in maintenance.bad_pages(stored, found, 10, 0).collect()}
    assert got == {"p1": "size_match", "p3": "missing", "p9": "orphan"}
    assert [r.path for r in maintenance.orphan_files(stored, found, 10, 0).collect()] == ["p9"]


def test_changes_without_an_order(spark):
    current = spark.createDataFrame([("a", "old", "x")], "doi string, title string, authors string").withColumn("created_at", F.lit(None).cast("timestamp")).withColumn("updated_at", F.lit(None).cast("timestamp"))
    changes = spark.createDataFrame([("a", "one", "p"), ("a", "two", "q"), ("b", "new", "r"), ("b", "new", "r"), (None, "lost", "s")], "doi string, title string, authors string")
    first = sorted((r.doi, r.title) for r in upsert.upsert_articles(current, changes, F.lit("2024-01-01").cast("timestamp")).collect())
    again = sorted((r.doi, r.title) for r in upsert.upsert_articles(current, changes.repartition(3), F.lit("2024-01-01").cast("timestamp")).collect())
    assert [d for d, _ in first] == ["a", "b"] and first == again


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_upserts_move_no_page_text_and_few_changes_move_no_table(spark, tmp_path):
    wide = "doi string, page_url string, html string, abstract string, match_score int, error_message string, scraped_at timestamp, pdf_downloaded boolean"
    spark.createDataFrame([(str(i), None, "h" * 100, None, 1, None, None, False) for i in range(50)], wide).write.parquet(str(tmp_path / "pages"))
    pages = spark.read.parquet(str(tmp_path / "pages"))
    spark.createDataFrame([("1", "text")], "doi string, abstract string").write.parquet(str(tmp_path / "changes"))
    changes = spark.read.parquet(str(tmp_path / "changes"))
    kept = upsert.fill_abstract(pages, changes, F.lit("2024-01-01").cast("timestamp")).drop("html")
    assert "html" not in plan_of(kept)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = plan_of(upsert.fill_abstract(pages, changes, F.lit("2024-01-01").cast("timestamp")))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
