"""Whole jobs on a small corpus, sources on disk, versioned tables, and streams."""

import json
import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from papyrine import schemas
from papyrine.functions.journals import registry
from papyrine.operators.search import StoredIndex, build_postings
from papyrine.plans import flows
from papyrine.session import materialise, scratch_path, scratch_scope
from papyrine.sources import metadata, pages, tables
from papyrine.streaming import incremental


def ts(text):
    return F.lit(text).cast("timestamp")


NOW = "2024-02-01"
ABSTRACT = "We study how taxes change what firms do, at length, in many words and places."


def work(doi, title, year=2020, kind="journal-article", **more):
    author = [{"given": "Ray", "family": "Ball"}, {"family": "Brown"}]
    return {"type": kind, "DOI": doi, "title": [title], "author": author, "issued": {"date-parts": [[year, 1]]}, "publisher": "P", **more}


@pytest.fixture
def corpus(spark):
    def empty(schema):
        return spark.createDataFrame([], schema)

    articles = spark.createDataFrame(
        [
            ("10/a", "Taxes and what firms do", "Ray Ball", 2020, "i", "J", "P", None, None),
            ("10/b", "Banks in bad times", "Brown, Philip", 2021, "i", "J", "P", None, None),
            ("10/c", "Front matter", "Unknown", 2019, "i", None, "P", None, None),
        ],
        schemas.ARTICLES,
    )
    return flows.Tables(
        articles,
        empty(schemas.PAGES),
        empty(schemas.FILES),
        empty(schemas.CANDIDATES),
        empty(schemas.PUBLISHED),
        empty(schemas.LOG),
        empty(schemas.RUNS),
    )


def test_collect_from_dumps(spark, corpus, tmp_path):
    dump = tmp_path / "dumps"
    dump.mkdir()
    works = [work("10/a", "Taxes &amp; firms"), work("10/n", "New <i>one</i>"), work("10/x", "Cover"), work("10/y", "A book", kind="book"), work("10/z", "No year", year=None)]
    (dump / "cache_0022-1082_2020.json").write_text(json.dumps(works))
    (dump / "cache_0022-1082_2021.json").write_text("[{broken")
    raw = metadata.read_dumps(spark, str(dump))
    assert [tuple(r) for r in metadata.broken_dumps(raw).collect()] == [("0022-1082", 2021)]
    read = metadata.readable(raw)
    assert {(r.issn, r.dump_year) for r in read.select("issn", "dump_year", "DOI").collect()} == {("0022-1082", 2020)}
    after = {r.doi: r for r in flows.collect(corpus, read, registry(spark), ts(NOW)).articles.collect()}
    assert set(after) == {"10/a", "10/b", "10/c", "10/n"}
    assert after["10/a"].title == "Taxes & firms" and after["10/a"].authors == "Ray Ball; Brown" and after["10/a"].journal_name == "J"
    assert after["10/n"].title == "New one" and after["10/n"].journal_name == "Journal of Finance"
    pairs = spark.createDataFrame([("i", 2020), ("i", 1990)], "issn string, year int")
    assert [tuple(r) for r in metadata.not_collected(pairs, corpus.articles).collect()] == [("i", 1990)]


def test_enrich(spark, corpus):
    words = ABSTRACT.split()
    works = spark.createDataFrame(
        [("https://doi.org/10/A", {w: [i for i, x in enumerate(words) if x == w] for w in words}), ("10/b", {"short": [0]})],
        "doi string, abstract_inverted_index map<string,array<int>>",
    )
    after, counts = flows.enrich(corpus, works, ts(NOW))
    assert {r.doi: r.abstract for r in after.pages.collect()} == {"10/a": ABSTRACT}
    assert {r.outcome: r.n for r in counts.collect()} == {"updated": 1, "empty_abstract": 1, "not_found": 1, "invalid_doi": 0, "failed": 0}
    assert sorted((r.doi, r.status, r.error_message) for r in after.log.collect()) == [
        ("10/a", "success", None),
        ("10/b", "failed", "empty_abstract"),
        ("10/c", "failed", "not_found"),
    ]


def test_match_resolve_verify_publish(spark, corpus):
    html = f'<div class="abstract-text"><p>{ABSTRACT}</p></div>'
    records = spark.createDataFrame([(1, "Taxes and what firms did", "http://p/1", html), (2, "Nothing alike", "http://p/2", html)], "pos long, title string, url string, html string")
    state = flows.match_pages(corpus, records, ts(NOW))
    found = {r.doi: r for r in state.pages.collect()}
    assert found["10/a"].page_url == "http://p/1" and found["10/a"].abstract == ABSTRACT and found["10/a"].match_score >= 85
    assert found["10/b"].page_url is None and found["10/b"].error_message == "No search results found"
    assert {r.doi: r.status for r in state.log.collect()} == {"10/a": "success", "10/b": "failed", "10/c": "failed"}

    works = spark.createDataFrame([("10/b", ("http://oa/b.pdf", "http://oa/b"), None)], "doi string, best_oa_location struct<pdf_url:string,landing_page_url:string>, locations array<struct<pdf_url:string,landing_page_url:string>>")
    listings = metadata.read_listings(spark.createDataFrame([("10/c", '{"results": [{"title": "Front matter", "url": "/papers/w7"}]}'), ("10/b", "{bad")], "doi string, raw string"), "raw")
    feeds = pages.parse_feed(spark.createDataFrame([("10/b", '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/1</id><title>Banks in bad times</title><author><name>P Brown</name></author></entry></feed>')], "doi string, xml string"))
    plan = materialise(flows.fetch_plan(state, works, listings, feeds, ts("2024-01-15")), "plan")
    fetched = spark.createDataFrame([("10/b", "oa", True, None), ("10/c", "nber", True, None)], "doi string, source string, ok boolean, error string")
    state = flows.resolve(state, plan, fetched, ts(NOW))
    files = {r.doi: (r.source, r.pdf_url, r.pdf_file_path) for r in state.files.collect()}
    assert files == {"10/b": ("oa", "http://oa/b.pdf", "10_b.pdf"), "10/c": ("nber", "https://www.nber.org/system/files/working_papers/w7/w7.pdf", "10_c.pdf")}
    memo = {(r.doi, r.source): r.status for r in state.candidates.collect()}
    assert memo == {("10/b", "oa"): "downloaded", ("10/c", "oa"): "no_match", ("10/c", "nber"): "downloaded"}

    texts = spark.createDataFrame([("10/b", "Banks in bad times. By Philip Brown. " + ABSTRACT * 2), ("10/c", "zzz qqq xxx " * 20)], "doi string, text string")
    state = flows.verify_files(state, texts, ts(NOW))
    assert {r.doi: r.verify_status for r in state.files.collect()} == {"10/b": "match"}
    assert {(r.doi, r.source): r.status for r in state.candidates.collect()}[("10/c", "nber")] == "no_match"
    assert ("10/c", "verify_pdf", "mismatch") in {(r.doi, r.stage, r.status) for r in state.log.collect()}
    ids = [r.id for r in state.log.collect()]
    assert len(ids) == len(set(ids))

    state, hand_over = flows.allocate(state, spark.createDataFrame([("brown2021banks",)], "key string"), ts(NOW))
    assert [(r.bib_key, r.authors, r.target_filename) for r in hand_over.collect()] == [("brown2021banksb", ["Brown, Philip"], "10_b.pdf")]
    written = spark.createDataFrame([("brown2021banksb", "s/brown2021banksb.md", '---\nextraction_model: "m"\n---\n<!-- VERIFIER: check -->')], "key string, path string, content string")
    expected = state.published.select("doi", "bib_key")
    state = flows.publish(state, expected, written, ts(NOW))
    got = state.published.collect()
    assert [(r.status, r.analyst_model, r.extraction_depth) for r in got] == [("flagged", "m", "deep")] and got[0].ingested_at is not None
    assert flows.allocate(state, spark.createDataFrame([], "key string"), ts(NOW))[1].count() == 0
    lines = {(r.section, r.ord): r.line for r in flows.report(state, "none").collect()}
    assert lines[("state", "published")] == "published: 1"


def test_remove_non_articles(spark, corpus):
    assert sorted(r.doi for r in flows.remove_non_articles(corpus).articles.collect()) == ["10/a", "10/b"]


def test_versioned_table(spark, tmp_path):
    table = tables.VersionedTable(spark, str(tmp_path / "t"), "k int, v string")
    assert table.read().count() == 0 and table.latest() is None
    assert table.publish(spark.createDataFrame([(1, "a")], "k int, v string")) == 1
    assert table.publish(table.read().union(spark.createDataFrame([(2, "b")], "k int, v string"))) == 2
    assert sorted(map(tuple, table.read().collect())) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError):
        tables.VersionedTable(spark, str(tmp_path / "none")).read()


def test_page_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\nline")
    (tmp_path / "b.html").write_text("<p>\n</p>")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.7")
    (tmp_path / "d.pdf").write_bytes(b"<html>")
    (tmp_path / "f.xml").write_text('<feed><entry><id>1</id><title>T</title><author><name>A</name></author><link href="h" type="t"/></entry><entry><id>2</id></entry></feed>')
    assert [(r.key, r.content) for r in pages.read_markdown(spark, str(tmp_path)).collect()] == [("a", "# A\nline")]
    assert [r.content for r in pages.read_texts(spark, str(tmp_path)).collect()] == ["<p>\n</p>"]
    assert {r.file_name: r.valid for r in pages.file_signatures(spark, str(tmp_path)).collect()} == {"c.pdf": True, "d.pdf": False}
    assert sorted((r.id, r.title) for r in pages.read_feeds(spark, str(tmp_path / "f.xml")).collect()) == [("1", "T"), ("2", None)]
    enriched = tmp_path / "e.json"
    enriched.write_text('{"doi": "10/a", "abstract_inverted_index": {"b": [1], "a": [0]}, "best_oa_location": {"pdf_url": "u"}}\n')
    row = metadata.read_enriched(spark, str(enriched)).collect()[0]
    assert row.abstract_inverted_index == {"b": [1], "a": [0]} and row.best_oa_location.pdf_url == "u"


def test_scratch_follows_the_cluster_setting(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "a int")
    assert materialise(df, "x").collect() == df.collect()
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: {"spark.checkpoint.dir": "/shared/"}[key]))
    assert scratch_path(cluster, "x").startswith("/shared/x-")
    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master="yarn", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError):
        scratch_path(unset, "x")


def test_scratch_scope_leaves_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "a int")
    with scratch_scope(spark):
        inner = materialise(materialise(df, "x"), "y")
        paths = [f.rsplit("/", 1)[0] for f in inner.inputFiles()]
        inner.write.parquet(str(tmp_path / "result"))
        assert all(os.path.isdir(p.removeprefix("file:").replace("///", "/")) for p in paths)
    assert spark.read.parquet(str(tmp_path / "result")).count() == 1
    assert not any(os.path.exists(p.removeprefix("file:").replace("///", "/")) for p in paths)


def test_index_follows_the_tables(spark, corpus, tmp_path, rows):
    """Collected, renamed and removed articles: the index equals a rebuilt one, and each refresh writes the changes."""
    index = StoredIndex(spark, str(tmp_path / "titles"), "doi", buckets=4)
    titles = lambda state: build_postings(state.articles, "doi", "title")
    assert flows.refresh_index(index, corpus.articles.limit(0), corpus.articles, "title") == 0
    works = spark.createDataFrame([("journal-article", "10/a", "P", ["Taxes renamed"], None, ([[2020]],), "i"), ("journal-article", "10/n", "P", ["A new one"], None, ([[2021]],), "i")], metadata.WORK + ", issn string")
    journals = spark.createDataFrame([("i", "J")], "issn string, name string")
    after = flows.collect(corpus, works, journals, ts(NOW))
    assert flows.refresh_index(index, corpus.articles, after.articles, "title") == 2  # the small segments are merged
    assert rows(index.postings()) == rows(titles(after))
    assert flows.refresh_index(index, after.articles, after.articles, "title") is None
    left = flows.remove_non_articles(after)
    flows.refresh_index(index, after.articles, left.articles, "title")
    assert rows(index.postings()) == rows(titles(left)) and index.size().first().n_docs == left.articles.count()
    assert [r.doi for r in index.search(["renamed"]).collect()] == ["10/a"]


def test_stream_collects_only_new_files(spark, tmp_path):
    incoming, seen = tmp_path / "in", []
    incoming.mkdir()
    (incoming / "cache_0022-1082_2020.json").write_text(json.dumps([work("10/a", "One")]))

    def run():
        stream = incremental.stream_dumps(spark, str(incoming))
        incremental.collect(stream, registry(spark), lambda batch, n: seen.extend(r.doi for r in batch.collect()), str(tmp_path / "cp")).awaitTermination()

    run()
    (incoming / "cache_0022-1082_2021.json").write_text(json.dumps([work("10/b", "Two")]))
    run()
    run()
    assert seen == ["10/a", "10/b"]


def test_broken_dumps_are_collected_again(spark, tmp_path):
    incoming, again, seen = tmp_path / "in", [], []
    incoming.mkdir()
    (incoming / "cache_0022-1082_2020.json").write_text("[{broken")
    (incoming / "notes.txt").write_text("no dump")

    def run(**more):
        stream = incremental.stream_dumps(spark, str(incoming))
        incremental.collect(stream, registry(spark), lambda batch, n: seen.extend(r.doi for r in batch.collect()), str(tmp_path / "cp"), **more).awaitTermination()

    with pytest.raises(Exception, match="unreadable dumps"):
        run()
    run(again=lambda rows, n: again.extend(map(tuple, rows.collect())))
    assert again == [("0022-1082", 2020)] and seen == []
    (incoming / "again").mkdir()
    (incoming / "again" / "cache_0022-1082_2020.json").write_text(json.dumps([work("10/a", "One")]))
    run(again=lambda rows, n: again.extend(map(tuple, rows.collect())))
    assert again == [("0022-1082", 2020)] and seen == ["10/a"]


def test_late_log_rows_are_kept(spark, tmp_path):
    source, path = tmp_path / "log", str(tmp_path / "stored")
    kind = "id long, doi string, processed_at timestamp"

    def deliver(rows, number):
        df = spark.createDataFrame(rows, "id long, doi string, at string").selectExpr("id", "doi", "cast(at as timestamp) as processed_at")
        df.write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(kind).parquet(str(source))
        incremental.append_once(stream, path, str(tmp_path / "cp")).awaitTermination()

    deliver([(1, "a", "2024-02-10"), (1, "a", "2024-02-10"), (2, "b", None)], 0)
    deliver([(3, "c", "2023-01-01"), (1, "a", "2024-02-10"), (2, "b", None)], 1)
    assert sorted((r.id, r.doi) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "b"), (3, "c")]


def test_fetch_outcomes(spark):
    plan = spark.createDataFrame([("a", "oa", 0, "u1"), ("a", "nber", 1, "u2"), ("a", "arxiv", 2, "u3"), ("b", "oa", 0, None), ("b", "nber", 1, "u4"), ("c", "oa", 0, "u5")], "doi string, source string, priority int, pdf_url string")
    fetched = spark.createDataFrame([("a", "oa", False, "HTTP 500"), ("a", "nber", True, None), ("a", "arxiv", True, None), ("b", "nber", False, "no file"), ("b", "nber", False, "again")], "doi string, source string, ok boolean, error string")
    got = {(r.doi, r.source): (r.status, r.error_message) for r in flows.fetch_outcomes(plan, fetched).collect()}
    assert got == {("a", "oa"): ("error", "HTTP 500"), ("a", "nber"): ("downloaded", None), ("b", "oa"): ("no_match", None), ("b", "nber"): ("error", "again")}


def test_fetch_plan_finds_works_by_normalised_doi(spark, corpus):
    works = spark.createDataFrame([("https://doi.org/10/B", ("http://oa/b.pdf", None), None), ("doi:10/b", ("http://oa/b2.pdf", None), None)], "doi string, best_oa_location struct<pdf_url:string,landing_page_url:string>, locations array<struct<pdf_url:string,landing_page_url:string>>")
    state = flows.match_pages(corpus, spark.createDataFrame([], "pos long, title string, url string, html string"), ts(NOW))
    listings = spark.createDataFrame([], "doi string, results array<struct<title:string,url:string>>")
    feeds = pages.parse_feed(spark.createDataFrame([], "doi string, xml string"))
    plan = flows.fetch_plan(state, works, listings, feeds, ts("2024-01-15")).filter("source = 'oa' and doi = '10/b'").collect()
    assert [r.pdf_url for r in plan] == ["http://oa/b.pdf"]


def test_version_claims(spark, tmp_path):
    one = tables.VersionedTable(spark, str(tmp_path / "t"), "k int")
    two = tables.VersionedTable(spark, str(tmp_path / "t"), "k int")
    rows = spark.createDataFrame([(1,)], "k int")
    two.latest = lambda: None  # read before the other writer was done
    assert one.publish(rows) == 1
    with pytest.raises(Exception, match="exists"):
        two.publish(rows)
    assert one.read().count() == 1
