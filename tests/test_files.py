"""Array files cut into pieces, files named by a column, and pages of texts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from papyrine.operators import verify
from papyrine.plans import flows
from papyrine.sources import arrays, files, metadata
from papyrine.streaming import incremental
from tests.test_flows import NOW, corpus, ts, work  # noqa: F401


def tricky(rnd, n):
    """Works whose strings hold quotes, backslashes, braces and brackets, some of them empty or deep."""
    bits = ['"', "\\", "\\\\", "{", "}", "[", "]", "},{", '\\"', ",", " ", "é", "𝕏", "tax", "\n"]
    for i in range(n):
        noise = "".join(rnd.choices(bits, k=rnd.randint(0, 40)))
        yield work(f"10/{i}", noise, year=2000 + i % 20, nested={"a": [{"b": noise}, [], {}]}, DOI2="\\" * rnd.randint(0, 9))


@pytest.mark.parametrize("split", [7, 64, 1000, 1 << 20])
def test_pieces_equal_the_whole_file(spark, tmp_path, split):
    rnd = random.Random(split)
    n = 60 if split < 100 else 400
    works = list(tricky(rnd, n))
    (tmp_path / "cache_1111-1111_2020.json").write_text(json.dumps(works, indent=rnd.choice([None, 1])), "utf-8")
    (tmp_path / "cache_2222-2222_2021.json").write_text(" \n" + json.dumps(works[:5], ensure_ascii=False), "utf-8")
    (tmp_path / "cache_3333-3333_2021.json").write_text("\n".join(json.dumps(w) for w in works[:7]), "utf-8")
    (tmp_path / "cache_4444-4444_2021.json").write_text("[]")
    (tmp_path / "cache_5555-5555_2021.json").write_text("")
    found = arrays.read_objects(spark, str(tmp_path), split=split).collect()
    by_file = {}
    for r in found:
        by_file.setdefault(r.path[-19:-10], []).append((r.offset, json.loads(r.value)))
    order = lambda rows: [w for _, w in sorted(rows, key=lambda x: x[0])]
    assert order(by_file["1111-1111"]) == works and order(by_file["2222-2222"]) == works[:5] and order(by_file["3333-3333"]) == works[:7]
    assert len(by_file) == 3
    if split == 1000:
        whole = metadata.read_dumps(spark, str(tmp_path)).filter("issn < '3'").drop("_corrupt_record")
        cut = metadata.read_array_dumps(spark, str(tmp_path), split=split).filter("issn < '3'").drop("_corrupt_record", "offset")
        assert whole.columns == cut.columns and whole.exceptAll(cut).count() == cut.exceptAll(whole).count() == 0
        assert arrays.pieces(spark, spark.createDataFrame([(str(tmp_path / "cache_1111-1111_2020.json"), 10_000)], "path string, length long"), 1000).count() == 10


def test_broken_objects_are_told_with_their_place(spark, tmp_path):
    good = json.dumps(work("10/a", "One"))
    text = f"[{good}, {{\"DOI\": 10/b}}, {good}, {{\"DOI\": \"cut off"
    (tmp_path / "cache_0022-1082_2020.json").write_text(text)
    (tmp_path / "cache_0022-1082_2021.json").write_text("[{broken")
    works = metadata.read_array_dumps(spark, str(tmp_path), split=50)
    assert metadata.readable(works).filter("DOI is not null").count() == 2
    broken = {(r.dump_year, r.offset) for r in works.filter("_corrupt_record is not null").collect()}
    assert broken == {(2020, text.index("{\"DOI\": 10/b")), (2020, text.index("{\"DOI\": \"cut")), (2021, 1)}
    assert sorted(map(tuple, metadata.broken_dumps(works).collect())) == [("0022-1082", 2020), ("0022-1082", 2021)]


def test_array_files_as_a_stream(spark, tmp_path):
    incoming, seen = tmp_path / "in", []
    incoming.mkdir()
    registry = spark.createDataFrame([("0022-1082", "J")], "issn string, name string")

    def run():
        stream = incremental.stream_array_files(spark, str(incoming))
        apply = lambda batch, n: seen.extend(r.doi for r in batch.collect())
        incremental.collect(stream, registry, apply, str(tmp_path / "cp"), parse=incremental.array_batch).awaitTermination()

    (incoming / "cache_0022-1082_2020.json").write_text(json.dumps([work("10/a", "One"), work("10/b", "Two")]))
    run()
    (incoming / "cache_0022-1082_2021.json").write_text(json.dumps([work("10/c", "Three")]))
    run()
    assert sorted(seen) == ["10/a", "10/b", "10/c"]
    told = metadata.unregistered(metadata.read_array_dumps(spark, str(incoming)), registry.filter("issn = 'x'"))
    assert [tuple(r) for r in told.collect()] == [("0022-1082", 3)]
    articles = spark.createDataFrame([("0022-1082", 2020)], "journal_issn string, year int")
    assert [tuple(r) for r in metadata.not_collected(spark.createDataFrame([("0022-1082", 2020), ("0022-1082", 2022)], "issn string, year int"), articles).collect()] == [("0022-1082", 2022)]


def test_files_by_path(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "BATCH", 10)
    rows = spark.createDataFrame([(i, f"d{i % 3}/p{i}.html", f"text {i} é" if i % 4 else None) for i in range(20)], "k int, path string, content string")
    assert files.write_texts(rows, str(tmp_path)).count() == 15
    (tmp_path / "d0" / "bad.html").write_bytes(b"\xff\xfeok")
    (tmp_path / "d0" / "dir.html").mkdir()
    asked = rows.drop("content").unionByName(spark.createDataFrame([(90, "d0/bad.html"), (91, "d0/dir.html"), (92, None), (93, "none/x.html")], "k int, path string"))
    got = {r.k: (r.content, r.scan_status) for r in files.read_paths(asked, "file:" + str(tmp_path)).collect()}
    assert len(got) == 24
    for i in range(20):
        assert got[i] == ((f"text {i} é", "found") if i % 4 else (None, "file_not_found"))
    assert got[90][1] == "found" and got[90][0].endswith("ok") and got[91] == (None, "unreadable")
    assert got[92] == got[93] == (None, "file_not_found")


PAGES = ["Some other paper. By Nobody Else. " * 5, "More of the same introduction. " * 5, "", *["Text of a page. " * 9] * 5, "References: Taxes and what firms do, Ray Ball"]


def test_citing_a_paper_is_no_match(spark, corpus):  # noqa: F811
    """The article's title and author on page 9 don't count, on page 2 they do."""
    queue = spark.createDataFrame([("10/a", "x", "pending"), ("10/b", "y", "pending")], "doi string, source string, verify_status string")
    stored = corpus.files.unionByName(queue, allowMissingColumns=True)
    own = ["Banks in bad times by Philip Brown. " * 4, "", *PAGES[3:]]
    texts = spark.createDataFrame([("10/a", "\f".join(PAGES)), ("10/b", "\f".join(own))], "doi string, text string")
    state = flows.verify_files(flows.replace(corpus, files=stored), texts, ts(NOW))
    assert {r.doi: r.verify_status for r in state.files.collect()}.get("10/b") == "match"
    assert "match" not in {r.verify_status for r in state.files.filter("doi = '10/a'").collect()}


def test_page_table(spark, tmp_path):
    texts = spark.createDataFrame([("a", "\f".join(PAGES)), ("b", "short\fpage"), ("c", "one page " * 20), ("d", None)], "doi string, text string")
    verify.page_table(texts).sortWithinPartitions("page_no").write.parquet(str(tmp_path / "pages"))
    stored = spark.read.parquet(str(tmp_path / "pages"))
    assert stored.filter("doi = 'a'").count() == 9
    heads = verify.page_heads(stored)
    assert "LessThanOrEqual(page_no,2)" in heads._jdf.queryExecution().executedPlan().toString()
    got = {r.doi: r.text for r in heads.collect()}
    assert "References" not in got["a"] and got["a"].startswith("Some other") and "introduction" in got["a"]
    assert got["b"] is None and got["c"] == ("one page " * 20).strip() and "d" not in got
    direct = {r.doi: r.text for r in texts.select("doi", verify.head_text(F.col("text"), pages=2).alias("text")).collect()}
    assert {k: v for k, v in direct.items() if k != "d"} == got
