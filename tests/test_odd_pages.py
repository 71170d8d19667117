"""Registered queries against their SQL on titles with cut references, quotes and blank paragraphs."""

import duckdb
import pytest

from papyrine.catalog import ORACLES, QUERIES

TITLES = ["A &amp; B &quot;C&quot; x", "cut &amp;&am", "cut &a", "cut &", "cut &amp", "&amp;lt; &amp;amp;lt; &copy; &amp;copy &lt;i&gt; a ]]> b", "plain"]
TEXTS = ['"Quoted" words and a "last one"', "erly and, x; that and, more words in a title of many", "Some & more < than > x y z a b c", 'Mid "quote" a b c d e f g h', "One two three four five six seven eight nine ten"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    # Authors without a last name: blanks, or nothing before a comma.
    blank = {3: ", , x a b c d e f g h. Rest", 63: "a  b c d e f g h i. Rest", 6: "a     b c d e f g h i. Rest"}
    docs = [(i, blank.get(i, TEXTS[i % len(TEXTS)] + ". Rest"), "en", "src", 9) for i in range(105)] + [(105, None, "en", "src", 0), (106, "x y", None, None, 3)]
    # A text of 42 letters has 50 with ' endnote', which are too few.
    pages = [(i, f"http://x/{i}", f"<html><title>{TITLES[i % len(TITLES)]}</title><h1>{TITLES[i % len(TITLES)]}</h1><p>{'y' * (40 + i % 7)}</p></html>") for i in range(35)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path


@pytest.mark.parametrize("name", ["atom_entries", "resolve_atom", "clean_title", "extract_abstract", "frontmatter"])
def test_odd_pages(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet/*.parquet')")
    df = QUERIES[name](spark, folder)
    want = con.execute(f"select {', '.join(df.columns)} from ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr) and want
