"""Hand-made cases of the cleaning functions and predicates."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from papyrine.functions import clean, rules, text
from papyrine.functions.journals import journals_by_field, registry, registry_rows
from papyrine.functions.markdown import front_matter, heading, source_links
from papyrine.functions.pagetext import extract_abstract, with_abstract
from papyrine.functions.stem import porter


def one(spark, values, fn, schema="string"):
    """fn(column) for each value, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {schema}")
    return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_clean_title(spark):
    got = one(spark, ["A &amp;amp; B", "<i>x</i>  y\n", None, "", "p < 0.05 <!-- c --> &#233;", "a b"], clean.clean_title)
    assert got == ["A & B", "x y", None, "", "p < 0.05 é", "a b"]


def test_format_authors(spark):
    schema = "array<struct<given:string,family:string>>"
    cases = [[("Ray", "Ball")], [(None, "Ball"), ("", "Brown")], [("Ray", None)], [], None]
    assert one(spark, cases, clean.format_authors, schema) == ["Ray Ball", "Ball; Brown", "", "Unknown", "Unknown"]


def test_titles_and_years(spark):
    assert one(spark, [["a", "b"], [], None], clean.joined_title, "array<string>") == ["a b", "", "No Title Available"]
    schema = "struct<`date-parts`:array<array<int>>>"
    cases = [([[2020, 5]],), ([[None]],), ([[0]],), ([],), ([[]],), None]
    assert one(spark, cases, clean.issued_year, schema) == [2020, None, None, None, None, None]


def test_normalize_doi(spark):
    cases = ["https://doi.org/10.1/X", " DOI:10.1/x ", "doi:https://doi.org/10.1/x", "", None, "http://doi.org/doi:10/y"]
    assert one(spark, cases, clean.normalize_doi) == ["10.1/x", "10.1/x", "https://doi.org/10.1/x", None, None, "10/y"]


def test_reconstruct_abstract(spark):
    cases = [{"b": [1, 5], "a": [0]}, {"x": [0], "y": [0, 2]}, {}, None]
    schema = "map<string,array<int>>"
    assert one(spark, cases, clean.reconstruct_abstract, schema) == ["a b b", "y y", None, None]
    assert one(spark, ["x" * 39, " " + "x" * 40 + " "], clean.accepted_abstract) == [None, "x" * 40]


def test_last_names(spark):
    cases = ["Ball, Ray; Brown, Philip", "Ray Ball", ";;", None, " Anna  de Witt ;X"]
    assert one(spark, cases, clean.author_last_names) == [["ball", "brown"], ["ball"], [], [], ["witt", "x"]]


def test_slugs(spark):
    assert one(spark, ["Müller-Ñandú", "ﬁne", "Ａb", "Łódź", "é"], text.ascii_slug) == ["mullernandu", "fine", "ab", "odz", "e"]
    assert one(spark, ["10.1/a\\b"], clean.doi_slug) == ["10.1_a_b.pdf"]


def test_bib_key_base(spark):
    df = spark.createDataFrame(
        [("Ball, Ray; Brown, P", 2023, "Earnings and prices"), (None, 2020, "On the"), ("李", 2020, "Why do it"), ("A Ünal", 1999, "The 3D print")],
        "a string, y int, t string",
    )
    got = [r[0] for r in df.select(clean.bib_key_base(F.col("a"), F.col("y"), F.col("t"))).collect()]
    assert got == ["ball2023earnings", "unknown2020paper", "unknown2020paper", "unal1999print"]


def test_addresses(spark):
    cases = ["https://x/papers.cfm?abstract_id=12", "https://x/abstract=13", "http://x/abstract/14", "http://x?abstractid=15&abstract=16", "none", None]
    assert one(spark, cases, clean.url_paper_id) == ["12", "13", "14", "16", None, None]


def test_head_text_and_fraction(spark):
    assert one(spark, ["a" * 99, "a " * 60], clean.head_text) == [None, ("a " * 60).strip()]
    df = spark.createDataFrame([("Li, A; Wu, B", "A reliable text"), ("", "x"), (None, "x")], "a string, t string")
    loose = [r[0] for r in df.select(clean.author_fraction(F.col("a"), F.col("t"))).collect()]
    strict = [r[0] for r in df.select(clean.author_fraction(F.col("a"), F.col("t"), whole_words=True)).collect()]
    assert loose == [0.5, 0.0, 0.0] and strict == [0.0, 0.0, 0.0]


TITLES = {
    "Analyst Coverage": False,
    "Front Matter": False,
    "Editorial": False,
    "Editorials in Finance": True,
    "Volume 45 Issue 3": False,
    "Volume effects": True,
    "Announcements and News": False,
    "Earnings Announcements": True,
    "Issue 3": False,
    "Contents": False,
}


def test_valid_article(spark):
    def valid(mode="substring"):
        return lambda t: rules.is_valid_article(F.lit("journal-article"), t, F.lit("10/x"), mode)

    assert one(spark, list(TITLES), valid()) == list(TITLES.values())
    assert one(spark, ["Analyst Coverage", "Cover"], valid("word")) == [True, False]
    with pytest.raises(ValueError):
        one(spark, ["x"], valid("other"))
    df = spark.createDataFrame([("book", "10/x"), ("proceedings-article", None), (None, "10/x"), ("proceedings-article", "10/x")], "k string, d string")
    got = [r[0] for r in df.select(rules.is_valid_article(F.col("k"), F.lit("T"), F.col("d"))).collect()]
    assert got == [False, False, False, True]
    assert one(spark, ["Volume effects", "Issue 3", "Editorials"], rules.is_cleanup_title) == [True, True, False]


def test_page_class(spark):
    cases = ["cloudflare CHALLENGE", "challenge", "Access Denied", "access denied", "x __CF_BM"]
    assert one(spark, cases, rules.page_class) == ["cloudflare_challenge", "ok", "ip_blocked", "ok", "cloudflare_challenge"]


def test_front_matter(spark):
    page = '---\na: 1\nb: "x: y"\na: 2\r\nnone\n---\nc: 3'
    got = one(spark, [page, "no", "---\nk: v", "---\nnone\n---", None], front_matter)
    assert got == [{"a": "2", "b": "x: y"}, {}, {"k": "v"}, {}, {}]
    assert one(spark, ["x\n# Head \ny", "## no"], heading) == ["Head", None]
    assert one(spark, ["sources/a1.md sources/b.md sources/a1.md sources/B.md"], source_links) == [["a1", "b"]]


LONG = "word " * 12


@pytest.mark.parametrize(
    "page, expected",
    [
        (f'<div class="x abstract-text"><h3>Abstract</h3><p>{LONG}</p><p>end</p></div>', LONG.strip() + " end"),
        (f'<div class="abstract-text">Abstract {LONG}</div>', LONG.strip()),
        (f"<section><h3>The Abstract</h3><p>{LONG}<br>x</p></section>", LONG.strip() + "x"),
        (f'<div class="paper-Abstract">Abstract<b>{LONG}</b></div>', LONG.strip()),
        (f"<div><b>Abstract</b><p>{LONG}</p><ul></ul><p>b</p><h4>K</h4><p>no</p></div>", LONG.strip() + " b"),
        ('<div class="abstract-text"><p>' + "x" * 50 + "</p></div>", None),
        ("<p>nothing here</p>", None),
        (f"<div class=abstract-text><p>{LONG}", LONG.strip()),
    ],
)
def test_extract_abstract(page, expected):
    assert extract_abstract(page) == expected


def test_with_abstract(spark):
    df = spark.createDataFrame([(f'<div class="abstract-text"><p>{LONG}</p></div>',), (None,), ("<p>x</p>",)], "html string")
    assert [r.abstract for r in with_abstract(df).collect()] == [LONG.strip(), None, None]


def test_registry(spark):
    rows = registry_rows()
    assert len(rows) == 35 and len({r[1] for r in rows}) == 35
    journals = registry(spark)
    assert journals_by_field(journals, "Finance").count() == 8 and journals_by_field(journals, "all").count() == 35
    with pytest.raises(ValueError):
        journals_by_field(journals, "physics")


def test_porter():
    cases = dict(caresses="caress", ponies="poni", agreed="agre", hopping="hop", happy="happi", relational="relat", electrical="electr", adoption="adopt", controll="control", sky="sky")
    assert {w: porter(w) for w in cases} == cases


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="aé B.-7\n", max_size=20), min_size=1, max_size=8))
def test_token_forms_agree(spark, texts):
    """Tokens, their counts and the token count by blanks tell the same story."""
    from papyrine.operators.search import document_length

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = text.tokens(F.col("t"))
    for row in df.select(found.alias("f"), text.term_counts(found).alias("c"), document_length(F.col("t")).alias("n")).collect():
        assert row.n == len(row.f)
        assert {c.term: c.tf for c in row.c or []} == {t: row.f.count(t) for t in row.f}


def test_abstract_by_string_search(spark):
    """The first string in document order counts, comments included."""
    nested = f"<div><b>Abstract</b><p>{LONG}</p> Abstract</div><p>outer {LONG}</p>"
    comment = f"<body><div><!-- Abstract --></div><p>{LONG}</p></body>"
    df = spark.createDataFrame([(1, nested), (2, comment)], "i int, html string")
    assert [r.abstract for r in with_abstract(df).orderBy("i").collect()] == [LONG.strip(), LONG.strip()]
