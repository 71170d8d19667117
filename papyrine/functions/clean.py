"""Cleaning of record fields: titles, authors, identifiers, abstracts, addresses."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from papyrine.functions.text import ascii_slug, fold, let, squeeze, strip

# Words never used as the title word of a citation key.
KEY_STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "can", "do", "does", "for", "from", "how",
    "in", "is", "it", "its", "no", "not", "of", "on", "or", "the", "their", "there", "this", "to",
    "under", "what", "when", "which", "who", "why", "with",
]

# Where a paper number stands in an address, in order of preference.
PAPER_ID_PATTERNS = [r"abstract_id=(\d+)", r"abstract=(\d+)", r"/abstract/(\d+)", r"abstractid=(\d+)"]

# DOI prefixes removed, in order, once each.
DOI_PREFIXES = ["https://doi.org/", "http://doi.org/", "doi:"]

MIN_ABSTRACT = 40
MISSING_TITLE = "No Title Available"
UNKNOWN = "Unknown"


@F.pandas_udf(StringType())
def _unescape_twice(text: pd.Series) -> pd.Series:
    return text.map(lambda t: html.unescape(html.unescape(t)), na_action="ignore")


def drop_markup(col: Column) -> Column:
    """Remove comments, declarations and tags. A '<' that starts no tag stays, as in 'p < 0.05'."""
    return F.regexp_replace(col, r"(?s)<!--.*?-->|<[/]?[A-Za-z][^>]*>|<[!?][^>]*>", "")


def clean_title(col: Column) -> Column:
    """Title without tags and character references, white space collapsed; NULL and '' stay as they are.

    References are decoded twice, in Arrow batches; titles without an ampersand go along as NULL and cost no decoding.
    """
    bare = drop_markup(col)
    decoded = _unescape_twice(F.when(F.contains(col, F.lit("&")), bare))
    return squeeze(F.coalesce(decoded, bare))


def joined_title(parts: Column) -> Column:
    """Title parts joined by a blank; a missing list becomes the placeholder, an empty one ''."""
    return F.array_join(F.coalesce(parts, F.array(F.lit(MISSING_TITLE))), " ")


def issued_year(issued: Column) -> Column:
    """First number of the first date part; NULL when absent or zero."""
    year = F.get(F.get(issued.getField("date-parts"), F.lit(0)), F.lit(0))
    return F.when(year != 0, year)


def format_authors(authors: Column) -> Column:
    """'given family' or 'family' joined by '; '. No list: 'Unknown'; a list without family names: ''."""

    def name(author: Column) -> Column:
        given, family = F.coalesce(author["given"], F.lit("")), F.coalesce(author["family"], F.lit(""))
        return F.when((given != "") & (family != ""), F.concat_ws(" ", given, family)).when(family != "", family)

    names = F.array_join(F.filter(F.transform(authors, name), lambda n: n.isNotNull()), "; ")
    return F.when(F.size(authors) > 0, names).otherwise(F.lit(UNKNOWN))


def normalize_doi(col: Column) -> Column:
    """Trimmed lower-case DOI without resolver prefixes; blank becomes NULL."""
    doi = F.lower(strip(col))
    for prefix in DOI_PREFIXES:
        doi = F.regexp_replace(doi, "^" + prefix.replace(".", r"\."), "")
    return let(doi, lambda d: F.nullif(d, F.lit("")))


def reconstruct_abstract(index: Column) -> Column:
    """Text of a word -> positions map. A position claimed twice goes to the later word in map order."""
    placed = F.flatten(
        F.transform(
            F.map_entries(index),
            lambda entry, order: F.transform(
                entry["value"], lambda pos: F.struct(pos.alias("pos"), (-order).alias("order"), entry["key"].alias("word"))
            ),
        )
    )
    kept = let(
        F.array_sort(placed),
        lambda ordered: F.filter(ordered, lambda x, i: (i == 0) | (F.get(ordered, i - 1)["pos"] != x["pos"])),
    )
    return let(kept, lambda k: F.when(F.size(k) > 0, F.array_join(F.transform(k, lambda x: x["word"]), " ")))


def accepted_abstract(text: Column, min_length: int = MIN_ABSTRACT) -> Column:
    """The trimmed abstract when it is long enough, otherwise NULL."""
    return let(strip(text), lambda t: F.when(F.length(t) >= min_length, t))


def author_list(authors: Column) -> Column:
    """The non-blank names of a ';'-joined author string."""
    return F.filter(F.transform(F.split(authors, ";"), strip), lambda a: a != "")


def _last_name(author: Column) -> Column:
    comma = F.contains(author, F.lit(","))
    return F.when(comma, F.substring_index(author, ",", 1)).otherwise(
        F.element_at(F.split(squeeze(author), " "), -1)
    )


def author_last_names(authors: Column) -> Column:
    """Lower-case last names, for both 'Last, First' and 'First Last'; an empty array for NULL."""
    names = F.transform(author_list(F.coalesce(authors, F.lit(""))), lambda a: F.lower(strip(_last_name(a))))
    return F.filter(names, lambda n: n != "")


def bib_key_base(authors: Column, year: Column, title: Column) -> Column:
    """First author's last name, year and first telling title word, as one lower-case ASCII word."""
    first = strip(F.split_part(F.coalesce(authors, F.lit("")), F.lit(";"), F.lit(1)))
    last = F.when(first == "", F.lit("unknown")).otherwise(_last_name(first))
    telling = F.filter(
        F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit("[A-Za-z]+"), F.lit(0)),
        lambda w: (F.length(w) > 2) & ~F.lower(w).isin(KEY_STOP_WORDS),
    )
    word = F.coalesce(F.get(telling, F.lit(0)), F.lit("paper"))
    name = F.coalesce(F.nullif(ascii_slug(last), F.lit("")), F.lit("unknown"))
    return F.concat(name, year.cast("string"), F.lower(word))


def url_paper_id(url: Column) -> Column:
    """The paper number in an address: first pattern that hits, else NULL."""
    return F.coalesce(*[F.nullif(F.regexp_extract(url, pattern, 1), F.lit("")) for pattern in PAPER_ID_PATTERNS])


def doi_slug(doi: Column) -> Column:
    """File name of a DOI: both slashes become underscores."""
    return F.concat(F.translate(doi, "/\\", "__"), F.lit(".pdf"))


PAGE_BREAK = "\f"  # between the pages of a text


def head_text(text: Column, min_length: int = 100, pages: int | None = None) -> Column:
    """Squeezed text, of the first ``pages`` pages or of all; NULL when it is too short to judge."""
    first = F.substring_index(text, PAGE_BREAK, pages) if pages else text
    return let(squeeze(first), lambda t: F.when(F.length(t) >= min_length, t))


def author_fraction(authors: Column, text: Column, whole_words: bool = False) -> Column:
    """Share of the last names found in the text; 0 without names.

    Names match as substrings ('li' is found in 'reliable'); ``whole_words`` asks for a word of its own.
    """
    low = F.lower(text)
    if whole_words:
        low = F.concat(F.lit(" "), F.regexp_replace(fold(low), "[^a-z]+", " "), F.lit(" "))

    def share(names: Column) -> Column:
        asked = F.transform(names, lambda n: F.concat(F.lit(" "), fold(n), F.lit(" "))) if whole_words else names
        found = let(low, lambda t: F.size(F.filter(asked, lambda n: F.contains(t, n))))
        return F.when(F.size(names) == 0, F.lit(0.0)).otherwise(found / F.greatest(F.size(names), F.lit(1)))

    return let(author_last_names(authors), share)


def strip_tags(col: Column) -> Column:
    return strip(F.regexp_replace(col, "<[^>]+>", ""))


# Addresses of the working-paper site.
LISTING_SITE = "https://www.nber.org"
LISTING_FILES = "https://www.nber.org/system/files/working_papers/"


def listing_paper_id(url: Column) -> Column:
    return F.regexp_substr(url, F.lit(r"(?<=/papers/)w\d+"))


def listing_landing_url(url: Column) -> Column:
    return F.concat(F.lit(LISTING_SITE), url)


def listing_pdf_url(url: Column) -> Column:
    paper = listing_paper_id(url)
    return F.concat(F.lit(LISTING_FILES), paper, F.lit("/"), paper, F.lit(".pdf"))


def oa_location(best: Column, locations: Column) -> Column:
    """First location with a PDF address outside the blocked host: the best one first, then list order."""
    ranked = F.concat(
        F.when(best.isNotNull(), F.array(best)).otherwise(F.array().cast("array<struct<pdf_url:string,landing_page_url:string>>")),
        F.coalesce(locations, F.array().cast("array<struct<pdf_url:string,landing_page_url:string>>")),
    )
    usable = F.filter(
        ranked,
        lambda loc: (F.coalesce(loc["pdf_url"], F.lit("")) != "") & ~F.contains(loc["pdf_url"], F.lit("ssrn.com")),
    )
    return F.get(usable, F.lit(0))


def atom_pdf_url(entry_id: Column, links: Column) -> Column:
    """PDF link of a feed entry, else the abstract address turned into the PDF one, else NULL."""
    pdf = F.get(
        F.filter(
            links,
            lambda l: (F.coalesce(l["_type"], F.lit("")) == "application/pdf")
            | (F.coalesce(l["_title"], F.lit("")) == "pdf"),
        ),
        F.lit(0),
    )["_href"]
    return F.coalesce(
        F.nullif(pdf, F.lit("")),
        F.when(F.contains(entry_id, F.lit("/abs/")), F.replace(entry_id, F.lit("/abs/"), F.lit("/pdf/"))),
    )
