"""Row predicates and labels."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Record types that count as research articles.
ARTICLE_TYPES = ["journal-article", "proceedings-article"]

# Phrases that mark a title as no article.
NON_ARTICLE_PHRASES = [
    "front matter",
    "back matter",
    "cover",
    "covers",
    "book review",
    "books received",
    "editorial board",
    "editorial note",
    "erratum",
    "corrigendum",
    "correction",
    "retraction",
    "index to volume",
    "subject index",
    "author index",
    "table of contents",
    "masthead",
    "issue information",
    "title pages",
    "copyright page",
]

# Patterns on the lower-case title that mark it as no article.
NON_ARTICLE_PATTERNS = [
    r"^announcements?$",
    r"^announcements? and ",
    r"^editorial$",
    r"^contents",
    r"^volume \d+",
    r"^issue \d+",
]

# The looser title rules of the clean-up job.
CLEANUP_EQUAL = ["announcements", "editorial"]
CLEANUP_PREFIXES = ["announcements and", "volume ", "issue ", "contents"]

# Page markers of access challenges (lower-case text) and blocks (exact case).
CHALLENGE_MARKERS = ["data-cfasync", "cf_clearance", "__cf_bm"]
CHALLENGE_PAIR = ("challenge", "cloudflare")
BLOCK_PHRASES = ["403 Forbidden", "429 Too Many Requests", "Access Denied", "Too Many Requests"]


def any_of(conditions) -> Column:
    return reduce(or_, conditions)


def holds_phrase(title: Column, mode: str = "substring") -> Column:
    """Does the lower-case title hold a non-article phrase? 'word' asks for word borders around it."""
    if mode == "word":
        return title.rlike(r"(?U)\b(?:" + "|".join(NON_ARTICLE_PHRASES) + r")\b")
    if mode != "substring":
        raise ValueError(f"unknown mode: {mode}")
    return any_of(F.contains(title, F.lit(p)) for p in NON_ARTICLE_PHRASES)


def is_valid_article(kind: Column, title: Column, doi: Column, mode: str = "substring") -> Column:
    """Research article: right type, no non-article title, a DOI. ``title`` is the raw joined title."""
    low = F.lower(F.coalesce(title, F.lit("")))
    # '$' of the source rule also stands before a final line end; Java's default does the same.
    noise = holds_phrase(low, mode) | any_of(low.rlike(p) for p in NON_ARTICLE_PATTERNS)
    return F.coalesce(kind, F.lit("")).isin(ARTICLE_TYPES) & ~noise & (F.coalesce(doi, F.lit("")) != "")


def is_cleanup_title(title: Column) -> Column:
    """The clean-up job's rule: any phrase, an exact word, or a prefix (so 'volume effects' counts too)."""
    low = F.lower(title)
    return (
        any_of(F.contains(low, F.lit(p)) for p in NON_ARTICLE_PHRASES)
        | low.isin(CLEANUP_EQUAL)
        | any_of(low.startswith(p) for p in CLEANUP_PREFIXES)
    )


def year_between(year: Column, start: int | None, end: int | None) -> Column:
    """Range test with optional bounds."""
    test = F.lit(True)
    if start is not None:
        test = test & (year >= start)
    if end is not None:
        test = test & (year <= end)
    return test


def is_missing(text: Column) -> Column:
    """NULL or ''."""
    return text.isNull() | (text == "")


def page_class(page: Column) -> Column:
    """'cloudflare_challenge', 'ip_blocked' or 'ok' for the text of a saved page."""
    low = F.lower(page)
    challenge = any_of(F.contains(low, F.lit(m)) for m in CHALLENGE_MARKERS) | (
        F.contains(low, F.lit(CHALLENGE_PAIR[0])) & F.contains(low, F.lit(CHALLENGE_PAIR[1]))
    )
    blocked = any_of(F.contains(page, F.lit(p)) for p in BLOCK_PHRASES)
    return F.when(challenge, "cloudflare_challenge").when(blocked, "ip_blocked").otherwise("ok")


def in_size_band(text: Column, target: int = 20833, tolerance: int = 500) -> Column:
    """Is the byte length of the text within ``tolerance`` of ``target``?"""
    return F.octet_length(text).between(max(0, target) - max(0, tolerance), max(0, target) + max(0, tolerance))


def matches_any(text: Column, phrases: list[str]) -> Column:
    return any_of(F.contains(text, F.lit(p)) for p in phrases)
