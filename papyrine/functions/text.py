"""Whitespace, accents and tokens."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space plus the four ASCII separators that Python's str.strip also removes.
SPACE = r"(?U)[\s\x1c-\x1f]"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once.

    A column expression that appears twice, as in ``when(length(x) > 9, x)``, is worked out twice unless the
    optimizer can prove both uses unconditional; inside lambdas it is worked out per element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(col: Column) -> Column:
    """Drop leading and trailing white space of any kind (Spark's trim drops blanks only)."""
    return F.regexp_replace(col, rf"^{SPACE}+|{SPACE}+$", "")


def squeeze(col: Column) -> Column:
    """Collapse every run of white space to one blank and trim."""
    return F.trim(F.regexp_replace(col, rf"{SPACE}+", " "))


def words(col: Column) -> Column:
    """White-space separated words; an empty array for blank text."""
    return F.array_remove(F.split(squeeze(col), " "), "")


def word_count(col: Column) -> Column:
    return F.size(words(col))


def _compatibility_letters() -> tuple[dict[str, str], dict[str, str]]:
    """Characters whose compatibility decomposition holds ASCII: one-character and longer expansions."""
    single, multiple = {}, {}
    for first, last in ((0xA0, 0x24F), (0x1E00, 0x1EFF), (0x2070, 0x218F), (0xFB00, 0xFB06), (0xFF01, 0xFF5E)):
        for point in range(first, last + 1):
            char = chr(point)
            plain = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()
            if len(plain) == 1:
                single[char] = plain
            elif len(plain) > 1:
                multiple[char] = plain
    return single, multiple


_SINGLE, _MULTIPLE = _compatibility_letters()
_MARKS = "".join(chr(p) for p in range(0x300, 0x370))


def fold(col: Column) -> Column:
    """Replace accented letters by their base letter and drop combining marks. ASCII text is passed through."""
    folded = F.translate(col, "".join(_SINGLE) + _MARKS, "".join(_SINGLE.values()))
    return F.when(F.octet_length(col) == F.length(col), col).otherwise(folded)


def ascii_slug(col: Column) -> Column:
    """Lower-case ASCII letters only, after compatibility decomposition."""
    expanded = col
    for char, plain in _MULTIPLE.items():
        if plain.isalpha():
            expanded = F.replace(expanded, F.lit(char), F.lit(plain))
    rare = "[" + "".join(c for c, p in _MULTIPLE.items() if p.isalpha()) + "]"
    # The replace chain runs only for the few rows that hold a ligature.
    whole = F.when(col.rlike(rare), expanded).otherwise(col)
    return F.regexp_replace(F.lower(fold(whole)), "[^a-z]", "")


def spaced(col: Column) -> Column:
    """Analysed text with every token between blanks of its own, so that ``' t '`` occurs once per token."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(fold(col)), "[^a-z]+", "  "), F.lit(" "))


def tokens(col: Column, stop_words: list[str] | None = None) -> Column:
    """Analysed tokens: lower case, accents stripped, split at everything that is not a-z."""
    flat = F.trim(F.regexp_replace(F.lower(fold(col)), "[^a-z]+", " "))
    parts = F.array_remove(F.split(flat, " "), "")
    return F.filter(parts, lambda t: ~t.isin(stop_words)) if stop_words else parts


def _run_starts(ordered: Column, value) -> Column:
    """Positions at which ``value(element)`` of a sorted array changes."""
    return F.filter(
        F.sequence(F.lit(0), F.size(ordered) - 1),
        lambda i: (i == 0) | (value(F.get(ordered, i)) != value(F.get(ordered, i - 1))),
    )


def term_counts(found: Column) -> Column:
    """Array of (term, tf) for an array of tokens: run lengths of the sorted tokens, within the row.

    No token leaves its document, so counting needs no shuffle.
    """

    def runs(ordered: Column) -> Column:
        return let(
            _run_starts(ordered, lambda x: x),
            lambda at: F.transform(
                at,
                lambda i, n: F.struct(
                    F.get(ordered, i).alias("term"),
                    (F.coalesce(F.get(at, n + 1), F.size(ordered)) - i).alias("tf"),
                ),
            ),
        )

    return let(F.sort_array(F.when(F.size(found) > 0, found)), runs)


def inverted_index(found: Column) -> Column:
    """Map word -> positions of an array of words, within the row; NULL for an empty array."""
    placed = F.transform(F.when(F.size(found) > 0, found), lambda w, i: F.struct(w.alias("word"), i.alias("pos")))

    def runs(ordered: Column) -> Column:
        return let(
            _run_starts(ordered, lambda x: x["word"]),
            lambda at: F.map_from_entries(
                F.transform(
                    at,
                    lambda i, n: F.struct(
                        F.get(ordered, i)["word"].alias("key"),
                        F.transform(
                            F.slice(ordered, i + 1, F.coalesce(F.get(at, n + 1), F.size(ordered)) - i), lambda x: x["pos"]
                        ).alias("value"),
                    ),
                )
            ),
        )

    return let(F.sort_array(placed), runs)


def query_terms(text: str, stop_words: list[str] | None = None) -> list[str]:
    """The distinct tokens of a query string, by the same rules as :func:`tokens`."""
    plain = "".join("" if c in _MARKS else _SINGLE.get(c, c) for c in text).lower()
    found = dict.fromkeys(t for t in re.split("[^a-z]+", plain) if t)
    return [t for t in found if t not in set(stop_words or ())]
