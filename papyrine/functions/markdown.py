"""Front matter, headings and links of Markdown pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyrine.functions.text import let, strip


def front_matter(content: Column) -> Column:
    """Map of the 'key: value' lines between the first two '---'; the last of duplicate keys wins."""
    lines = F.split(F.get(F.split(content, "---", 3), F.lit(1)), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")
    entries = F.transform(
        F.filter(lines, lambda line: F.contains(line, F.lit(":"))),
        lambda line: F.struct(
            strip(F.substring_index(line, ":", 1)).alias("key"),
            F.regexp_replace(strip(F.regexp_replace(line, r"^[^:]*:", "")), '^"+|"+$', "").alias("value"),
        ),
    )
    # Sorted by key and place, the last of equal keys is the one before another key; then back in page order.
    sorted_ = F.array_sort(F.transform(entries, lambda e, i: F.struct(e["key"].alias("key"), i.alias("at"), e["value"].alias("value"))))
    kept = let(sorted_, lambda all_: F.filter(all_, lambda e, i: ~F.coalesce(F.get(all_, i + 1)["key"] == e["key"], F.lit(False))))
    in_order = F.array_sort(F.transform(kept, lambda e: F.struct(e["at"].alias("at"), e["key"].alias("key"), e["value"].alias("value"))))
    last = F.transform(in_order, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.when(content.startswith("---"), F.coalesce(F.map_from_entries(last), empty)).otherwise(empty)


def heading(content: Column) -> Column:
    """Text of the first level-one heading, NULL without one."""
    return F.nullif(strip(F.regexp_extract(content, r"(?m)^#\s+(.+)$", 1)), F.lit(""))


def source_links(content: Column) -> Column:
    """Distinct citation keys linked as sources/<key>.md."""
    return F.array_distinct(F.regexp_extract_all(content, F.lit(r"sources/([a-z0-9]+)\.md"), F.lit(1)))
