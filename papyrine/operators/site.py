"""Published pages: reconciliation and index pages.

Index pages come as lines, one row each, with the columns that order them; a journal of any size is a range of
rows and never one value. ``write_lines`` stores them range-partitioned, so the files follow each other in order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.functions.markdown import front_matter, heading, source_links

FLAG = " ⚑"
UNCLASSIFIED = "Unclassified"


def entry_line(flagged: Column) -> Column:
    """List line of a record, marked when it is flagged."""
    return F.concat(
        F.lit("- ["),
        F.col("title"),
        F.lit("](../sources/"),
        F.col("bib_key"),
        F.lit(".md) ("),
        F.col("authors"),
        F.lit(", "),
        F.col("year").cast("string"),
        F.lit(")"),
        F.when(flagged, FLAG).otherwise(""),
    )


def _flagged() -> Column:
    return F.col("status") == "flagged"


def index_by_journal(pages: DataFrame) -> DataFrame:
    """Lines by journal, newest year, title. Records without a journal do not appear."""
    sections, within = journal_order()
    return (
        pages.filter(F.col("journal_name").isNotNull())
        .select(F.col("journal_name").alias("section"), "year", "title", "bib_key", entry_line(_flagged()).alias("line"))
        .orderBy(*sections, *within)
    )


def index_by_year(pages: DataFrame) -> DataFrame:
    """Lines by year, newest first, then journal and title."""
    sections, within = year_order()
    return pages.select(
        F.col("year").cast("string").alias("section"),
        "journal_name",
        "title",
        "bib_key",
        entry_line(_flagged()).alias("line"),
    ).orderBy(*sections, *within)


def topic_links(concepts: DataFrame) -> DataFrame:
    """(path, section, bib_key) of concept pages (path, content); the file name stands in for a missing heading."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "")
    return concepts.select(
        "path", F.coalesce(heading(F.col("content")), stem).alias("section"), F.explode_outer(source_links(F.col("content"))).alias("bib_key")
    )


def index_by_topic(pages: DataFrame, concepts: DataFrame) -> DataFrame:
    """Lines per concept page with the records it links, then the records no concept links."""
    links = topic_links(concepts)
    linked = links.join(pages, "bib_key").select(
        "section", F.lit(0).alias("part"), "path", "year", "title", "bib_key", entry_line(F.lit(False)).alias("line")
    )
    filled = linked.select("path").distinct()
    empty = (
        links.select("path", "section").distinct().join(filled, "path", "left_anti").select(
            "section",
            F.lit(0).alias("part"),
            "path",
            F.lit(None).cast("int").alias("year"),
            F.lit(None).cast("string").alias("title"),
            F.lit(None).cast("string").alias("bib_key"),
            F.lit("_No ingested sources linked yet._").alias("line"),
        )
    )
    known = links.select("bib_key").filter("bib_key is not null").distinct()
    rest = pages.join(known, "bib_key", "left_anti").select(
        F.lit(UNCLASSIFIED).alias("section"),
        F.lit(1).alias("part"),
        F.lit("").alias("path"),
        "year",
        "title",
        "bib_key",
        entry_line(_flagged()).alias("line"),
    )
    sections, within = topic_order()
    return linked.unionByName(empty).unionByName(rest).orderBy(*sections, *within)


def journal_order() -> tuple[list[Column], list[Column]]:
    return [F.col("section")], [F.desc("year"), F.col("title"), F.col("bib_key")]


def year_order() -> tuple[list[Column], list[Column]]:
    return [F.desc("section")], [F.asc_nulls_last("journal_name"), F.col("title"), F.col("bib_key")]


def topic_order() -> tuple[list[Column], list[Column]]:
    """Linked records go by key; the unlinked ones by newest year and title."""
    linked = F.when(F.col("part") == 0, F.col("bib_key"))
    return (
        [F.col("part"), F.col("path"), F.col("section")],
        [linked, F.desc_nulls_last("year"), F.col("title"), F.col("bib_key")],
    )


# Titles, notes and empty-index lines of the index pages.
TITLES = {"journal": "# Papers by journal", "year": "# Papers by year", "topic": "# Papers by topic"}
NO_PAPERS = "_No papers ingested yet._"
NO_CONCEPTS = "_No concept pages yet. Create them under wiki/concepts/ and build the index again._"
UNLINKED = "_Ingested but not yet linked from any concept page._"


def page_lines(lines: DataFrame, kind: str) -> DataFrame:
    """The lines of a whole index page in reading order: title, headings, notes, entries, and the blank lines between.

    ``kind`` is journal, year or topic. Headings of topics link to their concept pages. An index without entries has
    its empty-index line instead; no section passes through one task.
    """
    sections, within = {"journal": journal_order, "year": year_order, "topic": topic_order}[kind]()
    names = [c for c in ("part", "path", "section") if c in lines.columns]
    heads = lines.select(*names).distinct()
    text = F.col("section")
    if kind == "topic":
        name = F.element_at(F.split("path", "/"), -1)
        text = F.when(F.col("part") == 0, F.concat(F.lit("["), "section", F.lit("](../concepts/"), name, F.lit(")"))).otherwise(text)
    head = heads.withColumn("line", F.concat(F.lit("## "), text)).withColumn("_kind", F.lit(0))
    gap, end = (heads.withColumn("line", F.lit("")).withColumn("_kind", F.lit(k)) for k in (1, 4))
    parts = [head, gap, lines.withColumn("_kind", F.lit(3)), end]
    if kind == "topic":
        note = heads.filter("part = 1").withColumn("line", F.explode(F.array(F.lit(UNLINKED), F.lit("")))).withColumn("_kind", F.lit(2))
        note = note.withColumn("title", F.when(F.col("line") == "", "b").otherwise("a"))
        parts.insert(2, note)
    every = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts).withColumn("_top", F.lit(2))
    counted = lines.filter("part = 0") if kind == "topic" else lines
    empty = counted.agg(F.count("*").alias("_n")).filter("_n = 0").select(
        F.explode(F.array(F.lit(NO_CONCEPTS if kind == "topic" else NO_PAPERS), F.lit(""))).alias("line"), F.lit(1).alias("_top")
    )
    title = lines.sparkSession.createDataFrame([(TITLES[kind], 0, 0), ("", 0, 1)], "line string, _top int, _kind int")
    whole = every.unionByName(title, allowMissingColumns=True).unionByName(empty, allowMissingColumns=True)
    return whole.orderBy("_top", *sections, F.asc_nulls_first("_kind"), *within)


def write_lines(lines: DataFrame, path: str, kind: str) -> None:
    """Write an index page as text files in reading order."""
    page_lines(lines, kind).select("line").write.mode("overwrite").text(path)


def reconcile(keys: DataFrame, written: DataFrame, depth: str = "deep") -> DataFrame:
    """State of each expected key (doi, bib_key) from the written pages (key, path, content)."""
    joined = keys.join(written.select(F.col("key").alias("bib_key"), "path", "content"), "bib_key", "left")
    fields = front_matter(F.col("content"))
    failed = F.lower(F.coalesce(fields.getItem("extraction_failed"), F.lit("false"))) == "true"
    there = F.col("content").isNotNull()
    status = (
        F.when(~there, "failed")
        .when(failed, "failed")
        .when(F.contains("content", F.lit("<!-- VERIFIER")), "flagged")
        .otherwise("ingested")
    )
    error = F.when(~there, "Source page not written").when(failed, "extraction_failed in frontmatter")
    return joined.select(
        "doi",
        "bib_key",
        F.col("path").alias("source_page_path"),
        F.when(there, F.coalesce(fields.getItem("extraction_depth"), F.lit(depth))).alias("extraction_depth"),
        fields.getItem("extraction_model").alias("analyst_model"),
        fields.getItem("verifier_model").alias("verifier_model"),
        status.alias("status"),
        error.alias("error_message"),
    )
