"""Counts and breakdowns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.functions.rules import is_missing, matches_any
from papyrine.operators.common import first_per_key
from papyrine.operators.queues import PUBLISHED


def journal_or_unknown() -> Column:
    return F.coalesce("journal_name", F.lit("Unknown"))


def corpus_stats(
    articles: DataFrame, pages: DataFrame, files: DataFrame, log: DataFrame, published: DataFrame
) -> DataFrame:
    """One row of totals: one aggregate per table, brought together.

    ``pages_with_abstract`` counts '' as present; ``missing_abstracts`` counts '' as missing.
    """
    flag = F.coalesce("pdf_downloaded", F.lit(False))
    page_part = pages.agg(
        F.count("*").alias("pages"),
        F.count("abstract").alias("pages_with_abstract"),
        F.count_if(flag).alias("downloaded"),
        F.count_if(F.col("page_url").isNotNull() & ~flag).alias("pending_downloads"),
    )
    present = pages.filter(~is_missing(F.col("abstract"))).select("doi")
    parts = [
        articles.agg(F.count("*").alias("articles")),
        page_part,
        articles.join(present, "doi", "left_anti").agg(F.count("*").alias("missing_abstracts")),
        files.agg(F.count("*").alias("files")),
        published.agg(F.count_if(F.col("status").isin(*PUBLISHED)).alias("published")),
        log.agg(
            F.count_distinct(F.when((F.col("stage") == "enrich_openalex") & (F.col("status") == "success"), F.col("doi"))).alias("enriched"),
            F.count_distinct(F.when((F.col("stage") == "verify_pdf") & (F.col("status") == "mismatch"), F.col("doi"))).alias("quarantined"),
        ),
    ]
    # Every part is a single row: as (metric, n) lines they add up to one more single row.
    lines = reduce(DataFrame.unionByName, [part.unpivot([], part.columns, "metric", "n") for part in parts])
    names = [name for part in parts for name in part.columns]
    one_row = lines.agg(*[F.max(F.when(F.col("metric") == name, F.col("n"))).alias(name) for name in names])
    return one_row.withColumn("pending_pages", F.col("articles") - F.col("pages"))


def distinct_with_outcome(
    log: DataFrame, stage: str, status: str, out: str, approximate: bool = False
) -> DataFrame:
    """Number of distinct records with a given outcome of a stage."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return log.filter((F.col("stage") == stage) & (F.col("status") == status)).agg(count(F.col("doi")).alias(out))


def count_by(df: DataFrame, *keys: str, out: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(out))


def by_year(articles: DataFrame) -> DataFrame:
    return count_by(articles, "year").orderBy(F.desc_nulls_last("year"))


def top_journals(articles: DataFrame, limit: int = 10) -> DataFrame:
    return count_by(articles, "journal_name").orderBy(F.desc("n"), F.asc_nulls_last("journal_name")).limit(limit)


def missing_by_journal(articles: DataFrame, pages: DataFrame, limit: int | None = 10) -> DataFrame:
    """Missing count, total and share per journal, in one pass: the page join only adds a flag."""
    present = pages.filter(~is_missing(F.col("abstract"))).select("doi", F.lit(True).alias("present"))
    counted = (
        articles.select("doi", journal_or_unknown().alias("journal_name"))
        .join(present, "doi", "left")
        .groupBy("journal_name")
        .agg(F.count_if(F.col("present").isNull()).alias("missing_count"), F.count("*").alias("total_count"))
        .filter("missing_count > 0")
        .withColumn("missing_pct", F.col("missing_count") / F.col("total_count"))
        .orderBy(F.desc("missing_count"), "journal_name")
    )
    return counted.limit(limit) if limit else counted


def missing_bars(missing: DataFrame, width: int = 30) -> DataFrame:
    """A text bar per journal, scaled to the largest count of the given short report (see ``missing_by_journal``)."""
    top = F.max("missing_count").over(Window.partitionBy())
    length = F.floor(F.col("missing_count") / top * width).cast("int")
    return missing.withColumn("bar", F.repeat(F.lit("█"), length))


def outcome_counts(outcomes: DataFrame, column: str, named: Sequence[str], rest: str = "failed") -> DataFrame:
    """Rows per outcome; unnamed outcomes count as ``rest``, and outcomes without rows appear with 0."""
    label = F.when(F.col(column).isin(*named), F.col(column)).otherwise(F.lit(rest))
    buckets = [*[n for n in named if n != rest], rest]
    # One aggregate with a counter per bucket, unpivoted: a single row is shuffled per task.
    counters = outcomes.select(label.alias("outcome")).agg(
        *[F.count_if(F.col("outcome") == b).alias(b) for b in buckets]
    )
    return counters.unpivot([], buckets, "outcome", "n")


def collected_by_journal(articles: DataFrame) -> DataFrame:
    """Collected records per journal, largest first."""
    return count_by(articles.filter(F.col("journal_name").isNotNull()), "journal_name").orderBy(
        F.desc("n"), "journal_name"
    )


# Error texts of page searches that are worth another try.
RETRY_ERRORS = ["No search results", "Failed to search SSRN"]
LOW_MATCH_ERROR = "No match above threshold"


def failed_to_reset(
    pages: DataFrame, articles: DataFrame, year_from: int = 2000, include_low_match: bool = False
) -> DataFrame:
    """Pages that failed for a retryable reason, from a given year on."""
    phrases = RETRY_ERRORS + ([LOW_MATCH_ERROR] if include_low_match else [])
    failed = pages.filter(matches_any(F.col("error_message"), phrases)).select("doi", "error_message")
    recent = articles.filter(F.col("year") >= year_from).select("doi", "title", "year", "journal_name")
    return failed.join(recent, "doi")


def reset_breakdown(failed: DataFrame, years: int = 10) -> DataFrame:
    """Failed pages by year (newest ``years``) and by error text; a page may count under several texts."""
    per_year = count_by(failed, "year").orderBy(F.desc("year")).limit(years)
    phrases = RETRY_ERRORS + [LOW_MATCH_ERROR]
    per_error = failed.agg(
        *[F.count_if(F.contains(F.col("error_message"), F.lit(p))).alias(p) for p in phrases]
    ).unpivot([], phrases, "label", "n")
    return per_year.select(F.lit("year").alias("kind"), F.col("year").cast("string").alias("label"), "n").unionByName(
        per_error.select(F.lit("error").alias("kind"), "label", "n")
    )


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return count_by(df, *keys).filter("n > 1")


def page_scan_status(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Each stored path with whether a page was found there."""
    seen = found.select("path", F.lit(True).alias("seen"))
    return stored.join(seen, "path", "left").withColumn(
        "scan_status", F.when(F.col("seen"), "found").otherwise("file_not_found")
    ).drop("seen")


def extract_summary(extracted: DataFrame) -> DataFrame:
    """Extraction outcomes from (scan_status, abstract), with zero rows for outcomes that did not occur."""
    outcome = F.when(F.col("scan_status") == "file_not_found", "file_not_found").when(
        F.length("abstract") > 0, "success"
    )
    return outcome_counts(
        extracted.select(F.coalesce(outcome, F.lit("failed")).alias("outcome")), "outcome", ["success", "file_not_found"]
    )


def best_candidate(candidates: DataFrame, key: str, score: Column, position: Column) -> DataFrame:
    """Best row per key: highest score, then earliest position."""
    return first_per_key(candidates, [key], score.desc(), position.asc())


def first_source(attempts: DataFrame, order: Sequence[str], tie: str = "pos") -> DataFrame:
    """Per record the first successful source in the given order, and of that source the earliest attempt."""
    place = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("source"))
    return first_per_key(attempts.filter(place > 0), ["doi"], place.asc(), F.asc(tie))
