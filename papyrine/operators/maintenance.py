"""Repair jobs: untracked files, bad pages, failed searches, non-articles, and the run report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.functions.clean import doi_slug
from papyrine.functions.rules import in_size_band, is_cleanup_title
from papyrine.operators.common import attach
from papyrine.operators.stats import failed_to_reset
from papyrine.operators.upsert import delete_keys, upsert_files


def non_articles(articles: DataFrame) -> DataFrame:
    """Articles whose title looks like no research article."""
    return articles.filter(is_cleanup_title(F.col("title"))).select("doi", "title", "year", "journal_name").orderBy(
        F.desc("year"), "title", "doi"
    )


def backfill_files(pages: DataFrame, files: DataFrame) -> DataFrame:
    """Downloaded pages whose file is not tracked yet."""
    return pages.filter(F.col("pdf_downloaded") & F.col("pdf_file_path").isNotNull()).join(
        files.select("doi"), "doi", "left_anti"
    ).select("doi", "page_url", "pdf_file_path", "match_score")


def adopt_orphans(found: DataFrame, articles: DataFrame, pages: DataFrame, files: DataFrame) -> DataFrame:
    """Each stored file (file_name) with the article its name stands for.

    'tracked' files are known already, 'adopt' files belong to an article without a file, 'orphan' files to none.
    """
    # Articles are put together by doi first, so files of no article (NULL doi) enter no further join.
    known = (
        articles.select("doi", doi_slug(F.col("doi")).alias("file_name"))
        .join(pages.select("doi", "page_url", "match_score"), "doi", "left")
        .join(files.select("doi", F.lit(True).alias("tracked")), "doi", "left")
    )
    return found.join(known, "file_name", "left").select(
        "file_name",
        "doi",
        "page_url",
        "match_score",
        F.when(F.col("doi").isNull(), "orphan").when(F.col("tracked"), "tracked").otherwise("adopt").alias("file_status"),
    )


def adopt_files(adopted: DataFrame, files: DataFrame, now: Column) -> DataFrame:
    """The file table with the files to adopt as pending rows of the first site."""
    rows = adopted.filter("file_status = 'adopt'").select(
        "doi",
        F.lit("ssrn").alias("source"),
        F.col("page_url").alias("source_url"),
        F.lit(None).cast("string").alias("pdf_url"),
        F.col("file_name").alias("pdf_file_path"),
        F.col("match_score").cast("double").alias("match_score"),
    )
    return upsert_files(files, rows, now)


def bad_pages(stored: DataFrame, found: DataFrame, target: int, tolerance: int) -> DataFrame:
    """Stored rows (doi, path) against page files (path, html): size match, missing file, or orphan file in the band."""
    sized = found.select("path", F.octet_length("html").alias("bytes"), in_size_band(F.col("html"), target, tolerance).alias("hit"))
    status = (
        F.when(F.col("hit").isNull(), "missing")
        .when(F.col("hit") & F.col("doi").isNull(), "orphan")
        .when(F.col("hit"), "size_match")
    )
    return (
        stored.select("doi", "path")
        .join(sized, "path", "full_outer")
        .select("path", "doi", "bytes", status.alias("page_status"))
        .filter("page_status is not null")
    )


def orphan_files(stored: DataFrame, found: DataFrame, target: int, tolerance: int) -> DataFrame:
    """Paths in the size band that no matching row refers to."""
    hits = found.filter(in_size_band(F.col("html"), target, tolerance)).select("path")
    return hits.join(stored.select("path"), "path", "left_anti")


def reset_failed(
    pages: DataFrame, articles: DataFrame, year_from: int = 2000, include_low_match: bool = False
) -> DataFrame:
    """The page table without the failures that should be tried again."""
    return delete_keys(pages, failed_to_reset(pages, articles, year_from, include_low_match))


def run_attention(log: DataFrame, runs: DataFrame, run_id: str) -> DataFrame:
    """Mismatches and problem publications logged since the run began."""
    began = runs.filter(F.col("run_id") == run_id).agg(F.min("started_at").alias("_began"))
    issue = ((F.col("stage") == "verify_pdf") & (F.col("status") == "mismatch")) | (
        (F.col("stage") == "wiki_ingest") & F.col("status").isin("flagged", "failed")
    )
    return (
        attach(log.filter(issue), began)
        .filter(F.col("processed_at") >= F.col("_began"))
        .select("id", "doi", "stage", "status", "error_message", "processed_at")
        .orderBy("processed_at", "id")
    )


def run_stages(runs: DataFrame, run_id: str, order: str = "started_at") -> DataFrame:
    return runs.filter(F.col("run_id") == run_id).orderBy(order, "stage")


def run_report(stages: DataFrame, attention: DataFrame, stats: DataFrame, detail: Column | None = None) -> DataFrame:
    """The report of a run as (section, ord, line): its stages, items to look at, totals."""
    stage_lines = stages.select(
        F.lit("stages").alias("section"),
        F.concat_ws("|", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss"), "stage").alias("ord"),
        F.concat_ws(" | ", "stage", "status", *([detail] if detail is not None else [])).alias("line"),
    )
    item_lines = attention.select(
        F.lit("attention").alias("section"),
        F.lpad(F.col("id").cast("string"), 20, "0").alias("ord"),
        F.concat(
            F.lit("- `"),
            F.col("doi"),
            F.lit("` — "),
            F.col("stage"),
            F.lit(": "),
            F.col("status"),
            F.lit(" ("),
            F.coalesce(F.nullif("error_message", F.lit("")), F.lit("no detail")),
            F.lit(")"),
        ).alias("line"),
    )
    totals = stats.columns
    total_lines = stats.unpivot([], totals, "ord", "n").select(
        F.lit("state").alias("section"), "ord", F.concat_ws(": ", "ord", F.col("n").cast("string")).alias("line")
    )
    return stage_lines.unionByName(item_lines).unionByName(total_lines)
