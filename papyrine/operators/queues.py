"""Outstanding work: which records need which step next.

All are anti-joins or outer joins on the record key. Each ORDER BY ends in the key, so a limit always cuts at the
same row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.functions.rules import is_missing, year_between
from papyrine.operators.common import key_set, maybe_limit

ARTICLE_COLUMNS = ["doi", "title", "authors", "year", "journal_name"]
PUBLISHED = ("ingested", "flagged")


def newest_first(*tie: str) -> list[Column]:
    return [F.desc_nulls_last("year"), *[F.asc_nulls_last(t) for t in (tie or ("doi",))]]


def _unavailable(log: DataFrame) -> DataFrame:
    """Records whose file was found to be unobtainable."""
    return key_set(log.filter((F.col("stage") == "download_pdf") & (F.col("status") == "unavailable")), "doi")


def articles_by_year(articles: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    return articles.filter(year_between(F.col("year"), start, end)).orderBy(*newest_first("title", "doi"))


def pending_pages(articles: DataFrame, pages: DataFrame, limit: int | None = None) -> DataFrame:
    """Articles without a page row."""
    todo = articles.join(pages.select("doi"), "doi", "left_anti").select(*ARTICLE_COLUMNS)
    return maybe_limit(todo.orderBy(*newest_first()), limit)


def missing_abstracts(
    articles: DataFrame, pages: DataFrame, start: int | None = None, end: int | None = None, limit: int | None = None
) -> DataFrame:
    """Articles whose page has no abstract, or that have no page, within optional year bounds."""
    present = pages.filter(~is_missing(F.col("abstract"))).select("doi")
    todo = articles.filter(year_between(F.col("year"), start, end)).join(present, "doi", "left_anti")
    return maybe_limit(todo.select(*ARTICLE_COLUMNS).orderBy(*newest_first()), limit)


def download_queue(
    articles: DataFrame,
    pages: DataFrame,
    log: DataFrame,
    downloaded: bool | None = None,
    include_unavailable: bool = True,
    limit: int | None = None,
) -> DataFrame:
    """Pages with an address, by download flag (None: any; False also takes NULL)."""
    todo = pages.filter(F.col("page_url").isNotNull()).select("doi", "page_url", "pdf_downloaded")
    if downloaded is not None:
        todo = todo.filter(F.coalesce("pdf_downloaded", F.lit(False)) == F.lit(downloaded))
    if not include_unavailable:
        todo = todo.join(_unavailable(log), "doi", "left_anti")
    joined = todo.join(articles.select("doi", "title", "year"), "doi")
    ordered = maybe_limit(joined.orderBy(*newest_first()), limit)
    return ordered.select("doi", "title", "page_url", "pdf_downloaded")


def verify_queue(
    articles: DataFrame, files: DataFrame, statuses: Sequence[str] = ("pending",), limit: int | None = None
) -> DataFrame:
    """Files in one of the given states with their article, oldest download first."""
    todo = files.filter(F.col("verify_status").isin(*statuses)).join(articles.select(*ARTICLE_COLUMNS), "doi")
    ordered = maybe_limit(todo.orderBy(F.asc_nulls_last("downloaded_seq"), "doi"), limit)
    return ordered.select("doi", "source", "file_name", "title", "authors", "year", "journal_name")


def fallback_queue(
    articles: DataFrame, pages: DataFrame, files: DataFrame, log: DataFrame, limit: int | None = None
) -> DataFrame:
    """Articles without a file that either have no page address or whose file was found unobtainable."""
    addressed = pages.filter(F.col("page_url").isNotNull()).select("doi", F.lit(True).alias("addressed"))
    failed = _unavailable(log).withColumn("failed", F.lit(True))
    todo = (
        articles.select(*ARTICLE_COLUMNS)
        .join(files.select("doi"), "doi", "left_anti")
        .join(addressed, "doi", "left")
        .join(failed, "doi", "left")
        .filter(F.col("addressed").isNull() | F.col("failed").isNotNull())
    )
    return maybe_limit(todo.select(*ARTICLE_COLUMNS).orderBy(*newest_first()), limit)


def publish_queue(
    articles: DataFrame, files: DataFrame, published: DataFrame, limit: int | None = None
) -> DataFrame:
    """Verified files not yet published; pending and failed publications are tried again."""
    done = published.filter(F.col("status").isin(*PUBLISHED)).select("doi")
    todo = (
        files.filter(F.col("verify_status") == "match")
        .select("doi", "file_name")
        .join(done, "doi", "left_anti")
        .join(articles.select(*ARTICLE_COLUMNS), "doi")
    )
    return maybe_limit(todo.orderBy(*newest_first()), limit)


def published_pages(articles: DataFrame, published: DataFrame) -> DataFrame:
    """Published records with their article, by journal, newest year, title."""
    return (
        published.filter(F.col("status").isin(*PUBLISHED))
        .select("doi", "bib_key", "status")
        .join(articles.select(*ARTICLE_COLUMNS), "doi")
        .orderBy(F.asc_nulls_last("journal_name"), *newest_first("title", "doi"))
    )


def source_plan(queue: DataFrame, candidates: DataFrame, sources: Sequence[str], cutoff: Column) -> DataFrame:
    """Every (article, source) still to ask: all sources in order, minus pairs checked since the cutoff.

    The sources are a literal list, so each article explodes in place; nothing is shuffled for the product.
    """
    listed = F.array(*[F.lit(s) for s in sources])
    plan = queue.select("*", F.posexplode(listed).alias("priority", "source"))
    recent = key_set(candidates.filter(F.col("checked_at") >= cutoff), "doi", "source")
    return plan.join(recent, ["doi", "source"], "left_anti")


def recent_enriched(log: DataFrame, pages: DataFrame, articles: DataFrame, limit: int = 5) -> DataFrame:
    """Newest successfully enriched records with title and abstract.

    A record may occur several times. No answer holds more than ``limit`` rows of one record, so older rows of a
    busy record are cut before the joins.
    """
    per_record = Window.partitionBy("doi").orderBy(F.desc("processed_at"), "id")
    newest = (
        log.filter((F.col("stage") == "enrich_openalex") & (F.col("status") == "success"))
        .select("doi", "id", "processed_at")
        .withColumn("_n", F.row_number().over(per_record))
        .filter(F.col("_n") <= limit)
    )
    return (
        newest.join(pages.select("doi", "abstract"), "doi")
        .join(articles.select("doi", "title"), "doi")
        .orderBy(F.desc("processed_at"), "id")
        .limit(limit)
        .select("id", "doi", "title", "abstract", "processed_at")
    )


def search_author(articles: DataFrame, name: str, limit: int | None = 50) -> DataFrame:
    """Authors containing the text, any case. '%' and '_' act as wildcards; a backslash is an ordinary character."""
    pattern = "%" + name.lower().replace("\\", "\\\\") + "%"
    hits = articles.filter(F.lower("authors").like(pattern)).select(*ARTICLE_COLUMNS)
    return maybe_limit(hits.orderBy(*newest_first("title", "doi")), limit)


def lookup(df: DataFrame, key: str, column: str = "doi") -> DataFrame:
    """Rows of one key; the equality reaches the file scan."""
    return df.filter(F.col(column) == key)


def sample_articles(articles: DataFrame, limit: int = 10) -> DataFrame:
    return articles.select(*ARTICLE_COLUMNS).orderBy(*newest_first()).limit(limit)


def recent_log(log: DataFrame, limit: int = 10) -> DataFrame:
    return log.orderBy(F.desc_nulls_last("processed_at"), F.desc("id")).limit(limit)
