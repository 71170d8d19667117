"""Whole jobs: each takes the current tables and inputs and returns the next tables.

Nothing is written here; the caller publishes the returned frames as new versions. Outside work (fetching pages,
asking a model, writing pages) happens between two flows: one leaves a queue, the next reads the results.
Frames that several results read and that cost Python time are stored once in the shared folder.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.functions.clean import accepted_abstract, doi_slug, head_text, normalize_doi, reconstruct_abstract
from papyrine.functions.pagetext import with_abstract
from papyrine.operators.common import first_per_key
from papyrine.operators import keys, maintenance, matching, queues, site, stats, upsert, verify
from papyrine.operators.search import StoredIndex
from papyrine.session import materialise
from papyrine.sources.metadata import transform_works


@dataclass(frozen=True)
class Tables:
    """The corpus: one frame per table.

    ``log_rows`` holds the log lines that the flows so far have added; the caller appends them to the stored log and
    need not write the rest of it again.
    """

    articles: DataFrame
    pages: DataFrame
    files: DataFrame
    candidates: DataFrame
    published: DataFrame
    log: DataFrame
    runs: DataFrame | None = None
    log_rows: DataFrame | None = None


def with_log(tables: Tables, rows: DataFrame, stage: str, now: Column) -> Tables:
    """A log line per row (doi, status, error_message): readable in ``log``, to be appended from ``log_rows``."""
    lines = rows.select("doi", F.lit(stage).alias("stage"), "status", "error_message", now.alias("processed_at"))
    new = upsert.next_rows(tables.log, lines, F.md5(F.concat_ws("|", "doi", "stage", "status")))
    return more_log(tables, new)


def more_log(tables: Tables, new: DataFrame) -> Tables:
    return replace(
        tables,
        log=tables.log.unionByName(new, True),
        log_rows=new if tables.log_rows is None else tables.log_rows.unionByName(new, True),
    )


def collect(tables: Tables, works: DataFrame, journals: DataFrame, now: Column, mode: str = "substring") -> Tables:
    """New and changed articles from metadata works."""
    rows = transform_works(works, journals, mode)
    return replace(tables, articles=upsert.upsert_articles(tables.articles, rows, now))


def refresh_index(index: StoredIndex, before: DataFrame, after: DataFrame, text: str) -> int | None:
    """Bring an index from one version of a table to the next: the segment it writes, or None where no text changed.

    Rows with a new text are indexed, rows that lost theirs or are gone leave the index; nothing else is read again.
    """
    key = index.key
    old = before.filter(F.col(text).isNotNull()).select(key, F.col(text).alias("_old"))
    new = after.filter(F.col(text).isNotNull()).select(key, text)
    both = materialise(old.join(new, key, "full_outer").filter(~F.col("_old").eqNullSafe(F.col(text))), "changed-texts")
    if both.isEmpty():
        return None
    held = index.segments()
    segment = held[-1] + 1 if held else 0
    index.add(both, text, segment, removed=both.filter(F.col(text).isNull()))
    merged = index.tidy()
    return segment if merged is None else merged


def enrich(tables: Tables, works: DataFrame, now: Column, force: bool = False) -> tuple[Tables, DataFrame]:
    """Missing abstracts from enrichment records (doi, abstract_inverted_index); also the outcome counts."""
    todo = queues.missing_abstracts(tables.articles, tables.pages).select("doi", normalize_doi(F.col("doi")).alias("key"))
    text = accepted_abstract(reconstruct_abstract(F.col("abstract_inverted_index")))
    listed = works.select(normalize_doi(F.col("doi")).alias("key"), text.alias("abstract")).filter("key is not null")
    # Of a work listed twice the longest abstract counts.
    found = first_per_key(listed, ["key"], F.desc(F.length("abstract")), F.asc("abstract"))
    # Articles without a usable DOI are told at once; they have no key to join on.
    invalid = todo.filter("key is null").select("doi", F.lit(None).cast("string").alias("abstract"), F.lit("invalid_doi").alias("outcome"))
    asked = todo.filter("key is not null").join(found.select("key", F.lit(True).alias("there"), "abstract"), "key", "left")
    outcome = materialise(
        asked.select(
            "doi",
            "abstract",
            F.when(F.col("there").isNull(), "not_found").when(F.col("abstract").isNull(), "empty_abstract").otherwise("updated").alias("outcome"),
        ).unionByName(invalid),
        "enriched",
    )
    filled = outcome.filter("outcome = 'updated'").select("doi", "abstract")
    lines = outcome.select(
        "doi",
        F.when(F.col("outcome") == "updated", "success").otherwise("failed").alias("status"),
        F.when(F.col("outcome") != "updated", F.col("outcome")).alias("error_message"),
    )
    counts = stats.outcome_counts(outcome, "outcome", ["updated", "not_found", "empty_abstract", "invalid_doi"])
    after = replace(tables, pages=upsert.fill_abstract(tables.pages, filled, now, force))
    return with_log(after, lines, "enrich_openalex", now), counts


def match_pages(
    tables: Tables, records: DataFrame, now: Column, threshold: float = 85.0, k: int = matching.SEARCH_RESULTS
) -> Tables:
    """Pages for articles without one: retrieve, score, and take the best record (pos, title, url, html)."""
    todo = queues.pending_pages(tables.articles, tables.pages).select("doi", "title")
    best = matching.title_scores(todo, records.select("pos", "title"), k, threshold=threshold)
    outcome = materialise(matching.search_outcomes(todo, best, threshold), "matched")
    found = outcome.filter("status = 'success'").select("doi", "pos", "match_score", "error_message")
    page = with_abstract(found.join(records.select("pos", "url", "html"), "pos"), "html", "abstract")
    hits = page.select("doi", F.col("url").alias("page_url"), "html", "abstract", "match_score", "error_message")
    text = F.lit(None).cast("string")
    misses = outcome.filter("status <> 'success'").select(
        "doi", text.alias("page_url"), text.alias("html"), text.alias("abstract"), "match_score", "error_message"
    )
    return with_log(
        replace(tables, pages=upsert.upsert_pages(tables.pages, hits.unionByName(misses), now)),
        outcome.select("doi", "status", "error_message"),
        "scrape_ssrn",
        now,
    )


def fetch_plan(
    tables: Tables,
    works: DataFrame,
    listings: DataFrame,
    feeds: DataFrame,
    cutoff: Column,
    order: Sequence[str] = ("oa", "nber", "arxiv"),
    threshold: float = 90.0,
) -> DataFrame:
    """Addresses to fetch for articles without a file: (doi, source, priority, candidate_url, pdf_url, match_score).

    One row per source to ask, in order; the address is NULL where the source has none. Works are found by their
    normalised DOI, however it is written.
    """
    queue = queues.fallback_queue(tables.articles, tables.pages, tables.files, tables.log)
    plan = materialise(queues.source_plan(queue, tables.candidates, order, cutoff), "source-plan")
    article = queue.select("doi", "title", "authors")
    named = article.select("doi", normalize_doi(F.col("doi")).alias("_key")).filter("_key is not null")
    known = works.withColumn("_key", normalize_doi(F.col("doi"))).drop("doi").join(named, "_key")
    hits = (
        matching.resolve_oa(known)
        .unionByName(matching.resolve_listing(listings.join(article.select("doi", "title"), "doi"), threshold))
        .unionByName(matching.resolve_atom(feeds.join(article, "doi"), threshold))
    )
    # A work that is listed twice gives its source two addresses; one is fetched.
    one = first_per_key(hits, ["doi", "source"], F.desc("match_score"), F.asc("pdf_url"), F.asc("candidate_url"))
    return plan.select("doi", "source", "priority").join(one, ["doi", "source"], "left")


def fetch_outcomes(plan: DataFrame, fetched: DataFrame, order: Sequence[str] = ("oa", "nber", "arxiv")) -> DataFrame:
    """What became of each planned address, from fetch results (doi, source, ok, error).

    'no_match' without an address, 'downloaded' where the file arrived, else 'error' with its message. Addresses that
    were not tried are left out, and so is everything after the first file of an article.
    """
    results = first_per_key(fetched.select("doi", "source", "ok", "error"), ["doi", "source"], F.desc("ok"), F.asc("error"))
    tried = plan.join(results, ["doi", "source"], "left").filter("pdf_url is null or ok is not null")
    told = tried.select(
        *plan.columns,
        F.when(F.col("pdf_url").isNull(), "no_match").when(F.col("ok"), "downloaded").otherwise("error").alias("status"),
        F.when(F.col("pdf_url").isNotNull() & ~F.col("ok"), F.col("error")).alias("error_message"),
    )
    first = stats.first_source(told.filter("status = 'downloaded'"), order, tie="priority")
    return (
        told.join(first.select("doi", F.col("priority").alias("_stop")), "doi", "left")
        .filter(F.col("_stop").isNull() | (F.col("priority") <= F.col("_stop")))
        .drop("_stop")
    )


def resolve(
    tables: Tables, plan: DataFrame, fetched: DataFrame, now: Column, order: Sequence[str] = ("oa", "nber", "arxiv")
) -> Tables:
    """Remember the outcome of every address of a fetch plan, and record the files that arrived."""
    outcome = materialise(fetch_outcomes(plan, fetched, order), "fetched")
    memo = outcome.select("doi", "source", "candidate_url", "pdf_url", "match_score", "status", "error_message")
    arrived = outcome.filter("status = 'downloaded'")
    files = arrived.select(
        "doi",
        "source",
        F.col("candidate_url").alias("source_url"),
        "pdf_url",
        doi_slug(F.col("doi")).alias("pdf_file_path"),
        "match_score",
    )
    return with_log(
        replace(
            tables,
            candidates=upsert.upsert_candidates(tables.candidates, memo, now),
            files=upsert.upsert_files(tables.files, files, now),
        ),
        arrived.select("doi", F.lit("success").alias("status"), F.lit(None).cast("string").alias("error_message")),
        "resolve_fallback",
        now,
    )


def extract_abstracts(tables: Tables, found: DataFrame, now: Column) -> tuple[Tables, DataFrame]:
    """Abstracts taken anew from the stored page files (path, html) of all pages with a path; also the outcome counts.

    ``tables.pages`` has the file's place in ``html_file_path`` where that column exists, else ``found`` has a doi.
    """
    by_path = "html_file_path" in tables.pages.columns
    stored = tables.pages.select("doi", F.col("html_file_path").alias("path")).filter("path is not null") if by_path else tables.pages.select("doi")
    scanned = stored.join(found, "path" if by_path else "doi", "left")
    extracted = materialise(
        with_abstract(scanned, "html", "abstract").select(
            "doi", "abstract", F.when(F.col("html").isNull(), "file_not_found").otherwise("read").alias("scan_status")
        ),
        "extracted",
    )
    good = extracted.filter(F.length("abstract") > 0).select("doi", "abstract")
    return replace(tables, pages=upsert.fill_abstract(tables.pages, good, now, force=True)), stats.extract_summary(extracted)


def verify_files(
    tables: Tables, texts: DataFrame, now: Column, verdicts: DataFrame | None = None, model: str | None = None
) -> Tables:
    """Check pending files against the first pages of their texts (doi, text), store the results, quarantine the
    mismatches. A paper that names the article further back, as in its references, is no match."""
    pending = tables.files.filter("verify_status = 'pending'").select("doi", "source")
    article = tables.articles.select("doi", "title", "authors")
    rows = pending.join(article, "doi").join(texts.select("doi", head_text(F.col("text"), pages=verify.HEAD_PAGES).alias("text")), "doi", "left")
    result = materialise(verify.verify(verify.check_text(rows), verdicts, model), "verified")
    stored = upsert.set_verification(tables.files, result, now)
    wrong = (
        result.filter("verify_status = 'mismatch'")
        .join(pending, "doi")
        .select("doi", "source", F.col("verify_reason").alias("reason"))
    )
    after = verify.quarantine(wrong, tables.pages, stored, tables.candidates, tables.log, now)
    new = after.pop("log")
    return more_log(replace(tables, **after), new)


def allocate(tables: Tables, written: DataFrame, now: Column) -> tuple[Tables, DataFrame]:
    """Keys for verified files that are not published yet, as pending rows, and the manifest to hand over."""
    queue = queues.publish_queue(
        tables.articles, tables.files.withColumn("file_name", doi_slug(F.col("doi"))), tables.published
    )
    assigned = materialise(keys.assign_bib_keys(queue, tables.published, written), "keys")
    pending = assigned.join(tables.published.select("doi"), "doi", "left_anti").withColumn("status", F.lit("pending"))
    after = replace(tables, published=upsert.upsert_published(tables.published, _full(pending, tables.published), now))
    return after, keys.manifest(queue, assigned)


def _full(rows: DataFrame, like: DataFrame) -> DataFrame:
    """``rows`` with every column of another frame, NULL where it has none."""
    return rows.select(
        *[
            F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in like.schema.fields
            if f.name != "ingested_at"
        ]
    )


def publish(tables: Tables, expected: DataFrame, written: DataFrame, now: Column) -> Tables:
    """Record which expected keys (doi, bib_key) were written as pages (key, path, content)."""
    state = materialise(site.reconcile(expected, written), "reconciled")
    lines = state.filter("source_page_path is not null").select("doi", "status", "error_message")
    after = replace(tables, published=upsert.upsert_published(tables.published, _full(state, tables.published), now))
    return with_log(after, lines, "wiki_ingest", now)


def report(tables: Tables, run_id: str) -> DataFrame:
    """Stages, items to look at and totals of a run."""
    return maintenance.run_report(
        maintenance.run_stages(tables.runs, run_id),
        maintenance.run_attention(tables.log, tables.runs, run_id),
        stats.corpus_stats(tables.articles, tables.pages, tables.files, tables.log, tables.published),
    )


def remove_non_articles(tables: Tables) -> Tables:
    """The corpus without titles that are no research articles, and without their pages."""
    articles, pages = upsert.delete_cascade(tables.articles, tables.pages, maintenance.non_articles(tables.articles))
    return replace(tables, articles=articles, pages=pages)
