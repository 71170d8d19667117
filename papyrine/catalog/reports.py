"""Counts, breakdowns, repair lists and the run report."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyrine.catalog.registry import Corpus, check, query
from papyrine.functions.pagetext import with_abstract
from papyrine.operators import constraints, maintenance, stats
from papyrine.session import scratch_path
from papyrine.sources.files import read_paths, write_texts

STATS_SQL = """
select (select count(*) from articles) as articles,
       (select count(*) from work_pages) as pages,
       (select count(*) from work_pages where abstract is not null) as pages_with_abstract,
       (select count(*) from work_pages where pdf_downloaded) as downloaded,
       (select count(*) from work_pages where page_url is not null and not pdf_downloaded) as pending_downloads,
       (select count(*) from articles a left join work_pages w on a.doi = w.doi where w.abstract is null or w.abstract = '') as missing_abstracts,
       (select count(*) from files) as files,
       (select count(*) from published where status in ('ingested', 'flagged')) as published,
       (select count(distinct doi) from processing_log where stage = 'enrich_openalex' and status = 'success') as enriched,
       (select count(distinct doi) from processing_log where stage = 'verify_pdf' and status = 'mismatch') as quarantined,
       (select count(*) from articles) - (select count(*) from work_pages) as pending_pages"""
STATS_TABLES = "articles work_pages files processing_log published"


def totals(c: Corpus):
    return stats.corpus_stats(c.articles, c.work_pages, c.files, c.processing_log, c.published)


@query("corpus_stats", check(STATS_TABLES, STATS_SQL))
def corpus_stats(c: Corpus):
    return totals(c)


@query("by_year", check("articles", "select year, count(*) as n from articles group by year"))
def by_year(c: Corpus):
    return stats.by_year(c.articles)


@query("files_by_source", check("files", "select source, count(*) as n from files group by source"))
def files_by_source(c: Corpus):
    return stats.count_by(c.files, "source")


@query("files_by_status", check("files", "select verify_status, count(*) as n from files group by verify_status"))
def files_by_status(c: Corpus):
    return stats.count_by(c.files, "verify_status")


@query(
    "distinct_enriched",
    check("processing_log", "select count(distinct doi) as enriched from processing_log where stage = 'enrich_openalex' and status = 'success'"),
)
def distinct_enriched(c: Corpus):
    return stats.distinct_with_outcome(c.processing_log, "enrich_openalex", "success", "enriched")


MISSING_SQL = """
, missing as (select coalesce(a.journal_name, 'Unknown') as journal_name, count(*) as missing_count
              from articles a left join work_pages w on a.doi = w.doi where w.abstract is null or w.abstract = '' group by 1)
, total as (select coalesce(journal_name, 'Unknown') as journal_name, count(*) as total_count from articles group by 1)
, report as (select journal_name, missing_count, total_count, missing_count::double / total_count as missing_pct
             from missing join total using (journal_name) order by missing_count desc, journal_name limit 10)"""


@query(
    "missing_by_journal",
    check("articles work_pages", MISSING_SQL + " select journal_name, missing_count, total_count, round(missing_pct, 6) as missing_pct from report"),
)
def missing_by_journal(c: Corpus):
    return stats.missing_by_journal(c.articles, c.work_pages, 10).withColumn("missing_pct", F.round("missing_pct", 6))


@query(
    "missing_bar",
    check(
        "articles work_pages",
        MISSING_SQL
        + """ select journal_name, missing_count, total_count, round(missing_pct, 6) as missing_pct,
       repeat('█', cast(floor(missing_count::double / (select max(missing_count) from report) * 30) as int)) as bar from report""",
    ),
)
def missing_bar(c: Corpus):
    return stats.missing_bars(stats.missing_by_journal(c.articles, c.work_pages, 10)).withColumn(
        "missing_pct", F.round("missing_pct", 6)
    )


@query("top_journals", check("articles", "select journal_name, count(*) as n from articles group by 1 order by n desc, journal_name nulls last limit 10"))
def top_journals(c: Corpus):
    return stats.top_journals(c.articles, 10)


@query(
    "collected_by_journal",
    check("articles", "select journal_name, count(*) as n from articles where journal_name is not null group by 1"),
)
def collected_by_journal(c: Corpus):
    return stats.collected_by_journal(c.articles)


@query(
    "outcome_counts",
    check(
        "processing_log",
        """
, o as (select case when status in ('success', 'unavailable', 'not_found') then status else 'failed' end as outcome from processing_log where stage = 'enrich_openalex')
select b.outcome, count(o.outcome) as n from (values ('success'), ('unavailable'), ('not_found'), ('failed')) b(outcome) left join o using (outcome) group by 1""",
    ),
)
def outcome_counts(c: Corpus):
    run = c.processing_log.filter("stage = 'enrich_openalex'")
    return stats.outcome_counts(run, "status", ["success", "unavailable", "not_found"])


FAILED_SQL = """
, failed as (select w.doi, w.error_message, a.title, a.year, a.journal_name from work_pages w join articles a on w.doi = a.doi
             where a.year >= 2010 and (w.error_message like '%No search results%' or w.error_message like '%Failed to search SSRN%'
                   or w.error_message like '%No match above threshold%'))"""


@query("failed_to_reset", check("work_pages articles", FAILED_SQL + " select * from failed"))
def failed_to_reset(c: Corpus):
    return stats.failed_to_reset(c.work_pages, c.articles, 2010, include_low_match=True)


@query(
    "reset_breakdown",
    check(
        "work_pages articles",
        FAILED_SQL
        + """
, years as (select year, count(*) as n from failed group by year order by year desc limit 10)
select 'year' as kind, cast(year as varchar) as label, n from years
union all select 'error', 'No search results', count(*) from failed where error_message like '%No search results%'
union all select 'error', 'Failed to search SSRN', count(*) from failed where error_message like '%Failed to search SSRN%'
union all select 'error', 'No match above threshold', count(*) from failed where error_message like '%No match above threshold%'""",
    ),
)
def reset_breakdown(c: Corpus):
    return stats.reset_breakdown(stats.failed_to_reset(c.work_pages, c.articles, 2010, include_low_match=True))


@query(
    "reset_failed",
    check(
        "work_pages articles",
        FAILED_SQL + " select doi, page_url, abstract, error_message, match_score from work_pages where doi not in (select doi from failed)",
    ),
)
def reset_failed(c: Corpus):
    kept = maintenance.reset_failed(c.work_pages, c.articles, 2010, include_low_match=True)
    return kept.select("doi", "page_url", "abstract", "error_message", "match_score")


@query("duplicate_keys", "select text, lang, count(*) as n from documents group by text, lang having count(*) > 1")
def duplicate_keys(c: Corpus):
    return stats.duplicate_keys(c.documents, "text", "lang")


STORED_PATHS = """
select concat('10.5555/d', cast(doc_id as string)) as doi, concat('pages/', cast(doc_id as string), '.html') as path from {documents}"""
STORED_SQL = "stored as (" + STORED_PATHS.format(documents="documents") + ")"


def stored_paths(c: Corpus):
    return c.spark.sql(STORED_PATHS, documents=c.documents)


@query(
    "page_scan_status",
    check(
        "work_pages",
        f", {STORED_SQL} select s.path, s.doi, case when w.path is null then 'file_not_found' else 'found' end as scan_status from stored s left join work_pages w on s.path = w.path",
    ),
)
def page_scan_status(c: Corpus):
    return stats.page_scan_status(stored_paths(c), c.work_pages.select("path"))


# Stored pages with an abstract box, by their first paragraph; others name no abstract.
BOXED = """
select concat('pages/', cast(page_id as string), '.html') as path, lead,
       case when page_id % 3 = 0 then concat('<html><div class="abstract-text"><p>', lead, '</p></div></html>') else html end as html
from (select page_id, html, regexp_extract(html, '<p>([^<&]*)</p>', 1) as lead from {pages})"""


@query(
    "extract_summary",
    check(
        "work_pages",
        f""", {STORED_SQL}
, boxed as ({BOXED.format(pages="pages")})
, o as (select case when b.path is null then 'file_not_found' when html like '%abstract-text%' and length(trim(lead)) > 50 then 'success' else 'failed' end as outcome
        from stored s left join boxed b on s.path = b.path)
select k.outcome, count(o.outcome) as n from (values ('success'), ('failed'), ('file_not_found')) k(outcome) left join o using (outcome) group by 1""",
    ),
)
def extract_summary(c: Corpus):
    """Outcomes of the extraction job over the stored paths, each opened where it lies; missing files are counted."""
    base = scratch_path(c.spark, "saved")
    write_texts(c.spark.sql(BOXED, pages=c.pages), base, content="html").agg(F.count("*")).collect()
    scanned = with_abstract(read_paths(stored_paths(c), base, content="html"))
    return stats.extract_summary(scanned.select("scan_status", "abstract"))


@query(
    "bad_pages",
    check(
        "work_pages",
        f""", {STORED_SQL}
, found as (select path, octet_length(encode(html)) as bytes from work_pages)
, s as (select path, doi from stored where doi not like '%7')
, j as (select coalesce(s.path, f.path) as path, s.doi, f.bytes, case when f.path is null then 'missing' when f.bytes not between 2500 and 3500 then null
               when s.doi is null then 'orphan' else 'size_match' end as page_status from s full outer join found f on s.path = f.path)
select path, doi, cast(bytes as double) as bytes, page_status from j where page_status is not null""",
    ),
)
def bad_pages(c: Corpus):
    """Stored paths (some records dropped, so that files without a record occur) against the page files."""
    stored = stored_paths(c).filter("doi not like '%7'")
    bad = maintenance.bad_pages(stored, c.work_pages.select("path", "html"), 3000, 500)
    return bad.withColumn("bytes", F.col("bytes").cast("double"))


@query(
    "orphan_files",
    check(
        "work_pages",
        f""", {STORED_SQL} select path from work_pages where octet_length(encode(html)) between 2500 and 3500
and path not in (select path from stored where doi not like '%7')""",
    ),
)
def orphan_files(c: Corpus):
    stored = stored_paths(c).filter("doi not like '%7'")
    return maintenance.orphan_files(stored, c.work_pages.select("path", "html"), 3000, 500)


@query(
    "backfill_files",
    check(
        "work_pages files",
        """select doi, page_url, pdf_file_path, match_score from work_pages w
where pdf_downloaded and pdf_file_path is not null and not exists (select 1 from files f where f.doi = w.doi)""",
    ),
)
def backfill_files(c: Corpus):
    return maintenance.backfill_files(c.work_pages, c.files)


FOUND_FILES = "select concat('10.5555_d', cast(user_id as string), '.pdf') as file_name from {events} group by 1"


@query(
    "adopt_orphans",
    check(
        "articles work_pages files",
        f""", found as ({FOUND_FILES.format(events='events')} union all select distinct source || '.pdf' from documents)
select d.file_name, a.doi, w.page_url, cast(w.match_score as double) as match_score, case when a.doi is null then 'orphan' when f.doi is not null then 'tracked' else 'adopt' end as file_status
from found d left join articles a on replace(a.doi, '/', '_') || '.pdf' = d.file_name left join work_pages w on a.doi = w.doi left join files f on a.doi = f.doi""",
    ),
)
def adopt_orphans(c: Corpus):
    """Stored file names, some of no article, with what they stand for."""
    found = c.spark.sql(FOUND_FILES, events=c.events).union(
        c.documents.select(F.concat("source", F.lit(".pdf"))).distinct()
    )
    adopted = maintenance.adopt_orphans(found, c.articles, c.work_pages, c.files)
    return adopted.withColumn("match_score", F.col("match_score").cast("double"))


RUN = "run7"
ATTENTION_SQL = f"""
, attention as (select id, doi, stage, status, error_message, processed_at from processing_log
  where processed_at >= (select min(started_at) from runs where run_id = '{RUN}')
    and ((stage = 'verify_pdf' and status = 'mismatch') or (stage = 'wiki_ingest' and status in ('flagged', 'failed'))))"""


@query("run_attention", check("processing_log runs", ATTENTION_SQL + " select * from attention"))
def run_attention(c: Corpus):
    return maintenance.run_attention(c.processing_log, c.runs, RUN)


@query(
    "run_report",
    check(
        STATS_TABLES + " runs",
        ATTENTION_SQL
        + f"""
, totals as ({STATS_SQL})
, t as (unpivot totals on columns(*) into name ord value n)
select 'stages' as section, strftime(started_at, '%Y-%m-%d %H:%M:%S') || '|' || stage as ord, stage || ' | ' || status as line from runs where run_id = '{RUN}'
union all select 'attention', lpad(cast(id as varchar), 20, '0'), '- `' || doi || '` — ' || stage || ': ' || status || ' (' || coalesce(nullif(error_message, ''), 'no detail') || ')' from attention
union all select 'state', ord, ord || ': ' || cast(n as varchar) from t""",
    ),
)
def run_report(c: Corpus):
    return maintenance.run_report(
        maintenance.run_stages(c.runs, RUN), maintenance.run_attention(c.processing_log, c.runs, RUN), totals(c)
    )


@query(
    "constraint_report",
    check(
        "articles work_pages published processing_log",
        """
select 'articles' as table_name, 'doi unique' as rule, count(*) as violations from (select doi from articles group by doi having count(*) > 1)
union all select 'articles', 'title not null', count(*) from articles where title is null
union all select 'articles', 'journal_name not null', count(*) from articles where journal_name is null
union all select 'published', 'bib_key unique', count(*) from (select bib_key from published group by bib_key having count(*) > 1)
union all select 'work_pages', 'doi references articles', count(*) from work_pages where doi not in (select doi from articles)
union all select 'processing_log', 'doi references work_pages', count(*) from processing_log where doi not in (select doi from work_pages)
union all select 'processing_log', 'doi references published', count(*) from processing_log where doi not in (select doi from published)""",
    ),
)
def constraint_report(c: Corpus):
    return constraints.report(
        [
            ("articles", "doi unique", constraints.unique(c.articles, "doi")),
            ("articles", "title not null", constraints.not_null(c.articles, "title")),
            ("articles", "journal_name not null", constraints.not_null(c.articles, "journal_name")),
            ("published", "bib_key unique", constraints.unique(c.published, "bib_key")),
            ("work_pages", "doi references articles", constraints.references(c.work_pages, c.articles, "doi")),
            ("processing_log", "doi references work_pages", constraints.references(c.processing_log, c.work_pages, "doi")),
            ("processing_log", "doi references published", constraints.references(c.processing_log, c.published, "doi")),
        ]
    )
