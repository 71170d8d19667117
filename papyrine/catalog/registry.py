"""The query register and the mapping of the base tables onto corpus tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# One text per corpus table, valid in Spark and (but for array_join) in DuckDB; braces hold base tables. The abstract
# of a page is the text of all its plain paragraphs.
VIEWS = {
    "articles": """
select concat('10.5555/d', cast(doc_id as string)) as doi,
       trim(regexp_extract(text, '^[^.\n]*', 0)) as title,
       case when doc_id % 5 = 0 then 'Unknown'
            when doc_id % 5 < 3 then concat(regexp_extract(text, '^[^ ]* ([^ ]*)', 1), ' ', regexp_extract(text, '^[^ ]* [^ ]* ([^ ]*)', 1), '; ',
                 regexp_extract(text, '^[^ ]* [^ ]* [^ ]* ([^ ]*)', 1), ' ', regexp_extract(text, '^[^ ]* [^ ]* [^ ]* [^ ]* ([^ ]*)', 1))
            else concat(regexp_extract(text, '^[^ ]* ([^ ]*)', 1), ', ', regexp_extract(text, '^[^ ]* [^ ]* ([^ ]*)', 1)) end as authors,
       cast(2004 + doc_id % 22 as int) as year,
       source as journal_issn,
       case when doc_id % 17 = 0 then null else concat('Journal ', source) end as journal_name,
       lang as publisher
from {documents}""",
    "texts": """
select concat('10.5555/d', cast(doc_id as string)) as doi, text from {documents}""",
    "work_pages": """
select concat('10.5555/d', cast(page_id * 3 as string)) as doi,
       case when page_id % 5 = 0 then null else url end as page_url,
       html,
       case when page_id % 7 = 0 then null when page_id % 7 = 1 then ''
            else array_join(regexp_extract_all(html, '<p>([^<]*)</p>', 1), ' ') end as abstract,
       case when page_id % 6 = 0 then null else concat(url, '.pdf') end as pdf_url,
       case when page_id % 4 = 0 then concat('files/10.5555_d', cast(page_id * 3 as string), '.pdf') end as pdf_file_path,
       page_id % 4 = 0 as pdf_downloaded,
       cast(60 + page_id % 41 as int) as match_score,
       case when page_id % 7 = 0 then 'No search results found'
            when page_id % 7 = 1 then 'No match above threshold 85' else null end as error_message,
       concat('pages/', cast(page_id as string), '.html') as path
from {pages}""",
    "page_titles": """
select concat('10.5555/d', cast(page_id * 3 as string)) as doi,
       page_id as pos,
       regexp_extract(html, '<title>([^<]*)</title>', 1) as title
from {pages}""",
    "processing_log": """
select event_id as id,
       concat('10.5555/d', cast(user_id * 3 as string)) as doi,
       case event_id % 5 when 0 then 'scrape_ssrn' when 1 then 'enrich_openalex' when 2 then 'download_pdf'
            when 3 then 'verify_pdf' else 'wiki_ingest' end as stage,
       case event_type when 'error' then 'failed' when 'click' then 'success' when 'view' then 'unavailable'
            when 'signup' then 'mismatch' else 'flagged' end as status,
       props as error_message,
       ts as processed_at
from {events}""",
    "files": """
select concat('10.5555/d', cast(doc_id as string)) as doi,
       case doc_id % 4 when 0 then 'ssrn' when 1 then 'nber' when 2 then 'arxiv' else 'oa' end as source,
       concat('10.5555_d', cast(doc_id as string), '.pdf') as file_name,
       case when quality = 1 and toxic = 0 then 'match' when quality = 1 then 'uncertain'
            when toxic = 1 then 'unreadable' else 'pending' end as verify_status,
       doc_id as downloaded_seq
from {labels}""",
    "candidates": """
select concat('10.5555/d', cast(user_id * 3 as string)) as doi,
       case event_id % 3 when 0 then 'oa' when 1 then 'nber' else 'arxiv' end as source,
       max(value) as match_score,
       max(ts) as checked_at
from {events} where event_type in ('view', 'error')
group by 1, 2""",
    "attempts": """
select concat('10.5555/d', cast(user_id * 3 as string)) as doi,
       event_id as pos,
       case event_id % 3 when 0 then 'oa' when 1 then 'nber' else 'arxiv' end as source,
       value as match_score,
       event_type
from {events}""",
    "published": """
select concat('10.5555/d', cast(doc_id as string)) as doi,
       concat('key', cast(2004 + doc_id % 22 as string), 'w', cast(doc_id as string)) as bib_key,
       case doc_id % 3 when 0 then 'ingested' when 1 then 'flagged' else 'failed' end as status
from {labels} where quality = 1""",
    "runs": """
select min(event_id) as id,
       concat('run', cast(user_id as string)) as run_id,
       event_type as stage,
       case when sum(value) > 300 then 'success' else 'failed' end as status,
       min(ts) as started_at, max(ts) as finished_at
from {events} group by 2, 3""",
    "changes": """
select concat('10.5555/', case when user_id % 5 = 0 then 'n' else 'd' end, cast(user_id * 3 as string)) as doi,
       event_id as ord, concat('note ', props) as note, value as score, event_type as kind
from {events}""",
    "journals": """
select distinct source as issn, concat('Journal ', source) as name,
       case when length(source) = 4 then 'finance' else 'economics' end as field
from {documents}""",
}
BASE = ("documents", "pages", "events", "labels", "benchmark")


class Corpus:
    """The corpus tables over one data folder, as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            # For files that Spark cannot split (one row group), the session may ask for partitions.
            asked = self.spark.conf.get("spark.papyrine.inputPartitions", None)
            return table.repartition(int(asked)) if asked and name in ("documents", "pages") else table
        if name not in VIEWS:
            raise AttributeError(name)
        used = {b: getattr(self, b) for b in BASE if "{" + b + "}" in VIEWS[name]}
        return self.spark.sql(VIEWS[name], **used)


def ctes(*names: str) -> str:
    """The corpus tables as the head of a WITH clause (for the check SQL)."""
    plain = {b: b for b in BASE}
    # The one function that has another name there.
    return ", ".join(f"{n} as ({VIEWS[n].format(**plain).replace('array_join(', 'array_to_string(')})" for n in names)


def check(names: str, body: str) -> str:
    """Check SQL over the named corpus tables; ``body`` is a SELECT, or starts with further CTEs and a comma."""
    head = "with " + ctes(*names.split())
    return head + (body if body.lstrip().startswith(",") else "\n" + body)


def query(name: str, sql: str | None = None):
    """Register ``fn(corpus) -> DataFrame`` under a name, with its check SQL."""

    def register(fn):
        QUERIES[name] = lambda spark, folder: fn(Corpus(spark, folder))
        QUERIES[name].__doc__ = fn.__doc__
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def at(text: str):
    """A timestamp without zone, as the tables hold it."""
    return F.lit(text).cast("timestamp_ntz")
