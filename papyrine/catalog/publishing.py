"""Citation keys, manifest, reconciliation and index pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyrine.catalog.cleaning import BASE_SQL
from papyrine.catalog.registry import Corpus, check, query
from papyrine.operators import keys, queues, site
from papyrine.functions.markdown import heading
from papyrine.session import scratch_path
from papyrine.sources.files import read_paths, write_texts
from papyrine.sources.pages import read_markdown

PAGES_SQL = """
, pages_ as (select p.doi, p.bib_key, p.status, a.title, a.authors, a.year, a.journal_name from published p join articles a on p.doi = a.doi where p.status in ('ingested', 'flagged'))
, lined as (select *, '- [' || title || '](../sources/' || bib_key || '.md) (' || authors || ', ' || year || ')' as plain, case when status = 'flagged' then ' ⚑' else '' end as flag from pages_)"""


def site_pages(c: Corpus):
    return queues.published_pages(c.articles, c.published)


@query(
    "index_by_journal",
    check("articles published", PAGES_SQL + " select journal_name as section, year, title, bib_key, plain || flag as line from lined where journal_name is not null"),
)
def index_by_journal(c: Corpus):
    return site.index_by_journal(site_pages(c))


@query(
    "index_by_year",
    check("articles published", PAGES_SQL + " select cast(year as varchar) as section, journal_name, title, bib_key, plain || flag as line from lined"),
)
def index_by_year(c: Corpus):
    return site.index_by_year(site_pages(c))


# A concept page per article of every published record: a heading (or none) and links to two keys.
CONCEPTS = """
select concat('concepts/', replace(doi, '/', '_'), '.md') as path,
       concat(case when n % 4 = 0 then 'no heading' else concat('intro\n# Topic ', cast(n as string), ' ') end, '\nsee sources/', bib_key, '.md and sources/', bib_key, '.md, sources/x1.md') as content
from (select doi, bib_key, cast(regexp_extract(bib_key, 'w([0-9]+)', 1) as int) as n from {published}) where n % 3 <> 1 or n % 5 = 0"""


@query(
    "index_by_topic",
    check(
        "articles published",
        PAGES_SQL
        + """
, c as (select doi, bib_key, replace(doi, '/', '_') as stem, cast(regexp_extract(bib_key, 'w([0-9]+)', 1) as int) as n from published)
, concepts as (select *, 'concepts/' || stem || '.md' as path, case when n % 4 = 0 then stem else 'Topic ' || n end as section from c where n % 3 <> 1 or n % 5 = 0)
select section, cast(0 as int) as part, path, cast(l.year as double) as year, l.title, l.bib_key, coalesce(l.plain, '_No ingested sources linked yet._') as line from concepts k left join lined l on k.bib_key = l.bib_key
union all select 'Unclassified', 1, '', year, title, bib_key, plain || flag from lined where bib_key not in (select bib_key from concepts)""",
    ),
)
def index_by_topic(c: Corpus):
    concepts = c.spark.sql(CONCEPTS, published=c.published)
    return site.index_by_topic(site_pages(c), concepts).withColumn("year", F.col("year").cast("double"))


# Few distinct authors and titles, so that many records ask for the same key.
QUEUE = "select doi, publisher as authors, year, publisher as title from {articles}"
WRITTEN = """
select distinct concat(publisher, cast(year as string), 'paper', case when year % 3 = 0 then '' when year % 3 = 1 then 'c' else '30' end) as key from {articles}"""

KEYS_SQL = f"""
, queue as ({QUEUE.format(articles='articles')})
, written as ({WRITTEN.format(articles='articles')})
, fresh as (select doi, authors || year || 'paper' as base, row_number() over (partition by authors, year order by md5(doi)) as rank from queue where doi not in (select doi from published))
, slots as (select i, case when i = 0 then '' else substr('bcdefghijklmnopqrstuvwxyz', i, 1) end as suffix from range(26) t(i))
, free as (select base, list(i order by i) as free from (select distinct base from fresh) cross join slots where base || suffix not in (select key from written) group by base)
, numbered as (select base, 30 as used from (select distinct base from fresh) where base || '30' in (select key from written))
select doi, bib_key from queue join published using (doi)
union all
select doi, base || case when rank <= len(free) then (select suffix from slots where i = free[rank]) else cast(greatest(coalesce(used, 0), 26) + rank - len(free) as varchar) end
from fresh join free using (base) left join numbered using (base)"""


@query("bib_keys", check("articles published", KEYS_SQL))
def bib_keys(c: Corpus):
    """Keys for all articles when many share a base: reuse, letters around taken keys, then numbers."""
    queue, written = c.spark.sql(QUEUE, articles=c.articles), c.spark.sql(WRITTEN, articles=c.articles)
    return keys.assign_bib_keys(queue, c.published, written)


MANIFEST_QUEUE_SQL = """
, queue as (select f.doi, f.file_name, a.title, a.authors, a.year, a.journal_name from files f join articles a on f.doi = a.doi
  where f.verify_status = 'match')"""


@query(
    "manifest",
    check(
        "articles files published",
        MANIFEST_QUEUE_SQL
        + """
select bib_key, 'downloaded' as status, file_name as target_filename, doi, title,
       array_to_string(list_filter(list_transform(string_split(authors, ';'), lambda a: trim(a)), lambda a: a <> ''), '|') as authors, year, journal_name as journal
from queue join published using (doi)""",
    ),
)
def manifest(c: Corpus):
    """Hand-over rows of all verified files that have a key, written as JSON with a list of authors and read back."""
    queue = queues.verify_queue(c.articles, c.files, ("match",))
    rows = keys.manifest(queue, c.published.select("doi", "bib_key"))
    path = scratch_path(c.spark, "manifest")
    keys.write_manifest(rows, path)
    return c.spark.read.schema(rows.schema).json(path).withColumn("authors", F.array_join("authors", "|"))


# Written pages for most keys: failed, flagged and plain ones.
PAGES = """
select bib_key as key, concat('sources/', bib_key, '.md') as path,
       concat('---\ntitle: "x: y"\n', case when n % 3 = 0 then 'extraction_failed: TRUE\n' when n % 3 = 1 then 'extraction_depth: quick\nverifier_model: "v"\n' else '' end,
              'extraction_model: m', cast(n as string), '\n---\n', case when n % 4 = 0 then 'text <!-- VERIFIER: no -->' else 'text' end) as content
from (select bib_key, cast(regexp_extract(bib_key, 'w([0-9]+)', 1) as int) as n from {published}) where n % 5 > 0"""


@query(
    "reconcile",
    check(
        "published",
        """
, k as (select doi, bib_key, cast(regexp_extract(bib_key, 'w([0-9]+)', 1) as int) as n from published)
select doi, bib_key, case when n % 5 > 0 then 'sources/' || bib_key || '.md' end as source_page_path,
       case when n % 5 > 0 then case when n % 3 = 1 then 'quick' else 'deep' end end as extraction_depth,
       case when n % 5 > 0 then 'm' || n end as analyst_model, case when n % 5 > 0 and n % 3 = 1 then 'v' end as verifier_model,
       case when n % 5 = 0 or n % 3 = 0 then 'failed' when n % 4 = 0 then 'flagged' else 'ingested' end as status,
       case when n % 5 = 0 then 'Source page not written' when n % 3 = 0 then 'extraction_failed in frontmatter' end as error_message
from k""",
    ),
)
def reconcile(c: Corpus):
    """State of every expected key from the files of the pages that were written, each opened by its key."""
    base = scratch_path(c.spark, "site")
    write_texts(c.spark.sql(PAGES, published=c.published), base).agg(F.count("*")).collect()
    expected = c.published.select("doi", "bib_key")
    named = expected.select(F.col("bib_key").alias("key"), F.concat(F.lit("sources/"), "bib_key", F.lit(".md")).alias("path")).distinct()
    written = read_paths(named, base).filter("scan_status = 'found'").select("key", "path", "content")
    return site.reconcile(expected, written)


@query("concept_pages", "select 'c' || item_id as key, 'Item ' || item_id as title, text as body from benchmark")
def concept_pages(c: Corpus):
    """Markdown pages found by pattern in a folder: key, first heading and the rest."""
    base = scratch_path(c.spark, "concepts")
    page = c.benchmark.select(F.format_string("concepts/c%d.md", "item_id").alias("path"), F.concat(F.format_string("# Item %d\n", "item_id"), "text").alias("content"))
    write_texts(page, base).agg(F.count("*")).collect()
    body = F.regexp_replace("content", r"^[^\n]*\n", "")
    return read_markdown(c.spark, base).select("key", heading(F.col("content")).alias("title"), body.alias("body"))


@query(
    "index_page_topics",
    check(
        "articles published",
        PAGES_SQL
        + """
, c as (select doi, bib_key, replace(doi, '/', '_') as stem, cast(regexp_extract(bib_key, 'w([0-9]+)', 1) as int) as n from published)
, concepts as (select *, 'concepts/' || stem || '.md' as path, case when n % 4 = 0 then stem else 'Topic ' || n end as section from c where n % 3 <> 1 or n % 5 = 0)
, rest as (select plain || flag as line from lined where bib_key not in (select bib_key from concepts))
, page as (
  select '# Papers by topic' as line union all select ''
  union all select '## [' || section || '](../concepts/' || stem || '.md)' from concepts union all select '' from concepts union all select '' from concepts
  union all select coalesce(l.plain, '_No ingested sources linked yet._') from concepts k left join lined l on k.bib_key = l.bib_key
  union all select unnest(['## Unclassified', '', '_Ingested but not yet linked from any concept page._', '', '']) where (select count(*) from rest) > 0
  union all select line from rest)
select line, count(*) as n from (select unnest(string_split(line, chr(10))) as line from page) group by line""",
    ),
)
def index_page_topics(c: Corpus):
    """The topic page as it is written: how often each of its lines occurs."""
    path = scratch_path(c.spark, "topics")
    site.write_lines(site.index_by_topic(site_pages(c), c.spark.sql(CONCEPTS, published=c.published)), path, "topic")
    return c.spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))
