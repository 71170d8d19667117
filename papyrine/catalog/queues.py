"""Work queues, lookups and short lists."""

from __future__ import annotations

from papyrine.catalog.registry import Corpus, at, check, query
from papyrine.functions.journals import journals_by_field as by_field
from papyrine.operators import queues as q

ARTICLE = "doi, title, authors, year, journal_name"
UNAVAILABLE = "select doi from processing_log where stage = 'download_pdf' and status = 'unavailable'"


@query("articles_by_year", check("articles", "select * from articles where year between 2010 and 2015"))
def articles_by_year(c: Corpus):
    return q.articles_by_year(c.articles, 2010, 2015)


@query(
    "pending_pages",
    check("articles work_pages", f"select {ARTICLE} from articles a where not exists (select 1 from work_pages w where w.doi = a.doi)"),
)
def pending_pages(c: Corpus):
    return q.pending_pages(c.articles, c.work_pages)


@query(
    "missing_abstracts",
    check(
        "articles work_pages",
        """select a.doi, a.title, a.authors, a.year, a.journal_name from articles a left join work_pages w on a.doi = w.doi
where (w.abstract is null or w.abstract = '') and a.year >= 2010""",
    ),
)
def missing_abstracts(c: Corpus):
    return q.missing_abstracts(c.articles, c.work_pages, start=2010)


@query(
    "download_queue",
    check(
        "articles work_pages processing_log",
        f"""select w.doi, a.title, w.page_url, w.pdf_downloaded from work_pages w join articles a on w.doi = a.doi
where w.page_url is not null and (w.pdf_downloaded = false or w.pdf_downloaded is null) and w.doi not in ({UNAVAILABLE})""",
    ),
)
def download_queue(c: Corpus):
    return q.download_queue(c.articles, c.work_pages, c.processing_log, downloaded=False, include_unavailable=False)


@query(
    "verify_queue",
    check(
        "articles files",
        """select f.doi, f.source, f.file_name, a.title, a.authors, a.year, a.journal_name from files f join articles a on f.doi = a.doi
where f.verify_status in ('pending', 'uncertain')""",
    ),
)
def verify_queue(c: Corpus):
    return q.verify_queue(c.articles, c.files, ("pending", "uncertain"))


FALLBACK_SQL = f"""select a.doi, a.title, a.authors, a.year, a.journal_name
from articles a left join files f on a.doi = f.doi left join work_pages w on a.doi = w.doi
where f.doi is null and (w.page_url is null or exists (select 1 from ({UNAVAILABLE}) u where u.doi = a.doi))"""


@query("fallback_queue", check("articles files work_pages processing_log", FALLBACK_SQL))
def fallback_queue(c: Corpus):
    return q.fallback_queue(c.articles, c.work_pages, c.files, c.processing_log)


@query(
    "publish_queue",
    check(
        "articles files published",
        """select f.doi, f.file_name, a.title, a.authors, a.year, a.journal_name from files f join articles a on f.doi = a.doi
where f.verify_status = 'match' and not exists (select 1 from published p where p.doi = f.doi and p.status in ('ingested', 'flagged'))""",
    ),
)
def publish_queue(c: Corpus):
    return q.publish_queue(c.articles, c.files, c.published)


@query(
    "published_pages",
    check(
        "articles published",
        """select p.doi, p.bib_key, p.status, a.title, a.authors, a.year, a.journal_name from published p join articles a on p.doi = a.doi
where p.status in ('ingested', 'flagged')""",
    ),
)
def published_pages(c: Corpus):
    return q.published_pages(c.articles, c.published)


@query(
    "source_plan",
    check(
        "articles files work_pages processing_log candidates",
        f""", queue as ({FALLBACK_SQL})
, sources as (select * from (values ('oa', 0), ('nber', 1), ('arxiv', 2)) s(source, priority))
select q.doi, s.source, cast(s.priority as int) as priority, q.title, q.authors, q.year, q.journal_name from queue q cross join sources s
where not exists (select 1 from candidates k where k.doi = q.doi and k.source = s.source and k.checked_at >= timestamp '2024-01-29')""",
    ),
)
def source_plan(c: Corpus):
    queue = q.fallback_queue(c.articles, c.work_pages, c.files, c.processing_log)
    return q.source_plan(queue, c.candidates, ["oa", "nber", "arxiv"], at("2024-01-29"))


@query(
    "recent_enriched",
    check(
        "articles work_pages processing_log",
        """select p.id, p.doi, a.title, w.abstract, p.processed_at from processing_log p join work_pages w on p.doi = w.doi join articles a on a.doi = w.doi
where p.stage = 'enrich_openalex' and p.status = 'success' order by p.processed_at desc, p.id limit 5""",
    ),
)
def recent_enriched(c: Corpus):
    return q.recent_enriched(c.processing_log, c.work_pages, c.articles, 5)


@query(
    "search_author",
    check("articles", f"select {ARTICLE} from articles where lower(authors) like '%th_r%' order by year desc, title, doi limit 50"),
)
def search_author(c: Corpus):
    return q.search_author(c.articles, "TH_r", 50)


@query("lookup_doi", check("articles", "select * from articles where doi = '10.5555/d42'"))
def lookup_doi(c: Corpus):
    return q.lookup(c.articles, "10.5555/d42")


@query("journals_by_field", check("journals", "select issn, name, field from journals where field = 'economics'"))
def journals_by_field(c: Corpus):
    return by_field(c.journals, "Economics")


@query("sample_articles", check("articles", f"select {ARTICLE} from articles order by year desc, doi limit 10"))
def sample_articles(c: Corpus):
    return q.sample_articles(c.articles, 10)


@query("recent_log", check("processing_log", "select * from processing_log order by processed_at desc, id desc limit 10"))
def recent_log(c: Corpus):
    return q.recent_log(c.processing_log, 10)
