"""Upserts, updates, deletes and appends. Each query returns the whole next version of its table.

The changes come from the event log: many rows per key, known and new keys.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from papyrine.catalog.cleaning import NOISY_TITLES, PATTERNS, PHRASES, noisy_titles
from papyrine.catalog.registry import Corpus, at, check, query
from papyrine.operators import upsert
from papyrine.operators.stats import failed_to_reset
from papyrine.sources.arrays import write_arrays
from papyrine.sources.metadata import read_array_dumps, read_dumps, readable, transform_works, unregistered
from papyrine.sources.tables import KeyedTable
from papyrine.session import scratch_path

OLD, NOW = "2024-01-01 00:00:00", "2024-02-01 00:00:00"
LAST = """
, last as (select * exclude (rn) from (select *, row_number() over (partition by doi order by ord desc) as rn from changes) where rn = 1)"""
T_OLD, T_NOW = f"timestamp '{OLD}'", f"timestamp '{NOW}'"


UPSERT_SQL = check(
    "articles changes",
    LAST
    + f"""
select coalesce(a.doi, n.doi) as doi, case when n.doi is null then a.title else n.note end as title, case when n.doi is null then a.authors else n.kind end as authors,
       coalesce(a.year, 1999) as year, case when a.doi is null then 'new' else a.journal_issn end as journal_issn, case when a.doi is null then {T_NOW} else {T_OLD} end as created_at,
       case when n.doi is null then {T_OLD} else {T_NOW} end as updated_at
from articles a full outer join last n on a.doi = n.doi""",
)


def _article_change(c: Corpus):
    """Current articles, and changes of known and new ones."""
    columns = ["doi", "title", "authors", "year", "journal_issn"]
    current = c.articles.select(*columns, at(OLD).alias("created_at"), at(OLD).alias("updated_at"))
    changes = c.changes.select(
        "doi",
        F.col("note").alias("title"),
        F.col("kind").alias("authors"),
        F.lit(1999).alias("year"),
        F.lit("new").alias("journal_issn"),
        "ord",
    )
    return current, changes


@query("upsert_articles", UPSERT_SQL)
def upsert_articles(c: Corpus):
    return upsert.upsert_articles(*_article_change(c), at(NOW))


@query("upsert_articles_stored", UPSERT_SQL)
def upsert_articles_stored(c: Corpus):
    """The same change of a stored table: only the buckets of the changed keys are written, each key once."""
    current, changes = _article_change(c)
    table = KeyedTable(c.spark, scratch_path(c.spark, "articles"), current.schema, ["doi"], buckets=16)
    table.change(current, lambda rows, new: new)
    table.change(changes, lambda rows, new: upsert.upsert_articles(rows, new, at(NOW)), not_null=["doi", "year"])
    return table.read()


@query("changed_articles", UPSERT_SQL + " where n.doi is not null and a.doi is not null")
def changed_articles(c: Corpus):
    """The changed rows alone, looked up by key in the buckets that hold them."""
    current, changes = _article_change(c)
    table = KeyedTable(c.spark, scratch_path(c.spark, "articles"), current.schema, ["doi"], buckets=16)
    table.change(current, lambda rows, new: new)
    known = changes.join(current.select("doi"), "doi", "left_semi")
    table.change(known, lambda rows, new: upsert.upsert_articles(rows, new, at(NOW)))
    return table.lookup(known)


PAGE = ["doi", "page_url", "html", "abstract", "match_score", "error_message", "pdf_downloaded", "pdf_file_path"]


def pages_with_time(c: Corpus):
    return c.work_pages.select(*PAGE, at(OLD).alias("scraped_at"))


def shown(df):
    """Page columns without the page text; the score as a double."""
    return df.drop("html").withColumn("match_score", F.col("match_score").cast("double"))


@query(
    "upsert_pages",
    check(
        "work_pages changes",
        LAST
        + f"""
select coalesce(w.doi, n.doi) as doi, case when n.doi is null then w.page_url else n.kind end as page_url, case when n.doi is null then w.abstract else n.note end as abstract,
       cast(case when n.doi is null then w.match_score else cast(floor(n.score) as int) end as double) as match_score,
       case when n.doi is null then w.error_message end as error_message,
       coalesce(w.pdf_downloaded, false) as pdf_downloaded, w.pdf_file_path, case when n.doi is null then {T_OLD} else {T_NOW} end as scraped_at
from work_pages w full outer join last n on w.doi = n.doi""",
    ),
)
def upsert_pages(c: Corpus):
    changes = c.changes.select(
        "doi",
        F.col("kind").alias("page_url"),
        F.lit("<p></p>").alias("html"),
        F.col("note").alias("abstract"),
        F.floor("score").cast("int").alias("match_score"),
        F.lit(None).cast("string").alias("error_message"),
        "ord",
    )
    return shown(upsert.upsert_pages(pages_with_time(c), changes, at(NOW)))


FILL_SQL = f"""
, filled as (select coalesce(w.doi, n.doi) as doi, w.page_url, cast(w.match_score as double) as match_score, w.error_message, coalesce(w.pdf_downloaded, false) as pdf_downloaded, w.pdf_file_path,
       w.doi is not null as old, n.doi is not null as hit, w.abstract, n.note from work_pages w full outer join last n on w.doi = n.doi)"""


@query(
    "fill_abstract",
    check(
        "work_pages changes",
        LAST
        + FILL_SQL
        + f"""
select doi, page_url, match_score, error_message, pdf_downloaded, pdf_file_path,
       case when hit and coalesce(abstract, '') = '' then note else abstract end as abstract, case when hit and coalesce(abstract, '') = '' then {T_NOW} else {T_OLD} end as scraped_at from filled""",
    ),
)
def fill_abstract(c: Corpus):
    changes = c.changes.select("doi", F.col("note").alias("abstract"), "ord")
    return shown(upsert.fill_abstract(pages_with_time(c), changes, at(NOW)))


@query(
    "replace_abstract",
    check(
        "work_pages changes",
        LAST
        + FILL_SQL
        + f"""
select doi, page_url, match_score, error_message, pdf_downloaded, pdf_file_path, case when hit then note else abstract end as abstract, case when hit then {T_NOW} else {T_OLD} end as scraped_at from filled""",
    ),
)
def replace_abstract(c: Corpus):
    changes = c.changes.select("doi", F.col("note").alias("abstract"), "ord")
    return shown(upsert.fill_abstract(pages_with_time(c), changes, at(NOW), force=True))


@query(
    "update_files",
    check(
        "work_pages changes",
        LAST
        + """
select w.doi, case when n.doi is null then w.pdf_url else n.note end as pdf_url, case when n.doi is null then w.pdf_file_path when n.kind = 'error' then null else n.kind end as pdf_file_path,
       case when n.doi is null then w.pdf_downloaded else n.kind <> 'error' end as pdf_downloaded from work_pages w left join last n on w.doi = n.doi""",
    ),
)
def update_files(c: Corpus):
    """Download state of known pages after the last change of each."""
    done = F.col("kind") != "error"
    changes = c.changes.select(
        "doi", F.col("note").alias("pdf_url"), F.when(done, F.col("kind")).alias("pdf_file_path"), done.alias("pdf_downloaded"), "ord"
    )
    return upsert.update_file_info(c.work_pages.select("doi", "pdf_url", "pdf_file_path", "pdf_downloaded"), changes)


def files_table(c: Corpus):
    return c.files.select(
        "doi",
        "source",
        F.lit(None).cast("string").alias("source_url"),
        F.lit(None).cast("string").alias("pdf_url"),
        F.col("file_name").alias("pdf_file_path"),
        F.lit(50.0).alias("match_score"),
        "verify_status",
        F.lit("llm").alias("verify_method"),
        F.lit(1.5).alias("verify_score"),
        F.lit("m").alias("verify_model"),
        F.lit("r").alias("verify_reason"),
        at(OLD).alias("downloaded_at"),
        at(OLD).alias("verified_at"),
    )


@query(
    "upsert_files",
    check(
        "files changes",
        LAST
        + f"""
select coalesce(f.doi, n.doi) as doi, case when n.doi is null then f.source else n.kind end as source, case when n.doi is not null then 'u' end as source_url, n.note as pdf_url,
       case when n.doi is null then f.file_name else 'p' || n.kind end as pdf_file_path, case when n.doi is null then 50.0::double else n.score end as match_score,
       case when n.doi is null then f.verify_status else 'pending' end as verify_status, case when n.doi is null then 'llm' end as verify_method, case when n.doi is null then 1.5::double end as verify_score,
       case when n.doi is null then 'm' end as verify_model, case when n.doi is null then 'r' end as verify_reason,
       case when n.doi is null then {T_OLD} else {T_NOW} end as downloaded_at, case when n.doi is null then {T_OLD} end as verified_at
from files f full outer join last n on f.doi = n.doi""",
    ),
)
def upsert_files(c: Corpus):
    changes = c.changes.select(
        "doi",
        F.col("kind").alias("source"),
        F.lit("u").alias("source_url"),
        F.col("note").alias("pdf_url"),
        F.concat(F.lit("p"), "kind").alias("pdf_file_path"),
        F.col("score").alias("match_score"),
        "ord",
    )
    return upsert.upsert_files(files_table(c), changes, at(NOW))


@query(
    "set_verification",
    check(
        "files changes",
        LAST
        + f"""
select f.doi, f.source, case when n.doi is null then f.verify_status else n.kind end as verify_status, case when n.doi is null then 'llm' else 'deterministic' end as verify_method,
       case when n.doi is null then 1.5::double else n.score end as verify_score, case when n.doi is null then 'r' else n.note end as verify_reason,
       case when n.doi is null then {T_OLD} else {T_NOW} end as verified_at from files f left join last n on f.doi = n.doi""",
    ),
)
def set_verification(c: Corpus):
    verdicts = c.changes.select(
        "doi",
        F.col("kind").alias("verify_status"),
        F.lit("deterministic").alias("verify_method"),
        F.col("score").alias("verify_score"),
        F.lit(None).cast("string").alias("verify_model"),
        F.col("note").alias("verify_reason"),
        "ord",
    )
    out = upsert.set_verification(files_table(c), verdicts, at(NOW))
    return out.select("doi", "source", "verify_status", "verify_method", "verify_score", "verify_reason", "verified_at")


@query(
    "upsert_candidates",
    check(
        "candidates attempts",
        f"""
, last as (select * exclude (rn) from (select *, row_number() over (partition by doi, source order by pos desc) as rn from attempts where event_type <> 'view') where rn = 1)
select coalesce(k.doi, n.doi) as doi, coalesce(k.source, n.source) as source, case when n.doi is null then k.match_score else n.match_score end as match_score,
       case when n.doi is null then 'no_match' else n.event_type end as status, case when n.doi is null then k.checked_at else {T_NOW} end as checked_at
from candidates k full outer join last n on k.doi = n.doi and k.source = n.source""",
    ),
)
def upsert_candidates(c: Corpus):
    none = F.lit(None).cast("string")
    current = c.candidates.select(
        "doi", "source", none.alias("candidate_url"), none.alias("pdf_url"), "match_score", F.lit("no_match").alias("status"), none.alias("error_message"), "checked_at"
    )
    changes = c.attempts.filter("event_type <> 'view'").select(
        "doi", "source", none.alias("candidate_url"), none.alias("pdf_url"), "match_score", F.col("event_type").alias("status"), none.alias("error_message"), F.col("pos").alias("ord")
    )
    return upsert.upsert_candidates(current, changes, at(NOW)).select("doi", "source", "match_score", "status", "checked_at")


@query(
    "upsert_published",
    check(
        "published changes",
        LAST
        + f"""
, n as (select *, case kind when 'click' then 'ingested' when 'error' then 'failed' when 'view' then 'flagged' else 'pending' end as new_status from last)
select coalesce(p.doi, n.doi) as doi, case when n.doi is null then p.bib_key else 'k' || n.ord end as bib_key, coalesce(n.new_status, p.status) as status,
       n.note as error_message, case when n.doi is null then {T_OLD} when n.new_status in ('ingested', 'flagged') then {T_NOW} end as ingested_at
from published p full outer join n on p.doi = n.doi""",
    ),
)
def upsert_published(c: Corpus):
    none = F.lit(None).cast("string")
    unset = [none.alias(n) for n in ("source_page_path", "extraction_depth", "analyst_model", "verifier_model")]
    current = c.published.select("doi", "bib_key", *unset, "status", none.alias("error_message"), at(OLD).alias("ingested_at"))
    status = F.when(F.col("kind") == "click", "ingested").when(F.col("kind") == "error", "failed").when(F.col("kind") == "view", "flagged")
    changes = c.changes.select(
        "doi",
        F.concat(F.lit("k"), F.col("ord").cast("string")).alias("bib_key"),
        *unset,
        status.otherwise("pending").alias("status"),
        F.col("note").alias("error_message"),
        "ord",
    )
    out = upsert.upsert_published(current, changes, at(NOW))
    return out.select("doi", "bib_key", "status", "error_message", "ingested_at")


@query(
    "append_runs",
    check(
        "runs journals",
        f"""
select id, run_id, stage, status, null::varchar as detail, started_at, finished_at from runs
union all select (select max(id) from runs) + row_number() over (order by md5(issn)), 'new', issn, 'running', null, {T_NOW}, null from journals""",
    ),
)
def append_runs(c: Corpus):
    """The run ledger with a started stage per journal."""
    none = F.lit(None).cast("string")
    current = c.runs.select("id", "run_id", "stage", "status", none.alias("detail"), "started_at", "finished_at")
    rows = c.journals.select(
        F.lit("new").alias("run_id"), F.col("issn").alias("stage"), F.lit("running").alias("status"), at(NOW).alias("started_at")
    )
    return upsert.append_with_ids(current, rows, F.md5("stage"))


@query(
    "finish_stages",
    check(
        "runs",
        f"""
select id, run_id, stage, case when stage = 'error' then 'failed' else status end as status, case when stage = 'error' then '{{"n":' || id || '}}' end as detail,
       case when stage = 'error' then {T_NOW} else finished_at end as finished_at from runs""",
    ),
)
def finish_stages(c: Corpus):
    """The run ledger after every error stage was closed with a JSON detail."""
    current = c.runs.select("id", "run_id", "stage", "status", F.lit(None).cast("string").alias("detail"), "finished_at")
    outcomes = c.runs.filter("stage = 'error'").select(
        "id", F.lit("failed").alias("status"), F.to_json(F.struct(F.col("id").alias("n"))).alias("detail")
    )
    return upsert.finish_stages(current, outcomes, at(NOW))


@query(
    "delete_cascade",
    check(
        "articles work_pages",
        """
, gone as (select w.doi from work_pages w join articles a on w.doi = a.doi where w.error_message like '%No search results%' or w.error_message like '%Failed to search SSRN%')
select 'articles' as table_name, doi from articles where doi not in (select doi from gone)
union all select 'work_pages', doi from work_pages where doi not in (select doi from gone)""",
    ),
)
def delete_cascade(c: Corpus):
    articles, pages = upsert.delete_cascade(c.articles, c.work_pages, failed_to_reset(c.work_pages, c.articles))
    return articles.select(F.lit("articles").alias("table_name"), "doi").unionByName(
        pages.select(F.lit("work_pages").alias("table_name"), "doi")
    )


WORKS_SQL = (
    "with noisy as ("
    + NOISY_TITLES.format(documents="documents")
    + f"""), j as (select distinct source as issn, 'Journal ' || source as name from documents)
, valid as (select *, lower(title) as low from noisy)
, works as (select doi, trim(regexp_replace(title, '\\s+', ' ', 'g')) as title, case when year % 3 = 0 then 'Unknown' else 'Ann ' || kind || '; Solo' end as authors, year, journal_name as journal_issn, name as journal_name,
            case when year % 2 = 0 then 'Unknown' else 'P' end as publisher
     from valid join j on issn = journal_name
     where kind in ('journal-article', 'proceedings-article') and not ({PHRASES}) and not ({PATTERNS}) and year <> 2007)"""
)


def works(c: Corpus):
    """Works as the metadata service delivers them, one per document, some twice."""
    author = F.array(
        F.struct(F.lit("Ann").alias("given"), F.col("kind").alias("family")),
        F.struct(F.lit(None).cast("string").alias("given"), F.lit("Solo").alias("family")),
        F.struct(F.lit("Only").alias("given"), F.lit(None).cast("string").alias("family")),
    )
    issued = F.array(F.array(F.when(F.col("year") != 2007, F.col("year"))))
    base = noisy_titles(c).select(
        F.col("kind").alias("type"),
        F.col("doi").alias("DOI"),
        F.when(F.col("year") % 2 == 1, "P").alias("publisher"),
        F.array("title").alias("title"),
        F.when(F.col("year") % 3 != 0, author).alias("author"),
        F.struct(issued.alias("date-parts")).alias("issued"),
        F.col("journal_name").alias("issn"),
        F.col("year").alias("dump_year"),
    )
    return base.unionByName(base.filter("dump_year = 2005"))


ARTICLE_ROW = "doi, title, authors, year, journal_issn, journal_name, publisher"


@query("transform_metadata", WORKS_SQL + f" select {ARTICLE_ROW} from works")
def transform_metadata(c: Corpus):
    """Article rows from nested works: validity rule, cleaned title, author string, year, journal constants."""
    return transform_works(works(c), c.journals)


def write_dumps(c: Corpus, name: str) -> str:
    """Write the works as JSON dumps, one folder per journal and year, below the shared scratch folder."""
    path = scratch_path(c.spark, name)
    tagged = works(c).withColumn("dump", F.format_string("cache_%s_%d.json", "issn", "dump_year"))
    tagged.drop("issn", "dump_year").repartition("dump").write.partitionBy("dump").json(path)
    return path


@query("scan_metadata", WORKS_SQL + f" select {ARTICLE_ROW} from works")
def scan_metadata(c: Corpus):
    """The same rows from JSON dumps on disk, one array per journal and year; both come from the dump's name."""
    path = scratch_path(c.spark, "dumps")
    told = works(c).select(
        F.format_string("cache_%s_%d.json", "issn", "dump_year").alias("name"), F.to_json(F.struct(*[x for x in works(c).columns if x not in ("issn", "dump_year")])).alias("value")
    )
    write_arrays(told, path)
    return transform_works(readable(read_array_dumps(c.spark, path, "part-*", split=1 << 16)), c.journals)


@query("scan_metadata_lines", WORKS_SQL + f" select {ARTICLE_ROW} from works")
def scan_metadata_lines(c: Corpus):
    """The same rows from dumps of one work per line."""
    return transform_works(readable(read_dumps(c.spark, write_dumps(c, "dumps"), multi_line=False)), c.journals)


@query(
    "unregistered_works",
    WORKS_SQL
    + " select journal_name as issn, count(*) + count(*) filter (year = 2005) as works from noisy where journal_name is null or length(journal_name) <> 4 group by 1",
)
def unregistered_works(c: Corpus):
    """Works of dumps whose journal is not in a registry that lacks half of them."""
    return unregistered(works(c), c.journals.filter(F.length("issn") == 4))
