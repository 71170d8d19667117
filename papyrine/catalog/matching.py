"""Title matching, source resolution, verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyrine.catalog.cleaning import FRACTION_SQL, NAMES_SQL
from papyrine.catalog.registry import Corpus, at, check, query
from papyrine.functions.clean import atom_pdf_url, author_fraction, author_last_names, head_text
from papyrine.functions.pagetext import page_paragraphs
from papyrine.functions.text import squeeze
from papyrine.operators import matching, stats, verify
from papyrine.plans import flows
from papyrine.session import scratch_path
from papyrine.sources.metadata import read_enriched, read_listings
from papyrine.sources.pages import parse_feed


@query("title_match")
def title_match(c: Corpus):
    """The best page of every article whose combined similarity reaches the threshold."""
    found = matching.title_match(c.articles, c.page_titles, threshold=85.0)
    return found.select("doi", "pos", F.round("similarity", 6).alias("similarity"), "match_score")


@query(
    "best_candidate",
    check(
        "attempts",
        """select doi, pos, source, match_score, event_type from (select *, row_number() over (partition by doi order by match_score desc, pos) as rn from attempts) where rn = 1""",
    ),
)
def best_candidate(c: Corpus):
    return stats.best_candidate(c.attempts, "doi", F.col("match_score"), F.col("pos"))


@query(
    "first_source",
    check(
        "attempts",
        """select doi, pos, source, match_score, event_type from (select *, row_number() over (partition by doi
order by case source when 'oa' then 0 when 'nber' then 1 else 2 end, pos) as rn from attempts where event_type in ('click', 'purchase')) where rn = 1""",
    ),
)
def first_source(c: Corpus):
    found = c.attempts.filter(F.col("event_type").isin("click", "purchase"))
    return stats.first_source(found, ["oa", "nber", "arxiv"])


def _with_title(c: Corpus):
    return c.page_titles.select("doi", "pos", F.col("title").alias("page_title")).join(
        c.articles.select("doi", "title", "authors"), "doi"
    )


SAME_SQL = r"""
, both_titles as (select p.doi, p.pos, p.title as page_title, a.title, a.authors from page_titles p join articles a using (doi))
, told as (select *, (contains(lower(title), lower(page_title)) or contains(lower(page_title), lower(title)))
             and len(regexp_extract_all(title, '\S+')) = len(regexp_extract_all(page_title, '\S+')) as same from both_titles)"""


# A title with one more word holds the whole title, so its partial ratio is 100 and its length score says the rest.
LONGER_SQL = r"""
, scored as (select *, len(regexp_extract_all(title, '\S+')) as w, len(regexp_extract_all(page_title, '\S+')) as pw,
             contains(lower(title), lower(page_title)) or contains(lower(page_title), lower(title)) as inside from told where title <> '' and trim(page_title) <> '')
, both_scores as (select *, case when inside then (1 - 0.3::double) * 100 + 0.3::double * (least(w, pw) / greatest(w, pw) * 100) else 0 end as first_score,
             (1 - 0.3::double) * 100 + 0.3::double * (w / (w + 1) * 100) as second_score from scored)"""


@query(
    "resolve_listing",
    check(
        "articles page_titles",
        SAME_SQL
        + LONGER_SQL
        + """
select doi, 'nber' as source, 'https://www.nber.org/papers/w' || n as candidate_url,
       'https://www.nber.org/system/files/working_papers/w' || n || '/w' || n || '.pdf' as pdf_url, round(greatest(first_score, second_score), 6) as match_score
from (select *, case when first_score >= second_score then '1' else '2' end || pos as n from both_scores) where greatest(first_score, second_score) >= 90""",
    ),
)
def resolve_listing(c: Corpus):
    """Best item of a listing per article: its page's title, its own title and a word in tags, the same again (the
    earlier one stays), and its own title as an item of another kind. Short titles stay below the threshold."""
    n = F.col("pos").cast("string")

    def item(title, url):
        return F.struct(title.alias("title"), url.alias("url"))

    results = F.array(
        item(F.col("page_title"), F.concat(F.lit("/papers/w1"), n)),
        item(F.concat(F.lit("<b>"), F.col("title"), F.lit("</b> plus")), F.concat(F.lit("/papers/w2"), n)),
        item(F.concat(F.col("title"), F.lit(" <i>plus</i>")), F.concat(F.lit("/papers/w4"), n)),
        item(F.col("title"), F.concat(F.lit("/books/b3"), n)),
    )
    listed = _with_title(c).filter("title <> '' and trim(page_title) <> ''")
    told = listed.select("doi", "title", F.to_json(F.struct(results.alias("results"))).alias("raw"))
    found = matching.resolve_listing(read_listings(told, "raw"))
    return found.withColumn("match_score", F.round("match_score", 6))


# A feed with two entries: the page's title by a stranger, and the article's title by the article's last author word.
FEED = """
select doi, pos, title, authors, concat('<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/1', cast(pos as string),
  '</id><title>  ', page_escaped, '\n x </title><author><name>No Body</name></author><link href="http://a/1" type="text/html"/></entry>',
  '<entry><id>http://arxiv.org/abs/2', cast(pos as string), '</id><title>', escaped, '</title><author><name>A B</name></author><author><name>Some ', last, '</name></author>',
  case when pos % 2 = 0 then '<link href="http://a/2.pdf" type="application/pdf" rel="related"/>' else '' end, '</entry></feed>') as xml
from {source}"""


# The same with one more word in the second title, and that entry once more.
LONGER_FEED = FEED.replace("', escaped, '</title>", "', escaped, ' plus</title>").replace(
    "'</entry></feed>')",
    "'</entry><entry><id>http://arxiv.org/abs/3', cast(pos as string), '</id><title>', escaped, ' plus</title><author><name>Some ', last, '</name></author></entry></feed>')",
)


def _feeds(c: Corpus, feed: str = FEED):
    def escape(col):
        return F.replace(F.replace(F.replace(col, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    # A page's title is encoded for HTML: names that XML has not, and references that were cut, are text to a feed.
    page = F.replace(F.regexp_replace("page_title", "&(?!(?:quot|lt|gt|amp);)", "&amp;"), F.lit(">"), F.lit("&gt;"))

    source = _with_title(c).select(
        "doi",
        "pos",
        "title",
        "authors",
        page.alias("page_escaped"),
        escape(F.col("title")).alias("escaped"),
        # A name in two words stays one word here, so that its second is nobody's last name. Authors may give no name.
        escape(F.regexp_replace(F.coalesce(F.try_element_at(author_last_names(F.col("authors")), F.lit(-1)), F.lit("")), r"\s+", "-")).alias("last"),
    )
    return parse_feed(c.spark.sql(feed, source=source))


@query(
    "atom_entries",
    check(
        "articles page_titles",
        r"""
select doi, e as entry, case when e = 1 then trim(regexp_replace(replace(replace(replace(replace(p.title, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') || ' x', '\s+', ' ', 'g'))
       else trim(regexp_replace(a.title, '\s+', ' ', 'g')) end as title,
       case when e = 2 and pos % 2 = 0 then 'http://a/2.pdf' else 'http://arxiv.org/pdf/' || e || pos end as pdf_url
from page_titles p join articles a using (doi) cross join (values (1), (2)) t(e)""",
    ),
)
def atom_entries(c: Corpus):
    """Entries of a feed per page: title and PDF address."""
    entry = _feeds(c).select("doi", F.posexplode("entries").alias("i", "e"))
    return entry.select(
        "doi",
        (F.col("i") + 1).alias("entry"),
        squeeze(F.coalesce("e.title", F.lit(""))).alias("title"),
        atom_pdf_url(F.col("e.id"), F.col("e.link")).alias("pdf_url"),
    )


@query(
    "resolve_atom",
    check(
        "articles page_titles",
        f"""
select doi, 'arxiv' as source, 'http://arxiv.org/abs/2' || pos as candidate_url,
       case when pos % 2 = 0 then 'http://a/2.pdf' else 'http://arxiv.org/pdf/2' || pos end as pdf_url,
       round((1 - 0.3::double) * 100 + 0.3::double * (w / (w + 1) * 100), 6) as match_score
from (select p.pos, a.*, len(regexp_extract_all(a.title, '\\S+')) as w from page_titles p join articles a using (doi)
      where a.title <> '' and not regexp_matches({NAMES_SQL}[-1], '\\s'))
where (1 - 0.3::double) * 100 + 0.3::double * (w / (w + 1) * 100) >= 90""",
    ),
)
def resolve_atom(c: Corpus):
    """Best feed entry per article that shares an author (names in two words before a comma never match): the article's
    title and a word, twice, of which the earlier stays; short titles stay below the threshold. Articles without a last
    name are left out: any author would do for them."""
    feeds = _feeds(c, LONGER_FEED).filter("title <> ''").filter(F.size(author_last_names(F.col("authors"))) > 0)
    return matching.resolve_atom(feeds).withColumn("match_score", F.round("match_score", 6))


@query(
    "resolve_oa",
    check(
        "work_pages",
        """
select doi, 'oa' as source, page_url as candidate_url, coalesce(pdf_url, 'http://oa.org/' || doi) as pdf_url, 100.0::double as match_score from work_pages where pdf_url is not null
union all select doi, 'oa', 'http://oa.org', 'http://oa.org/' || doi, 100.0::double from work_pages where pdf_url is null""",
    ),
)
def resolve_oa(c: Corpus):
    """Open-access location of the work of every page."""

    def place(pdf, landing):
        return F.struct(pdf.cast("string").alias("pdf_url"), landing.cast("string").alias("landing_page_url"))

    works = c.work_pages.select(
        "doi",
        F.when(F.col("pdf_url").isNotNull(), place(F.col("pdf_url"), F.col("page_url"))).alias("best_oa_location"),
        F.array(
            place(F.concat(F.lit("https://papers.ssrn.com/"), "doi"), F.lit("http://s")),
            place(F.concat(F.lit("http://oa.org/"), "doi"), F.lit("http://oa.org")),
        ).alias("locations"),
    )
    path = scratch_path(c.spark, "works")
    works.write.json(path)
    return matching.resolve_oa(read_enriched(c.spark, path))


# Scores and verdicts supplied as input, for every file.
VERDICTS = """
select doi, case when downloaded_seq % 7 = 0 then '{{"match": true}}'
     else concat('{{"match": ', case when downloaded_seq % 2 = 0 then 'true' else 'false' end, ', "confidence": 0.', cast(5 + downloaded_seq % 4 as string), ', "reason": "', case when downloaded_seq % 5 = 0 then '' else concat('seen ', doi) end, '"}}') end as verdict
from {files} where downloaded_seq % 3 > 0"""


@query(
    "verify_status",
    check(
        "articles texts files",
        FRACTION_SQL
        + """
, checked as (select f.doi, case when downloaded_seq % 11 > 0 then 'text' end as text, cast(downloaded_seq * 7 % 101 as double) as score, fraction as frac, downloaded_seq as n
              from files f join fractions using (doi))
, decided as (select *, case when text is null then 'unreadable' when score >= 88 and frac >= 0.5 then 'match' when score <= 55 and frac = 0 then 'mismatch' else 'gray' end as first,
              n % 3 > 0 as told, n % 7 > 0 as valid, case when n % 5 = 0 then '' else 'seen ' || doi end as said, n % 2 = 0 as yes, n % 4 >= 2 as sure, 'Title ' || cast(score as int) || ', authors ' || cast(round_even(frac * 100, 0) as int) || '%' as numbers from checked)
select doi, case when first <> 'gray' then first when told and valid and sure and yes then 'match' when told and valid and sure then 'mismatch' else 'uncertain' end as verify_status,
       case when first = 'gray' and told then 'llm' else 'deterministic' end as verify_method, case when first <> 'unreadable' then score end as verify_score,
       case when first = 'gray' and told then 'small' end as verify_model,
       case when first = 'unreadable' then 'No extractable text' when first = 'match' then numbers when first = 'mismatch' then 'Title score ' || cast(score as int) || ', no author match'
            when told and not valid then 'LLM call failed' when told and sure and not yes and said = '' then 'Title score ' || cast(score as int) || ', no author match'
            when told then said else 'Gray zone (t' || substr(numbers, 2) || '), LLM disabled' end as verify_reason
from decided""",
    ),
)
def verify_status(c: Corpus):
    """Decision for all files from given scores, real author shares and outside verdicts."""
    checked = (
        c.files.join(c.articles.select("doi", "authors"), "doi")
        .join(c.texts.withColumnRenamed("text", "body"), "doi")
        .select(
            "doi",
            F.when(F.col("downloaded_seq") % 11 > 0, F.lit("text")).alias("text"),
            (F.col("downloaded_seq") * 7 % 101).cast("double").alias("title_score"),
            author_fraction(F.col("authors"), F.col("body")).alias("author_frac"),
        )
    )
    verdicts = verify.parse_verdicts(c.spark.sql(VERDICTS, files=c.files))
    return verify.verify(checked, verdicts, "small")


@query("verify_pages")
def verify_pages(c: Corpus):
    """Title and authors of every article with a page, checked against the page's whole text."""
    rows = c.work_pages.select("doi", head_text(page_paragraphs(F.col("html"))).alias("text")).join(
        c.articles.select("doi", "title", "authors"), "doi"
    )
    return verify.verify(verify.check_text(rows)).withColumn("verify_score", F.round("verify_score", 6))


NOW = "2024-02-01 00:00:00"


@query(
    "quarantine",
    check(
        "files work_pages processing_log candidates",
        """
, bad as (select doi, source from files where verify_status in ('unreadable', 'uncertain'))
, misses as (select doi, source from bad where source <> 'ssrn')
, lines as (select doi, 'verify_pdf' as stage, 'mismatch' as status, 'Title score 12, no author match' as note from bad
            union all select doi, 'download_pdf', 'unavailable', 'PDF mismatch quarantined' from bad where source = 'ssrn')
select 'pages' as table_name, doi as key, cast(case when b.doi is null then pdf_downloaded else false end as varchar) as status,
       case when b.doi is null then pdf_file_path end as note from work_pages w left join (select doi from bad where source = 'ssrn') b using (doi)
union all select 'candidates', coalesce(k.doi, m.doi) || '|' || coalesce(k.source, m.source), case when m.doi is null then 'old' else 'no_match' end,
       case when m.doi is null then null else 'Verified mismatch' end from candidates k full outer join misses m on k.doi = m.doi and k.source = m.source
union all select 'files', doi, verify_status, null from files where doi not in (select doi from bad)
union all select 'log', doi || '|' || id, status, error_message from processing_log
union all select 'log', doi || '|' || ((select max(id) from processing_log) + row_number() over (order by md5(doi || '|' || stage))), status, note from lines""",
    ),
)
def quarantine(c: Corpus):
    """All four tables after the doubtful files were taken out, as (table, key, status, note)."""
    bad = c.files.filter(F.col("verify_status").isin("unreadable", "uncertain")).select(
        "doi", "source", F.lit("Title score 12, no author match").alias("reason")
    )
    memo = c.candidates.select(
        "doi",
        "source",
        F.lit(None).cast("string").alias("candidate_url"),
        F.lit(None).cast("string").alias("pdf_url"),
        "match_score",
        F.lit("old").alias("status"),
        F.lit(None).cast("string").alias("error_message"),
        "checked_at",
    )
    out = verify.quarantine(bad, c.work_pages, c.files, memo, c.processing_log, at(NOW))

    def rows(name, df, key, status, note):
        return df.select(F.lit(name).alias("table_name"), key.alias("key"), status.alias("status"), note.alias("note"))

    none = F.lit(None).cast("string")
    parts = [
        rows("pages", out["pages"], F.col("doi"), F.col("pdf_downloaded").cast("string"), F.col("pdf_file_path")),
        rows("candidates", out["candidates"], F.concat_ws("|", "doi", "source"), F.col("status"), F.col("error_message")),
        rows("files", out["files"], F.col("doi"), F.col("verify_status"), none),
        rows("log", c.processing_log.unionByName(out["log"]), F.concat_ws("|", "doi", F.col("id").cast("string")), F.col("status"), F.col("error_message")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


# Fetch plans out of the attempts: the first attempt of each record and source; views arrived, errors failed.
PLAN = """
select doi, source, priority, case when event_type <> 'click' then concat('http://f/', cast(pos as string)) end as pdf_url, pos, event_type
from (select *, case source when 'oa' then 0 when 'nber' then 1 else 2 end as priority, row_number() over (partition by doi, source order by pos) as rn from {attempts}) t
where rn = 1"""


@query(
    "resolve_outcomes",
    check(
        "attempts",
        f"""
, plan as ({PLAN.format(attempts="attempts")})
, told as (select *, case when pdf_url is null then 'no_match' when event_type = 'view' then 'downloaded' when event_type = 'error' then 'error' end as status from plan)
, stop as (select doi, min(priority) as last from told where status = 'downloaded' group by doi)
select doi, source, pdf_url, status, case when status = 'error' then 'HTTP ' || pos end as error_message
from told left join stop using (doi) where status is not null and (last is null or priority <= last)""",
    ),
)
def resolve_outcomes(c: Corpus):
    """What became of every planned address: arrived, failed, or none; nothing after the first file of a record."""
    plan = c.spark.sql(PLAN, attempts=c.attempts).withColumn("match_score", F.lit(100.0)).withColumn("candidate_url", F.col("pdf_url"))
    fetched = plan.filter(F.col("event_type").isin("view", "error") & F.col("pdf_url").isNotNull()).select(
        "doi",
        "source",
        (F.col("event_type") == "view").alias("ok"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("HTTP "), F.col("pos").cast("string"))).alias("error"),
    )
    out = flows.fetch_outcomes(plan.drop("pos", "event_type"), fetched)
    return out.select("doi", "source", "pdf_url", "status", "error_message")


@query(
    "match_outcomes",
    check(
        "files",
        """
, s as (select doi, case when downloaded_seq % 4 > 0 then cast(downloaded_seq % 101 as double) + 0.25 end as score, downloaded_seq as n from files)
select doi, case when score >= 85 then n end as pos, cast(floor(score) as int) as match_score,
       case when score is null then 'failed' when score >= 85 then 'success' else 'no_match' end as status,
       case when score is null then 'No search results found' when score < 85 then 'No match above threshold 85. Best: ' || cast(floor(score) as int) || '.2' end as error_message
from s""",
    ),
)
def match_outcomes(c: Corpus):
    """Searches with, without and below a result, from given scores (the message rounds halves to even)."""
    best = c.files.filter("downloaded_seq % 4 > 0").select(
        "doi", F.col("downloaded_seq").alias("pos"), (F.col("downloaded_seq") % 101 + 0.25).cast("double").alias("similarity")
    )
    return matching.search_outcomes(c.files.select("doi"), best)
