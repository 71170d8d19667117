"""Streams over the given tables, their batch twins, and file scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.catalog.changes import ARTICLE_ROW, WORKS_SQL, write_dumps
from papyrine.catalog.registry import VIEWS, Corpus, check, query
from papyrine.operators.upsert import upsert_articles
from papyrine.session import scratch_path
from papyrine.sources.pages import file_signatures
from papyrine.sources.tables import KeyedTable
from papyrine.streaming import incremental

STATUS_SQL = check(
    "processing_log",
    """
select doi, stage, status, processed_at from (select *, row_number() over (partition by doi, stage order by processed_at desc, id desc) as rn from processing_log) where rn = 1""",
)
LOG_SQL = check("processing_log", "select id, doi, stage, status, error_message, processed_at from processing_log")


def log_stream(c: Corpus) -> DataFrame:
    """The processing log as a stream over its file."""
    events = (
        c.spark.readStream.schema(c.events.schema)
        .option("pathGlobFilter", "events.parquet")
        .option("recursiveFileLookup", True)
        .parquet(c.folder)
    )
    return c.spark.sql(VIEWS["processing_log"], events=events)


@query("latest_status", STATUS_SQL)
def latest_status(c: Corpus):
    return incremental.latest_status(c.processing_log)


@query("latest_status_stream", STATUS_SQL)
def latest_status_stream(c: Corpus):
    """The same states kept by a stream in a table by key, of which a batch rewrites the buckets it touches."""
    kind = c.processing_log.select("doi", "stage", "status", "processed_at", "id").schema
    table = KeyedTable(c.spark, scratch_path(c.spark, "status"), kind, ["doi", "stage"], buckets=16)
    incremental.keep_latest(log_stream(c), table, scratch_path(c.spark, "status-checkpoint")).awaitTermination()
    return table.read().drop("id")


@query("log_dedup", LOG_SQL)
def log_dedup(c: Corpus):
    """The log after a replay of all its entries."""
    return incremental.distinct_log(c.processing_log.unionByName(c.processing_log))


@query("log_dedup_stream", LOG_SQL)
def log_dedup_stream(c: Corpus):
    """The same on a stream that delivers every entry twice, and again in a second run."""
    path, checkpoint = scratch_path(c.spark, "log"), scratch_path(c.spark, "log-checkpoint")
    twice = log_stream(c).unionByName(log_stream(c))
    for _ in range(2):  # the second run starts anew and delivers all entries once more
        incremental.append_once(twice, path, checkpoint).awaitTermination()
        checkpoint = scratch_path(c.spark, "log-checkpoint")
    return c.spark.read.parquet(path).drop("day")


@query(
    "log_counts",
    check("processing_log", "select stage, status, count(*) as entries from processing_log group by stage, status"),
)
def log_counts(c: Corpus):
    """Entries per stage and status from counts per day, which the log stream keeps; the log itself is not read."""
    return _counts(c).select("stage", "status", "entries")


@query("distinct_enriched_by_day")
def distinct_enriched_by_day(c: Corpus):
    """Estimated number of records per stage and status, from one sketch per day."""
    return _counts(c).select("stage", "status", "records")


def _counts(c: Corpus) -> DataFrame:
    counts = KeyedTable(c.spark, scratch_path(c.spark, "counts"), incremental.DAY_COUNTS, ["day"], buckets=16, unique=False)
    path, checkpoint = scratch_path(c.spark, "log"), scratch_path(c.spark, "log-checkpoint")
    incremental.append_once(log_stream(c), path, checkpoint, counts).awaitTermination()
    return incremental.counts_since(counts.read())


@query("stream_collect", WORKS_SQL + f" select {ARTICLE_ROW} from works")
def stream_collect(c: Corpus):
    """Article table built by the incremental collector from JSON dumps, twice: the second run finds nothing new."""
    dumps = write_dumps(c, "incoming")
    root, checkpoint = scratch_path(c.spark, "articles"), scratch_path(c.spark, "collect-checkpoint")
    table = KeyedTable(
        c.spark,
        root,
        "doi string, title string, authors string, year int, journal_issn string, journal_name string, "
        "publisher string, created_at timestamp_ntz, updated_at timestamp_ntz",
        ["doi"],
        buckets=16,
    )
    now = F.lit("2024-02-01").cast("timestamp_ntz")
    for _ in range(2):
        works = incremental.stream_dumps(c.spark, dumps, multi_line=False, files_per_batch=10_000)
        incremental.collect(
            works, c.journals, lambda batch, n: table.change(batch, lambda rows, new: upsert_articles(rows, new, now), not_null=["title"]), checkpoint
        ).awaitTermination()
    return table.read().drop("created_at", "updated_at")


@query("file_magic")
def file_magic(c: Corpus):
    """Signature check of the data files themselves."""
    return file_signatures(c.spark, c.folder, "*.parquet", b"PAR1")
