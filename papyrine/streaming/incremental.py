"""Incremental forms: new dumps, the processing log, current states."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from papyrine.operators.common import first_per_key
from papyrine.sources.arrays import objects
from papyrine.sources.metadata import WORK, array_works, broken_dumps, readable, transform_works, with_dump_name
from papyrine.sources.tables import KeyedTable, existing


def stream_dumps(spark: SparkSession, path: str, multi_line: bool = True, files_per_batch: int = 1000) -> DataFrame:
    """New dump files as a stream of works, read as ``read_dumps`` reads them."""
    works = (
        spark.readStream.schema(WORK + ", _corrupt_record string")
        .option("multiLine", multi_line)
        .option("mode", "PERMISSIVE")
        .option("pathGlobFilter", "*.json")
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(path)
    )
    return with_dump_name(works)


def stream_array_files(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """New dump files (path, length) as a stream; their contents are not read here.

    With ``parse=array_batch`` in ``collect``, each batch's files are cut at object borders and read by many tasks.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    files = files.option("pathGlobFilter", "*.json").option("recursiveFileLookup", True)
    return files.option("maxFilesPerTrigger", files_per_batch).load(path).select("path", "length")


def array_batch(files: DataFrame) -> DataFrame:
    """Works of a batch of array files (path, length)."""
    return array_works(objects(files.sparkSession, files))


def collect(
    works: DataFrame,
    journals: DataFrame,
    apply: Callable[[DataFrame, int], None],
    checkpoint: str,
    again: Callable[[DataFrame, int], None] | None = None,
    parse: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Turn waiting dumps into article rows and hand each batch to ``apply`` (an upsert), then stop.

    The checkpoint remembers which files were collected, so a rerun reads only new ones. Dumps with unreadable
    records go to ``again`` as (issn, dump_year), to be fetched once more under a new name; without it such a batch
    fails, so no dump is lost unseen. Both get the batch number: a batch that is replayed after a failure comes with
    the number it had. ``parse`` turns a batch into works where the stream brings files.
    """

    def handle(batch: DataFrame, number: int) -> None:
        batch = (parse(batch) if parse else batch).persist()
        broken = broken_dumps(batch)
        if again is not None:
            again(broken, number)
        elif not broken.isEmpty():
            raise ValueError("unreadable dumps, and nobody to collect them again")
        apply(transform_works(readable(batch), journals), number)
        batch.unpersist()

    return works.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_status(log: DataFrame, *more: str) -> DataFrame:
    """Current status per record and stage: a rank filter, so a stage's log is cut to one row per key before it moves."""
    newest = first_per_key(log, ["doi", "stage"], F.desc_nulls_last("processed_at"), F.desc("id"))
    return newest.select("doi", "stage", "status", "processed_at", *more)


def distinct_log(log: DataFrame) -> DataFrame:
    """The log with each entry once (batch form)."""
    return log.dropDuplicates(["id"])


def keep_latest(log: DataFrame, table: KeyedTable, checkpoint: str) -> StreamingQuery:
    """Keep the current status per record and stage in a table (doi, stage, status, processed_at, id).

    The table is the state: a batch is cut to its newest entry per key and compared with the rows of the buckets these
    keys lie in. Only such buckets are written, late entries change nothing, and a batch that is replayed gives the
    same rows.
    """

    def newer(rows: DataFrame, batch: DataFrame) -> DataFrame:
        return latest_status(rows.unionByName(batch), "id")

    def store(batch: DataFrame, number: int) -> None:
        batch.persist()
        table.change(latest_status(batch, "id"), newer)
        batch.unpersist()

    return log.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


NO_DAY = "__HIVE_DEFAULT_PARTITION__"


def stored_days(spark: SparkSession, path: str, days: Sequence[str | None], schema: StructType) -> DataFrame:
    """The stored log entries of some days (None: without a time), from the folders of these days alone."""
    folders = existing(spark, [f"{path}/day={NO_DAY if d is None else d}" for d in days])
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*folders)


def append_once(log: DataFrame, path: str, checkpoint: str, counts: KeyedTable | None = None) -> StreamingQuery:
    """Append the entries of a log stream that are not stored yet, each once, however late they come.

    The stored log itself is the memory: it lies in folders by day, and a batch is compared with the ids of its own
    days alone, read from their folders, and of those with the range of its own ids, which the files are sorted by; so
    neither state nor time limits are needed. A replayed entry carries the time it had. With ``counts``, the counts of
    the batch's days are made anew from their folders (:func:`day_counts`).
    """

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("day", F.to_date("processed_at")).dropDuplicates(["id"]).persist()
        ranges = new.groupBy(F.col("day").cast("string").alias("day")).agg(F.min("id").alias("low"), F.max("id").alias("high")).collect()  # a row per day
        if ranges:
            days = [r.day for r in ranges]
            low, high = min(r.low for r in ranges), max(r.high for r in ranges)
            known = stored_days(spark, path, days, new.schema).filter(F.col("id").between(low, high)).select("id")
            fresh = new.join(known, "id", "left_anti")
            fresh.repartition("day").sortWithinPartitions("day", "id").write.mode("append").partitionBy("day").parquet(path)
            if counts is not None:
                counts.change(day_counts(stored_days(spark, path, days, new.schema)), lambda rows, now: replaced_days(rows, now))
        new.unpersist()

    return log.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


SKETCH = 12  # log2 of the buckets of a distinct-count sketch: a standard error of 1.04 / sqrt(4096), 1.6 %
DAY_COUNTS = "day date, stage string, status string, entries long, records binary"


def day_counts(log: DataFrame) -> DataFrame:
    """(day, stage, status, entries, records): counts of a day's entries, and a sketch of the records they are about."""
    return log.groupBy("day", "stage", "status").agg(
        F.count("*").alias("entries"), F.hll_sketch_agg("doi", F.lit(SKETCH)).alias("records")
    )


def replaced_days(rows: DataFrame, now: DataFrame) -> DataFrame:
    """Stored counts with those of some days anew."""
    days = now.select("day").distinct()
    same = rows["day"].eqNullSafe(days["day"])
    return rows.join(days, same, "left_anti").unionByName(now)


def counts_since(counts: DataFrame, day: str | None = None) -> DataFrame:
    """(stage, status, entries, records) from the counts per day: ``entries`` exact, ``records`` the estimated number of
    different records. The log is not read."""
    wanted = counts.filter(F.col("day") >= F.lit(day).cast("date")) if day else counts
    return wanted.groupBy("stage", "status").agg(
        F.sum("entries").alias("entries"), F.hll_sketch_estimate(F.hll_union_agg("records")).alias("records")
    )
