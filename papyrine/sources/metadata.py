"""Record dumps: JSON files of works, and their conversion to article rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.functions.clean import clean_title, format_authors, issued_year, joined_title
from papyrine.functions.rules import is_valid_article
from papyrine.operators.common import first_per_key
from papyrine.sources.arrays import SPLIT, read_objects

WORK = (
    "type string, DOI string, publisher string, title array<string>, "
    "author array<struct<given:string,family:string>>, issued struct<`date-parts`:array<array<int>>>"
)
LOCATION = "struct<pdf_url:string,landing_page_url:string>"
ENRICHED = (
    f"doi string, abstract_inverted_index map<string,array<int>>, best_oa_location {LOCATION}, "
    f"locations array<{LOCATION}>"
)
LISTING = "results array<struct<title:string,url:string>>"

# Dump files are named after the journal and the year they hold. A dump may also be a folder of
# that name with parts in it.
DUMP_NAME = r"cache_([^/_]+)_(\d{4})\.json(?:/|$)"


def read_dumps(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Works from dump files, with the journal and year of the file name.

    Schema is given, so no file is read twice; an unreadable record stays as ``_corrupt_record``. With
    ``multi_line=False`` a file holds one work per line and is split over tasks.
    """
    works = (
        spark.read.schema(WORK + ", _corrupt_record string")
        .option("multiLine", multi_line)
        .option("mode", "PERMISSIVE")
        .option("pathGlobFilter", "*.json")
        .option("recursiveFileLookup", True)
        .json(path)
    )
    return with_dump_name(works)


def array_works(objects: DataFrame) -> DataFrame:
    """Works from the objects (path, offset, value) of array files, as ``read_dumps`` returns them.

    Also the offset of each; an object that cannot be parsed keeps its text as ``_corrupt_record``.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = objects.select(F.from_json("value", WORK + ", _corrupt_record string", options).alias("work"), "path", "offset")
    return with_dump_name(parsed.select("work.*", "path", "offset"), F.col("path")).drop("path")


def read_array_dumps(spark: SparkSession, path: str, pattern: str = "*.json", split: int = SPLIT) -> DataFrame:
    """Works from dump files that hold one JSON array each, a file read by as many tasks as it has pieces."""
    return array_works(read_objects(spark, path, pattern, split))


def readable(works: DataFrame) -> DataFrame:
    """Works that could be parsed."""
    return works.filter("_corrupt_record is null").drop("_corrupt_record")


def broken_dumps(works: DataFrame) -> DataFrame:
    """(issn, dump_year) of dumps with unreadable records, to be fetched again."""
    broken = works.filter("_corrupt_record is not null and DOI is null")
    return broken.select("issn", "dump_year").distinct()


def with_dump_name(works: DataFrame, name: Column | None = None) -> DataFrame:
    """Works with the journal and year that their file's name tells."""
    name = F.col("_metadata.file_path") if name is None else name
    return works.select(
        "*",
        F.nullif(F.regexp_extract(name, DUMP_NAME, 1), F.lit("")).alias("issn"),
        F.nullif(F.regexp_extract(name, DUMP_NAME, 2), F.lit("")).cast("int").alias("dump_year"),
    )


def read_enriched(spark: SparkSession, path: str) -> DataFrame:
    """Enrichment records: inverted abstracts and open-access locations, one JSON object per line."""
    return spark.read.schema(ENRICHED).json(path)


def read_listings(df: DataFrame, column: str) -> DataFrame:
    """Parse a JSON listing column into its ``results`` array; unreadable text gives NULL."""
    return df.withColumn("results", F.from_json(column, LISTING).getField("results")).drop(column)


def transform_works(works: DataFrame, journals: DataFrame, mode: str = "substring") -> DataFrame:
    """Article rows from works (with their ``issn``): valid articles that have a year, constants from the journal.

    The validity rule sees the raw title, the row gets the cleaned one. Of a work listed twice the
    newest row stays.
    """
    raw = F.array_join(F.coalesce("title", F.array(F.lit(""))), " ")
    valid = works.filter(is_valid_article(F.col("type"), raw, F.col("DOI"), mode))
    rows = valid.select(
        F.col("DOI").alias("doi"),
        clean_title(joined_title(F.col("title"))).alias("title"),
        format_authors(F.col("author")).alias("authors"),
        issued_year(F.col("issued")).alias("year"),
        F.col("issn").alias("journal_issn"),
        F.coalesce("publisher", F.lit("Unknown")).alias("publisher"),
    ).filter("year is not null")
    named = rows.join(journals.select(F.col("issn").alias("journal_issn"), F.col("name").alias("journal_name")), "journal_issn")
    columns = ["doi", "title", "authors", "year", "journal_issn", "journal_name", "publisher"]
    return first_per_key(named.select(*columns), ["doi"], *[F.desc(c) for c in ("year", "title", "authors", "journal_issn", "journal_name", "publisher")])


def unregistered(works: DataFrame, journals: DataFrame) -> DataFrame:
    """(issn, works): works of dumps whose journal is not in the registry, which ``transform_works`` leaves out."""
    known = journals.select("issn").distinct()
    return works.join(known, "issn", "left_anti").groupBy("issn").agg(F.count("*").alias("works"))


def not_collected(pairs: DataFrame, articles: DataFrame) -> DataFrame:
    """(issn, year) pairs of which no article is stored."""
    have = articles.select(F.col("journal_issn").alias("issn"), "year").distinct()
    return pairs.join(have, ["issn", "year"], "left_anti")
