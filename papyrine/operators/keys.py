"""Citation keys: unique, stable across runs, and allocated without passing any group through one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.functions.clean import author_list, bib_key_base
from papyrine.operators.common import spread_rank
from papyrine.session import materialise

LETTERS = "bcdefghijklmnopqrstuvwxyz"
SLOTS = len(LETTERS) + 1  # the bare base, then one letter


def _claims(keys: DataFrame) -> DataFrame:
    """(base, slot) pairs that a key occupies: as a bare base, and as base + letter."""
    key = F.col("key")
    letter = F.right(key, F.lit(1))
    parent = F.expr("substring(key, 1, length(key) - 1)")
    pairs = F.array(
        F.struct(key.alias("base"), F.lit(0).alias("slot")),
        F.struct(parent.alias("base"), F.instr(F.lit(LETTERS), letter).alias("slot")),
    )
    return keys.select(F.explode(pairs).alias("c")).select("c.base", "c.slot").filter(
        "base <> '' and slot between 0 and 25"
    )


def assign_bib_keys(queue: DataFrame, published: DataFrame, written: DataFrame) -> DataFrame:
    """(doi, bib_key) for a queue (doi, authors, year, title).

    Known records keep their key. New records of one base take the free keys base, base+b ... base+z in queue
    order (newest year first; within a year by the digest of the doi, which spreads a busy base evenly). Keys of
    ``published`` and page names in ``written`` (key) are taken. A base that is itself another base plus a letter
    keeps its bare key, so two bases never meet. After z the keys go on with numbers.
    """
    known = queue.select("doi").join(published.select("doi", "bib_key"), "doi")
    # The bases are read five times below: store them once, two short columns.
    new = materialise(
        queue.join(published.select("doi"), "doi", "left_anti").select(
            "doi", bib_key_base(F.col("authors"), F.col("year"), F.col("title")).alias("base")
        ),
        "key-bases",
    )
    ranked = spread_rank(new, ["base"], F.md5("doi"))

    taken = published.select(F.col("bib_key").alias("key")).union(written.select("key")).distinct()
    bases = new.select("base").distinct()
    reserved = _claims(bases.select(F.col("base").alias("key"))).filter("slot > 0")
    blocked = (
        _claims(taken)
        .union(reserved)
        .join(bases, "base", "left_semi")
        .groupBy("base")
        .agg(F.collect_set("slot").alias("blocked"))  # at most 26 values
    )
    numbered = (
        taken.select(
            F.regexp_extract("key", r"^(.*[a-z])([0-9]+)$", 1).alias("base"),
            F.regexp_extract("key", r"^(.*[a-z])([0-9]+)$", 2).alias("_n"),
        )
        .filter("base <> ''")
        .groupBy("base")
        .agg(F.max(F.col("_n").try_cast("long")).alias("used"))
    )
    free = F.filter(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda s: ~F.array_contains("blocked", s))
    slot = F.get("free", (F.col("rank") - 1).cast("int"))
    number = F.greatest(F.coalesce("used", F.lit(0)), F.lit(SLOTS)) + F.col("rank") - F.size("free")
    assigned = (
        ranked.join(blocked, "base", "left")
        .join(numbered, "base", "left")
        .withColumn("blocked", F.coalesce("blocked", F.array().cast("array<int>")))
        .withColumn("free", free)
        .select(
            "doi",
            F.when(slot == 0, F.col("base"))
            .when(slot > 0, F.concat("base", F.substring(F.lit(LETTERS), slot, F.lit(1))))
            .otherwise(F.concat("base", number.cast("string")))
            .alias("bib_key"),
        )
    )
    return known.unionByName(assigned)


def manifest(batch: DataFrame, keys: DataFrame) -> DataFrame:
    """One row per paper to hand over: key, file, authors as a list."""
    return batch.join(keys, "doi").select(
        "bib_key",
        F.lit("downloaded").alias("status"),
        F.col("file_name").alias("target_filename"),
        "doi",
        "title",
        author_list(F.coalesce("authors", F.lit(""))).alias("authors"),
        "year",
        F.col("journal_name").alias("journal"),
    )


def write_manifest(rows: DataFrame, path: str) -> None:
    """The manifest as JSON, one object per line, authors as a list; missing values are written as null."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)
