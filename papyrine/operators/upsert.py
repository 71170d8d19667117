"""Changes to tables as pure functions (current, changes) -> next version.

Plain Parquet has no MERGE; the caller writes the result as a new version (see ``sources.tables``). The current rows
are joined with the changes, one per key, and never with whole rows of the other side: columns that nobody asks for
are not read, and where the changes are few they are broadcast and the current table is not shuffled at all.
Duplicates inside the changes are resolved first. Times come in as a parameter, so a rerun gives the same table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.functions.rules import is_missing
from papyrine.operators.common import attach, first_per_key, key_set, spread_rank
from papyrine.operators.queues import PUBLISHED


def last_change(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One change per key: the last by ``ord`` where that column exists.

    Changes that are equal in ``ord``, or have none, are ordered by a hash of all columns, so a rerun takes the same
    one. A change without a key changes nothing.
    """
    rest = [c for c in changes.columns if c not in keys]
    known = changes.dropna(subset=list(keys))
    order = [F.desc("ord")] if "ord" in changes.columns else []
    one = first_per_key(known, keys, *order, F.desc(F.xxhash64(*rest)) if rest else F.lit(0))
    return one.drop("ord")


def merge(
    current: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    on_update: Mapping[str, Column],
    on_insert: Mapping[str, Column] | None = None,
    insert: bool = True,
) -> DataFrame:
    """Upsert: ``on_update`` gives new values for keys in both, ``on_insert`` for new keys.

    Expressions refer to the current row as ``c.x`` and to the change as ``n.x``. Columns not named keep the
    current value on update; on insert they come from the change where it has them and are NULL otherwise.

    Known rows are a left join with the changes; new rows are the changes whose key is not among the keys that a semi
    join finds in the current table.
    """
    incoming = last_change(changes, keys)
    kinds = {f.name: f.dataType for f in current.schema.fields}
    c = current.alias("c")
    n = incoming.withColumn("_there", F.lit(True)).alias("n")
    same = [F.col(f"c.{k}") == F.col(f"n.{k}") for k in keys]
    changed = F.col("n._there").isNotNull()

    def updated(name: str) -> Column:
        kept = F.col(f"c.{name}")
        return F.when(changed, on_update[name]).otherwise(kept).cast(kinds[name]) if name in on_update else kept

    known = c.join(n, same, "left").select(*[updated(name).alias(name) for name in current.columns])
    if not insert:
        return known

    def inserted(name: str) -> Column:
        if on_insert and name in on_insert:
            return on_insert[name].cast(kinds[name])
        return (F.col(f"n.{name}") if name in incoming.columns else F.lit(None)).cast(kinds[name])

    stored = current.select(*keys).join(incoming.select(*keys), list(keys), "left_semi")
    fresh = incoming.join(stored, list(keys), "left_anti").alias("n")
    return known.unionByName(fresh.select(*[inserted(name).alias(name) for name in current.columns]))


def _from_change(*names: str) -> dict[str, Column]:
    return {name: F.col(f"n.{name}") for name in names}


def upsert_articles(current: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """On a known key only title, authors and updated_at change."""
    return merge(
        current,
        changes,
        ["doi"],
        {**_from_change("title", "authors"), "updated_at": now},
        {"created_at": now, "updated_at": now},
    )


def upsert_pages(current: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """All content columns are replaced; the file columns stay."""
    content = ("page_url", "html", "abstract", "match_score", "error_message")
    return merge(
        current,
        changes,
        ["doi"],
        {**_from_change(*content), "scraped_at": now},
        {"scraped_at": now, "pdf_downloaded": F.lit(False)},
    )


def fill_abstract(current: DataFrame, changes: DataFrame, now: Column, force: bool = False) -> DataFrame:
    """Fill missing abstracts, or replace all with ``force``; the time moves only where the text was set."""
    replace = F.lit(True) if force else is_missing(F.col("c.abstract"))
    return merge(
        current,
        changes,
        ["doi"],
        {
            "abstract": F.when(replace, F.col("n.abstract")).otherwise(F.col("c.abstract")),
            "scraped_at": F.when(replace, now).otherwise(F.col("c.scraped_at")),
        },
        {"scraped_at": now, "pdf_downloaded": F.lit(False)},
    )


def update_file_info(pages: DataFrame, changes: DataFrame) -> DataFrame:
    """Download state of known pages; unknown keys are not inserted."""
    return merge(
        pages, changes, ["doi"], _from_change("pdf_url", "pdf_file_path", "pdf_downloaded"), insert=False
    )


def reset_downloads(pages: DataFrame, keys: DataFrame) -> DataFrame:
    """Clear the download flag and path of the given keys."""
    return merge(
        pages,
        key_set(keys, "doi"),
        ["doi"],
        {"pdf_downloaded": F.lit(False), "pdf_file_path": F.lit(None)},
        insert=False,
    )


_VERIFY = ("verify_method", "verify_score", "verify_model", "verify_reason", "verified_at")


def upsert_files(current: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Record the file of an article; its verification starts over."""
    fresh = {"verify_status": F.lit("pending"), "downloaded_at": now, **{c: F.lit(None) for c in _VERIFY}}
    taken = _from_change("source", "source_url", "pdf_url", "pdf_file_path", "match_score")
    return merge(current, changes, ["doi"], {**taken, **fresh}, fresh)


def set_verification(files: DataFrame, verdicts: DataFrame, now: Column) -> DataFrame:
    """Store verdicts on known files."""
    columns = ("verify_status", "verify_method", "verify_score", "verify_model", "verify_reason")
    return merge(files, verdicts, ["doi"], {**_from_change(*columns), "verified_at": now}, insert=False)


def upsert_candidates(current: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Remember the outcome of asking a source for a record."""
    columns = ("candidate_url", "pdf_url", "match_score", "status", "error_message")
    return merge(
        current, changes, ["doi", "source"], {**_from_change(*columns), "checked_at": now}, {"checked_at": now}
    )


def upsert_published(current: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Publication state; the time is set for ingested and flagged only."""
    columns = (
        "bib_key",
        "source_page_path",
        "extraction_depth",
        "analyst_model",
        "verifier_model",
        "status",
        "error_message",
    )
    stamped = {"ingested_at": F.when(F.col("n.status").isin(*PUBLISHED), now)}
    return merge(current, changes, ["doi"], {**_from_change(*columns), **stamped}, stamped)


def next_rows(current: DataFrame, rows: DataFrame, digest: Column, id_column: str = "id") -> DataFrame:
    """``rows`` with the next free ids, in the order of a unique digest, numbered without a single task.

    This is what a log grows by: append it to the stored log instead of writing the log anew. Only the id column of
    the current log is read.
    """
    top = current.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("_top"))
    numbered = attach(spread_rank(rows, [], digest, "_rank"), top).withColumn(
        id_column, (F.col("_top") + F.col("_rank")).cast(current.schema[id_column].dataType)
    )
    return numbered.select(*[c for c in current.columns if c in numbered.columns])


def append_with_ids(current: DataFrame, rows: DataFrame, digest: Column, id_column: str = "id") -> DataFrame:
    """The current rows and ``next_rows``, as one frame to read."""
    return current.unionByName(next_rows(current, rows, digest, id_column), True)


def finish_stages(runs: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """Record status and detail of started stages by id."""
    return merge(runs, outcomes, ["id"], {**_from_change("status", "detail"), "finished_at": now}, insert=False)


def delete_keys(df: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """Rows whose key is not in ``keys``."""
    on = list(columns or ("doi",))
    return df.join(key_set(keys, *on), on, "left_anti")


def delete_cascade(articles: DataFrame, pages: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove articles and the pages that refer to them."""
    return delete_keys(articles, keys), delete_keys(pages, keys)
