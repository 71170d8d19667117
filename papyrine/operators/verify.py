"""Does a file belong to its article? Decision, verdicts and quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.functions.clean import PAGE_BREAK, author_fraction, head_text
from papyrine.functions.similarity import partial_ratio
from papyrine.operators.upsert import (
    delete_keys,
    next_rows,
    reset_downloads,
    upsert_candidates,
)

GRAY_LOW, GRAY_HIGH, MIN_FRACTION, MIN_CONFIDENCE = 55, 88, 0.5, 0.7
VERDICT = "match boolean, confidence double, reason string"
HEAD_PAGES = 2  # pages on which an article's own title and authors stand


def page_table(texts: DataFrame, key: str = "doi", text: str = "text") -> DataFrame:
    """(key, page_no, text): the pages of texts, from their page breaks, numbered from 1.

    Stored in the order of ``page_no``, heads are read without the row groups of the pages behind them.
    """
    pages = F.posexplode(F.split(F.col(text), PAGE_BREAK)).alias("_at", "text")
    return texts.select(key, pages).select(key, (F.col("_at") + 1).alias("page_no"), "text")


def page_heads(pages: DataFrame, key: str = "doi", first: int = HEAD_PAGES, min_length: int = 100) -> DataFrame:
    """(key, text): the squeezed first pages of every text, NULL where they are too short to judge."""
    head = pages.filter(F.col("page_no") <= first).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("page_no", "text"))).alias("_p"))
    return head.select(key, head_text(F.array_join(F.col("_p.text"), PAGE_BREAK), min_length).alias("text"))


def check_text(rows: DataFrame) -> DataFrame:
    """Add title_score and author_frac to rows (doi, title, authors, text)."""
    return rows.withColumn("title_score", partial_ratio(F.col("title"), F.col("text"))).withColumn(
        "author_frac", author_fraction(F.col("authors"), F.col("text"))
    )


def first_decision(
    text: Column, score: Column, fraction: Column, low: float = GRAY_LOW, high: float = GRAY_HIGH
) -> Column:
    """'unreadable', 'match', 'mismatch' or 'gray' from the text alone."""
    return (
        F.when(text.isNull(), "unreadable")
        .when((score >= high) & (fraction >= MIN_FRACTION), "match")
        .when((score <= low) & (fraction == 0), "mismatch")
        .otherwise("gray")
    )


def parse_verdicts(raw: DataFrame, column: str = "verdict") -> DataFrame:
    """Every asked row with its verdict (match, confidence, reason).

    A verdict needs a boolean, a number and a text; without one of them all three are NULL: the question was asked,
    and the answer is void.
    """
    parsed = raw.withColumn("_v", F.from_json(F.col(column), VERDICT))
    complete = F.col("_v.match").isNotNull() & F.col("_v.confidence").isNotNull() & F.col("_v.reason").isNotNull()
    return parsed.select(*[c for c in raw.columns if c != column], F.when(complete, F.col("_v")).alias("_v")).select(
        *[c for c in raw.columns if c != column], "_v.*"
    )


def percent(col: Column) -> Column:
    """Fraction as a whole percentage, halves to even."""
    return F.concat(F.bround(col * 100).cast("int").cast("string"), F.lit("%"))


def verify(checked: DataFrame, verdicts: DataFrame | None = None, model: str | None = None) -> DataFrame:
    """Final state of checked rows (doi, text, title_score, author_frac).

    Gray rows take the outside verdict where one exists. They stay uncertain if nobody was asked, if the verdict is
    doubtful, and if the answer was void (a verdict row whose fields are NULL). Reasons and scores are stored as the
    queue's consumers expect them.
    """
    decided = checked.withColumn("_first", first_decision(F.col("text"), F.col("title_score"), F.col("author_frac")))
    if verdicts is None:
        verdicts = checked.sparkSession.createDataFrame([], "doi string, " + VERDICT)
    told = verdicts.select("doi", "match", "confidence", "reason", F.lit(True).alias("_told"))
    joined = decided.join(told, "doi", "left")
    sure = F.coalesce(F.col("confidence") >= MIN_CONFIDENCE, F.lit(False))
    gray = F.col("_first") == "gray"
    status = (
        F.when(~gray, F.col("_first"))
        .when(sure & F.col("match"), "match")
        .when(sure & ~F.col("match"), "mismatch")
        .otherwise("uncertain")
    )
    asked = gray & F.col("_told").isNotNull()
    title = F.bround("title_score").cast("int").cast("string")
    numbers = F.concat(F.lit("Title "), title, F.lit(", authors "), percent(F.col("author_frac")))
    no_match = F.concat(F.lit("Title score "), title, F.lit(", no author match"))
    reason = (
        F.when(F.col("_first") == "unreadable", "No extractable text")
        .when(F.col("_first") == "match", numbers)
        .when(F.col("_first") == "mismatch", no_match)
        .when(asked & F.col("match").isNull(), "LLM call failed")
        .when(asked & (status == "mismatch") & (F.col("reason") == ""), no_match)
        .when(asked, F.col("reason"))
        .otherwise(F.concat(F.lit("Gray zone (title "), title, F.lit(", authors "), percent(F.col("author_frac")), F.lit("), LLM disabled")))
    )
    return joined.select(
        "doi",
        status.alias("verify_status"),
        F.when(asked, "llm").otherwise("deterministic").alias("verify_method"),
        F.when(F.col("_first") != "unreadable", F.col("title_score")).alias("verify_score"),
        F.when(asked, F.lit(model)).alias("verify_model"),
        reason.alias("verify_reason"),
    )


def quarantine(
    mismatches: DataFrame, pages: DataFrame, files: DataFrame, candidates: DataFrame, log: DataFrame, now: Column
) -> dict[str, DataFrame]:
    """Take mismatched files (doi, source, reason) out of circulation.

    A file from the first site resets its page and logs the site as unobtainable; any other source is remembered
    as a miss. Each file row is removed, and the verdict stays in the log: under ``log`` are the lines to append.
    """
    first_site = mismatches.filter(F.col("source") == "ssrn")
    others = mismatches.filter(F.coalesce(F.col("source") != "ssrn", F.lit(True)))
    misses = others.select(
        "doi",
        "source",
        F.lit(None).cast("string").alias("candidate_url"),
        F.lit(None).cast("string").alias("pdf_url"),
        F.lit(None).cast("double").alias("match_score"),
        F.lit("no_match").alias("status"),
        F.lit("Verified mismatch").alias("error_message"),
    )
    lines = mismatches.select(
        "doi",
        F.lit("verify_pdf").alias("stage"),
        F.lit("mismatch").alias("status"),
        F.col("reason").alias("error_message"),
    ).unionByName(
        first_site.select(
            "doi",
            F.lit("download_pdf").alias("stage"),
            F.lit("unavailable").alias("status"),
            F.lit("PDF mismatch quarantined").alias("error_message"),
        )
    )
    stamped = lines.withColumn("processed_at", now)
    return {
        "pages": reset_downloads(pages, first_site),
        "candidates": upsert_candidates(candidates, misses, now),
        "files": delete_keys(files, mismatches),
        "log": next_rows(log, stamped, F.md5(F.concat_ws("|", "doi", "stage"))),
    }
