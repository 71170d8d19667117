"""Secret scans by corpus-wide ownership frequency, with built-in functions only.

Patterns find spans in every text: assignments, access keys, hex runs, and bare tokens that could be credentials. The
values of all spans that look live (letters and digits mixed, enough different characters) are candidates. Over the
whole corpus every candidate's hash is counted by distinct owner and by distinct repository: a value that several
owners hold is an example that people copy, a value of one owner is a credential of that owner and is reported as a
span of kind ``live``. Spans of the three base kinds stay whatever the counts say.

How it is spread: one scan of the texts leaves a row per text with the lengths of its matches and of the gaps between
them (``split`` and ``regexp_extract_all`` walk the same matches), written to the shared folder. Places are running
sums of those lengths per text. Owners are counted after a distinct with map-side combine, so a value that a third of
all rows hold is one row per owner and repository; the counts go back to the spans by (hash, salt), with the salt taken
from the row, so the spans of a common value are dealt over many tasks.

Null texts are empty. Null owners, repositories and keys are values of their own, equal to each other only. Repeated
rows are rows of their own. An empty table gives no rows. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.llm.textual import partitions
from papyrine.session import materialise

KINDS = ("assign", "access", "hex", "token", "live")  # order of spans that start together
BASE = 3  # the first kinds are reported without regard to counts
PATTERNS = (
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    r"(AKIA[A-Z0-9]{14,})",
    r"([0-9a-f]{16,})",
    r"([A-Za-z0-9+/_=-]{20,})",
)
ASSIGNED = 12  # characters of an assigned value
VARIETY = 8  # different characters of a live-looking value
OWNERS = 1  # owners of a live credential; a value with more is a copied example


def _matches(text: Column, kind: int) -> Column:
    """array<(kind, at, gap, size, value)>: all matches in order, with the code points before each since the last one.

    An assignment whose value is too short is a match without a value: it holds its place, for the next one to be found
    where it should.
    """
    pattern = F.lit(PATTERNS[kind])

    def one(match: Column, at: Column) -> Column:
        value = F.regexp_extract(match["m"], PATTERNS[0], 2) if kind == 0 else match["m"]
        return F.struct(
            F.lit(kind).alias("kind"),
            at.alias("at"),
            F.length(match["g"]).alias("gap"),
            F.length(match["m"]).alias("size"),
            F.when(F.length(value) >= (ASSIGNED if kind == 0 else 0), value).alias("value"),
        )

    pieces = F.arrays_zip(F.split(text, PATTERNS[kind], -1).alias("g"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"))
    whole = F.transform(F.filter(pieces, lambda p: p["m"].isNotNull()), one)
    return F.when(text.rlike(PATTERNS[kind]), whole)


def live_looking(value: Column) -> Column:
    """Letters and digits mixed, with enough different characters."""
    return value.rlike("[A-Za-z]") & value.rlike("[0-9]") & (F.size(F.array_distinct(F.split(value, ""))) >= VARIETY)


def scanned(docs: DataFrame, text: str = "text", key: str = "doc_id", owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """(rid, key, owner, repository, found) of every row, written to the shared folder: ``found`` has all matches."""
    kind = "struct<kind:int,at:int,gap:int,size:int,value:string>"
    rows = docs.select(F.col(key).alias("key"), F.col(owner).alias("owner"), F.col(repository).alias("repository"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = F.flatten(F.filter(F.array(*[_matches(F.col("text"), k).cast(f"array<{kind}>") for k in range(len(PATTERNS))]), lambda x: x.isNotNull()))
    return materialise(rows.select(F.monotonically_increasing_id().alias("rid"), "key", "owner", "repository", found.alias("found")), "scanned")


def placed(hits: DataFrame) -> DataFrame:
    """(rid, owner, repository, kind, start, end, value, from): spans in code points, end exclusive; ``from`` is where
    the value starts."""
    rows = hits.where(F.size("found") > 0).select("rid", "owner", "repository", F.inline("found"))
    run = Window.partitionBy("rid", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = rows.withColumn("end", F.sum(F.col("gap").cast("long") + F.col("size")).over(run)).where("value is not null")
    return ends.select("rid", "owner", "repository", "kind", (F.col("end") - F.col("size")).alias("start"), "end", "value", (F.col("end") - F.length("value")).alias("from"))


def ownership(candidates: DataFrame) -> DataFrame:
    """(hash, n_owners, n_repositories) of candidates (hash, owner, repository); a repository belongs to its owner."""
    held = candidates.select("hash", "owner", "repository").distinct()
    by_owner = held.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"))


def judged(spans: DataFrame) -> DataFrame:
    """(rid, start, end, hash, n_owners, n_repositories): every live-looking value once, with its counts."""
    values = spans.where(live_looking(F.col("value"))).select("rid", F.col("from").alias("start"), "end", F.sha2("value", 256).alias("hash"), "owner", "repository")
    once = values.groupBy("rid", "start", "end").agg(F.first("hash").alias("hash"), F.first("owner").alias("owner"), F.first("repository").alias("repository"))
    once = materialise(once, "candidates")
    salted = once.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(max(64, partitions(spans)))))
    counts = salted.select("hash", "salt").distinct().join(ownership(once), "hash")
    return salted.join(counts, ["hash", "salt"]).select("rid", "start", "end", "hash", "n_owners", "n_repositories")


def findings(docs: DataFrame, text: str = "text", key: str = "doc_id", owner: str = "source", repository: str = "doc_id", owners: int = OWNERS) -> DataFrame:
    """(key, start, end, hash, n_owners, n_repositories, verdict) of all live-looking values of the corpus.

    The verdict is ``live`` where at most ``owners`` owners hold the value, else ``copied``.
    """
    hits = scanned(docs, text, key, owner, repository)
    verdict = F.when(F.col("n_owners") <= owners, "live").otherwise("copied")
    return judged(materialise(placed(hits), "spans")).join(hits.select("rid", "key"), "rid").select(F.col("key").alias(key), "start", "end", "hash", "n_owners", "n_repositories", verdict.alias("verdict"))


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", owner: str = "source", repository: str = "doc_id", owners: int = OWNERS) -> DataFrame:
    """One row per row of ``docs``: key, n_assign, n_access, n_hex, n_live, n_copied, base_sha256, spans.

    ``spans`` lists kind:start:end by start, then kind; base_sha256 is the digest of the list of base kinds alone.
    """
    hits = scanned(docs, text, key, owner, repository)
    spans = materialise(placed(hits), "spans")
    values = judged(spans)
    rows = spans.where(F.col("kind") < BASE).select("rid", "kind", "start", "end").unionByName(
        values.select("rid", F.when(F.col("n_owners") <= owners, KINDS.index("live")).otherwise(len(KINDS)).alias("kind"), "start", "end")
    )
    kinds = F.array(*map(F.lit, KINDS))
    text_of = lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])
    listed = lambda below: F.array_join(F.transform(F.filter("all", lambda s: s["kind"] < below), text_of), ",")
    grouped = rows.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("all"))
    count = lambda kind: F.size(F.filter("all", lambda s: s["kind"] == kind)).cast("long")
    names = {"n_assign": 0, "n_access": 1, "n_hex": 2, "n_live": KINDS.index("live"), "n_copied": len(KINDS)}
    told = lambda frame: frame.select(
        F.col("key").alias(key), *[count(k).alias(n) for n, k in names.items()], F.sha2(listed(BASE), 256).alias("base_sha256"), listed(len(KINDS)).alias("spans")
    )
    none = F.lit(None).cast("array<struct<start:bigint,kind:int,end:bigint>>")
    with_spans = hits.where(F.size("found") > 0).select("rid", "key").join(grouped, "rid", "left")
    without = hits.where(F.size("found") == 0).select("rid", "key").withColumn("all", none)
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return told(with_spans.unionByName(without).withColumn("all", F.coalesce("all", empty)))
