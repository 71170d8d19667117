"""Tables by key: what a change reads and writes, constraints in the write pass, states and counts kept by streams."""

import os

import pytest
from pyspark.sql import functions as F

from papyrine.operators import upsert
from papyrine.sources import tables
from papyrine.streaming import incremental

KIND = "k long, v string"


def files(root):
    return {os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def put(rows, new):
    return upsert.merge(rows, new, ["k"], {"v": F.col("n.v")})


def test_few_keys_write_few_files(spark, tmp_path, rows):
    """1,000 buckets, 10 changed keys: at most 10 new files, at most 10 read, and the old version stays readable."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    root = str(tmp_path / "t")
    table = tables.KeyedTable(spark, root, KIND, ["k"], buckets=1000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert table.read().count() == 0
    assert table.change(spark.range(6000).selectExpr("id as k", "'old' as v"), put) == 1
    before = files(root)
    assert 950 < len(before) <= 1000
    old = table.read()
    changed = spark.createDataFrame([(i * 700, "new") for i in range(9)] + [(99999, "more")], KIND)
    assert table.change(changed, put) == 2
    written = files(root) - before
    assert 0 < len(written) <= 10 and before <= files(root)
    assert len(table._read(table.latest()[1], table.buckets_of(changed)).inputFiles()) <= 10
    assert old.filter("v = 'old'").count() == 6000 and table.read(1).count() == 6000
    assert table.read().filter("v = 'new'").count() == 9 and table.read().count() == 6001
    assert rows(table.lookup(changed)) == rows(changed)
    gone = spark.createDataFrame([(99999, None), (0, None)], KIND)
    assert table.change(gone, lambda current, keys: upsert.delete_keys(current, keys, "k")) == 3
    assert table.read().count() == 5999
    assert table.change(changed.limit(0), put) == 3


def test_a_change_that_breaks_a_rule_is_not_published(spark, tmp_path):
    table = tables.KeyedTable(spark, str(tmp_path / "t"), KIND, ["k"], buckets=8)
    table.change(spark.createDataFrame([(1, "a"), (2, "b")], KIND), put)
    twice = spark.createDataFrame([(3, "c"), (3, "d")], KIND)
    with pytest.raises(tables.ConstraintError, match="repeated"):
        table.change(twice, lambda current, new: current.unionByName(new))
    with pytest.raises(tables.ConstraintError, match="null v"):
        table.change(spark.createDataFrame([(4, None)], KIND), put, not_null=["v"])
    with pytest.raises(tables.ConstraintError, match="left the buckets"):
        table.change(spark.createDataFrame([(1, "a")], KIND), lambda current, new: current.unionByName(spark.range(50).selectExpr("id + 100 as k", "'x' as v")))
    assert table.latest()[0] == 1 and table.read().count() == 2


def test_constraints_are_counted_while_writing(spark, tmp_path):
    """A duplicate key stops the publish, without a second scan of the rows."""
    source = str(tmp_path / "rows")
    spark.createDataFrame([("a", "k1"), ("b", "k2"), ("c", "k2"), ("d", None), ("e", None)], "doi string, bib_key string").write.parquet(source)
    rows = spark.read.parquet(source)
    table = tables.VersionedTable(spark, str(tmp_path / "t"), "doi string, bib_key string")
    with pytest.raises(tables.ConstraintError, match="'repeated': 1"):
        table.publish(rows, unique=["bib_key"])
    assert table.latest() is None
    with pytest.raises(tables.ConstraintError, match="'null bib_key': 2"):
        table.publish(rows.filter("doi <> 'c'"), unique=["bib_key"], not_null=["doi", "bib_key"])
    assert table.publish(rows.filter("doi <> 'c'"), unique=["bib_key"], not_null=["doi"]) == 1
    assert table.read().count() == 4 and table.read().columns == ["doi", "bib_key"]
    watched, _ = tables.checked(rows, ["bib_key"], ["doi"])
    assert watched._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_versions_are_claimed_once(spark, tmp_path):
    versions = tables.VersionList(spark, str(tmp_path / "v"))
    assert versions.latest() is None
    versions.claim(1, [{"folder": "a"}])
    with pytest.raises(Exception, match="exists"):
        versions.claim(1, [{"folder": "b"}])
    (tmp_path / "v" / "2").write_text("")  # claimed by a writer that died
    assert versions.latest() == (1, [{"folder": "a"}])


LOG = "id long, doi string, stage string, status string, processed_at timestamp"


def deliver(spark, source, entries):
    rows = spark.createDataFrame(entries, "id long, doi string, stage string, status string, at string")
    rows.selectExpr("id", "doi", "stage", "status", "cast(at as timestamp) as processed_at").write.mode("append").parquet(str(source))
    return spark.readStream.schema(LOG).parquet(str(source))


def test_states_touch_their_buckets(spark, tmp_path):
    table = tables.KeyedTable(spark, str(tmp_path / "t"), LOG, ["doi", "stage"], buckets=64)
    run = lambda entries: incremental.keep_latest(deliver(spark, tmp_path / "log", entries), table, str(tmp_path / "cp")).awaitTermination()
    run([(i, f"d{i}", "s", "first", "2024-01-02") for i in range(200)])
    before = files(tmp_path / "t")
    run([(300, "d3", "s", "second", "2024-01-03"), (301, "d4", "s", "late", "2024-01-01"), (302, "new", "s", "first", None), (303, "d5", "s", "same", "2024-01-02")])
    assert 0 < len(files(tmp_path / "t") - before) <= 4
    got = {r.doi: r.status for r in table.read().collect()}
    assert len(got) == 201 and (got["d3"], got["d4"], got["d5"], got["new"]) == ("second", "first", "same", "first")


def test_a_batch_reads_the_folders_of_its_days(spark, tmp_path):
    path = str(tmp_path / "stored")
    counts = tables.KeyedTable(spark, str(tmp_path / "counts"), incremental.DAY_COUNTS, ["day"], buckets=8, unique=False)
    run = lambda entries: incremental.append_once(deliver(spark, tmp_path / "log", entries), path, str(tmp_path / "cp"), counts).awaitTermination()
    first = [(i, f"d{i % 50}", "s", "ok" if i % 3 else "failed", f"2024-01-{1 + i % 20:02}") for i in range(400)]
    run(first)
    run([(7, "d7", "s", "ok", "2024-01-08"), (900, "d900", "s", "ok", "2024-01-08"), (901, "d901", "s", "ok", None)])
    stored = spark.read.parquet(path)
    assert stored.count() == 402 and stored.select("id").distinct().count() == 402
    some = incremental.stored_days(spark, path, ["2024-01-08", None, "2030-01-01"], stored.schema)
    assert {f.split("day=")[1].split("/")[0] for f in some.inputFiles()} == {"2024-01-08", incremental.NO_DAY}
    assert len(some.inputFiles()) < len(stored.inputFiles()) / 4
    exact = {(r.stage, r.status): (r.entries, r.records) for r in stored.groupBy("stage", "status").agg(F.count("*").alias("entries"), F.countDistinct("doi").alias("records")).collect()}
    told = incremental.counts_since(counts.read())
    assert "stored" not in told._jdf.queryExecution().executedPlan().toString()
    for r in told.collect():
        entries, records = exact[r.stage, r.status]
        assert r.entries == entries and abs(r.records - records) <= max(1, 0.05 * records)
    assert incremental.counts_since(counts.read(), "2024-01-20").agg(F.sum("entries")).first()[0] == 20
