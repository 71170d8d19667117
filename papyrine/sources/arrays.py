"""JSON array files cut at object borders, so that one large file is read by many tasks.

A place in the middle of a JSON text cannot be understood by itself: a brace may lie inside a string, an object inside
another. Both follow from what comes before, and only from three small facts about every piece of the file: whether it
holds an odd number of quotes, and by how much it deepens the nesting if it starts outside or inside a string. So the
file is scanned twice. The first scan returns these facts per piece, running sums over the pieces tell for each of them
how it starts, and in the second scan a task returns the objects that begin in its piece, reading on past its end until
the last one is complete.

Files may be an array of objects, or objects one after the other. Objects are returned as text, to be parsed by
``from_json``; one that never ends, as of a file that was cut off, is returned as far as it goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyrine.session import materialise

SPLIT = 8 << 20  # bytes of a piece
MORE = 1 << 20  # bytes read at a time past its end
BATCH = 4 << 20  # bytes of objects returned at a time


def _local(path: str) -> str:
    return "file:///" + path[5:].lstrip("/") if path.startswith("file:") else path


def _opened(path: str):
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(_local(path))
    return system.open_input_file(place)


def _bytes(file, start: int, stop: int) -> bytes:
    file.seek(start)
    return file.read(stop - start)


def _escaped_at(file, start: int) -> bool:
    """Whether an odd number of backslashes lies right before a place."""
    count = 0
    while start > 0:
        begin = max(0, start - 4096)
        part = _bytes(file, begin, start)
        run = len(part) - len(part.rstrip(b"\\"))
        count += run
        if run < len(part):
            break
        start = begin
    return count % 2 == 1


def _quotes(data: np.ndarray, escaped: bool) -> np.ndarray:
    """Places of the quotes that open or close a string; ``escaped``: the first byte follows an open backslash."""
    quotes = np.flatnonzero(data == 34)
    slash = data == 92
    if not slash.any() and not escaped:
        return quotes
    # A byte is escaped if the run of backslashes before it has odd length.
    at = np.arange(len(data))
    last_other = np.maximum.accumulate(np.where(slash, -1, at))
    before = quotes - 1
    run = np.where(before >= 0, before - np.where(before >= 0, last_other[before], -1), 0)
    whole = (before >= 0) & (np.where(before >= 0, last_other[before], 0) < 0) | (before < 0)
    return quotes[(run + (whole & escaped)) % 2 == 0]


def _structure(data: np.ndarray, escaped: bool, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of braces and brackets outside strings, and +1 or -1 for each; starting inside a string or not."""
    at = np.flatnonzero((data == 123) | (data == 125) | (data == 91) | (data == 93))
    open_strings = np.searchsorted(_quotes(data, escaped), at) + int(inside)
    at = at[open_strings % 2 == 0]
    return at, np.where((data[at] == 123) | (data[at] == 91), 1, -1)


def scan_piece(data: bytes, escaped: bool) -> tuple[int, int, int]:
    """(quotes modulo 2, nesting if it starts outside a string, nesting if it starts inside one)."""
    view = np.frombuffer(data, np.uint8)
    outside, inside = (int(_structure(view, escaped, i)[1].sum()) for i in (False, True))
    return len(_quotes(view, escaped)) % 2, outside, inside


def pieces(spark: SparkSession, files: DataFrame, split: int = SPLIT) -> DataFrame:
    """(path, start, stop, inside, depth, base) from files(path, length), stored: how every piece starts.

    ``base`` is the nesting at which objects lie: 1 in a file that starts with a bracket, else 0.
    """
    cut = files.filter("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split).cast("long"))).alias("start"))
    cut = cut.select("path", "start", F.least(F.col("start") + split, F.col("length")).alias("stop"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, start, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with _opened(path) as file:
                    data = _bytes(file, start, stop)
                    rows.append((path, start, stop, *scan_piece(data, _escaped_at(file, start)), int(data.lstrip(b"\xef\xbb\xbf \t\r\n")[:1] == b"[") if start == 0 else None))
            names = ["path", "start", "stop", "odd", "outside", "within", "first"]
            kinds = [pa.string(), *[pa.int64()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names)

    told = cut.repartition("path", "start").mapInArrow(scan, "path string, start long, stop long, odd long, outside long, within long, first long")
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    told = told.withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1)
    told = told.withColumn("deeper", F.when(F.col("inside"), F.col("within")).otherwise(F.col("outside")))
    depth = F.coalesce(F.sum("deeper").over(before), F.lit(0))
    base = F.max("first").over(Window.partitionBy("path"))
    return materialise(told.select("path", "start", "stop", "inside", depth.alias("depth"), base.alias("base")), "array-pieces")


def objects_of(file, start: int, stop: int, inside: bool, depth: int, base: int) -> Iterator[tuple[int, bytes]]:
    """(offset, text) of the objects that begin between two places of a file."""
    escaped = _escaped_at(file, start)
    data = _bytes(file, start, stop)
    end = stop
    at, step = _structure(np.frombuffer(data, np.uint8), escaped, inside)
    while True:
        after = depth + np.cumsum(step)
        opens = at[(step > 0) & (after == base + 1)]
        opens = opens[np.frombuffer(data, np.uint8)[opens] == 123] if len(opens) else opens
        opens = opens[opens < stop - start]
        closes = at[(step < 0) & (after == base)]
        slot = np.searchsorted(closes, opens)
        if len(opens) and slot[-1] == len(closes):  # the last object goes on
            more = _bytes(file, end, end + max(MORE, end - start))
            if more:
                data, end = data + more, end + len(more)
                at, step = _structure(np.frombuffer(data, np.uint8), escaped, inside)
                continue
        break
    for begin, s in zip(opens.tolist(), slot.tolist(), strict=True):
        yield start + begin, data[begin : closes[s] + 1] if s < len(closes) else data[begin:]


def read_objects(spark: SparkSession, path: str, pattern: str = "*.json", split: int = SPLIT) -> DataFrame:
    """(path, offset, value): the text of every object of the array files below ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return objects(spark, files.select("path", "length"), split)


def objects(spark: SparkSession, files: DataFrame, split: int = SPLIT) -> DataFrame:
    """(path, offset, value) of files(path, length)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list) -> pa.RecordBatch:
            p, o, v = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(p), pa.array(o, pa.int64()), pa.array(v)], ["path", "offset", "value"])

        for batch in batches:
            for name, *piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, size = [], 0
                with _opened(name) as file:
                    for offset, text in objects_of(file, *piece):
                        rows.append((name, offset, text.decode("utf-8", "replace")))
                        size += len(text)
                        if size >= BATCH:
                            yield made(rows)
                            rows, size = [], 0
                if rows:
                    yield made(rows)

    cut = pieces(spark, files, split)
    return cut.repartition("path", "start").select("path", "start", "stop", "inside", "depth", "base").mapInArrow(read, "path string, offset long, value string")


def write_arrays(rows: DataFrame, path: str) -> None:
    """Write rows (name, value) of JSON objects as array files, one for each name, below ``path/name=...``."""

    def bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            names, lines = [], []
            for name, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is not None and name != now:
                    names.append(now)
                    lines.append("]")
                names.append(name)
                lines.append(("," if name == now else "[") + value)
                now = name
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(lines, pa.string())], ["name", "value"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array(["]"])], ["name", "value"])

    dealt = rows.select("name", "value").repartition("name").sortWithinPartitions("name")
    dealt.mapInArrow(bracketed, "name string, value string").write.partitionBy("name").text(path)
