"""Counting hashes over all rows, with one entry per block and hash in the shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from papyrine.llm.textual import by_partition, joined, mix, partitions


def frequencies(table: DataFrame) -> DataFrame:
    """(b, t, f): for each block, the packed hashes that occur twice or more in all blocks, and how often."""
    parts = partitions(table)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(b: int, sets: list[bytes]) -> pa.RecordBatch:
            t, f = np.unique(joined(sets, np.uint64), return_counts=True)
            rows = list(by_partition((mix(t) % np.uint64(parts)).astype(np.int64), parts, t, f.astype(np.uint32)))
            p, tb, fb = zip(*rows, strict=True) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array([b] * len(p), pa.int64()), pa.array(tb, pa.binary()), pa.array(fb, pa.binary())], ["p", "b", "t", "f"])

        now, sets = None, []
        for batch in batches:
            for b, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if b != now and sets:
                    yield flush(now, sets)
                    sets = []
                now = b
                sets.append(s)
        if sets:
            yield flush(now, sets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
        if not rows:
            return
        ts = [np.frombuffer(r[1], np.uint64) for r in rows]
        names, code = np.unique(np.concatenate(ts), return_inverse=True)
        total = np.bincount(code, joined((r[2] for r in rows), np.uint32), len(names)).astype(np.int64)
        out, at = [], 0
        for (b, _, _), t in zip(rows, ts, strict=True):
            f = total[code[at : at + len(t)]]
            at += len(t)
            out.append((b, t[f > 1].tobytes(), f[f > 1].tobytes()))
        b, t, f = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(t, pa.binary()), pa.array(f, pa.binary())], ["b", "t", "f"])

    sent = table.select("b", "s").mapInArrow(send, "p int, b long, t binary, f binary").repartition(parts, "p")
    return sent.mapInArrow(count, "b long, t binary, f binary")
