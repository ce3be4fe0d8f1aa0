"""Sparse matrices in column blocks: (column hash, row owner) entries, packed per block.

A task packs its entries by the block of their column (the top 32 bits of the hash,
scaled to the number of blocks) into one row a block, so that a shuffle moves a few
large rows.  A block is then put together and worked on with numpy.  The number of
blocks follows the number of entries, so a block stays at about ``ENTRIES``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Entries that a block holds on average, and that a task holds before it writes them out.
ENTRIES, HELD = 1_500_000, 500_000


def count(spark: SparkSession, entries: int) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(entries) // ENTRIES))


def pack(chunks: Iterable[tuple[np.ndarray, ...]], blocks: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Chunks are (keys, column, column...) of one length; the first is the uint64 hash, which is left out if its name is empty."""
    held: list[tuple[np.ndarray, ...]] = []
    n = 0

    def out() -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        held.clear()
        block = (((columns[0] >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)).astype(np.uint32)
        order = np.argsort(block, kind="stable")
        block = block[order]
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        ends = np.r_[starts[1:], len(block)]
        sorted_columns = [c[order] for c, name in zip(columns, names, strict=True) if name]
        del columns, order
        for at in range(0, len(starts), 64):
            some = list(zip(starts[at : at + 64], ends[at : at + 64], strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(block[s]) for s, _ in some], pa.int32())] + [pa.array([c[s:e].tobytes() for s, e in some], pa.binary()) for c in sorted_columns], ["block", *filter(None, names)]
            )

    for chunk in chunks:
        if len(chunk[0]):
            held.append(chunk)
            n += len(chunk[0])
        if n >= HELD:
            yield from out()
            n = 0
    if n:
        yield from out()
    pa.default_memory_pool().release_unused()  # the worker lives on for other tasks


def unpack(table: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in table.column(name)), kind)


def packed(chunks: Iterable[tuple[np.ndarray, ...]], blocks: int, names: list[str]) -> pa.Table:
    """As ``pack``, in one table: to deal a block's result anew."""
    out = list(pack(chunks, blocks, names))
    return pa.Table.from_batches(out) if out else pa.table({"block": pa.array([], pa.int32())} | {n: pa.array([], pa.binary()) for n in names if n})
