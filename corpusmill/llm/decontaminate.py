"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Test items are partitioned by the size of their shingle set.  Each partition has its
own window over documents: two strides, a stride being the least power of two above the partition's
sizes, so that an item lying anywhere in a long document fills a fair share of some window,
however long the document is.  A sketch keeps the least hash in each of ``BINS`` ranges
of hashes (one-permutation MinHash); a window that shares a bin's minimum with an item makes
the document a candidate for it.  Strides are sketched once and merged for larger windows.
Items of ``TINY`` shingles or less are searched with windows of one shingle, whose minimum
is the shingle itself.  Candidates are verified by exact containment of the item's set in
the document's, so nothing is found that isn't there.  What the sketches miss: an item of s shingles, of which 4/5
are in a window of 4s at most, has the window's minimum in a bin with a probability of about 1/5 or more
(2/3 where s is near ``TINY``), and all of its bins (8 at least, 64 for large items) must fail: about 10^-4 at
s = 9 and below 10^-4 from s = 64 on, less for whole items.  ``tests/llm`` measures it.

The items are the stated query set: they go to the executors in blocks of about ``SHINGLES`` shingles
(some 20 MB, sent with the task's function), and each block is searched for in all documents, in one pass.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.text import codes, grams, prepare, words

#: ``SHINGLES``: of the items that go out together.
BINS, TINY, SHINGLES = 64, 8, 1_000_000
_NONE = np.uint32(0xFFFFFFFF)


def _high(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(32)).astype(np.uint32)


def _bin(v: np.ndarray) -> np.ndarray:
    return (v >> np.uint32(26)).astype(np.int64)


class Index:
    """The sketches of a block of items with shingles of ``n`` words, by size partition; built on the driver, sent to every task."""

    def __init__(self, n: int, items: list[tuple[int, np.ndarray]]):
        self.n, self.sets = n, items
        by: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for k, (_, s) in enumerate(items):
            v = np.unique(_high(s))
            if len(s) <= TINY:
                stride, least = 0, v
            else:
                stride = 1 << int(len(s)).bit_length()
                least = v[np.r_[True, _bin(v)[1:] != _bin(v)[:-1]]]
            for x in least.tolist():
                by[stride][x].append(k)
        self.strides = []
        for stride, lists in sorted(by.items()):
            values = np.array(sorted(lists), np.uint32)
            seen = np.zeros(1 << 16, bool)
            seen[values & np.uint32(0xFFFF)] = True
            self.strides.append((stride, values, seen, [lists[int(x)] for x in values]))

    def candidates(self, h: np.ndarray) -> set[int]:
        """Places in ``sets`` of the items that share a minimum with a window of the document's shingles, in order of start."""
        out: set[int] = set()
        if not len(h):
            return out
        v = _high(h)
        table, of = None, 0
        for stride, values, seen, lists in self.strides:
            if not stride:
                least = v
            else:
                if table is None:
                    table = np.full((-(-len(v) // stride)) * BINS, _NONE, np.uint32)
                    np.minimum.at(table, np.arange(len(v)) // stride * BINS + _bin(v), v)
                    table, of = table.reshape(-1, BINS), stride
                while of < stride:
                    if len(table) % 2:
                        table = np.vstack([table, np.full((1, BINS), _NONE, np.uint32)])
                    table, of = np.minimum(table[::2], table[1::2]), of * 2
                least = (np.minimum(table[:-1], table[1:]) if len(table) > 1 else table).ravel()
            hit = np.unique(least[seen[least & np.uint32(0xFFFF)]])
            at = np.searchsorted(values, hit)
            for k in at[(at < len(values)) & (values[np.minimum(at, len(values) - 1)] == hit)].tolist():
                out.update(lists[k])
        return out

    def found(self, words_: np.ndarray, num: int, den: int) -> list[tuple[int, int, int]]:
        """(item_id, shingles, shared) of the items contained to num/den or more in a document of the hashed words."""
        if len(words_) < self.n:
            return []
        h = grams(words_, self.n)
        maybe = self.candidates(h)
        if not maybe:
            return []
        own = np.unique(h)
        out = []
        for k in sorted(maybe):
            item, s = self.sets[k]
            at = np.searchsorted(own, s)
            shared = int((own[np.minimum(at, len(own) - 1)] == s).sum())
            if shared * den >= num * len(s):
                out.append((item, len(s), shared))
        return out


def _found(indexes: list[Index], text: str | None, num: int, den: int) -> list[tuple[int, int, int]]:
    h = codes(words(text, lower=True))
    return [x for index in indexes for x in index.found(h, num, den)]


def _indexes(benchmark: DataFrame, n: int) -> Iterator[list[Index]]:
    """The indexes of each block of items, one for each length of shingles; a block at a time comes to the driver."""
    rows = benchmark.select("item_id", "text").where("item_id is not null and text is not null").distinct()
    total = rows.agg(F.sum(F.size(F.split("text", r"[\x20\x09-\x0D]+")))).first()[0] or 0
    blocks = max(1, -(-total // SHINGLES))
    for b in range(blocks):
        some = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else rows
        by: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        for r in some.toLocalIterator():
            if len(h := codes(words(r.text, lower=True))):
                by[min(n, len(h))].append((r.item_id, np.unique(grams(h, n))))
        yield [Index(size, items) for size, items in sorted(by.items())]


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """doc_id, item_id, n_item, n_shared of each item whose n-word shingles are in a document to num/den or more.

    Texts are lower-cased.  An item of w < n words has one shingle, all of it, and is found wherever its w words
    stand in a document.  Null and empty texts, and items without an id, are found nowhere, and an empty table finds nothing.
    Repeated rows repeat their results; of repeated items one counts.  A document's shingles may lie anywhere in it,
    however long it is.  Other columns are ignored.
    """
    prepare(docs.sparkSession)
    out = None
    for block in _indexes(benchmark, n):
        def search(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(d.as_py(), *x) for d, t in zip(*b.columns, strict=True) for x in _found(block, t.as_py(), num, den)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["doc_id", "item_id", "n_item", "n_shared"])

        found = docs.select("doc_id", "text").mapInArrow(search, "doc_id long, item_id long, n_item long, n_shared long")
        out = out.union(found) if out else found
    return out


def clean(docs: DataFrame, benchmark: DataFrame, n: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """The rows of ``docs`` in which no item is found; rows stay where they are, without a shuffle.

    Rows with a null or empty text stay, repeated rows stay or go alike, rows without a doc_id are judged by their text
    like all others.  Without items all rows stay.  Columns keep their names and values, whatever they are called.
    """
    prepare(docs.sparkSession)
    at = docs.columns.index("text")
    for block in _indexes(benchmark, n):
        def keep(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not _found(block, t.as_py(), num, den) for t in b.column(at)], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
