"""Substring dedup with repeated-phrase automata.

Every word in a window of ``window`` words that also starts earlier (in a smaller
doc_id, or before in the same document) goes; windows are judged on the input.

1. Recurring passages are confirmed over the whole corpus.  A window's phrase is
   its ``phrase``-word run of the smallest hash, so equal windows have equal
   phrases, and a document needs a seventh or so of its runs.  A phrase is spelt with
   two letters a word (16 bits of the word's hash), and that spelling is what is counted, in column blocks: the
   phrases of two documents, or twice in one, recur.
2. Each document with a recurring phrase gets the spellings of its own from there.  Automata are
   compiled from them with pyahocorasick in shards, one for each block of documents (about
   ``SHARD`` bytes of text), so memory is bounded by the block.  The block's documents, spelt
   alike, stream through it, and where a phrase stands is known from the automaton alone.  (Every
   document through every shard would be the corpus times its recurring part; a document of which no
   phrase recurs holds no occurrence and needs no stream.)
3. The windows around the occurrences are compared by a 64-bit hash, in blocks.
   All but the first by (doc_id, start) are removed.  Words that share their letters
   only make more windows to compare.

Documents of the same words are one class; its smallest doc_id stands for it, and
in the others each word of a text of ``window`` words or more is removed.  A shard sends
each of its windows to be compared once, so a passage in a third of all rows is no hot key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import blocks as B
from corpusmill.llm.text import codes, digest, grams, having_id, kept, looked_up, mix, prepare, words

SHARD = 1 << 20
#: The place of rows without a doc_id: after all others (of the largest id, at its place).
LAST = (1 << 63) - 1
EMPTY = hashlib.sha256(b"").hexdigest()
#: Words of a phrase at most: its letters are kept in twelve bytes.
LONGEST = 6
#: Of a phrase that is counted: it is twice in its document or batch; it isn't counted, as it surely recurs.
AGAIN, SURE = 1, 2


def _letters(h: np.ndarray) -> np.ndarray:
    """Two letters (bytes) for each hashed word."""
    return (h >> np.uint64(48)).astype(">u2").view(np.uint8).reshape(-1, 2)


def _phrases(h: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the phrases of all windows of a document, and their spelling in eight and four bytes."""
    if len(h) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    g = grams(h, phrase)
    runs = window - phrase + 1
    at = sliding_window_view(g, runs).argmin(axis=1) + np.arange(len(h) - window + 1)
    at = at[np.r_[True, at[1:] != at[:-1]]]
    spelt = np.zeros((len(at), 2 * LONGEST), np.uint8)
    spelt[:, : 2 * phrase] = _letters(h)[at[:, None] + np.arange(phrase)].reshape(len(at), -1)
    return g[at], spelt[:, :8].copy().view(">u8").ravel().astype(np.uint64), spelt[:, 8:].copy().view(">u4").ravel().astype(np.uint32)


def _summaries(docs: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cls, n, sha = [], [], []
            for t in b.column(1):
                w = words(t.as_py())
                whole = b" ".join(w)
                cls.append(digest(whole))
                n.append(len(w))
                sha.append(hashlib.sha256(whole).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cls, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string()), b.column(2)], ["_id", "class", "n_words", "sha", "_no_id"])

    return docs.mapInArrow(work, "_id long, class long, n_words long, sha string, _no_id boolean")


def _settled(g: np.ndarray, hi: np.ndarray, lo: np.ndarray, owner: np.ndarray, flag: np.ndarray) -> tuple[np.ndarray, ...]:
    """The phrases of a batch, as they are dealt: of those that several documents share one is sent to be counted, the others
    are sure to recur and are dealt evenly, so that a phrase in a third of all documents is no hot key."""
    order = np.argsort(g, kind="stable")
    g, hi, lo, owner, flag = g[order], hi[order], lo[order], owner[order], flag[order]
    start = np.r_[True, g[1:] != g[:-1]]
    size = np.diff(np.r_[np.flatnonzero(start), len(g)])
    flag = np.where(start, np.where(np.repeat(size, size) > 1, AGAIN, flag), SURE).astype(np.uint8)
    # A phrase's hash is the least of many, so it is mixed anew to be dealt evenly.
    return mix(np.where(flag == SURE, owner.view(np.uint64) + g, g)), hi, lo, owner, flag


def _recurring(docs: DataFrame, window: int, phrase: int, n_blocks: int) -> DataFrame:
    """class and the spellings of its phrases that recur in the corpus."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chunks():
            for b in batches:
                seen = set()
                found = []
                for t in b.column(0):
                    w = words(t.as_py())
                    if len(w) < window or (cls := digest(b" ".join(w))) in seen:
                        continue
                    seen.add(cls)
                    g, hi, lo = _phrases(codes(w), window, phrase)
                    g, first, times = np.unique(g, return_index=True, return_counts=True)
                    found.append((g, hi[first], lo[first], np.full(len(g), cls, np.int64), (times > 1).astype(np.uint8)))
                if found:
                    yield _settled(*(np.concatenate(x) for x in zip(*found, strict=True)))

        yield from B.pack(chunks(), n_blocks, ["", "hi", "lo", "owner", "flag"])

    def recur(t: pa.Table) -> pa.Table:
        hi, lo, owner, flag = (B.unpack(t, c, k) for c, k in (("hi", np.uint64), ("lo", np.uint32), ("owner", np.int64), ("flag", np.uint8)))
        sure, order = np.flatnonzero(flag == SURE), np.flatnonzero(flag != SURE)
        order = order[np.lexsort((owner[order], lo[order], hi[order]))]
        key, low, by, twice = hi[order], lo[order], owner[order], flag[order] == AGAIN
        start = np.r_[True, (key[1:] != key[:-1]) | (low[1:] != low[:-1])] if len(key) else np.zeros(0, bool)
        group = np.cumsum(start) - 1
        again = np.zeros(int(start.sum()), bool)
        again[group[twice]] = True
        again[group[1:][~start[1:] & (by[1:] != by[:-1])]] = True
        held = np.r_[sure, order[again[group]]]
        return B.packed([(owner[held].view(np.uint64), hi[held], lo[held])], n_blocks, ["owner", "hi", "lo"])

    def gather(t: pa.Table) -> pa.Table:
        hi, lo = B.unpack(t, "hi", np.uint64), B.unpack(t, "lo", np.uint32)
        spelt = np.hstack([hi.astype(">u8").view(np.uint8).reshape(-1, 8), lo.astype(">u4").view(np.uint8).reshape(-1, 4)])
        return _by_owner(["class", "keys"], [B.unpack(t, "owner", np.int64)], spelt)

    by_phrase = docs.select("text").mapInArrow(pack, "block int, hi binary, lo binary, owner binary, flag binary")
    by_row = by_phrase.groupBy("block").applyInArrow(recur, "block int, owner binary, hi binary, lo binary")
    return by_row.groupBy("block").applyInArrow(gather, "class long, keys binary")


def _by_owner(names: list[str], owners: list[np.ndarray], values: np.ndarray) -> pa.Table:
    """A row for each owner (columns), with its values packed."""
    order = np.lexsort(owners[::-1])
    owners, values = [o[order] for o in owners], values[order]
    if not len(values):
        return pa.table({n: pa.array([], pa.int64()) for n in names[:-1]} | {names[-1]: pa.array([], pa.binary())})
    starts = np.flatnonzero(np.r_[True, np.any([o[1:] != o[:-1] for o in owners], axis=0)])
    ends = np.r_[starts[1:], len(values)]
    return pa.table({n: pa.array(o[starts]) for n, o in zip(names, owners, strict=False)} | {names[-1]: pa.array([values[s:e].tobytes() for s, e in zip(starts, ends, strict=True)], pa.binary())})


def occurrences(block: list[tuple[np.ndarray, bytes]], window: int, phrase: int) -> Iterator[np.ndarray]:
    """For each document (hashed words, spellings of ``2 * LONGEST`` bytes) of the block: starts of the windows that hold an occurrence of the shard's phrases."""
    width = 2 * LONGEST
    spelt = {keys[k : k + 2 * phrase] for _, keys in block for k in range(0, len(keys), width)}
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for s in spelt:
        automaton.add_word(s.decode("latin-1"))
    if spelt:
        automaton.make_automaton()
    for h, _ in block:
        n = len(h)
        if not spelt or n < window:
            yield np.zeros(0, np.int64)
            continue
        ends = np.fromiter((end for end, _ in automaton.iter(_letters(h).tobytes().decode("latin-1"))), np.int64)
        at = (ends[ends % 2 == 1] + 1) // 2 - phrase  # a match that begins within a word's letters is none
        edge = np.zeros(n + 2, np.int32)
        np.add.at(edge, np.maximum(at - (window - phrase), 0), 1)
        np.add.at(edge, at + 1, -1)
        yield np.flatnonzero(np.cumsum(edge)[: n - window + 1] > 0)


def _not_first(key, doc, owner, start) -> tuple[np.ndarray, np.ndarray]:
    """The order of (key, doc, owner, start), and which of the ordered entries have the same key as an earlier one."""
    order = np.lexsort((start, owner, doc, key))
    key, doc, owner, start = key[order], doc[order], owner[order], start[order]
    first = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], np.arange(len(key)), 0)) if len(key) else np.zeros(0, int)
    return order, (doc != doc[first]) | (owner != owner[first]) | (start != start[first])


def _removed(found: DataFrame, window: int, phrase: int, n_blocks: int) -> DataFrame:
    """_id, class and packed starts of the windows that go."""

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shards(b):
            held, size = [], 0
            for i, c, t, keys in zip(*b.columns, strict=True):
                w = words(t.as_py())
                if digest(b" ".join(w)) == c.as_py():
                    held.append((i.as_py(), c.as_py(), codes(w), keys.as_py()))
                    size += sum(map(len, w))
                if size > SHARD:
                    yield held
                    held, size = [], 0
            if held:
                yield held

        def chunks():
            for b in batches:
                for held in shards(b):
                    key, doc, owner, start = [], [], [], []
                    for (i, c, h, _), at in zip(held, occurrences([(h, k) for _, _, h, k in held], window, phrase), strict=True):
                        if len(at):
                            key.append(grams(h, window)[at])
                            doc.append(np.full(len(at), i, np.int64))
                            owner.append(np.full(len(at), c, np.int64))
                            start.append(at.astype(np.uint32))
                    if key:
                        columns = [np.concatenate(x) for x in (key, doc, owner, start)]
                        order, again = _not_first(*columns)
                        key, doc, owner, start = (c[order] for c in columns)
                        # What isn't the first in its shard goes for certain: it is dealt evenly, not to its window's block.
                        dealt = np.where(again, mix(owner.view(np.uint64) + start), key)
                        yield dealt, np.where(again, np.uint64(0), key), doc, owner, start, again

        yield from B.pack(chunks(), n_blocks, ["", "key", "doc", "owner", "start", "again"])

    def judge(t: pa.Table) -> pa.Table:
        kinds = {"key": np.uint64, "doc": np.int64, "owner": np.int64, "start": np.uint32, "again": np.bool_}
        key, doc, owner, start, again = (B.unpack(t, c, k) for c, k in kinds.items())
        open_ = np.flatnonzero(~again)
        order, late = _not_first(key[open_], doc[open_], owner[open_], start[open_])
        gone = np.r_[np.flatnonzero(again), open_[order][late]]
        return B.packed([(owner[gone].view(np.uint64), doc[gone], start[gone])], n_blocks, ["owner", "doc", "start"])

    def gather(t: pa.Table) -> pa.Table:
        owner, doc, start = (B.unpack(t, c, k) for c, k in (("owner", np.int64), ("doc", np.int64), ("start", np.uint32)))
        return _by_owner(["_id", "class", "starts"], [doc, owner], start)

    packed = found.select("_id", "class", "text", "keys").mapInArrow(locate, "block int, key binary, doc binary, owner binary, start binary, again binary")
    by_row = packed.groupBy("block").applyInArrow(judge, "block int, owner binary, doc binary, start binary")
    return by_row.groupBy("block").applyInArrow(gather, "_id long, class long, starts binary")


def remove(w: list[bytes], starts: np.ndarray, window: int) -> list[bytes]:
    """The words that no window at one of the starts covers."""
    edge = np.zeros(len(w) + 1, np.int32)
    starts = np.unique(starts).astype(np.int64)
    edge[starts] += 1
    np.subtract.at(edge, starts + window, 1)
    return [w[i] for i in np.flatnonzero(np.cumsum(edge[: len(w)]) == 0)]


def dedup_passages(docs: DataFrame, window: int = 20, phrase: int = 6) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text, for every row of ``docs`` (doc_id, text).

    kept_text is null where nothing goes (the text stays as it is) and otherwise the kept words joined by one space.
    Null texts have no words; texts of fewer words than the window lose none.  Rows
    without a doc_id come after all others, in no stated order among themselves; rows that repeat both doc_id
    and text are one document and have the same result.  Other columns are ignored.  ``phrase``: 2 to ``LONGEST`` words.
    """
    if not 2 <= phrase <= min(window, LONGEST):
        raise ValueError(f"a phrase has 2 to {LONGEST} words and fits a window")
    spark = prepare(docs.sparkSession)
    docs = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("_id"), "text", F.col("doc_id").isNull().alias("_no_id"))
    of = kept(_summaries(docs.select("_id", "text", "_no_id")))
    by_class = kept(of.groupBy("class").agg(F.min("_id").alias("_id"), F.count("*").alias("times")))
    total = of.agg(F.sum("n_words")).first()[0] or 0
    recurring = kept(_recurring(docs, window, phrase, B.count(spark, total // 5)))
    found = having_id(docs.select("_id", "text"), by_class.join(recurring, "class").select("_id", "class", "keys"), "_id")
    removed = kept(_removed(found, window, phrase, B.count(spark, total // 5)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, c, t, s in zip(*b.columns, strict=True):
                w = words(t.as_py())
                if digest(b" ".join(w)) == c.as_py():
                    rest = remove(w, np.frombuffer(s.as_py(), np.uint32), window)
                    text = b" ".join(rest)
                    out.append((i.as_py(), c.as_py(), len(w) - len(rest), hashlib.sha256(text).hexdigest(), text.decode("utf-8", "surrogatepass")))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], ["_id", "class", "n_removed", "kept", "kept_text"])

    cut = (
        having_id(docs.select("_id", "text"), removed, "_id").select("_id", "class", "text", "starts")
        .mapInArrow(work, "_id long, class long, n_removed long, kept string, kept_text string").dropDuplicates(["_id", "class"])
    )
    copy = F.expr(f"_id != first and n_words >= {window}")
    marked = kept(looked_up(of, by_class.withColumnRenamed("_id", "first"), "class"))
    # Copies and short texts are settled; the others may have been cut.
    asked = F.expr(f"_id = first and n_words >= {window}")
    none = (F.lit(None).cast(t).alias(c) for c, t in (("n_removed", "long"), ("kept", "string"), ("kept_text", "string")))
    return (
        marked.where(asked).join(cut, ["_id", "class"], "left").unionByName(marked.where(~asked).select("*", *none))
        .select(
            F.when(~F.col("_no_id"), F.col("_id")).alias("doc_id"), "n_words",
            F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(copy, F.lit(EMPTY)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
            F.when(copy, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
        )
    )
