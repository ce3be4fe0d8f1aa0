"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

A document's row is its set of n-word shingles.  Documents of equal sets are one
row (a class).  Rows x and y link when their Jaccard similarity is num/den or
more, which bounds their overlap by the sizes: |x & y| >= num (|x|+|y|) / (num+den).

1. Isolated rows go first.  Linked rows differ in D columns at most, so of
   D + 1 + E column ranges at least 1 + E hold the same in both.  A row of which fewer
   ranges are met with in other rows (of a size that could link) links with nothing.
   Empty ranges are compared only for rows with more than E of them, which need one
   range; others need as many fewer as they have.  No link is lost.
2. The incidence entries of the other rows are dealt into column blocks, which
   count their columns; a row's columns are ordered by that count, rare ones first.
3. The product: for each pair the overlap is accumulated over the shared columns
   among the first |x| - bound + 1 of x and |y| - bound + 1 of y, at least one of
   which linked rows share.  A pair is dropped when the accumulated count and all
   columns behind the last shared one cannot reach the bound.
4. The other columns of the remaining pairs are added up, block by block, until
   the bound is reached or out of reach.

Steps 3 and 4 are done twice: once by a single row of each column, then between rows not connected yet (``links``).
All links lie within components, so each row's are counted there, tile by tile (``link_counts``), and no pair is kept.
Widely shared passages are the last columns of their rows, so they make pairs only
of rows that consist of little else.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusmill.llm import blocks as B
from corpusmill.llm.graph import components
from corpusmill.llm.text import _marked, digest, having_id, kept, lacking_id, looked_up, mix, perhaps_id, prepare, shingles

#: Rows of a block in which a component's links are counted, and columns of a slice of its dense product.
ROWS, SLICE = 512, 4096


def _bounds(num: int, den: int) -> list[int]:
    """Lower ends of the size levels; a row's partners are in its level or the next."""
    ratio, out = max(1.5, den / num + 0.01), [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(np.ceil(out[-1] * ratio))))
    return out


def _ranges(x: np.ndarray, level: int, top: int, num: int, den: int) -> tuple[np.ndarray, int]:
    """A hash for each column range of the sorted row x, at a level whose rows have ``top`` columns at most, and how many a link needs."""
    differ = (den - num) * 2 * top // (den + num)
    if not differ:
        return x[:0], 1
    spare = (differ + 1) // 3 + 1
    m = differ + 1 + spare
    at = ((x >> np.uint64(33)) * np.uint64(m)) >> np.uint64(31)
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    held = at[starts]
    out = mix(np.add.reduceat(mix(x), starts) + mix(held + np.uint64(level << 40)))
    empty = m - len(held)
    if empty <= spare:
        return out, 1 + spare - empty
    return np.r_[out, mix(np.setdiff1d(np.arange(m, dtype=np.uint64), held) + np.uint64(level << 40) + np.uint64(1 << 39))], 1


def classes(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, class (hash of the set; null for no words) and n, for every document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cls, n = [], []
            for t in b.column(1):
                x = shingles(t.as_py(), words)
                n.append(len(x))
                cls.append(digest(x) if len(x) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cls, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "class", "n"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, class long, n long")


def _met(docs: DataFrame, words: int, num: int, den: int, n_blocks: int) -> DataFrame:
    """The classes of which enough column ranges are met with in others."""
    bounds = _bounds(num, den)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chunks():
            for b in batches:
                seen = set()
                for t in b.column(0):
                    x = shingles(t.as_py(), words)
                    if not len(x) or (cls := digest(x)) in seen:
                        continue
                    seen.add(cls)
                    level = bisect_right(bounds, len(x)) - 1
                    s, need = _ranges(x, level, bounds[level + 1] - 1, num, den)
                    if len(x) * den >= bounds[level + 1] * num:
                        more, least = _ranges(x, level + 1, bounds[level + 2] - 1, num, den)
                        s, need = np.concatenate([s, more]), min(need, least)
                    yield s, s.astype(np.uint32), np.full(len(s), cls, np.int64), np.full(len(s), need, np.uint32)

        yield from B.pack(chunks(), n_blocks, ["", "key", "owner", "need"])

    def meet(t: pa.Table) -> pa.Table:
        key, owner, need = B.unpack(t, "key", np.uint32), B.unpack(t, "owner", np.int64), B.unpack(t, "need", np.uint32)
        order = np.lexsort((owner, key))
        key, owner, need = key[order], owner[order], need[order]
        other = (key[1:] == key[:-1]) & (owner[1:] != owner[:-1])
        met = np.zeros(len(key), bool)
        met[1:] |= other
        met[:-1] |= other
        return B.packed([(owner[met].view(np.uint64), need[met])], n_blocks, ["owner", "need"])

    def enough(t: pa.Table) -> pa.Table:
        owner, at, times = np.unique(B.unpack(t, "owner", np.int64), return_index=True, return_counts=True)
        return pa.table({"class": owner[times >= B.unpack(t, "need", np.uint32)[at]]})

    by_range = docs.select("text").mapInArrow(pack, "block int, key binary, owner binary, need binary")
    by_row = by_range.groupBy("block").applyInArrow(meet, "block int, owner binary, need binary")
    return by_row.groupBy("block").applyInArrow(enough, "class long")


def _rows(docs: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """class, n and the packed sorted columns; ``members`` has one doc_id for each class wanted.  Repeated documents repeat their row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(c.as_py(), x) for t, c in zip(b.column(0), b.column(1), strict=True) if digest(x := shingles(t.as_py(), words)) == c.as_py()]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int64()), pa.array([len(x) for _, x in rows], pa.int64()), pa.array([x.tobytes() for _, x in rows], pa.binary())], ["class", "n", "columns"])

    found = having_id(docs.select("doc_id", "text"), members, "doc_id")
    return found.select("text", "class").mapInArrow(work, "class long, n long, columns binary")


def _firsts(rows: DataFrame, num: int, den: int, n_blocks: int) -> DataFrame:
    """column, class, n, place: the rows' first columns in order of (count, hash), without those of one row alone.

    Entries are dealt by column to be counted, and by row to be put in order; either way in packed blocks.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chunks():
            for b in batches:
                for c, x in zip(b.column(0), b.column(1), strict=True):
                    x = np.frombuffer(x.as_py(), np.uint64)
                    yield x, np.full(len(x), c.as_py(), np.int64), np.full(len(x), len(x), np.uint32)

        yield from B.pack(chunks(), n_blocks, ["key", "owner", "n"])

    def counted(t: pa.Table) -> pa.Table:
        key, owner, n = B.unpack(t, "key", np.uint64), B.unpack(t, "owner", np.int64), B.unpack(t, "n", np.uint32)
        order = np.lexsort((owner, key))
        key, owner, n = key[order], owner[order], n[order]
        once = np.r_[True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])]
        key, owner, n = key[once], owner[once], n[once]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        times = np.repeat(np.diff(np.r_[starts, len(key)]), np.diff(np.r_[starts, len(key)]))
        held = times > 1
        return B.packed([(owner[held].view(np.uint64), key[held], n[held], times[held].astype(np.uint32))], n_blocks, ["owner", "key", "n", "times"])

    def first(t: pa.Table) -> pa.Table:
        key, owner, n, times = B.unpack(t, "key", np.int64), B.unpack(t, "owner", np.int64), B.unpack(t, "n", np.uint32).astype(np.int64), B.unpack(t, "times", np.uint32)
        order = np.lexsort((key, times, owner))
        key, owner, n = key[order], owner[order], n[order]
        start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        held = np.diff(np.r_[start, len(owner)])
        place = np.arange(len(owner)) - np.repeat(start, held) + n - np.repeat(held, held)  # columns of one row come before those here
        least = -(-n * num // den)  # the smallest partner has the smallest bound
        short = place <= n - -(-num * (n + least) // (num + den))
        return pa.table({"column": key[short], "class": owner[short], "n": n[short], "place": place[short]})

    by_column = rows.select("class", "columns").mapInArrow(pack, "block int, key binary, owner binary, n binary")
    by_row = by_column.groupBy("block").applyInArrow(counted, "block int, owner binary, key binary, n binary, times binary")
    return by_row.groupBy("block").applyInArrow(first, "column long, class long, n long, place long")


def _reaching(pairs: DataFrame, rows: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (u, v) whose overlap, added up over the blocks of all their columns, reaches the bound."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for u, v, x, y in zip(*batch.columns, strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                bound, both = -(-num * (len(x) + len(y)) // (num + den)), 0
                for k in range(4):  # quarters of the hashes; the rest of the shorter row is the most that can follow
                    lo, hi = np.uint64(k << 62), np.uint64(((k + 1) << 62) - 1)
                    x0, x1 = np.searchsorted(x, lo), np.searchsorted(x, hi, "right")
                    y0, y1 = np.searchsorted(y, lo), np.searchsorted(y, hi, "right")
                    both += len(np.intersect1d(x[x0:x1], y[y0:y1], assume_unique=True))
                    if both + min(len(x) - x1, len(y) - y1) < bound:
                        break
                else:
                    out.append((u.as_py(), v.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(2)], ["u", "v"])

    pairs = kept(pairs)
    rows = perhaps_id(rows, pairs.select(F.col("u").alias("class")).union(pairs.select("v")).distinct(), "class")
    x, y = (rows.select(F.col("class").alias(u), F.col("columns").alias(c)) for u, c in (("u", "x"), ("v", "y")))
    return pairs.join(x, "u").join(y, "v").select("u", "v", "x", "y").mapInArrow(added, "u long, v long")


def links(rows: DataFrame, num: int, den: int, n_blocks: int) -> DataFrame:
    """(u, v): links enough to connect all that linked rows connect.

    The product is taken twice, so that a group of k near copies doesn't make k * k pairs.  First each
    column's rows are multiplied by one row alone, the one in which the column comes first
    (the fewer rare columns a row has, the nearer it is to the middle of its group).  Then by
    every row that the links so found haven't connected with them already: only pairs
    of different components are left, and none of those is left out.
    """
    firsts = kept(_firsts(rows, num, den, n_blocks))
    bound = f"((n_a + n_b) * {num} + {num + den - 1}) div {num + den}"
    near = f"place_a <= n_a - {bound} and place_b <= n_b - {bound}"

    def side(f: DataFrame, s: str) -> DataFrame:
        return f.select(*(F.col(c).alias(f"{c}_{s}") for c in f.columns))

    middle = firsts.groupBy("column").agg(F.min(F.struct("place", "class", "n")).alias("m"), F.count("*").alias("times")).where("times > 1")
    middle = kept(middle.select(F.col("column").alias("column_a"), F.col("m.class").alias("class_b"), F.col("m.n").alias("n_b"), F.col("m.place").alias("place_b"), "times"))
    star = looked_up(side(firsts, "a"), middle, "column_a")
    star = star.where(f"class_a != class_b and {near}").select(F.least("class_a", "class_b").alias("u"), F.greatest("class_a", "class_b").alias("v")).distinct()
    found = kept(_reaching(star, rows, num, den))

    root = components(found)
    of = firsts.join(root, F.col("class") == F.col("node"), "left").select("column", "class", "n", "place", F.coalesce("root", "class").alias("of"))
    of = kept(of)
    open_ = kept(of.groupBy("column").agg(F.min("of").alias("lo"), F.max("of").alias("hi"), F.count("*").alias("times")).where("lo < hi").select("column", "times"))
    of = kept(looked_up(of, open_, "column"))
    # A component's least place and its extreme sizes bound what any of its rows can do; of a single row they are its own.
    parts = of.groupBy("column", "of").agg(F.min("place").alias("place"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    reach = lambda s, t: f"place_{s} <= hi_{s} - ((hi_{s} + lo_{t}) * {num} + {num + den - 1}) div {num + den}"
    two = side(parts, "a").join(side(parts, "b"), F.expr(f"column_a = column_b and of_a < of_b and {reach('a', 'b')} and {reach('b', 'a')}"))
    two = two.select(F.col("column_a").alias("column"), "of_a", "of_b")
    two = two.join(side(of, "a").withColumnRenamed("column_a", "column"), ["column", "of_a"])
    pairs = (
        two.join(side(of, "b").withColumnRenamed("column_b", "column"), ["column", "of_b"]).where(near)
        .groupBy("class_a", "class_b", "n_a", "n_b").agg(F.count("*").alias("overlap"), F.max("place_a").alias("last_a"), F.max("place_b").alias("last_b"))
        .where(f"overlap + least(n_a - last_a, n_b - last_b) - 1 >= {bound}")
        .select(F.least("class_a", "class_b").alias("u"), F.greatest("class_a", "class_b").alias("v"))
    )
    return found.union(_reaching(pairs, rows, num, den)).distinct()


def _overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many columns each row of x shares with each row of y: a product of dense slices of the columns that both sides have."""
    columns, at = np.unique(np.concatenate([*x, *y]), return_inverse=True)
    cut = sum(map(len, x))
    both = (np.bincount(at[:cut], minlength=len(columns)) > 0) & (np.bincount(at[cut:], minlength=len(columns)) > 0)
    place, n = np.cumsum(both) - 1, int(both.sum())
    sides = []
    for rows, a in ((x, at[:cut]), (y, at[cut:])):
        row, held = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), both[a]
        row, a = row[held], place[a[held]]
        order = np.argsort(a, kind="stable")
        sides.append((len(rows), row[order], a[order]))
    out = np.zeros((len(x), len(y)), np.int64)
    for lo in range(0, n, SLICE):
        dense = []
        for k, row, a in sides:
            part = slice(*np.searchsorted(a, [lo, lo + SLICE]))
            dense.append(np.zeros((k, min(SLICE, n - lo)), np.float32))
            dense[-1][row[part], a[part] - lo] = 1
        out += (dense[0] @ dense[1].T).astype(np.int64)
    return out


def link_counts(rows: DataFrame, roots: DataFrame, num: int, den: int, n_blocks: int) -> DataFrame:
    """class, n_links: with how many other rows of its component a row links.  ``roots`` has class and root.

    A component's rows are dealt by hash into blocks of about ``ROWS`` rows and ``B.ENTRIES`` entries at most; each
    pair of blocks is a tile, whose overlaps are worked out at once and only counted.  Components of one block
    share tiles.  Every pair is compared, so the work grows with the square of a component.
    """

    def count(t: pa.Table) -> pa.Table:
        groups: dict[int, dict[tuple[int, int], np.ndarray]] = {}
        for root, block, cls, x in zip(*(t.column(c).to_pylist() for c in ("root", "b", "class", "columns")), strict=True):
            groups.setdefault(root, {})[block, cls] = np.frombuffer(x, np.uint64)  # a repeated row once
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        cls, links_ = [], []
        for held in groups.values():
            u, v = ([k for k in held if k[0] == b] for b in (i, j))
            if not u or not v:
                continue
            x, y = [held[k] for k in u], [held[k] for k in v]
            bound = -(-num * (np.array([len(r) for r in x])[:, None] + np.array([len(r) for r in y])[None, :]) // (num + den))
            linked = _overlaps(x, y) >= bound
            if i == j:
                np.fill_diagonal(linked, False)
            for keys, n in ((u, linked.sum(1)), (v, linked.sum(0)))[: 1 if i == j else 2]:
                cls += [c for _, c in keys]
                links_ += n.tolist()
        return pa.table({"class": pa.array(cls, pa.int64()), "n_links": pa.array(links_, pa.int64())})

    sized = kept(rows.select("class", "n").distinct().join(roots, "class"))
    blocks = kept(sized.groupBy("root").agg(F.expr(f"cast(ceil(greatest(count(*) / {ROWS}, sum(n) / {B.ENTRIES})) as int)").alias("blocks"), F.count("*").alias("times")).where("times > 1"))
    dealt = kept(looked_up(sized, blocks, "root").select("class", "root", "blocks", F.expr("cast(pmod(xxhash64(class), blocks) as int)").alias("b")))
    tiles = perhaps_id(rows, dealt.select("class"), "class").select("class", "columns").join(dealt, "class").withColumn("p", F.explode(F.expr("sequence(0, blocks - 1)")))
    tiles = tiles.select(F.expr(f"if(blocks = 1, pmod(xxhash64(root), {n_blocks}), root)").alias("tile"), F.least("b", "p").alias("i"), F.greatest("b", "p").alias("j"), "root", "b", "class", "columns")
    return tiles.groupBy("tile", "i", "j").applyInArrow(count, "class long, n_links long").groupBy("class").agg(F.sum("n_links").alias("n_links"))


def jaccard_components(docs: DataFrame, words: int = 5, num: int = 8, den: int = 10, counted: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id, class, n_links of every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id reachable by links of similarity num/den or more.  n_links counts all
    other classes (different sets) that the row's class links with; it is left out unless ``counted``.
    Null and empty texts have n_shingles 0 and link with nothing; rows without a
    doc_id get a null component_id, and a set that only such rows have links with nothing.
    Repeated rows are members of one class.  Other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    of = kept(classes(docs, words))
    by_class = kept(of.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.count("*").alias("times")))
    total = of.agg(F.sum("n")).first()[0] or 0
    met = kept(_met(docs, words, num, den, B.count(spark, total * (den - num) // num)))
    members = by_class.where("doc_id is not null").join(met, "class").select("doc_id", "class")
    rows = kept(_rows(docs, members, words))
    entries = rows.agg(F.sum("n")).first()[0] or 0
    found = kept(links(rows, num, den, B.count(spark, entries)))
    root = components(found)
    labelled = kept(by_class.join(root, F.col("class") == F.col("node"), "left").select("class", "doc_id", F.coalesce("root", "class").alias("root"), F.col("times").alias("copies")))
    first = kept(labelled.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("times")))
    component = looked_up(labelled, first, "root").select("class", "component_id", F.col("copies").alias("times"))
    columns = ["doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), "class"]
    if counted:
        degree = link_counts(rows, labelled.select("class", "root"), num, den, B.count(spark, entries))
        component = component.join(degree, "class", "left")
        columns.append(F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return looked_up(of, kept(component), "class", "left").select(*columns)


def one_of_each(docs: DataFrame, words: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """The documents without those in the component of a smaller doc_id, and of rows that repeat doc_id and text one.

    Rows without words or without a doc_id stay.
    """
    of = kept(jaccard_components(docs, words, num, den, counted=False).where("doc_id is not null").select("doc_id", "class", (F.col("component_id") < F.col("doc_id")).alias("gone")))
    asked = kept(of.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("gone").alias("gone"), F.max("gone").alias("some")))
    left = lacking_id(docs, asked.where("some or n > 1"), "doc_id", ["doc_id", "text"])
    # Ids that rows of several classes share: only the rows whose own class goes.
    mixed = kept(of.where("gone").join(asked.where("some and not gone").select("doc_id"), "doc_id").groupBy("doc_id").agg(F.collect_set("class").alias("_gone")))
    if not mixed.limit(1).count():
        return left

    def staying(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stays = [not gone or digest(shingles(t, words)) not in gone for t, gone in zip(b.column("text").to_pylist(), b.column("_gone").to_pylist(), strict=True)]
            yield b.select(["_row"]).filter(pa.array(stays, pa.bool_()))

    marked = _marked(left, mixed, "doc_id")
    some = marked.where("_seen").join(mixed.withColumnRenamed("doc_id", "_key"), "_key", "left").select("_row", F.col("_row.text").alias("text"), "_gone")
    some = some.mapInArrow(staying, StructType().add("_row", docs.schema)).select("_row.*")
    return marked.where("not _seen").select("_row.*").unionByName(some)
