"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard has ``nodes`` places on a ring of 2^CELLS cells; a key belongs to the first
place at or after its cell.  A shard may hold floor(N / shards) keys, the first N mod
shards of them one more, so that counts differ by one at most.  Keys beyond a full
shard's room continue clockwise to the next place whose shard has room.  An arc's
earliest keys stay, so few keys move when the ring changes.

The driver sees a count for each arc (shards x nodes numbers, whatever the input) and
settles which ranks of an arc go where.  A row's rank in its arc is the number of rows in the arc's cells
before its own plus its rank in the cell, so rows are never sorted by more than a cell, and a cell of more than ``PART``
rows (rows equal in all that the key is made of) in parts by the place they are read at.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.text import kept

CELLS = 20
#: Rows of a cell that a task ranks; cells of more, which hold repeated rows, are ranked in parts.
PART = 1_000_000


def ring(shards: int, nodes: int) -> list[tuple[int, int]]:
    """(cell, shard) of the places, in ring order; of two in one cell the first by hash counts."""
    at: dict[int, int] = {}
    for s in range(shards):
        for v in range(nodes):
            at.setdefault(int.from_bytes(hashlib.sha256(f"{s}:{v}".encode()).digest()[:8], "big") >> (64 - CELLS), s)
    return sorted(at.items())


def assign(counts: list[int], owners: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, rank behind the last, shard, first slot): where the ranks of each arc go."""
    total = sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used, out, left = [0] * shards, [], []

    def put(arc: int, first: int, n: int, s: int) -> int:
        n = min(n, room[s] - used[s])
        if n:
            out.append((arc, first, first + n, s, used[s]))
            used[s] += n
        return n

    for arc, n in enumerate(counts):
        done = put(arc, 0, n, owners[arc])
        if done < n:
            left.append((arc, done, n))
    for arc, first, n in left:
        step = arc
        while first < n:
            step = (step + 1) % len(owners)
            first += put(arc, first, n - first, owners[step])
    return out


def placed(rows: DataFrame, shards: int, nodes: int) -> DataFrame:
    """``rows`` (doc_id, size, text_crc32, and others) with shard and slot."""
    spark = rows.sparkSession
    places = ring(shards, nodes)
    cells, owners = [c for c, _ in places], [s for _, s in places]
    rows = rows.withColumn("_key", F.xxhash64("doc_id", "text_crc32", "size"))
    rows = rows.withColumn("_cell", F.shiftrightunsigned("_key", 64 - CELLS).cast("int"))
    # A cell's arc: the number of places before it; past the last place the ring begins anew.
    bound = spark.createDataFrame([(a, (cells[a - 1] + 1) if a else 0, cells[a] if a < len(cells) else (1 << CELLS) - 1) for a in range(len(cells) + 1)], "_arc int, _lo int, _hi int")
    bound = bound.select(F.when(F.col("_arc") == len(cells), 0).otherwise(F.col("_arc")).alias("_arc"), F.when(F.col("_arc") == len(cells), 0).otherwise(1).alias("_turn"), F.explode(F.sequence("_lo", F.greatest("_lo", "_hi"))).alias("_c")).where("_c < %d" % (1 << CELLS))
    filled = kept(rows.groupBy("_cell").agg(F.count("*").alias("_n"))).withColumn("_part", F.lit(0).cast("long"))
    large = filled.where(F.col("_n") > PART).select("_cell", F.ceil(F.col("_n") / PART).alias("_parts"))  # a row a cell at most
    if large.limit(1).count():
        # The rows are kept with their part, so that they are counted and ranked alike.
        rows = kept(rows.join(F.broadcast(large), "_cell", "left").withColumn("_part", F.coalesce(F.pmod(F.monotonically_increasing_id(), "_parts"), F.lit(0))).drop("_parts"))
        filled = kept(rows.groupBy("_cell", "_part").agg(F.count("*").alias("_n")))
    else:
        rows = rows.withColumn("_part", F.lit(0).cast("long"))
    filled = filled.join(bound, F.col("_cell") == F.col("_c")).withColumn("_before", F.sum("_n").over(Window.partitionBy("_arc").orderBy("_turn", "_cell", "_part")) - F.col("_n"))
    filled = kept(filled.select(F.col("_cell").alias("_c"), F.col("_part").alias("_p"), "_arc", "_before", "_n"))
    counts = {r["_arc"]: r["n"] for r in filled.groupBy("_arc").agg(F.sum("_n").alias("n")).collect()}
    went = assign([counts.get(a, 0) for a in range(len(owners))], owners, shards)
    where = spark.createDataFrame(went or [(-1, 0, 0, 0, 0)], "_a int, _first long, _behind long, shard int, _slot long")
    rank = F.row_number().over(Window.partitionBy("_cell", "_part").orderBy("_key", "doc_id", "text_crc32", "size")) - 1
    ranked = rows.withColumn("_rank", rank).join(filled.drop("_n"), (F.col("_cell") == F.col("_c")) & (F.col("_part") == F.col("_p"))).withColumn("_rank", F.col("_rank") + F.col("_before"))
    # At most two ranges of ranks for each place and one for each shard: a bounded table.
    joined = ranked.join(F.broadcast(where), (F.col("_arc") == F.col("_a")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_behind")))
    return joined.withColumn("slot", (F.col("_slot") + F.col("_rank") - F.col("_first")).cast("long")).drop("_key", "_cell", "_c", "_part", "_p", "_arc", "_before", "_rank", "_a", "_first", "_behind", "_slot")


def shard(docs: DataFrame, shards: int = 16, nodes: int = 64) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of ``docs`` (doc_id, text).

    The law is ``rows``: counts differ by one at most; slots run from 0 without gaps.  A null text has size 1 and the
    checksum of no bytes.  Rows equal in doc_id, size and checksum are interchangeable.  Other columns are ignored.
    """
    return placed(kept(sized(docs).select("doc_id", "size", "text_crc32")), shards, nodes).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def sized(docs: DataFrame) -> DataFrame:
    raw = F.coalesce(docs["text"], F.lit(""))
    return docs.withColumns({"size": (F.octet_length(raw) + 1).cast("long"), "text_crc32": F.crc32(F.encode(raw, "UTF-8"))})


def sharded(docs: DataFrame, shards: int = 16, nodes: int = 64) -> DataFrame:
    """The rows of ``docs`` with shard and slot (columns of those names give way), as ``shard`` deals them.

    Null texts and ids have their place like all others; rows that repeat all of doc_id, size and checksum each have a slot; no rows give none.
    """
    columns = [c for c in docs.columns if c not in ("shard", "slot")]
    rows = sized(docs.select(F.struct(*(docs[c] for c in columns)).alias("_row"), "doc_id", "text")).drop("text")
    return placed(rows, shards, nodes).select("_row.*", "shard", "slot")
