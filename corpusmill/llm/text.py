"""Words, hashes and sets of shingles for the Python stages, and session settings.

Words are the maximal runs of ``[^\\x20\\x09-\\x0D]``.  ``bytes.split()`` cuts at
exactly those six characters and ``bytes.lower()`` changes A-Z alone, so both work
on the UTF-8 bytes of a text.  A null text has no words.
"""

from __future__ import annotations

import re
import sys
import tempfile

import numpy as np
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hashes of words are kept, and forgotten all at once, at this many.
VOCABULARY = 200_000
_P = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= VOCABULARY:
            self.clear()
        self[word] = code = xxhash.xxh3_64_intdigest(word) - (1 << 63)
        return code

    def __reduce__(self):
        return _Vocabulary, ()


_codes = _Vocabulary()


def words(text: str | None, lower: bool = False) -> list[bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def codes(tokens: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    return np.fromiter(map(_codes.__getitem__, tokens), np.int64, len(tokens)).view(np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word windows in order of start; fewer words make one window; none make none."""
    n = min(n, len(h))
    if not n:
        return h
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out *= _P
        out += h[k : len(h) - n + 1 + k]
    return mix(out + np.uint64(n))


def shingles(text: str | None, n: int) -> np.ndarray:
    """The sorted set of hashed n-word shingles of the lower-cased text."""
    return np.unique(grams(codes(words(text, lower=True)), n))


def digest(a: np.ndarray | bytes) -> int:
    """A signed 64-bit hash."""
    return xxhash.xxh3_64_intdigest(a if isinstance(a, bytes) else a.tobytes()) - (1 << 63)


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds what an Arrow batch hands to Python, sends this package's functions along with
    the tasks (executors need not have it), and sees to a checkpoint folder: the one that the session
    names; where none is named, a temporary one on a local master and an error on a cluster."""
    cloudpickle.register_pickle_by_value(sys.modules[__package__])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[[^,]*(,\d+)?\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return spark


def kept(df: DataFrame) -> DataFrame:
    """The rows, written to the checkpoint folder: later jobs read them instead of working them out again."""
    prepare(df.sparkSession)
    return df.checkpoint()


#: The filter of ``having_id`` has 2^BITS bits, whatever the number of ids.
BITS, _CHUNK = 24, 15
#: Keys that more than 1/HOT of the rows hold are looked up in a broadcast table, of HOT rows at most.
HOT = 1000


def _marked(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """``_row`` (all of ``df``'s columns), ``_key`` (the id) and ``_seen``: false only where the id isn't among ``ids``.

    By a Bloom filter of 2 MB at most (2^24 bits in 512 rows of 4 KB, whatever the input), which is broadcast.
    """
    slot = F.shiftrightunsigned(F.xxhash64(F.lit(7), F.col("_key")), 64 - BITS).cast("int")
    marks = (
        ids.select(F.col(column).alias("_key")).select(slot.alias("_s")).distinct()
        .select(F.shiftright("_s", _CHUNK).alias("_chunk"), (F.col("_s") % (1 << _CHUNK)).cast("long").alias("_bit"))
        .groupBy("_chunk").agg(F.expr("bitmap_construct_agg(_bit)").alias("_marks"))
    )
    bit = "(conv(hex(substring(_marks, cast((_s % 32768) div 8 as int) + 1, 1)), 16, 10) div cast(power(2, _s % 8) as int)) % 2 = 1"
    asked = df.select(F.struct(*(df[c] for c in df.columns)).alias("_row"), df[column].alias("_key")).withColumn("_s", slot)
    asked = asked.withColumn("_chunk", F.shiftright("_s", _CHUNK)).join(F.broadcast(marks), "_chunk", "left")
    return asked.select("_row", "_key", F.coalesce(F.col("_key").isNotNull() & F.expr(bit), F.lit(False)).alias("_seen"))


def perhaps_id(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows of ``df`` that the Bloom filter lets through: all whose id is among ``ids``, and few others."""
    return _marked(df, ids, column).where("_seen").select("_row.*")


def having_id(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows of ``df`` whose id is among ``ids``, with the other columns of ``ids``.

    A Bloom filter spares most of the other rows the shuffle; an ordinary join then
    settles it.  Where the filter fills up, all rows are shuffled.
    """
    return perhaps_id(df, ids, column).join(ids, column)


def lacking_id(df: DataFrame, ids: DataFrame, column: str, once: list[str]) -> DataFrame:
    """The rows of ``df`` whose id isn't among ``ids`` where ``gone`` is true; those of an id where it isn't stay, once for equal columns ``once``.

    Rows that the Bloom filter rules out stay where they are; the others are shuffled.
    """
    marked = _marked(df, ids, column)
    asked = marked.where("_seen").join(ids.where("gone").select(F.col(column).alias("_key")), "_key", "left_anti").select("_row.*").dropDuplicates(once)
    return marked.where("not _seen").select("_row.*").unionByName(asked)


def looked_up(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", times: str = "times") -> DataFrame:
    """``rows`` joined with ``table``: one row a key, which says in ``times`` how many of the rows hold it (left out of the result).

    The rows of a frequent key stay where they are: its row of the table is broadcast, as are those of at most
    ``HOT`` keys, each held by more than 1/HOT of all rows.  The others are joined by a shuffle that no key
    dominates.  With ``left`` rows without a key, or whose key isn't there, have nulls.  Both sides are read more than once.
    """
    total = table.agg(F.sum(times)).first()[0] or 0
    hot = F.col(times) * HOT > total
    few, rest = F.broadcast(table.where(hot).drop(times)), table.where(~hot).drop(times)
    out = rows.join(few, key).unionByName(rows.where(F.col(key).isNotNull()).join(few.select(key), key, "left_anti").join(rest, key, how))
    if how == "left":
        out = out.unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True)
    return out
