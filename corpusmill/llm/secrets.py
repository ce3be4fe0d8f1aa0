"""Secret scans with corpus-wide ownership frequency, in Spark SQL functions.

Base spans are the matches of three patterns in every whole text; they always stay.
The method adds spans: token-shaped strings (``OWNED``: 32 or more characters with a digit and letters of both cases,
or 20 or more letters and digits with some of each, hexadecimal ones too) are candidates, hashed with SHA-256 and counted
by distinct repositories and owners over the corpus.  A string found in one repository, or in at most ``MAX_REPOSITORIES`` of at
most ``MAX_OWNERS`` owners, is owner-specific and looks live, so its spans are added; one that more
owners hold, or that is all over one owner's repositories, is a copied example.  The same verdict is reported for the base values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.text import kept, looked_up

#: Fixed values: (kind, pattern, group of the value, least length of the value).  A base
#: match that is too short is dropped after matching, so what it covers is not matched again.
ASSIGN = r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = [
    ("assign", ASSIGN, 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    # Maximal runs of 24 or more are the matches of [0-9a-f]+ that are that long.
    ("hex", r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),
]
_MIXED = r"(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{32,}"
_PLAIN = r"(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])[A-Za-z0-9]{20,}(?![A-Za-z0-9+/_-])"
OWNED = ("owned", rf"(?<![A-Za-z0-9+/_-])(?:{_MIXED}|{_PLAIN})", 0, 20)
MAX_OWNERS, MAX_REPOSITORIES = 1, 10
#: A text without any of these, lower-cased, has no match of the kind.
NEEDED = {"assign": ("passw", "secret", "token", "api"), "access": ("akia",)}

_SPAN = "array<struct<start: bigint, kind: int, `end`: bigint, value: string>>"


def _spans(text: str, number: int, kind: tuple[str, str, int, int]) -> Column:
    """The matches of one kind, in order: what lies between them gives their places.  A match's group is found in the match alone."""
    name, pattern, group, least = kind
    none = F.expr(f"cast(array() as {_SPAN})")
    parts = F.arrays_zip(F.split(text, pattern).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))

    def add(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["gap"])
        end = start + F.length(p["match"])
        value = F.regexp_extract(p["match"], pattern, group) if group else p["match"]
        one = F.array(F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end"), value.alias("value")))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.when(F.length(value) >= least, one).otherwise(none)).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("out"))
    found = F.aggregate(F.filter(parts, lambda p: p["match"].isNotNull()), start, add, lambda acc: acc["out"])
    some = F.col(text).rlike(pattern)
    if name in NEEDED:
        words = [F.contains("_low", F.lit(w)) for w in NEEDED[name]]
        some = reduce(lambda x, y: x | y, words)
    return F.when(some, found).otherwise(none)


def _written(spans: Column) -> Column:
    names = F.array(*(F.lit(k[0]) for k in [*KINDS, OWNED]))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def _is(kind: int):
    return lambda s: s["kind"] == kind


def scan(docs: DataFrame, repository: str = "source", owner: str | None = None, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_owner_specific, n_copied, found of every row of ``docs``.

    The owner is what precedes the first slash of the repository, unless a column is named.
    ``found`` lists kind, start, end (code points), the value's SHA-256 (never the value), the owners and repositories that hold it and
    whether it looks live.  A null text is empty; a null owner or repository is one of its own.  Rows that repeat doc_id and text have
    the same result.  No rows give none.  Other columns are ignored.
    """
    name = docs[owner] if owner else F.substring_index(docs[repository], "/", 1)
    rows = docs.select("doc_id", F.coalesce(docs["text"], F.lit("")).alias("_t"), F.coalesce(docs[repository], F.lit("\0")).alias("repo"), F.coalesce(name, F.lit("\0")).alias("owner"))
    rows = rows.withColumn("_low", F.lower("_t"))
    base = F.array_sort(F.concat(*(_spans("_t", k, kind) for k, kind in enumerate(KINDS))))
    rows = rows.select("doc_id", "repo", "owner", F.xxhash64("_t").alias("key"), base.alias("base"), _spans("_t", len(KINDS), OWNED).alias("more"))
    hashed = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("hash")))
    rows = kept(rows.withColumn("base", hashed(F.col("base"))).withColumn("more", hashed(F.col("more"))))

    some = F.expr("size(base) + size(more) > 0")
    every = rows.where(some).select("doc_id", "key", "repo", "owner", F.explode(F.concat("base", "more")).alias("s")).select("doc_id", "key", "repo", "owner", "s.*")
    where = every.groupBy("hash", "repo", "owner").agg(F.count("*").alias("c"))  # partly aggregated first: a copied string is no hot key
    copies = where.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("c").alias("c")).groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"), F.sum("c").alias("times"))
    live = (F.col("owners") <= max_owners) & (F.col("repos") <= max_repositories)
    copies = kept(copies.withColumn("live", live))
    once = kept(every.select("doc_id", "key", "start", "kind", "end", "hash").distinct())
    by_doc = looked_up(once, copies, "hash").groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "hash", "owners", "repos", "live"))).alias("found"))
    by_doc = by_doc.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), "found")
    # Rows without any span stay where they are.
    found = rows.where(some).join(by_doc, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k"))).drop("_d", "_k")
    joined = found.unionByName(rows.where(~some).withColumn("found", F.expr("cast(array() as array<struct<start: bigint, kind: int, `end`: bigint, hash: string, owners: bigint, repos: bigint, live: boolean>>)")))
    count = lambda test: F.size(F.filter("found", test)).cast("long")
    names = F.array(*(F.lit(k[0]) for k in [*KINDS, OWNED]))
    return joined.select(
        "doc_id", *(F.size(F.filter("found", _is(k))).cast("long").alias(f"n_{kind[0]}") for k, kind in enumerate(KINDS)),
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(F.filter("found", lambda s: (s["kind"] < len(KINDS)) | s["live"])).alias("spans"),
        count(lambda s: s["live"]).alias("n_owner_specific"), count(lambda s: ~s["live"]).alias("n_copied"),
        F.transform("found", lambda s: F.struct(F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["hash"].alias("hash"), s["owners"].alias("owners"), s["repos"].alias("repositories"), s["live"].alias("live"))).alias("found"),
    )
