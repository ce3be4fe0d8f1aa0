"""Host-level quality rules: document rules, rates by host shrunk with an empirical beta prior, verdicts joined back.

All in Spark SQL functions.  A document *fails* when one of the rules fires.  A host's
rate of failures has the posterior beta(f + a, n - f + b), where the beta prior (a, b) has the mean
and variance of the hosts' raw rates (method of moments), so that hosts with few
documents are drawn to the mean.  A host is bad when its rate is credibly more than ``EXCESS`` times that of
all documents: when the posterior's mean less ``Z`` deviations (99 %, one-sided) is above it.  Documents that fail
the base rule go everywhere; on a bad host, those that fail any rule go too.  A document
that fails no rule stays, whatever its host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.text import kept, looked_up

EXCESS, Z = 1.5, 2.326
#: Hosts that are broadcast at most; more are joined by a shuffle.
BROADCAST_HOSTS = 50_000
#: Space, tab, line feed, vertical tab, form feed and return.
BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK), "")


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the struct ``_q``: n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words, base_failed, failed.

    A null text has no words.  Windows and lines are compared within a text, by a 64-bit hash of
    the window's words and by the lines themselves; long texts stay within their row.
    """
    d = df.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    d = d.withColumn("_w", _words(F.col("_text")))
    d = d.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    hashes = F.expr(f"transform(sequence(0, size(_w) - {WINDOW}), i -> xxhash64({', '.join(f'_w[i + {k}]' for k in range(WINDOW))}))")
    d = d.withColumn("_h", F.when(F.size("_w") >= WINDOW, hashes).otherwise(F.expr("cast(array() as array<bigint>)")))
    ordered = F.expr("sort_array(transform(_h, (h, i) -> struct(h, i)))")
    d = d.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), ordered).otherwise(F.expr("cast(array() as array<struct<h: bigint, i: int>>)")))
    twice = F.expr("array_sort(transform(filter(_s, (x, k) -> (k > 0 and _s[k - 1].h = x.h) or (k + 1 < size(_s) and _s[k + 1].h = x.h)), x -> x.i))")
    d = d.withColumn("_t", F.when(F.size("_s") > 0, twice).otherwise(F.expr("cast(array() as array<int>)")))
    repeat = F.expr(f"aggregate(transform(_t, (i, k) -> if(k + 1 < size(_t), least({WINDOW}, _t[k + 1] - i), {WINDOW})), 0L, (n, x) -> n + x)")
    # One generated row each: what follows, filters too, then uses the measures' values and never works them out again.
    d = d.select(
        *(c for c in d.columns if c not in ("_text", "_w", "_lines", "_h", "_s", "_t")),
        F.explode(
            F.array(
                F.struct(
                    F.size("_w").cast("long").alias("n_words"),
                    F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
                    F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
                    (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
                    F.size("_lines").cast("long").alias("n_lines"),
                    repeat.cast("long").alias("n_repeat_words"),
                )
            )
        ).alias("_q"),
    )
    q = F.col("_q")
    d = d.withColumn("_q", q.withField("base_failed", (q.n_words < 10) | (100 * q.n_repeat_words > 20 * q.n_words)))
    return d.withColumn("_q", q.withField("failed", F.coalesce(q.base_failed | _soft(), F.lit(True))))


def _soft() -> Column:
    """The rules that count for the host: many symbols, many repeated lines, odd word lengths."""
    return F.expr("10 * _q.n_symbols > _q.n_words or 10 * _q.n_dup_lines > 3 * _q.n_lines or _q.word_chars < 2 * _q.n_words or _q.word_chars > 15 * _q.n_words")


def _name(host: Column) -> Column:
    """A host's name that is never null."""
    return F.coalesce(F.concat(F.lit("="), host.cast("string")), F.lit(""))


def hosts(measures: DataFrame, excess: float = EXCESS, z: float = Z) -> DataFrame:
    """_host, n, rate (the posterior mean), bad, from rows with _host (never null) and _q; one row a host."""
    by = kept(measures.groupBy("_host").agg(F.count("*").alias("n"), F.sum(F.col("_q.failed").cast("long")).alias("f")).withColumn("r", F.col("f") / F.col("n")))
    prior = by.agg(F.avg("r").alias("m"), F.var_pop("r").alias("v"), (F.sum("f") / F.sum("n")).alias("pooled"))
    prior = prior.selectExpr("m", "pooled", "case when v > 0 and v < m * (1 - m) then m * (1 - m) / v - 1 else 1e6 end as s")
    rated = by.join(F.broadcast(prior)).selectExpr("_host", "n", "n + s as weight", "(f + m * s) / (n + s) as rate", "pooled")
    return rated.selectExpr("_host", "n", "rate", f"rate - {z} * sqrt(rate * (1 - rate) / (weight + 1)) > {excess} * pooled as bad")


def judged(measures: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows with the boolean ``kept``.  A host with a third of all rows is brought its verdict; its rows aren't shuffled."""
    verdicts = verdicts.select("_host", "bad", F.col("n").alias("times"))
    few = verdicts.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    joined = measures.join(F.broadcast(verdicts.drop("times")), "_host", "left") if few else looked_up(kept(measures), verdicts, "_host", "left")
    return joined.withColumn("kept", ~(F.col("_q.base_failed") | (F.coalesce("bad", F.lit(False)) & F.col("_q.failed")))).drop("bad")


def assess(docs: DataFrame, host: str = "source", text: str = "text", excess: float = EXCESS) -> DataFrame:
    """doc_id, the measures, base_failed and kept of every row of ``docs``; no text leaves the scan.

    Null and empty texts fail the base rule (they have no words).  A null host is a host.  Repeated rows are judged
    alike and count each.  No rows give none.  Other columns are ignored, so that their names can't clash.
    """
    m = kept(measured(docs.select("doc_id", _name(docs[host]).alias("_host"), F.col(text).alias("_raw")), "_raw").drop("_raw"))
    return judged(m, kept(hosts(m, excess))).select("doc_id", "_q.n_words", "_q.word_chars", "_q.n_symbols", "_q.n_dup_lines", "_q.n_repeat_words", "_q.base_failed", "kept")


def keep_good(docs: DataFrame, host: str = "source", text: str = "text", excess: float = EXCESS) -> DataFrame:
    """The rows of ``docs`` that ``assess`` keeps, with their columns, whatever these are called.

    The texts are measured twice, for the hosts and for the filter, and never shuffled.  Rows with a null or empty text
    go, repeated rows stay or go together, a row without a doc_id or host is judged like any other.
    """
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), _name(docs[host]).alias("_host"), docs[text].alias("_raw"))
    verdicts = kept(hosts(measured(rows.select("_host", "_raw"), "_raw").select("_host", "_q"), excess))
    return judged(measured(rows, "_raw").drop("_raw"), verdicts).where("kept").select("_row.*")
