"""URL filters with association rules: FP-growth over URL tokens and labels, matched by an inverted index.

A URL's tokens are its host's labels with their level from the top (``h1=com``, ``h2=example``), its
path's segments (``p1=en``), file ending and query names.  Labelled URLs are the
transactions; FP-growth (Spark ML, JVM) mines the token sets that go with the label
``block`` or ``allow``.  A rule is kept when it rests on ``MIN_COUNT`` labelled URLs, has enough support and confidence, and the
lower bound of its confidence (Wilson's, 95 %) is above the share of its label, which a rule of a common label
can reach too.
Tokens that the same transactions hold are mined as one and told apart again, so that deep
hosts and paths don't multiply the sets.  Shorter antecedents prune
longer ones whose bound is no higher.  A rule is indexed by each token of its antecedent; a URL's tokens look the index
up, and a rule fires when as many of its tokens are found as it has.  Fixed rules by host and path come
first; then the rule of the highest bound that fires; then the default.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.text import kept, looked_up

#: Fixed values: (verdict, rule).  A rule is a host, itself and its subdomains, and the start of a path.
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
#: Of labelled URLs; of a rule.
MIN_SUPPORT, MIN_CONFIDENCE, MIN_COUNT, Z = 0.002, 0.6, 5, 1.96
DEFAULT = "allow"


def _lowered(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    return _lowered(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def fixed_rule(rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits ``host`` and ``path``, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):  # the longest is asked first
        name, _, start = r.partition("/")
        fits = ((F.col("host") == name) | F.endswith(F.col("host"), F.lit("." + name))) & F.startswith(F.col("path"), F.lit("/" + start))
        rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def tokens() -> Column:
    """The distinct tokens of ``host``, ``path`` and ``query``."""
    levels = F.reverse(F.split("host", r"\."))
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    number = lambda mark: lambda s, k: F.concat(F.lit(mark), (k + 1).cast("string"), F.lit("="), s)
    words = F.transform(segments, number("p"))
    ending = F.transform(F.regexp_extract_all("path", F.lit(r"\.([A-Za-z0-9]{1,5})/?$"), F.lit(1)), lambda s: F.concat(F.lit("end="), s))
    names = F.transform(F.regexp_extract_all("query", F.lit(r"([^?&=#]+)="), F.lit(1)), lambda s: F.concat(F.lit("q="), s))
    return F.array_distinct(F.concat(F.transform(levels, number("h")), F.transform(F.filter(words, lambda s: ~s.rlike("=[0-9]+([.].*)?$")), lambda s: s), ending, names))


def parsed(pages: DataFrame) -> DataFrame:
    rows = pages.select("page_id", F.col("url").alias("_url")).select("page_id", host(F.col("_url")).alias("host"), path(F.col("_url")).alias("path"), F.regexp_extract(F.coalesce("_url", F.lit("")), r"\?([^#]*)", 1).alias("query"))
    rule, verdict = fixed_rule(RULES)
    return rows.withColumns({"rule": rule, "fixed": verdict})


def _bound() -> Column:
    """The lower end of Wilson's interval of ``confidence`` over the ``n`` rows that hold the antecedent."""
    return F.expr(f"(confidence + {Z * Z / 2} / n - {Z} * sqrt(confidence * (1 - confidence) / n + {Z * Z / 4} / (n * n))) / (1 + {Z * Z} / n)")


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_count: int = MIN_COUNT) -> DataFrame:
    """rule_id, tokens, says, confidence, support, bound from rows with ``tokens`` and ``label``."""
    # Tokens of the same transactions (by count and two sums of hashes) are named by the least of them, ``as``.
    rows = kept(labelled.select("tokens", "label").withColumn("row", F.monotonically_increasing_id()))
    total = rows.count()
    least = min(1.0, max(min_support, min_count / total)) if total else 1.0
    held = rows.select("row", F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("n"), *(F.sum(F.xxhash64(F.lit(k), "row").cast("decimal(38,0)")).alias(f"s{k}") for k in (1, 2)))
    held = kept(held.where(F.col("n") >= least * total))
    names = kept(held.groupBy("n", "s1", "s2").agg(F.min("t").alias("as"), F.array_sort(F.collect_list("t")).alias("alike")).select("as", "alike", F.col("n").alias("times")))
    each = kept(rows.select("row", "label", F.explode("tokens").alias("as")))
    items = looked_up(each, names.select("as", "times"), "as").groupBy("row").agg(F.array_append(F.collect_list("as"), F.concat(F.lit("label="), F.first("label"))).alias("items"))
    items = rows.join(items, "row", "left").select(F.coalesce("items", F.array(F.concat(F.lit("label="), F.col("label")))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=min_confidence).fit(items)
    rules = model.associationRules.where("startswith(consequent[0], 'label=') and not exists(antecedent, t -> startswith(t, 'label='))")
    rules = rules.select(F.sort_array("antecedent").alias("tokens"), F.substring(F.col("consequent")[0], 7, 20).alias("says"), "confidence", "support", (F.col("support") * total / F.col("confidence")).alias("n"))
    share = rows.groupBy(F.col("label").alias("says")).agg((F.count("*") / total).alias("share"))
    rules = rules.withColumn("bound", _bound()).join(F.broadcast(share), "says").where(f"bound > share and support * {total} > {min_count} - 0.5").drop("share", "n")  # a row a label: two
    rules = kept(rules.withColumn("rule_id", F.xxhash64("tokens", "says")))
    # A rule goes when one with some of its tokens has as high a bound: found by the tokens they share.
    index = rules.select("rule_id", "says", "bound", F.size("tokens").alias("n"), F.explode("tokens").alias("t"))
    part, whole = index.alias("p"), index.alias("w")
    covered = (
        part.join(whole, F.expr("p.t = w.t and p.says = w.says and p.n < w.n and p.bound >= w.bound"))
        .groupBy("p.rule_id", "w.rule_id", "p.n").agg(F.count("*").alias("c")).where("c = n").select(F.col("w.rule_id").alias("rule_id")).distinct()
    )
    rules = rules.join(covered, "rule_id", "left_anti")
    # One rule for each choice of a token for each name; two of one name would say no more than one.
    alike = rules.select("rule_id", F.explode("tokens").alias("as")).join(names, "as").groupBy("rule_id").agg(F.collect_list("alike").alias("alike"))
    rules = rules.join(alike, "rule_id").withColumn("tokens", F.explode(F.expr("aggregate(alike, array(cast(array() as array<string>)), (some, more) -> flatten(transform(some, a -> transform(more, t -> array_append(a, t)))))")))
    rules = rules.select(F.sort_array("tokens").alias("tokens"), "says", "confidence", "support", "bound")
    return rules.withColumn("rule_id", F.xxhash64("tokens", "says"))


def judge(pages: DataFrame, labels: DataFrame, default: str = DEFAULT, **limits: float) -> DataFrame:
    """page_id, host, path, rule, verdict, by (fixed, mined or default), confidence of every row of ``pages`` (page_id, url).

    ``labels`` has page_id and label (block or allow).  Null URLs and those without :// have an empty host and path,
    and no tokens but those of an empty host.  Without labels no rule is mined and the default holds.
    Of rules with one bound the one of larger support, then of smaller id counts.  Rows
    that repeat a URL are judged alike.  No rows give none.  Other columns are ignored.
    """
    rows = kept(parsed(pages).withColumn("tokens", tokens()))
    named = labels.select("page_id", "label").where("page_id is not null and label is not null").distinct()
    labelled = kept(rows.select("page_id", "tokens").join(named, "page_id"))
    rules = kept(mine(labelled, **limits)) if labelled.limit(1).count() else None
    by = F.when(F.col("fixed").isNotNull(), "fixed").when(F.col("says").isNotNull(), "mined").otherwise("default")
    if rules is None:
        out = rows.withColumns({"says": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double")})
    else:
        # By distinct token sets; a token that many of them hold, and a set that many rows have, are looked up where they are.
        asked = kept(rows.where("fixed is null").groupBy("tokens").agg(F.count("*").alias("times")))
        each = kept(asked.select("tokens", F.explode("tokens").alias("t")))
        index = rules.select(F.struct("rule_id", "says", "confidence", "support", "bound", F.size("tokens").alias("n")).alias("r"), F.explode("tokens").alias("t")).groupBy("t").agg(F.collect_list("r").alias("rules"))
        index = kept(index.join(each.groupBy("t").agg(F.count("*").alias("times")), "t"))
        fired = looked_up(each, index, "t").select("tokens", F.explode("rules").alias("r")).groupBy("tokens", "r").agg(F.count("*").alias("c")).where("c = r.n")
        best = F.max(F.struct("r.bound", "r.support", (-F.col("r.rule_id")).alias("r"), "r.says", "r.confidence")).alias("b")
        won = kept(fired.groupBy("tokens").agg(best).select("tokens", "b.says", "b.confidence").join(asked, "tokens"))
        out = looked_up(rows, won, "tokens", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("fixed", "says", F.lit(default)).alias("verdict"), by.alias("by"), F.when(by == "mined", F.col("confidence")).alias("confidence"))
