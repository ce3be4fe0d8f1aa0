"""Secrets, toxicity, shards, URLs, mixture, quality and chat on small tables."""

import hashlib
import itertools
import math
import random
import re

import brute
import pytest
from conftest import DOCS, prose, table
from pyspark.sql import functions as F

from corpusmill.llm import chat, mixing, quality, secrets, sharding, toxicity, url_filters


def base_spans(t):
    kinds = [("assign", re.compile(secrets.ASSIGN), 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]
    found = sorted((m.start(), k, m.end(), name) for k, (name, p, g, n) in enumerate(kinds) for m in p.finditer(t or "") if len(m.group(g)) >= n)
    return ",".join(f"{name}:{a}:{b}" for a, _, b, name in found), [sum(f[1] == k for f in found) for k in range(3)]


HEX = "0123456789abcdef0123456789abcdef"


def test_secrets(spark):
    texts = [
        None, "", "no secrets", "password=abcdef", "PassWord : 'abcde'", "token: token=abcdefgh", 'api_key="x/y+z.==" apikey=123456', "é🙂 secret=" + HEX, "AKIA" + "A" * 15, "AKIA" + "Z9" * 8 + "AKIA", HEX + "g" + HEX[:23],
        HEX + HEX, "paſſword=abcdefg toKen=abcdefg", "x" * 50_000 + " passwd = longenough " + HEX, "secret=" * 30, "token=" + "a1B" * 20 + "\ntoken=" + "a1B" * 20,
    ]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "password=abcdef"), (3, "password=abcdef")]
    got = secrets.scan(table(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "password=abcdef" if r.doc_id is None else texts[r.doc_id]
        spans, counts = base_spans(text)
        assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest() and [r.n_assign, r.n_access, r.n_hex] == counts
        assert set(spans.split(",")) - {""} <= set(r.spans.split(","))


def test_copied_strings_are_examples(spark):
    own, copied = "Ab1" + "x" * 40, "Zz9" + "y" * 40
    rows = [(1, f"k {own} {copied}", "o1/r1"), (2, copied, "o2/r1"), (3, own, "o1/r2"), (4, own, None)]
    got = {r.doc_id: (r.spans, r.n_owner_specific, r.n_copied) for r in secrets.scan(table(spark, rows[:3])).collect()}
    assert got[1] == ("owned:2:45", 1, 1) and got[2] == ("", 0, 1) and got[3] == ("owned:0:43", 1, 0)
    assert {r.doc_id: r.n_copied for r in secrets.scan(table(spark, rows)).collect()} == {1: 2, 2: 1, 3: 1, 4: 1}
    assert secrets.scan(spark.createDataFrame([], DOCS)).count() == 0


def test_repositories_count_too(spark):
    """A string in many repositories of one owner is a copied example; in a few it is the owner's; short ones of letters and digits count."""
    wide, own, short = "Wd1" + "x" * 40, "Ow2" + "y" * 40, "f3ef4d6b2755a36d7d9c25bd"
    rows = [(k, f"{wide} {own if k < 5 else ''}", f"o1/r{k}") for k in range(12)] + [(50, short, "o2/r0"), (51, "abcdefghijklmnopqrstuvwxyz 12345678901234567890123 a-b-c-d-e-f-g-1-2-3-4-5", "o3/r0")]
    got = {r.doc_id: r for r in secrets.scan(table(spark, rows)).collect()}
    assert got[0].spans == "owned:44:87" and got[7].spans == "" and got[50].spans == "hex:0:24,owned:0:24" and got[51].spans == ""
    assert {(f.owners, f.repositories, f.live) for f in got[0].found} == {(1, 12, False), (1, 5, True)}


def test_toxicity(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for d in range(400):
        w = prose(rng, 40).split()
        bad = d % 4 == 0
        if bad:
            w[rng.randrange(40)] = "nastyword"
            w[rng.randrange(40)] = "vileterm"
        rows.append((d, " ".join(w)))
        labels.append((d, int(bad)))
    rows += [(None, None), (1000, ""), (1001, "x" * 200_000), (0, rows[0][1])]
    lab = spark.createDataFrame(labels + [(None, 1), (5, None), (2000, 1)], "doc_id long, label int")
    got = toxicity.score(table(spark, rows), lab).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert len(held) > 50 and all(r.predicted == (r.doc_id % 4 == 0) for r in held)
    flipped = lab.withColumn("label", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("label")).otherwise(F.col("label")))
    again = toxicity.score(table(spark, rows), flipped).collect()
    assert sorted((r.doc_id or -1, round(r.score, 9)) for r in got) == sorted((r.doc_id or -1, round(r.score, 9)) for r in again)
    assert toxicity.score(table(spark, rows[:3]), lab.limit(0)).select("predicted").distinct().collect() == [(0,)]
    assert toxicity.score(spark.createDataFrame([], DOCS), lab).count() == 0


def test_toxicity_as_brute_force(spark):
    """The same scores as with dense arrays; of repeated ids the first text counts, an id of both labels for both; held-out labels are unread."""
    rng = random.Random(16)
    rows = [(d, prose(rng, 12) + (" nastyword vileterm" if d % 3 == 0 else "")) for d in range(120)]
    labels = [(d, int(d % 3 == 0)) for d in range(120)] + [(4, 1), (4, 1)]
    again = [(7, "zzz zzz"), (7, "zzzz nastyword")]
    df, lab = table(spark, rows + again), spark.createDataFrame(labels, "doc_id long, label int")
    got = {(r.doc_id, r.text): r.score for r in toxicity.score(df, lab).join(df.select("doc_id", "text").distinct(), "doc_id").collect() if r.doc_id != 7}
    held = {r.d for r in spark.range(120).select(F.col("id").alias("d"), toxicity.held_out(F.col("id")).alias("h")).where("h").collect()}
    learnt = sorted({(d, y) for d, y in labels if d not in held})
    texts = {d: min([t for i, t in rows + again if i == d]) for d, _ in rows}
    want = brute.classifier([texts[d] for d, _ in learnt], [y for _, y in learnt], [sum(y == k for _, y in learnt) for k in (0, 1)])
    assert all(got[d, texts[d]] == pytest.approx(p, abs=1e-6) for (d, _), p in zip(learnt, want) if d != 7)


@pytest.mark.parametrize("n", [0, 1, 17, 500])
def test_shards(spark, n):
    rows = [(k if k % 50 else None, "é" * (k % 7) if k % 3 else None) for k in range(n)]
    rows += rows[:2]
    got = sharding.shard(table(spark, rows), 16).collect()
    assert len(got) == len(rows)
    counts = [sum(r.shard == s for r in got) for s in range(16)]
    assert max(counts) - min(counts) <= 1
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    assert all(r["size"] >= 1 for r in got)
    out = sharding.sharded(table(spark, rows), 4)
    assert set(out.columns) == set(DOCS.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")) | {"slot"} and out.count() == len(rows)


def test_shards_key_by_key(spark):
    """As a walk around the ring, key by key; one key is held by a third of all rows."""
    rng = random.Random(2)
    rows = [(k, prose(rng, k % 5)) for k in range(400)] + [(None, None)] * 3 + [(7, "the same text")] * 200
    got = sorted(((r.doc_id is None, r.doc_id), r.text or "", r.shard, r.slot) for r in sharding.sharded(table(spark, rows), 5).collect())
    assert got == sorted(((d is None, d), t or "", s, k) for d, t, s, k in brute.ring(spark, rows, 5))


def test_a_key_of_many_rows_is_ranked_in_parts(spark, monkeypatch):
    rows = [(k, prose(random.Random(k), 5)) for k in range(100)] + [(None, None)] * 90
    whole = sorted((r.shard, r.slot, r.text or "") for r in sharding.sharded(table(spark, rows), 5).collect())
    monkeypatch.setattr(sharding, "PART", 20)
    got = sharding.sharded(table(spark, rows).repartition(3), 5).collect()
    assert sorted((r.shard, r.slot, r.text or "") for r in got) == whole and len({(r.shard, r.slot) for r in got}) == len(rows)


def test_few_keys_move_when_a_shard_is_added(spark):
    """Of 20,000 keys 1 in 17 must move to a new shard; few others do."""
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    old, new = ({r.doc_id: r.shard for r in sharding.shard(df, n).collect()} for n in (16, 17))
    moved = [d for d in old if old[d] != new[d]]
    assert 20_000 // 17 <= len(moved) < 0.15 * 20_000 and sum(new[d] != 16 for d in moved) < 0.08 * 20_000


def test_urls(spark):
    urls = [
        None, "", "no scheme", "http://A.Example.COM/en/7x?q=1", "https://example.net/de/8", "http://x.net/de/1", "ftp://foo.org/es/", "http://foo.org/es", "http://notexample.com/en/7", "http://evil.com/en/x#://b.net/de/", "http://com/en/", "http://host?x=/en/", "a://b://c/d",
        "http://x.com/EN/", "http://user@y.com:80/en/a",
    ]
    pages = spark.createDataFrame([(k, u, "h", "r") for k, u in enumerate(urls)] + [(3, urls[3], "h", "r"), (None, urls[5], "h", "r")], "page_id long, url string, host string, rule string")
    labels = spark.createDataFrame([(1, "block"), (None, "block"), (2, None)], "page_id long, label string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(pages, labels).collect() if r.page_id is not None}

    def expect(u):
        if not u or "://" not in u:
            return ("", "", None)
        rest = u.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = [r for _, r in url_filters.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        return (host, path, max(fits, key=len, default=None))

    for k, u in enumerate(urls):
        assert got[k][:3] == expect(u), u
        if got[k][2]:
            assert got[k][3] == dict((r, v) for v, r in url_filters.RULES)[got[k][2]]
    assert url_filters.judge(pages, labels).count() == len(urls) + 2
    assert url_filters.judge(pages.limit(0), labels).count() == 0 and url_filters.judge(pages, labels.limit(0)).where("by = 'mined'").count() == 0


def test_urls_are_judged_by_mined_rules(spark):
    rows = [(k, f"http://{'spam' if k % 3 == 0 else 'fine'}.site{k % 5}.test/{'buy' if k % 3 == 0 else 'read'}/{k}") for k in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(k, "block" if k % 3 == 0 else "allow") for k in range(0, 300, 2)], "page_id long, label string")
    got = url_filters.judge(pages, labels).collect()
    assert all((r.verdict == "block") == (r.page_id % 3 == 0) for r in got) and any(r.by == "mined" for r in got)


def test_a_common_label_has_rules(spark):
    """Of a label of 4 in 5 pages no rule's lift can exceed 1.25; its rules count all the same, and the more confident rule wins."""
    rows = [(k, f"http://{'spam' if k % 5 == 0 else 'fine'}.site{k % 7}.test/{'mixed' if k % 5 < 2 else 'read'}/{k}") for k in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(k, "block" if k % 5 == 0 else "allow") for k in range(0, 300, 2)], "page_id long, label string")
    got = url_filters.judge(pages, labels, default="block").collect()
    assert all((r.verdict, r.by) == ("allow" if r.page_id % 5 else "block", "mined") for r in got)


def test_deep_hosts_and_paths_are_mined(spark):
    """URLs that differ only behind the fourth host label or path segment; forty segments in common don't multiply the sets."""
    deep, long = "/a/b/c/d/e/", "/" + "/".join(f"s{k}" for k in range(40)) + "/"
    rows = [(k, [f"http://w.test{deep}{'bad' if k % 2 else 'good'}/x{k}", f"http://{'bad' if k % 2 else 'good'}.e.d.c.b.test/x{k}", f"http://v.test{long}{'bad' if k % 2 else 'good'}/x{k}"][k % 3]) for k in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(k, "block" if k % 2 else "allow") for k in range(200)], "page_id long, label string")
    got = url_filters.judge(pages, labels).collect()
    assert all((r.verdict, r.by, r.confidence) == ("block" if r.page_id % 2 else "allow", "mined", 1) for r in got)


def test_tokens_alike_give_each_a_rule(spark):
    """Tokens of the same labelled rows are mined as one, but each is looked up by itself."""
    rows = spark.createDataFrame([(["p1=a", "p2=b"], "block")] * 5 + [(["p1=c"], "allow")] * 5, "tokens array<string>, label string")
    assert sorted((r.tokens, r.says, r.confidence, r.support) for r in url_filters.mine(rows).collect()) == [(["p1=a"], "block", 1, 0.5), (["p1=c"], "allow", 1, 0.5), (["p2=b"], "block", 1, 0.5)]


def test_mined_verdicts_as_brute_force(spark):
    """Every set of tokens of the labelled rows as an antecedent; labels follow the tokens but for some noise, and so do the verdicts on the other rows."""
    rng = random.Random(12)
    rows, label = [], {}
    for k in range(240):
        host, seg = rng.choice(["spam", "fine", "odd"]), rng.choice(["buy", "read"])
        rows.append((k, f"http://{host}.s{k % 3}.test/{seg}/{k}"))
        bad = host == "spam" or (host == "odd" and seg == "buy")
        label[k] = "block" if bad != (rng.random() < 0.1) else "allow"
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(k, v) for k, v in label.items() if k % 2 == 0], "page_id long, label string")
    got = {r.page_id: (r.verdict, r.by) for r in url_filters.judge(pages, labels).collect()}
    sets = {r.page_id: frozenset(r.tokens) for r in url_filters.parsed(pages).withColumn("tokens", url_filters.tokens()).collect()}
    train = [k for k in label if k % 2 == 0]
    share = {v: sum(label[k] == v for k in train) / len(train) for v in ("block", "allow")}
    rules = []
    for some in {frozenset(c) for k in train for n in range(1, len(sets[k]) + 1) for c in itertools.combinations(sorted(sets[k]), n)}:
        held = [label[k] for k in train if some <= sets[k]]
        for v, s in share.items():
            hits, n, z = held.count(v), len(held), url_filters.Z
            if hits >= max(url_filters.MIN_COUNT, url_filters.MIN_SUPPORT * len(train)) and hits >= url_filters.MIN_CONFIDENCE * n:
                p = hits / n
                bound = (p + z * z / 2 / n - z * math.sqrt(p * (1 - p) / n + z * z / 4 / n / n)) / (1 + z * z / n)
                if bound > s:
                    rules.append((bound, hits, some, v))
    for k in label:
        fired = sorted(((b, h, v) for b, h, some, v in rules if some <= sets[k]), reverse=True)
        best = {v for b, h, v in fired if abs(b - fired[0][0]) < 1e-12 and h == fired[0][1]}
        assert got[k][0] in best and got[k][1] == "mined" if fired else got[k] == ("allow", "default")
    held_out = [k for k in label if k % 2 and got[k] == ("block", "mined")]
    assert sum(label[k] == "block" for k in held_out) / len(held_out) > share["block"] + 0.2


def test_prefix_sums_over_ranges(spark):
    rng = random.Random(4)
    rows = [(None if k == 9 else f"h{k}", rng.randint(0, 50)) for k in range(500)]
    df = spark.createDataFrame(rows, "h string, n long").repartition(7)
    got = {r.h: (r.at, r.sum) for r in mixing.before(df, ["h"], {"at": F.lit(1).cast("long"), "sum": F.col("n")}).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    assert got == {h: (k, sum(n for _, n in order[:k])) for k, (h, _) in enumerate(order)}


def test_targets_of_many_sources(spark):
    rng = random.Random(5)
    size = {f"s{k}": rng.choice([0, 1, 5, 100, 10_000]) for k in range(200)} | {None: 40}
    got = {r._source: r.target for r in mixing.targets(spark.createDataFrame(list(size.items()), "_source string, source_size long"), 1.5, 2).collect()}
    assert got == pytest.approx(brute.goals(size))


def test_mixture(spark):
    rng = random.Random(9)
    rows = [(k if k % 40 else None, prose(rng, rng.randint(0, 30)) if k % 17 else None, ["a", "b", "B", None, "tiny"][k % 5] if k % 5 != 4 or k == 4 else "a") for k in range(400)]
    rows += rows[:3]
    df = table(spark, rows)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(7)).collect()))
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    order = sorted([s for s in size if s is not None], key=lambda s: s.encode()) + [None]
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}
    target, capped = {}, set()
    while True:
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in capped)
        total = sum(weight[s] for s in order if s not in capped)
        target = {s: 2 * size[s] if s in capped else left * weight[s] / total for s in order}
        over = {s for s in order if s not in capped and target[s] > 2 * size[s]}
        if not over:
            break
        capped |= over
    for s in order:
        mine = [r for r in got if r.source_size == size[s] and abs(r.target - target[s]) < 1e-6]
        assert sum(r.taken for r in mine) == int(target[s] + 1e-9) and all(r.taken <= 2 * r["size"] for r in mine)
    out = mixing.mixed(df)
    assert out.columns == df.columns
    assert sum(len(r.text.split()) for r in out.collect()) == sum(r.taken for r in got)
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0 and mixing.mixed(spark.createDataFrame([], DOCS)).count() == 0
    assert [r.taken for r in mixing.mix(table(spark, [(1, None), (2, "")])).collect()] == [0, 0]


def measures(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    twice = {x for x in wins if wins.count(x) > 1} if len(w) < 2000 else set()
    cover = {j for i, x in enumerate(wins) if x in twice for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)


def test_quality(spark, odd):
    rows = [*odd, (60, "a b c d e a b c d e f a b c d e"), (61, "x\nx\n\n \nx y\r\nx"), (62, "### $$ a|b <x> &%* é🙂"), (63, "w " * 300), (64, "a b c d e f g h i j a b c d e " + " ".join(map(str, range(100))))]
    got = quality.assess(table(spark, rows)).collect()
    want = sorted(str((d, *m, m[0] < 10 or 100 * m[4] > 20 * m[0])) for d, t in rows for m in [measures(t)])
    assert sorted(str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in got) == want
    assert all(not (r.base_failed and r.kept) for r in got)
    assert quality.assess(spark.createDataFrame([], DOCS)).count() == 0


def test_hosts(spark):
    rng = random.Random(1)
    good = [(k, prose(rng, 60), f"h{k % 9}") for k in range(180)]
    junk = [(1000 + k, " ".join(x + "##" for x in prose(rng, 30).split()), "bad") for k in range(40)] + [(2000, prose(rng, 60), "bad"), (2001, " ".join(x + "##" for x in prose(rng, 30).split()), "h1"), (2002, None, None), (2003, prose(rng, 60), None)]
    df = table(spark, good + junk)
    kept = {r.doc_id for r in quality.assess(df).where("kept").collect()}
    assert {d for d, _, _ in good} <= kept and not kept & set(range(1000, 1040)) and {2000, 2001, 2003} <= kept and 2002 not in kept
    out = quality.keep_good(df)
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} == kept
    # The host decides: the same texts spread over the good hosts pass the base rule and stay.
    spread = df.withColumn("source", F.when(F.col("source") == "bad", F.concat(F.lit("h"), (F.col("doc_id") % 9).cast("string"))).otherwise(F.col("source")))
    assert set(range(1000, 1040)) <= {r.doc_id for r in quality.assess(spread).where("kept").collect()}
    assert kept == {r[0] for r in brute.good(good + junk, measures)}


def test_many_hosts(spark, monkeypatch):
    """More hosts than are broadcast: the same verdicts."""
    rng = random.Random(3)
    rows = [(k, " ".join(x + "##" for x in prose(rng, 30).split()) if k % 10 and k % 7 < 2 else prose(rng, 40), f"h{k % 7}") for k in range(210)] + [(300, None, None)]
    df = table(spark, rows)
    few = sorted(r.doc_id for r in quality.keep_good(df).collect())
    monkeypatch.setattr(quality, "BROADCAST_HOSTS", 2)
    assert sorted(r.doc_id for r in quality.keep_good(df).collect()) == few and len(few) < 200


def events(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, seq long, kind string, turn long, role string, text string")


def test_log_is_folded(spark):
    log = [
        (1, 0, "message", 0, "user", "hi"), (1, 1, "delta", 1, "assistant", "he"), (1, 2, "delta", 1, "assistant", "llo"), (1, 3, "message", 2, "user", "more"), (1, 4, "edit", 0, "user", "hi there"), (1, 5, "regenerate", 1, "assistant", ""),
        (1, 6, "delta", 1, "assistant", "good "), (1, 7, "delta", 1, "assistant", "day"), (1, 8, "message", 2, "user", "thanks"), (2, 1, "regenerate", 1, "assistant", "b"), (2, 0, "message", 0, "user", None), (2, 0, "message", 2, "user", "gone"), (None, 0, None, 0, None, "x"),
    ]
    got = {r.conv_id: [(m.role, m.text) for m in r.messages] for r in chat.folded(events(spark, log).repartition(5)).collect()}
    assert got[2] == [("user", ""), ("assistant", "b")] and got[None] == [("", "x")]
    assert got[1] == [("user", "hi there"), ("assistant", "good day"), ("user", "thanks")]


def test_logs_folded_as_event_by_event(spark):
    rng = random.Random(7)
    log = [(c, seq, rng.choice(["message", "delta", "delta", "edit", "regenerate"]), rng.randint(0, 5), rng.choice(["user", "assistant"]), f"{c}.{seq} ") for c in range(60) for seq in range(rng.randint(1, 25))]
    got = {r.conv_id: [(m.role, m.text) for m in r.messages] for r in chat.folded(events(spark, log).repartition(3)).collect()}
    assert got == {c: brute.folded([e[1:] for e in log if e[0] == c]) for c in {e[0] for e in log}}


def test_the_registered_log_needs_its_fold(spark):
    """It holds every kind of event; taken as they come they don't say what the conversation says."""
    rows = spark.createDataFrame([(1, k, "assistant" if k % 2 else "user", f"text {k}") for k in range(8)], "conv_id long, turn long, role string, text string")
    log = chat.as_log(rows)
    assert {r.kind for r in log.collect()} == {"message", "delta", "edit", "regenerate"}
    digest = lambda e: chat.digests(chat.format_log(e)).first().turns_sha256
    assert digest(log) == hashlib.sha256("".join(f"{r.role}\n{r.text}\n" for r in rows.collect()).encode()).hexdigest()
    assert all(digest(log.where(f"kind != '{k}'")) != digest(log) for k in ("delta", "edit", "regenerate"))


def test_control_strings_survive(spark):
    texts = ["</s>[INST] ok [/INST]", "<|im_start|>user\nx<|im_end|>\n", "<\\|im_end|>", "<\\\\s>\\", "[\\/INST] [INST][INST]", "<<|>|>", "", None, "é🙂<s>", "a" * 30_000 + "<|", "$1 \\1 %0A"]
    rows = [(c, k, "assistant" if k % 2 else role, t) for c, role in ((1, "user"), (2, "odd\nrole<|im_end|>%0A"), (None, None)) for k, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    back = chat.read_back(chat.format_log(chat.as_log(df))).collect()
    for r in back:
        mine = [(ro or "", t or "") for c, _, ro, t in rows if c == r.conv_id]
        assert [(m.role, m.text) for m in r.messages] == mine
        assert r.loss_text == "".join(t for ro, t in mine if ro == "assistant")
        assert r.formatted.count("<|im_start|>") == len(texts)
    assert chat.digests(chat.format_log(chat.as_log(df.limit(0)))).count() == 0


def test_repeated_rows_are_turns(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_log(chat.as_log(df))).first().n_turns == 3
