"""The n-gram join, substring dedup and decontamination against brute force."""

import hashlib
import random

import numpy as np
import pytest
from conftest import DOCS, prose, table
from pyspark.sql import functions as F

from corpusmill.llm import decontaminate, graph, ngram_join, substring
from corpusmill.llm.text import having_id, lacking_id, prepare


def shingles(t, n):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def components(rows, n, num, den):
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and den * len(a & b) >= num * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d is None, d, len(sets[i]), None if d is None else least[find(i)]) for i, (d, _) in enumerate(rows) if d is not None)


def got_components(df, n, num, den):
    return sorted((r.doc_id is None, r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df, n, num, den).collect() if r.doc_id is not None)


@pytest.mark.parametrize("n,num,den", [(3, 90, 100), (5, 8, 10), (1, 7, 10)])
def test_components_of_odd_rows(spark, odd, n, num, den):
    assert got_components(table(spark, odd), n, num, den) == components(odd, n, num, den)


def test_components_of_a_dense_group(spark):
    """Near copies of which some pairs link and some don't: chains, several components, no pair lost."""
    rng = random.Random(5)
    base = prose(rng, 150).split()
    rows = []
    for d in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"new{rng.randint(0, 10**6)}"
        rows.append((d, " ".join(w)))
    for n, num, den in ((3, 90, 100), (5, 8, 10)):
        assert got_components(table(spark, rows), n, num, den) == components(rows, n, num, den)


def degrees(rows, n, num, den):
    sets = {shingles(t, n) for _, t in rows} - {frozenset()}
    of = {a: sum(a != b and den * len(a & b) >= num * len(a | b) for b in sets) for a in sets}
    return sorted((d, of.get(shingles(t, n), 0)) for d, t in rows if d is not None)


@pytest.mark.parametrize("size", [512, 7])
def test_every_link_is_counted(spark, odd, monkeypatch, size):
    """A group of near copies in one block and in many, with all pairs of which some link and some don't."""
    monkeypatch.setattr(ngram_join, "ROWS", size)
    monkeypatch.setattr(ngram_join, "SLICE", 50)
    rng = random.Random(11)
    base, rows = prose(rng, 150).split(), [r for r in odd if r[0] is not None]
    for d in range(100, 160):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"new{rng.randint(0, 10**6)}"
        rows += [(d, " ".join(w))] * (1 + (d == 120))
    for n, num, den in ((3, 90, 100), (5, 8, 10)):
        got = sorted((r.doc_id, r.n_links) for r in ngram_join.jaccard_components(table(spark, rows), n, num, den).collect())
        assert got == degrees(rows, n, num, den) and max(k for _, k in got) > 5


def test_one_of_each(spark, odd):
    df = table(spark, odd)
    kept = ngram_join.one_of_each(df, 3, 90, 100)
    assert kept.columns == df.columns
    want = [(d, t) for d, t in odd if d is None] + [d for d in components(odd, 3, 90, 100) if d[1] == d[3]]
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == sorted({d[1] for d in want[2:]}) and kept.where("doc_id is null").count() == 2


def test_one_of_each_of_a_shared_id(spark, odd):
    """Of rows that share an id but not a text, only the near copy of a smaller id goes."""
    near = odd[1][1]
    rows = odd[:2] + [(2, "a text of its own that no other row holds"), (2, None), (2, near), (9, "another text")]
    kept = ngram_join.one_of_each(table(spark, rows), 3, 90, 100)
    got = {(r.doc_id, r.text) for r in kept.collect()}
    assert got == {rows[0], rows[2], rows[3], rows[5]} and kept.count() == 4 and kept.columns == table(spark, rows).columns


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert ngram_join.jaccard_components(none).count() == 0 and ngram_join.one_of_each(none).count() == 0
    assert substring.dedup_passages(none).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(none, items).count() == 0 and decontaminate.clean(none, items).count() == 0


def test_graph(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(50, 90)] + [(200, 200), (7, 7)] + [(rng.randint(300, 340), rng.randint(300, 340)) for _ in range(20)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[k] == 0 for k in range(1, 41)) and all(got[k] == 50 for k in [*range(51, 90), 100]) and 200 not in got


def test_id_filters(spark):
    prepare(spark)
    df = spark.range(1000).selectExpr("if(id = 5, null, id) as doc_id", "'t' as text", "id as other")
    ids = spark.createDataFrame([(k, k % 2 == 0) for k in range(0, 2000, 7)], "doc_id long, gone boolean")
    assert having_id(df, ids, "doc_id").count() == len(range(0, 1000, 7))
    assert lacking_id(df.union(df.where("doc_id in (7, 8)")), ids, "doc_id", ["doc_id", "text"]).count() == 1000 - len(range(0, 1000, 14)) + 1


def removed(rows, window):
    last = 1 << 63
    order = sorted({(last if d is None else d, t or "") for d, t in rows}, key=lambda x: x[0])
    seen, out = set(), {}
    for d, t in order:
        w = t.encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if k in seen:
                gone[i : i + window] = [True] * window
            seen.add(k)
        kept = [x for x, g in zip(w, gone) if not g]
        out[d, t] = (len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
    return sorted((last if d is None else d, *out[last if d is None else d, t or ""]) for d, t in rows)


def test_passages_of_odd_rows(spark, odd):
    got = sorted((1 << 63 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.dedup_passages(table(spark, odd)).collect())
    assert got == removed(odd, 20)


def test_passages_shared_by_many(spark):
    rng = random.Random(8)
    passage, other = prose(rng, 40), prose(rng, 22)
    rows = [(d, " ".join([prose(rng, rng.randint(0, 40)), passage if d % 3 else other, prose(rng, 5), passage if d % 5 == 0 else ""])) for d in range(80)]
    got = substring.dedup_passages(table(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == removed(rows, 20)
    assert all(r.kept_text is None or hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)


def spelt(h, window, phrase):
    _, hi, lo = substring._phrases(h, window, phrase)
    return b"".join(int(x).to_bytes(8, "big") + int(y).to_bytes(4, "big") for x, y in zip(hi, lo))


@pytest.mark.parametrize("phrase", [6, 4])
def test_automata_find_every_window(phrase):
    """Positions come from the automaton: phrases that another document spells are found, and without spellings none."""
    rng = random.Random(2)
    a = prose(rng, 60).encode().split()
    b = prose(rng, 10).encode().split() + a[15:45] + prose(rng, 10).encode().split()
    a, b = substring.codes(a), substring.codes(b)
    found = list(substring.occurrences([(a, b""), (b, spelt(b, 20, phrase))], 20, phrase))
    assert set(range(15, 26)) <= set(found[0].tolist()) and set(range(10, 21)) <= set(found[1].tolist())
    assert [len(x) for x in substring.occurrences([(a, b""), (b, b"")], 20, phrase)] == [0, 0]


def test_nothing_is_cut_without_automata(spark, monkeypatch):
    rng = random.Random(8)
    passage = prose(rng, 40)
    rows = [(d, f"{prose(rng, 9)} {passage} {prose(rng, 9)}") for d in range(6)]
    assert sum(r.n_removed for r in substring.dedup_passages(table(spark, rows)).collect()) == 5 * 40
    monkeypatch.setattr(substring, "occurrences", lambda block, window, phrase: (np.zeros(0, np.int64) for _ in block))
    assert sum(r.n_removed for r in substring.dedup_passages(table(spark, rows)).collect()) == 0


def test_the_largest_id_is_no_missing_one(spark):
    last = (1 << 63) - 1
    assert sorted((r.doc_id is None, r.doc_id) for r in substring.dedup_passages(table(spark, [(last, "a b"), (None, "c")])).collect()) == [(False, last), (True, None)]


def test_contained_items(spark, odd):
    rng = random.Random(4)
    items = [(k, prose(rng, n)) for k, n in enumerate([1, 3, 5, 6, 9, 12, 13, 20, 40, 70, 200])] + [(50, None), (51, ""), (None, "x"), (52, "ONE two")]
    rows = list(odd)
    for d, (k, t) in enumerate(items):
        if t and k is not None:
            w = t.split()
            w[len(w) // 2] = w[len(w) // 2] if len(w) < 40 else "changed"
            rows += [(100 + d, prose(rng, 300) + " " + " ".join(w).upper() + " " + prose(rng, 300)), (200 + d, prose(rng, 50) + " " + " ".join(w[: len(w) // 2])), (300 + d, prose(rng, 30_000) + " " + t)]
    got = sorted(tuple(r) for r in decontaminate.contaminated(table(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect() if r.doc_id is not None)
    want = []
    for d, t in rows:
        for k, i in items:
            x = shingles(i, 5)
            s = shingles(t, min(5, len((i or "").split()) or 5))  # an item of fewer words is one shingle of its own length
            if d is not None and k is not None and x and 10 * len(x & s) >= 8 * len(x):
                want.append((d, k, len(x), len(x & s)))
    assert got == sorted(want) and len(want) > 15
    df = table(spark, rows)
    left = decontaminate.clean(df, spark.createDataFrame(items, "item_id long, text string"))
    assert left.columns == df.columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id) == sorted(d for d, _ in rows if d and d not in {x[0] for x in want})


def test_short_items_in_long_documents(spark):
    rows = [(1, "x " * 60 + "Un deux trois quatre " + "y " * 60), (2, "un deux trois"), (3, "deux un trois quatre")]
    items = spark.createDataFrame([(1, "un deux trois quatre"), (2, "deux")], "item_id long, text string")
    assert sorted(tuple(r) for r in decontaminate.contaminated(table(spark, rows), items).collect()) == [(1, 1, 1, 1), (1, 2, 1, 1), (2, 2, 1, 1), (3, 2, 1, 1)]
    assert [r.doc_id for r in decontaminate.clean(table(spark, rows), items.where("item_id = 1")).collect()] == [2, 3]


def test_blocks_of_items(spark, odd, monkeypatch):
    items = spark.createDataFrame([(k, " ".join(odd[k % 3][1].split()[k : k + 12])) for k in range(40)], "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.contaminated(table(spark, odd), items).na.fill(-1).collect()))
    monkeypatch.setattr(decontaminate, "SHINGLES", 100)
    assert sorted(map(tuple, decontaminate.contaminated(table(spark, odd), items).na.fill(-1).collect())) == whole and len(whole) > 40


@pytest.mark.parametrize("size", [9, 30, 64, 300])
def test_recall_of_the_sketches(size):
    """Items of which just 4/5 of the shingles are in a long document, in one piece: all but few are candidates (1 in 10^4 at the worst size)."""
    rng = np.random.default_rng(size)
    missed = 0
    for _ in range(2000):
        item = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        own = rng.integers(0, 1 << 63, 6 * size).astype(np.uint64)
        at = int(rng.integers(0, 5 * size))
        own[at : at + -(-4 * size // 5)] = rng.permutation(item)[: -(-4 * size // 5)]
        missed += 0 not in decontaminate.Index(5, [(1, item)]).candidates(own)
    assert missed <= 4


def test_frequent_keys_are_looked_up(spark, monkeypatch):
    """Whatever counts as frequent: the rows of an ordinary join, rows without a key too."""
    from corpusmill.llm import text

    df = spark.createDataFrame([(None if k % 7 == 0 else "hot" if k % 3 else f"k{k}", k) for k in range(200)], "key string, v long")
    known = df.where("key is not null and v % 5 > 0").groupBy("key").agg(F.count("*").alias("times"), F.max("v").alias("most"))
    for hot in (1, 10, 1000):
        monkeypatch.setattr(text, "HOT", hot)
        for how in ("inner", "left"):
            want = df.join(known.drop("times"), "key", how)
            assert sorted(map(str, text.looked_up(df, known, "key", how).select(want.columns).collect())) == sorted(map(str, want.collect()))
