"""Plain Python versions of what the operators compute, for small tables."""

import hashlib
import zlib

import numpy as np
from pyspark.sql import functions as F

from corpusmill.llm import mixing, quality, sharding, toxicity


def words(t):
    return (t or "").encode("utf-8", "surrogatepass").split()


def shingles(t, n):
    w = [x.lower() for x in words(t)]
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def good(rows, measures):
    """Rows (doc_id, text, source) that the quality rules keep; a host's rate by its beta posterior."""
    seen = []
    for r in rows:
        n, chars, symbols, dup, repeat = measures(r[1])
        lines = len([x for x in (r[1] or "").split("\n") if x.strip(" \t\n\v\f\r")])
        base = n < 10 or 100 * repeat > 20 * n
        seen.append((r, base, base or 10 * symbols > n or 10 * dup > 3 * lines or chars < 2 * n or chars > 15 * n))
    host = {}
    for r, _, f in seen:
        host.setdefault(r[2], []).append(f)
    rates = np.array([np.mean(x) for x in host.values()])
    m, v = rates.mean(), rates.var()
    s = m * (1 - m) / v - 1 if 0 < v < m * (1 - m) else 1e6
    pooled = np.mean([f for _, _, f in seen])
    bad = set()
    for h, x in host.items():
        rate, weight = (sum(x) + m * s) / (len(x) + s), len(x) + s
        if rate - quality.Z * np.sqrt(rate * (1 - rate) / (weight + 1)) > quality.EXCESS * pooled:
            bad.add(h)
    return [r for r, base, f in seen if not base and not (f and r[2] in bad)]


def representatives(rows, n, num, den):
    """Of rows with ids of their own, those of the smallest id in their component."""
    sets = [shingles(r[1], n) for r in rows]
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
    for i, r in enumerate(rows):
        least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return [r for i, r in enumerate(rows) if least[find(i)] == r[0]]


def untested(rows, items, n, num, den):
    """Rows in which no item is contained."""
    out = []
    for r in rows:
        hit = False
        for t in items:
            x = shingles(t, n)
            if x:
                hit |= den * len(x & shingles(r[1], min(n, len(words(t))))) >= num * len(x)
        if not hit:
            out.append(r)
    return out


def goals(size):
    """Targets by source, the excess over twice a size reshared until there is none."""
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [s for s in size if s is None]
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}
    capped = set()
    while True:
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in capped)
        total = sum(weight[s] for s in order if s not in capped)
        target = {s: 2 * size[s] if s in capped else left * weight[s] / total for s in order}
        over = {s for s in order if target[s] > 2 * size[s]}
        if not over:
            return target
        capped |= over


def mixture(rows):
    """The rows of the mixture, repeated and cut."""
    size = {}
    for r in rows:
        size[r[2]] = size.get(r[2], 0) + len(words(r[1]))
    target, out = goals(size), []
    for s, n in size.items():
        mine = sorted((r for r in rows if r[2] == s), key=lambda r: (hashlib.md5(f"0|{f'null|{len(words(r[1]))}' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] or 0, len(words(r[1]))))
        left = int(target[s] + 1e-9)
        while left > 0 and n:
            for r in mine:
                w = words(r[1])
                if w and left > 0:
                    out.append(r if len(w) <= left else (r[0], b" ".join(w[:left]).decode(), *r[2:]))
                    left -= min(len(w), left)
    return out


def ring(spark, rows, shards, nodes=64):
    """(doc_id, text, shard, slot) of each row, key by key around the ring."""
    sized = [(d, t, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for d, t in rows]
    keys = {(r.d, r.c, r.n): r.k for r in spark.createDataFrame(sorted({(d, c, n) for d, _, c, n in sized}, key=str), "d long, c long, n long").withColumn("k", F.xxhash64("d", "c", "n")).collect()}
    places = sharding.ring(shards, nodes)
    arcs = [[] for _ in places]
    for d, t, c, n in sized:
        key = keys[d, c, n]
        cell = (key & ((1 << 64) - 1)) >> (64 - sharding.CELLS)
        arc = next((a for a, (at, _) in enumerate(places) if at >= cell), None)
        arcs[0 if arc is None else arc].append((arc is not None, cell, key, -1 if d is None else d, c, n, d, t))
    room = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    used, out, left = [0] * shards, [], []

    def put(s, row):
        out.append((*row[6:], s, used[s]))
        used[s] += 1

    for (_, s), rows_ in zip(places, arcs):
        for k, row in enumerate(sorted(rows_, key=lambda r: r[:6])):
            if used[s] < room[s]:
                put(s, row)
            else:
                left.append((arcs.index(rows_), row))
    for arc, row in left:
        step = arc
        while used[places[step][1]] >= room[places[step][1]]:
            step = (step + 1) % len(places)
        put(places[step][1], row)
    return out


def classifier(texts, labels, share):
    """Scores of naive-Bayes-scaled logistic regression with dense arrays; ``share``: of (label 0, label 1) among all labels."""
    held = [set(toxicity.features(t).tolist()) for t in texts]
    every = sorted(set().union(*held))
    x = np.array([[f in h for f in every] for h in held], float)
    y = np.array(labels, float)
    n1, n0 = y.sum(), (1 - y).sum()
    c1, c0 = x[y == 1].sum(0), x[y == 0].sum(0)
    size = 1 << toxicity.BITS
    ratio = np.log((c1 + 1) / (c1.sum() + size)) - np.log((c0 + 1) / (c0.sum() + size))
    chi = len(y) * (c1 * (n0 - c0) - c0 * (n1 - c1)) ** 2 / np.maximum((c0 + c1) * (len(y) - c0 - c1) * n0 * n1, 1)
    z = (x * ratio)[:, chi >= toxicity.LEAST]
    w, m, v = (np.zeros(z.shape[1] + 1) for _ in range(3))
    z = np.hstack([z, np.ones((len(y), 1))])
    for t in range(1, toxicity.STEPS + 1):
        g = z.T @ (1 / (1 + np.exp(-z @ w)) - y) / len(y)
        g[:-1] += toxicity.PENALTY * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return 1 / (1 + np.exp(-(z @ w + np.log(share[1] / share[0]) - np.log(n1 / n0))))


def folded(events):
    """The messages of one conversation's log, event by event in order of seq."""
    turns = {}
    for _, kind, turn, role, text in sorted(events, key=lambda e: e[0]):
        if kind == "delta" and turn in turns:
            turns[turn][1] += text
        else:
            turns[turn] = [role, text, True]
        if kind == "regenerate":
            for later in turns:
                if later > turn:
                    turns[later][2] = False
    return [(r, t) for _, (r, t, live) in sorted(turns.items()) if live]
