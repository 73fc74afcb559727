"""SimHash groups against all pairs."""

import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from jobloom.llm import simhash
from jobloom.llm.components import components
from jobloom.llm.queries import op9_simhash


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(prints):
    """Least id reachable, by all pairs."""
    parent = {i: i for i in prints}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    prints = {r.doc_id: plain(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = grouped(prints)
    rows = op9_simhash(spark, sf).collect()
    assert len(rows) == len(want)
    for r in rows:
        assert r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == want[r.doc_id]


def test_crowded_postings(spark):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    prints = {}
    for i in range(400):  # chains and clusters in crowded postings
        x = centre if i % 3 else rng.getrandbits(64)
        for _ in range(rng.randrange(5)):
            x ^= 1 << (rng.randrange(64) if i % 2 else rng.randrange(12))
        prints[i] = x
    for i in range(400, 460):
        prints[i] = prints[i - 1] ^ 1 << (i % 64)
    rows = spark.createDataFrame([(i, signed(x)) for i, x in prints.items()], "doc_id long, fingerprint long")
    got = {r.doc_id: r.component_id for r in rows.join(simhash.classes(rows), "fingerprint").collect()}
    assert got == grouped(prints)


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(rng.randrange(300, 340), rng.randrange(300, 340)) for _ in range(25)] + [(7, 7)]
    parent = {}

    def find(i):
        parent.setdefault(i, i)
        return i if parent[i] == i else find(parent[i])

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: find(i) for i in parent if find(i) != i}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    texts = [None, "", " \n", "one", "One", "one two", "a b c", "A b  c", long, long]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(9, long, "x"), (None, "one", "x")], "doc_id long, text string, fingerprint string")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert [got[i].component_id for i in range(10)] == [0, 0, 0, 3, 3, 5, 6, 6, 8, 8] and got[None].component_id == 3
    for i, t in enumerate(texts):
        assert got[i].fingerprint == signed(plain(t))
    kept = simhash.keep_one(docs)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 5, 6, 8] and kept.columns == docs.columns
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0


def test_keep_one_finds_similar_texts(spark):
    """Near copies by shingle sets, against all pairs."""
    rng = random.Random(21)
    prose = lambda n: ["".join(rng.choices("etaoinshrdlu", k=rng.randrange(2, 9))) for _ in range(n)]
    texts = []
    for n in (12, 30, 90, 300, 1500):
        base = prose(n)
        texts.append(" ".join(base))
        for edits in (1, 2, 3, 6, 12):
            w = list(base)
            for k in range(edits):
                w[(k * n // edits + n // 3) % n] = "edit" + str(k)
            texts.append(" ".join(w))
        texts += [" ".join(base[: n // 2] + prose(n // 2)), " ".join(prose(n))]

    def shingles(t):
        w = t.split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}

    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        return i if parent[i] == i else find(parent[i])

    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    want = {i for i in range(len(texts)) if find(i) == i}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == want


def test_keep_one_links_a_star(spark):
    """One base with copies that resemble it but not each other, against all pairs."""
    rng = random.Random(33)
    word = lambda: "".join(rng.choices("etaoinshrdlu", k=7))
    base = [word() for _ in range(304)]
    texts = [" ".join(base)]
    for _ in range(500):
        w = list(base)
        at = rng.randrange(0, 50)
        for k in range(6):
            w[at + 50 * k] = word()
        texts.append(" ".join(w))
    texts += [" ".join(word() for _ in range(300)) for _ in range(20)]
    sets = [frozenset(zip(*(t.split()[k:] for k in range(5)))) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        return i if parent[i] == i else find(parent[i])

    near = [len(s & sets[0]) / len(s | sets[0]) for s in sets[1:501]]
    assert 0.81 < min(near) and max(near) < 0.85
    for a in range(len(texts)):
        for b in range(a):
            if find(a) != find(b) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    want = {i for i in range(len(texts)) if find(i) == i}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == want


def test_forest_connects_what_brute_force_connects():
    """A forest holds one link less than texts for each group, and each of its links is similar enough."""
    rng = np.random.RandomState(2)
    base = rng.randint(0, 1 << 40, 120)
    sets = [np.unique(np.where(rng.rand(120) < rng.choice([0.02, 0.06, 0.1]), rng.randint(0, 1 << 40, 120), base)) for _ in range(60)] + [np.unique(rng.randint(0, 1 << 40, 30)) for _ in range(5)]
    same, root = np.arange(65) * 10, np.arange(65) % 64 * 10
    like = lambda a, b: len(set(a) & set(b)) >= 0.8 * len(set(a) | set(b))
    links = [(i, j) for i in range(65) for j in range(i) if like(sets[i], sets[j])]

    def groups(links):
        head = dict(zip(same.tolist(), root.tolist()))
        changed = True
        while changed:
            changed = False
            for u, v in links:
                low = min(head[u], head[v])
                changed |= head[u] != low or head[v] != low
                for k in (u, v):
                    for x in [x for x in head if head[x] == head[k]] if head[k] != low else []:
                        head[x] = low
        return head

    found = simhash.forest(same, root, sets, 0.8)
    assert groups(found) == groups([(int(same[i]), int(same[j])) for i, j in links]) and len(found) < len(links)
    assert all(like(sets[u // 10], sets[v // 10]) for u, v in found)


def test_keep_one_moves_no_texts_at_the_end(spark):
    """All texts were dealt anew to drop the rows that are there twice."""
    rows = [(i, f"text{i} of words{i} that{i} nobody{i} shares{i}") for i in range(4)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert "Aggregate" not in kept._jdf.queryExecution().optimizedPlan().toString() and kept.count() == 4
    twice = simhash.keep_one(spark.createDataFrame(rows + rows[:1] + [(9, rows[1][1])], "doc_id long, text string"))
    assert sorted(map(tuple, twice.collect())) == rows
