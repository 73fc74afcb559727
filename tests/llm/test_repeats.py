"""Repeated strings against a set of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np

from jobloom.llm import repeats
from jobloom.llm.queries import op5_repeats


def brute(texts):
    data = {i: (t or "").encode() for i, t in texts}
    count = Counter(b[s:s + 200] for b in data.values() for s in range(len(b) - 199))
    out = {}
    for i, b in data.items():
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - 199):
            if count[b[s:s + 200]] > 1:
                gone[s:s + 200] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        out[i] = len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()
    return out


def got(rows):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(texts)
    assert got(op5_repeats(spark, sf).collect()) == want and sum(w[1] for w in want.values())


def test_random_edits(spark):
    """Copies with edits, shared passages just over and under the size, and periodic text."""
    rng = random.Random(12)
    prose = lambda n: " ".join("".join(rng.choices("etaoinshrdlué", k=rng.randrange(1, 9))) for _ in range(n))
    texts, passage = [], prose(60)
    base = prose(400)
    for i in range(12):
        t = list(base)
        for _ in range(i):
            t[rng.randrange(len(t))] = rng.choice("xyz")
        texts.append("".join(t))
    data = prose(300).encode().decode()
    for n in range(196, 206):
        texts.append(prose(30) + "|" + "".join(c for c in data if c.isascii())[:n] + "|" + prose(20))
    texts += [prose(20) + passage + prose(10) for _ in range(8)]
    texts += ["Of " * 150, "Of " * 90 + prose(40), "ab" * 150, "a" * 199, "a" * 200, "a" * 201, "abc" * 70, prose(40) + "q" * 260, "", None, base, prose(5)]
    texts += ["x" * 199 + "1", "x" * 199 + "2", "1" + "x" * 150, prose(30) * 9]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_bytes int").repartition(5)
    assert got(repeats.without_repeats(docs).collect()) == brute(rows)
    kept = repeats.without_repeats(docs, kept_bytes=True).filter("doc_id = 3").first()
    assert kept.kept is None or hashlib.sha256(kept.kept).hexdigest() == kept.kept_sha256


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, "short"), (None, None)], "doc_id long, text string")
    assert sorted((r.n_bytes, r.n_removed) for r in repeats.without_repeats(docs).collect()) == [(0, 0), (5, 0)]
    assert repeats.without_repeats(docs.limit(0)).count() == 0
    rng = random.Random(1)
    long = "".join(rng.choices("abcdefghij ", k=2_300_000))
    docs = spark.createDataFrame([(1, long), (2, "z" + long[1_000_000:1_000_600] + "y"), (1, long[:300] + "!"), (5, "same " * 3 + long[5:100]), (5, "same " * 3 + long[5:100])], "doc_id long, text string")
    rows = sorted((r.n_bytes, r.n_removed, r.n_spans) for r in repeats.without_repeats(docs).collect())
    assert rows == [(110, 0, 0), (110, 0, 0), (301, 300, 1), (602, 600, 1), (2_300_000, 900, 2)]
