"""MinHash fingerprints against true likeness and plain edits."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from jobloom.llm import minhash
from jobloom.llm.queries import op10_fingerprints


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def edits(rows):
    out = {}
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        out[i] = text[:len(text) - half] + following[:half], following
    return out


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    want, texts = edits(rows), dict(rows)
    got = op10_fingerprints(spark, sf).collect()
    assert len(got) == len(rows)
    errors, same = [], {}
    for r in got:
        edited, following = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(texts[r.doc_id]), hashlib.sha256(edited.encode()).hexdigest())
        for estimate, other in ((r.near_edited, edited), (r.near_next, following)):
            a, b = shingles(texts[r.doc_id]), shingles(other)
            errors.append(abs(estimate - len(a & b) / len(a | b)))
        assert same.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
    assert sum(errors) / len(errors) < 0.03 and max(errors) < 0.25


def test_plan_is_native(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    plan = minhash.with_fingerprint(docs, "text", "f")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_edge_cases(spark):
    rng = random.Random(8)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(20_000))
    texts = [None, "", " \t\n", "one", "one two", "a b c d e", "a b  c\nd e", long, long + " tail", "é😀" * 7]
    docs = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, fingerprint int")
    got = {r.doc_id: r for r in minhash.fingerprints(docs).collect()}
    want = edits([(i, t or "") for i, t in enumerate(texts)])
    assert {i: r.edited for i, r in got.items()} == {i: e for i, (e, _) in want.items()}
    assert got[0].fingerprint == got[2].fingerprint == "" and got[0].near_next == 1.0 and got[2].near_next == 0.0
    assert got[5].fingerprint == got[6].fingerprint and got[5].near_next == 1.0 and got[7].near_next > 0.95
    assert got[3].fingerprint != got[4].fingerprint and len(got[3].fingerprint) == 256
    assert minhash.fingerprints(docs.limit(0)).count() == 0
    alone = minhash.fingerprints(docs.filter("doc_id = 5")).collect()
    assert len(alone) == 1 and alone[0].edited == "a b ca b " [:9] and alone[0].near_next == 1.0
    twice = minhash.fingerprints(docs.union(docs)).collect()
    assert len(twice) == 2 * len(texts)
