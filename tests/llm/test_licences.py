"""Licence scan against a plain search."""

import re

from jobloom.llm import licences
from jobloom.llm.queries import op1_licence_scan


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    found = [(i, label) for phrase, label in licences.BASE_PHRASES.items() for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def base(row):
    return row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op1_licence_scan(spark, sf).collect()
    assert len(rows) == len(texts) and any(r.n_base for r in rows)
    for r in rows:
        assert base(r) == brute(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_edge_cases(spark):
    mit = licences.LONG_TEMPLATES["mit-text"][0]
    edited = mit.replace("to deal in the software", "to deal freely and fully in the software")
    texts = [None, "", "cc by CC-BY cc by by cc", "All rights reserved. all rights all rights reserved", "x " * 20_000 + "GENERAL PUBLIC LICENSE", mit.upper(), edited, mit.replace("hereby granted", "never granted"), "KELVIN K cc by"]
    docs = spark.createDataFrame([(i, t, -1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    rows = {r.doc_id: r for r in licences.summary(licences.scan(docs)).collect()}
    for i, t in enumerate(texts):
        assert base(rows[i]) == brute(t)
    assert [rows[i].labels for i in (5, 6, 7)] == ["mit-text", "mit-text", ""]
    assert rows[1].score == 0.0
    assert licences.summary(licences.scan(docs.limit(0))).count() == 0
    twice = licences.summary(licences.scan(docs.union(docs)))
    assert twice.count() == 2 * len(texts)
