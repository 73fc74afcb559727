"""Quality classifier: held-out accuracy, calibration, and edge cases."""

import zlib

import numpy as np

from jobloom.llm import classifier
from jobloom.llm.queries import op6_quality_classifier


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op6_quality_classifier(spark, sf).collect()
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    score, y = np.array(held).T
    assert ((score >= 0.5) == y).mean() > 0.95
    assert (score[y == 1] >= 0.5).mean() > 0.97
    assert abs(score.mean() - y.mean()) < 0.04


def test_contexts_against_plain_sums(spark):
    places, signs = classifier.index_vectors()
    texts = ["a b c d a", "b a", "", "x"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9, None)], "doc_id long, text string")
    want = np.zeros((classifier.BUCKETS, classifier.DIMS))
    for t in texts:
        ids = classifier.buckets(t)
        for i, a in enumerate(ids):
            for j in range(max(0, i - 2), min(len(ids), i + 3)):
                if j != i:
                    for p, s in zip(places[ids[j]], signs[ids[j]]):
                        want[a, p] += s
    count = np.zeros(classifier.BUCKETS)
    for t in texts:
        np.add.at(count, classifier.buckets(t), 1)
    want -= np.outer(count, want.sum(axis=0) / count.sum())
    norm = np.linalg.norm(want, axis=1, keepdims=True)
    want = np.divide(want, norm, out=np.zeros_like(want), where=norm > 0)
    got = classifier.word_vectors(docs.repartition(5))
    assert np.allclose(got[:, :classifier.DIMS], want, atol=1e-5) and np.allclose(got[:, classifier.DIMS], np.log1p(count) / 10)


def test_edge_cases(spark):
    docs = spark.createDataFrame([(i, None if i % 9 == 0 else "" if i % 9 == 1 else f"w{i} " * (i % 5 + 1), "q") for i in range(60)] + [(3, "w3 w3 w3 w3 ", "q")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2 if i % 7 else None, 0) for i in range(80)], "doc_id long, quality int, toxic int")
    model = classifier.fit(docs, labels)
    rows = classifier.scored(docs, *model, name="p").collect()
    assert len(rows) == 61 and len({r.p for r in rows if r.doc_id == 3}) == 1 and all(0 <= r.p <= 1 for r in rows)
    none = classifier.fit(docs, labels.limit(0))
    assert {round(r.p, 6) for r in classifier.scored(docs, *none, name="p").collect()} == {0.5}
    one = classifier.fit(docs, labels.filter("quality = 1"))
    assert min(r.p for r in classifier.scored(docs, *one, name="p").collect()) > 0.99
    kept = classifier.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= 61
    assert classifier.keep_good(docs.limit(0), labels).count() == 0
