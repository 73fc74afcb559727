"""The pipeline stage by stage, and its guarantees."""

from collections import Counter

import corpus_pipeline
import numpy as np
from jobloom.llm import bpe, pii
from jobloom.llm.queries import RANKS
from jobloom.runtime import settle


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").collect()}
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = settle(stage(spark, docs, sf), "stage")
        assert docs.columns == columns
        kept.append(docs.collect())
    ids = [{r.doc_id for r in rows} for rows in kept]
    assert len(good & ids[0]) >= 0.97 * len(good) and len(ids[0]) < sizes[0]
    assert ids[1] < ids[0] and len(kept[1]) == len(ids[1]) == len({r.text for r in kept[1]})
    assert ids[2] == ids[1] and not any(pii.base_spans(r.text) for r in kept[2] if "[" not in r.text)
    words = Counter()
    for r in kept[2]:
        words[r.doc_id] = len(r.text.split())
    assert ids[3] <= ids[2] and max(Counter(r.doc_id for r in kept[3]).values()) <= 3
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert len(out) == len(kept[3]) and all(r.exact for r in out)
    assert Counter(bpe.merger(RANKS).decode(bytes(r.ids)) for r in out) == Counter(r.text.encode() for r in kept[3])
    assert all(np.frombuffer(r.offsets, "<u4")[0] == 0 and len(r.offsets) == 4 * r.n_tokens + 4 for r in out)


def test_run_and_empty(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    assert corpus_pipeline.run(spark, sf).count() > 50
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

