"""Byte-level BPE against the public library and exact round trips."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from jobloom.llm import bpe
from jobloom.llm.queries import RANKS, op8_byte_bpe


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def own(texts):
    return [np.frombuffer(ids, "<u4").tolist() for ids, _ in bpe.merger(RANKS).encode(texts)]


CASES = ["", " ", "  ", "a", "'s's", "x's't''ll 'll", "don't  we'll\n\n  they've  ", "\t\n x", "  y", "日本語 テキスト １２３", "a" * 5000, " " * 3000, "!?" * 400, "'re've'm'd'", "é́ ñ", "😀😀 x 😀", "\x1c\x1d a", "it'", "'l", "'r e", "tab\tspace \t mix\r\n end ", "<|endoftext|>"]


def test_edge_cases(library):
    assert own(CASES) == [library.encode_ordinary(t) for t in CASES]


def test_random_texts(library):
    rng = random.Random(4)
    alphabet = list("aabcstrevlmd'' \n\t  .,!?019é日 ñ") + ["　", "😀", "​"]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(3000)]
    assert own(texts) == [library.encode_ordinary(t) for t in texts]


def test_long_piece_equals_short_way():
    m = bpe.merger(RANKS)
    rng = random.Random(1)
    pieces = ["".join(rng.choices("abcdehinorst", k=80)).encode() for _ in range(50)]
    ids, owner = m.merge_many(pieces)
    assert [ids[owner == i].tolist() for i in range(50)] == [m.merge_long(p) for p in pieces]


def test_offsets_and_decoding():
    for text, (ids, offsets) in zip(CASES, bpe.merger(RANKS).encode(CASES)):
        at, data = np.frombuffer(offsets, "<u4"), text.encode()
        tokens = [bpe.merger(RANKS).bytes[i] for i in np.frombuffer(ids, "<u4").tolist()]
        assert [data[a:b] for a, b in zip(at, at[1:])] == tokens
        assert bpe.merger(RANKS).decode(ids) == data


def test_frames(spark):
    docs = spark.createDataFrame([(1, None, 5), (1, "a b", 6), (None, "", 7)], "doc_id long, text string, ids int")
    rows = bpe.encode(docs, RANKS).withColumn("n", bpe.id_count(F.col("ids"))).collect()
    assert sorted(r.n for r in rows) == [0, 0, 2]
    assert bpe.encode(docs.limit(0), RANKS).count() == 0


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op8_byte_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = np.array(library.encode_ordinary(texts[r.doc_id]), "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
