import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st

from jobloom.llm import spelling
from jobloom.llm.queries import op12_spelling_variants


def by_rule(docs):
    """The contract, word pair by word pair."""
    counts = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{key}:{word}".encode())
            counts[word[:h % len(word)] + word[h % len(word) + 1:] if h % 97 == 0 else word] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    near = {w: [] for w in n}
    for a in n:
        for b in n:
            cut = {a[:i] + "?" + a[i + 1:] for i in range(len(a))} & {b[:i] + "?" + b[i + 1:] for i in range(len(b))}
            if a != b and (cut and len(a) == len(b) or b in {a[:i] + a[i + 1:] for i in range(len(a))} or a in {b[:i] + b[i + 1:] for i in range(len(b))}):
                near[a].append(b)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    def root(w):
        return root(form[w]) if form[w] else w
    return {(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def got(rows):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows.collect()}


def written(spark, tmp_path, docs):
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def some_docs(seed=3, n=120):
    rng = np.random.RandomState(seed)
    base = ["colour", "recieve", "Straße", "anagram", "listen", "silent", "enlist", "banana", "señora", "élèves", "programme", "letters"]
    docs = []
    for key in range(n):
        words = []
        for _ in range(60):
            w = base[rng.randint(len(base))]
            if rng.rand() < 0.3:
                i, c = rng.randint(len(w)), "abé"[rng.randint(3)]
                w = [w[:i] + w[i + 1:], w[:i] + c + w[i:], w[:i] + c + w[i + 1:], w.upper()][rng.randint(4)]
            words.append(w)
        docs.append((key, " ".join(words) + (" ÷×÷×÷ 123abcde_fghij" if key % 3 == 0 else "")))
    return docs + [(500, None), (501, ""), (502, " \t\n"), (3, docs[3][1])]


def test_whole_query_equals_the_rule(spark, tmp_path):
    docs = some_docs()
    out = op12_spelling_variants(spark, written(spark, tmp_path, docs))
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = by_rule(docs)
    assert got(out) == want and any(f for _, f, *_ in want)


@pytest.mark.parametrize("parts", [3, 4, 6])
def test_crowded_buckets_lose_nothing(spark, tmp_path, parts):
    """With room for two words a bucket, nearly all pairs come by the remainders."""
    docs = some_docs(5)
    words = spelling.word_counts(spark.createDataFrame(docs, "doc_id long, text string"), every=97).filter("n >= 3").cache()
    crowd, gather = spelling.CROWD, spelling.GATHER
    try:
        spelling.CROWD, spelling.GATHER = 2, 10
        crowded = got(spelling.variants(words, parts=parts))
    finally:
        spelling.CROWD, spelling.GATHER = crowd, gather
    assert crowded == got(spelling.variants(words, parts=parts)) == by_rule(docs)


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, word string, n long")
    assert got(spelling.variants(spelling.word_counts(docs, every=97))) == set()
    docs = spark.createDataFrame([(1, "lettre letter letter", "x", 5)], docs.schema)
    assert got(spelling.variants(spelling.word_counts(docs))) == {("lettre", None, "lettre", 1, 0, None), ("letter", None, "letter", 2, 0, None)}


def test_ties_and_chains(spark):
    words = [("abcde", 1), ("abcdz", 4), ("abcdy", 4), ("abcyy", 9), ("abyyy", 20), ("ayyyy", 40)]
    rows = got(spelling.variants(spark.createDataFrame(words, "word string, n long")))
    assert {(w, f, r) for w, f, r, *_ in rows} == {
        ("abcde", "abcdy", "ayyyy"), ("abcdz", None, "abcdz"), ("abcdy", "abcyy", "ayyyy"), ("abcyy", "abyyy", "ayyyy"), ("abyyy", "ayyyy", "ayyyy"), ("ayyyy", None, "ayyyy"),
    }


def test_very_long_words(spark):
    long = "ab" * 400
    words = [(long, 9), (long + "c", 3), (long[:300] + "c" + long[301:], 3), (long[:300] + "cc" + long[302:], 3), ("c" + long, 2)]
    rows = {w: (f, k) for w, f, _, _, k, _ in got(spelling.variants(spark.createDataFrame(words, "word string, n long")))}
    assert [rows[w] for w, _ in words] == [(None, 3), (long, 1), (long, 2), (None, 1), (long, 1)]


WORD = st.text("abcé", min_size=5, max_size=9)


@settings(max_examples=300, deadline=None)
@given(WORD, st.integers(0, 8), st.sampled_from("abcéz"), st.integers(0, 2), st.sampled_from([3, 4, 5]))
def test_near_words_share_a_signature(word, at, letter, kind, parts):
    at = at % len(word)
    other = [word[:at] + letter + word[at + 1:], word[:at] + letter + word[at:], word[:at] + word[at + 1:]][kind]
    a, b = spelling.signatures([word, other], parts)
    assert word == other or set(a.tolist()) & set(b.tolist())
    assert spelling.one_edit(word, other) == (word != other)
    assert spelling.near_mask(np.array([word, other], object), np.array([0]), np.array([1]))[0] == (word != other)


def test_streamed_buckets_of_any_length():
    """A bucket that spans batches is one bucket."""
    rng = np.random.RandomState(1)
    rows = pd.DataFrame({"signature": np.sort(rng.randint(0, 30, 3000)), "word": ["w" + "abcdefgh"[i % 8] + str(i // 8) for i in range(3000)], "n": 1})
    whole = {tuple(r) for f in spelling._met(iter([rows])) for r in f[["u", "v"]].itertuples(index=False)}
    gather = spelling.GATHER
    try:
        spelling.GATHER = 7
        parts = {tuple(r) for f in spelling._met(rows[i:i + 7] for i in range(0, 3000, 7)) for r in f[["u", "v"]].itertuples(index=False)}
    finally:
        spelling.GATHER = gather
    assert parts == whole and len(whole) > 100
