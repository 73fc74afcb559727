"""Quality rules against a plain restatement."""

import base64
import random
import re
from collections import Counter

from jobloom.llm import quality_rules
from jobloom.llm.queries import op2_quality_rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), len(words) < 50 or 100 * len(hit) > 50 * len(words)


def counts(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").collect()}
    rows = op2_quality_rules(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert counts(r) == brute(texts[r.doc_id])
        assert not (r.base_failed and r.kept)
    clean = [r for r in rows if r.doc_id in good and not r.base_failed]
    assert all(r.kept for r in clean)


def test_edge_cases(spark):
    rng = random.Random(3)
    prose = " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randrange(2, 9))) for _ in range(3000))
    noise = "\n".join(base64.b64encode(rng.randbytes(57)).decode() for _ in range(400))
    texts = [None, "", "a b\na b\n\n \n \na b", "\x0b\x85x y", "ab " * 9000, prose, noise, prose + " " + "lo " * 3000, "é😀 " * 3]
    docs = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)], "doc_id long, text string, kept boolean")
    rows = {r.doc_id: r.rules for r in quality_rules.measures(docs).collect()}
    for i, t in enumerate(texts):
        assert counts(rows[i]) == brute(t)
    assert rows[5].kept and not rows[4].kept and not rows[6].in_bands and not rows[7].kept
    assert quality_rules.measures(docs.limit(0)).count() == 0


def test_every_part_is_judged():
    rng = random.Random(8)
    letters = lambda n: " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randrange(2, 9))) for _ in range(n)).encode()[:n]
    compressor = quality_rules.zstandard.ZstdCompressor(level=3)
    verdict = lambda *parts: quality_rules.band_verdict(b"".join(parts), quality_rules.Bands(), compressor)
    noise = lambda n: base64.b64encode(rng.randbytes(n))[:n]
    again = lambda n: (b"the same again " * n)[:n]
    for size in (5000, 8000, 12000):
        assert verdict(letters(size))[1:] == (0.0, True)
        for bad in (noise, again):
            n = size * 3 // 4
            k = size - n
            for parts in ((bad(n), letters(k)), (letters(k // 2), bad(n), letters(k - k // 2)), (letters(k), bad(n))):
                assert not verdict(*parts)[2], (size, bad(9), [len(x) for x in parts])
    for tail, size in ((noise, 8000), (noise, 6000), (again, 6000)):
        n = size - 4096
        _, share, passed = verdict(letters(4096), tail(n))
        assert share == n / size and not passed
