"""Source mix against plain sums, and its schedule against the targets."""

import re
from collections import defaultdict

from jobloom.llm import mixing
from jobloom.llm.common import word_count
from jobloom.llm.queries import op3_source_mix


def plain_targets(rows):
    size = defaultdict(int)
    for _, text, source in rows:
        size[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + ([None] if None in size else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(size.values()))
    while True:
        share = left / (sum(weight[s] for s in open_) or 1)
        full = {s for s in open_ if weight[s] * share > 3 * size[s]}
        if not full:
            return size, {**target, **{s: weight[s] * share for s in open_}}
        for s in full:
            target[s] = 3.0 * size[s]
            left -= target[s]
        open_ -= full


def check(rows, got, block=4096):
    size, target = plain_targets(rows)
    assert len(got) == len(rows)
    sums, key = defaultdict(int), defaultdict(list)
    for i, text, source in rows:
        key[i].append((len(re.findall(r"[^\x20\x09-\x0D]+", text or "")), size[source], source))
    for r in got:
        n, total, source = next(k for k in key[r.doc_id] if k[0] == r.size and k[1] == r.source_size)
        assert 0 <= r.taken <= 3 * n and abs(r.target - target[source]) < 1e-6 * max(1, target[source])
    by = {i: s for i, _, s in rows}
    for r in got:
        sums[by[r.doc_id]] += r.taken
    for s in size:
        assert abs(sums[s] - target[s]) <= 1, (s, sums[s], target[s])


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op3_source_mix(spark, sf).collect()
    check(rows, got)
    assert sorted(got) == sorted(op3_source_mix(spark, sf).collect())


def test_edge_cases(spark):
    rows = [(1, "a b c", None), (2, None, "a"), (3, "", "b"), (4, "w " * 50_000, "c"), (5, "x y", "é"), (6, "x y", "é"), (7, "one", "z"), (8, "q " * 10, "\U0001f600")]
    docs = spark.createDataFrame([(*r, 1.5) for r in rows], "doc_id long, text string, source string, size double")
    check(rows, mixing.taken(docs, block=16).collect())
    assert mixing.taken(docs.limit(0)).count() == 0
    assert [r.taken for r in mixing.taken(docs.filter("doc_id in (2, 3)")).collect()] == [0, 0]
    twice = docs.union(docs.filter("doc_id = 5")).collect()
    assert len(mixing.taken(spark.createDataFrame(twice, docs.schema), block=2).collect()) == 9


def test_schedule_is_even(spark):
    """Every stretch of the schedule is close to the targets."""
    sources = spark.createDataFrame([(0, 1000 * 16), (1, 3000 * 16), (2, 50 * 16 + 3), (3, 0)], "number long, quota long")
    rows = sorted((r.slot, r.number) for r in mixing.schedule(sources, 16).collect())
    assert len(rows) == 4051 and len({(r.number, r.block) for r in mixing.schedule(sources, 16).collect()}) == 4051
    for share, n in ((1000 / 4051, 0), (3000 / 4051, 1)):
        seen = 0
        for i, (_, number) in enumerate(rows[:4000], 1):
            seen += number == n
            assert abs(seen - share * i) < 8


def test_documents(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(5 + i % 7)), f"s{i % 4}" if i < 60 else "big", 0, "t") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, lang string")
    out = mixing.mixed_documents(docs, block=8)
    assert out.columns == docs.columns
    _, target = plain_targets([r[:3] for r in rows])
    got = defaultdict(int)
    texts = {r[0]: r[1] for r in rows}
    for r in out.withColumn("w", word_count(out.text)).collect():
        got[r.source] += r.w
        assert texts[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
    for s, t in target.items():
        assert abs(got[s] - t) <= 1


def test_slots_of_documents(spark):
    """In the order of their first slots every source's documents come evenly, and all that is taken has a slot."""
    rows = [(i, "w " * 8, "abc"[i % 3]) for i in range(600)] + [(600, None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.taken(docs, block=8).collect()
    by = {i: s for i, _, s in rows}
    assert all((r.taken == 0) == (r.first_slot is None) == (r.n_slots == 0) and 8 * r.n_slots >= r.taken for r in got)
    first = sorted((r.first_slot, by[r.doc_id], r.taken) for r in got if r.taken)
    assert len({slot for slot, _, _ in first}) == len(first)  # a block of 8 words is one document
    slots = 600
    for name, weight in zip("abc", (1, 2, 3)):
        new = [slot for slot, source, _ in first if source == name]
        assert all(abs(k - slot * weight / 6) < 8 for k, slot in enumerate(new) if slot < slots)
