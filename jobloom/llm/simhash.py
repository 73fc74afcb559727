"""SimHash near-duplicates with a byte-position inverted index.

Fingerprints that differ in at most ``bits`` bits differ in at most as many of
their eight bytes, so they share the rest.  Every distinct fingerprint is
posted under tuples of byte positions with the bytes found there; fingerprints
that meet under a posting form pairs; a pair stays if the tally of positional
bytes it shares reaches the guaranteed minimum, and its differing bits are
then counted.

A posting that many fingerprints share would make all pairs of a group.  Its
fingerprints go to postings of more bytes instead, and those that are crowded
even there to an exact form without pairs: two fingerprints within two bits
have a common neighbour within one bit of each, so each is posted under
itself and its 64 one-bit flips, and whatever meets (65 at most) is linked to
its least member.

Edge cases: a text of fewer words than a shingle is one shingle; a null,
empty or blank text has fingerprint zero and is linked like any other; equal
rows are equal links; ids may repeat or be null (a null id is never the
least); an empty table gives an empty result.
"""

import math
import re
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from jobloom.llm.common import LOWER, SPACED_WORD, UPPER, small_batches
from jobloom.llm.components import components
from jobloom.runtime import broadcast_if_small, settle, union_all

WORD = re.compile(SPACED_WORD)
LOWERED = str.maketrans(UPPER, LOWER)
SEED = 42
CROWD = 32
PARTS = 16
COMMON = 1 << 18
CHUNK = 1 << 16
CROWDED = 64   # texts above which those with a common shingle are compared block by block
BLOCK = 100_000  # shingles of a block, in all its texts
MARGIN = 1e-3  # of likeness, well above what 32-bit digests that are equal by chance add
LEAST = 300    # shingles that a text counts for at least, which bounds the texts of a block
SLICE = 4_096  # shingles in one piece of their table
DROPPED = 1_000_000  # keys, of eight bytes, that are sent to all tasks


def fingerprint(text: str, width: int = 3) -> int:
    """Signed 64-bit SimHash over word shingles, repeats included."""
    words = WORD.findall(text.translate(LOWERED))
    if not words:
        return 0
    data = " ".join(words).encode()
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 0x20)
    k = min(width, len(words)) - 1
    begin = np.r_[0, gaps + 1][:len(words) - k].tolist()
    end = np.r_[gaps, len(data)][k:].tolist()
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, np.int64)
    for at in range(0, len(begin), CHUNK):
        h = np.array([digest(data[a:b], SEED) for a, b in zip(begin[at:at + CHUNK], end[at:at + CHUNK])], "<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(begin), bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint", width: int = 3) -> DataFrame:
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(lambda t: fingerprint(t, width)).astype("int64")

    return docs.withColumn(name, run(F.col(text)))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _byte(value: Column, position: int) -> Column:
    return F.shiftrightunsigned(value, 8 * position).bitwiseAND(F.lit(255))


def shared_bytes(a: Column, b: Column) -> Column:
    """Positions at which two fingerprints have the same byte."""
    return reduce(lambda x, y: x + y, [(_byte(a, p) == _byte(b, p)).cast("int") for p in range(8)])


def _masks(kept: int, unit: int) -> list[int]:
    """Masks of all choices of ``kept`` blocks of ``unit`` bytes."""
    block = (1 << 8 * unit) - 1
    return [_signed(sum(block << 8 * unit * i for i in chosen)) for chosen in combinations(range(8 // unit), kept)]


def _meet(points: DataFrame, masks: list[int], bits: int) -> tuple[DataFrame, DataFrame]:
    """Verified pairs from uncrowded postings, and the fingerprints of crowded ones."""
    keys = F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(masks)])
    postings = points.select("fp", F.explode(keys).alias("key")).select("fp", "key.c", "key.part")
    sized = postings.groupBy("c", "part").agg(F.count("*").alias("n")).filter("n > 1")
    posted = settle(postings.join(sized, ["c", "part"]), "postings")
    calm = posted.filter(F.col("n") <= CROWD).groupBy("c", "part").agg(F.collect_list("fp").alias("fps"))
    pairs = calm.select(F.explode(F.flatten(F.transform("fps", lambda a: F.filter(F.transform("fps", lambda b: F.struct(a.alias("u"), b.alias("v"))), lambda p: (p["u"] < p["v"]) & (shared_bytes(p["u"], p["v"]) >= 8 - bits) & (F.bit_count(p["u"].bitwiseXOR(p["v"])) <= bits))))).alias("p"))
    return pairs.select("p.u", "p.v"), posted.filter(F.col("n") > CROWD).select("fp").distinct()


def _meet_at_neighbours(points: DataFrame) -> DataFrame:
    """Exact links within two bits, one per member of a common neighbour."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)).cast("long") for i in range(64)])
    spread = points.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("centre"))
    met = spread.groupBy("centre").agg(F.sort_array(F.collect_set("fp")).alias("fps")).filter(F.size("fps") > 1)
    return met.select(F.col("fps")[0].alias("u"), F.explode(F.slice("fps", F.lit(2), F.size("fps") - 1)).alias("v")).distinct()


def links(points: DataFrame) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``fp`` within two bits, or enough of them to connect the same."""
    wide, crowded = _meet(points, _masks(2, 2), 2)
    narrow, packed = _meet(settle(crowded, "crowded"), _masks(6, 1), 2)
    return wide.union(narrow).union(_meet_at_neighbours(settle(packed, "packed")))


def classes(rows: DataFrame) -> DataFrame:
    """(fingerprint, component_id) of the distinct fingerprints of ``rows(doc_id, fingerprint)``."""
    points = settle(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "points")
    linked = components(links(points.select(F.col("fingerprint").alias("fp"))))
    rooted = points.join(linked.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(least, "root").select("fingerprint", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """doc_id, fingerprint (64-bit) and component_id of every row."""
    rows = settle(with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), width=width).drop("text"), "fingerprints")
    return rows.join(classes(rows), "fingerprint")


def shingle_digests(text: str, width: int) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles, sorted."""
    words = WORD.findall(text.translate(LOWERED))
    n = max(1, len(words) - width + 1) if words else 0
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(" ".join(words[i:i + width]).encode(), SEED) for i in range(n)), np.uint64, n))


def partial_prints(digests: np.ndarray, similarity: float) -> list[int]:
    """Postings of a text under SimHashes of small parts of its shingles.

    The shingles are dealt into classes of two to four by their low bits; a
    class's SimHash is posted for the first ``PARTS`` classes.  The number of
    classes follows the number of shingles, and a text near a change posts
    both, so two texts as similar as asked share a dealing.
    """
    n = len(digests)
    out = set()
    for size in {max(0, int(n * f / 2).bit_length() - 1) for f in (similarity, 1, 1 / similarity)}:
        label = (digests & np.uint64((1 << size) - 1)).astype(np.int64)
        chosen = label < PARTS
        kept, label = digests[chosen] >> np.uint64(size), label[chosen]
        order = np.argsort(label, kind="stable")
        kept, label = kept[order], label[order]
        first = np.flatnonzero(np.r_[True, label[1:] != label[:-1]]) if len(label) else []
        for a, b in zip(first, [*first[1:], len(label)]):
            bits = np.unpackbits(kept[a:b].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
            part = np.packbits(2 * bits > b - a).tobytes()
            out.add(xxhash.xxh64_intdigest(bytes([size, int(label[a])]) + part) - (1 << 63))
    return sorted(out)


def common_shingles(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Digests of shingles that are common among every 32nd text, sorted, with levels that grow with their count.

    They only shape the order in which the shingles of a text are looked at:
    any order that is the same for all texts finds the same pairs, and one
    with rare shingles first makes few candidates.  At most ``COMMON`` rows
    reach the driver.
    """

    @F.pandas_udf("array<long>")
    def digests(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_digests(t, width).view(np.int64) for t in texts], dtype=object)

    sample = texts.filter(F.pmod("same", F.lit(32)) == 0).dropDuplicates(["same"])
    counted = sample.select(F.explode(digests("text")).alias("digest")).groupBy("digest").agg(F.count("*").alias("n")).filter("n > 2")
    found = counted.orderBy(F.desc("n"), "digest").limit(COMMON).toPandas()
    hot, level = found["digest"].to_numpy(np.int64).view(np.uint64), np.minimum(127, 8 * np.log2(found["n"].to_numpy(np.float64))).astype(np.uint64)
    order = np.argsort(hot)
    return hot[order], level[order]


def prefix(digests: np.ndarray, similarity: float, hot: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The first shingles in the common order; two sets as similar as asked share one of them at least."""
    keys = digests >> np.uint64(8)
    if len(hot) and len(keys):
        at = np.minimum(np.searchsorted(hot, digests), len(hot) - 1)
        keys |= np.where(hot[at] == digests, level[at], np.uint64(0)) << np.uint64(56)
    n = len(keys)
    return np.sort(keys)[:n - math.ceil(similarity * n - 1e-9) + 1].view(np.int64)


def shingled(texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """same, partial prints, number of shingles and their prefix, of every row of ``texts(same, text)``."""
    hot, level = common_shingles(texts, width)
    shared = texts.sparkSession.sparkContext.broadcast((hot, level))

    @F.pandas_udf("parts array<long>, n int, keys array<long>")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            digests = shingle_digests(t, width)
            rows.append((partial_prints(digests, similarity), len(digests), prefix(digests, similarity, *shared.value)))
        return pd.DataFrame(rows, columns=["parts", "n", "keys"])

    return texts.select("same", run("text").alias("s")).select("same", "s.*")


def head_pairs(sketch: DataFrame, similarity: float) -> DataFrame:
    """Pairs of every text and the least member of each of its postings under partial prints, but for those whose sizes rule a likeness out."""
    postings = settle(sketch.select("same", "n", F.explode("parts").alias("part")).distinct(), "parts")
    heads = postings.groupBy("part").agg(F.min(F.struct("same", "n")).alias("u"), F.count("*").alias("size")).filter("size > 1")
    met = postings.join(heads, "part").filter((F.col("same") != F.col("u.same")) & (F.least("n", "u.n") >= similarity * F.greatest("n", "u.n") - 1e-6))
    return met.select(F.col("u.same").alias("u"), F.col("same").alias("v")).distinct()


def shared_posts(sketch: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, same, root, size) of the prefix shingles that stand in texts of several roots; ``size`` counts a shingle's texts."""
    placed = sketch.select("same", "keys").dropDuplicates(["same"]).join(roots.withColumnRenamed("node", "same"), "same", "left").withColumn("root", F.coalesce("root", "same"))
    posts = placed.select("same", "root", F.explode("keys").alias("key"))
    mixed = posts.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("size")).filter("a <> b").select("key", "size")
    return posts.join(mixed, "key").distinct()


def cells(shared: DataFrame, sketch: DataFrame) -> DataFrame:
    """(same, cell, ways) of the texts with a shingle of more than ``CROWDED`` texts: the one that most texts share, and its number of blocks."""
    chosen = shared.filter(F.col("size") > CROWDED).groupBy("same").agg(F.max(F.struct("size", "key")).alias("m")).select("same", F.col("m.key").alias("cell"))
    sized = settle(chosen.join(sketch.select("same", "n").dropDuplicates(["same"]), "same"), "chosen")
    return sized.select("same", "cell").join(sized.groupBy("cell").agg(F.ceil(F.sum(F.greatest("n", F.lit(LEAST))) / BLOCK).cast("int").alias("ways")), "cell")


def forest(same: np.ndarray, root: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that connect all texts of different roots whose sets are as similar as asked, none to spare."""
    size = np.array([len(x) for x in sets], np.float32)
    names, word = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size.astype(np.int64))
    order = np.argsort(word, kind="stable")
    owner, word = owner[order], word[order]
    common = np.zeros((len(sets), len(sets)), np.float32)  # whole numbers below 2 ** 24
    for at in range(0, len(names), SLICE):
        a, b = np.searchsorted(word, [at, at + SLICE])
        held = np.zeros((len(sets), min(SLICE, len(names) - at)), np.float32)
        held[owner[a:b], word[a:b] - at] = 1
        common += held @ held.T
    alike = common >= similarity * (size[:, None] + size - common) - 1e-3
    head = {r: r for r in root.tolist()}

    def top(r):
        while head[r] != r:
            head[r] = r = head[head[r]]
        return r

    del owner, word, order
    out = []
    for i, j in zip(*np.nonzero(np.triu(alike & (root[:, None] != root), 1))):
        x, y = top(int(root[i])), top(int(root[j]))
        if x != y:
            head[max(x, y)] = min(x, y)
            out.append((int(same[i]), int(same[j])))
    return out


def cell_links(texts: DataFrame, roots: DataFrame, placed: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links between the texts of each cell: blocks of some ``BLOCK`` shingles meet each other inside tasks, and forests come out."""

    @F.pandas_udf("array<long>")
    def shingles(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_digests(t, width).view(np.int64) for t in texts], dtype=object)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = forest(rows["same"].to_numpy(), rows["root"].to_numpy(), list(rows["set"]), similarity)
        return pd.DataFrame(found, columns=["u", "v"]).astype("int64")

    named = placed.join(roots.withColumnRenamed("node", "same"), "same", "left").withColumn("root", F.coalesce("root", "same"))
    mine = named.withColumn("block", F.pmod(F.xxhash64("same", "cell"), F.col("ways")).cast("int"))
    sets = settle(texts.join(mine, "same").dropDuplicates(["same"]).select("same", "root", "cell", "ways", "block", shingles("text").alias("set")), "cells")
    met = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)))
    pair = [F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two")]
    return met.select("same", "root", "set", "cell", *pair).groupBy("cell", "one", "two").applyInPandas(run, "u long, v long")


def open_pairs(sketch: DataFrame, roots: DataFrame, placed: DataFrame, similarity: float) -> DataFrame:
    """All pairs (u, v) of different roots and cells that may be as similar as asked.

    Every such pair shares a shingle of its prefixes, so none is lost.  Only
    shingles found under several roots are joined.  A pair's common shingles
    up to the end of the prefix that ends first are all counted, and beyond it
    no more can be common than that text has left.
    """
    shared = settle(shared_posts(sketch, roots).join(placed.select("same", "cell"), "same", "left"), "shared")
    side = lambda c: shared.select("key", F.col("same").alias(c), F.col("root").alias(f"root_{c}"), F.col("cell").alias(f"cell_{c}"))
    elsewhere = ~F.coalesce(F.col("cell_u") == F.col("cell_v"), F.lit(False))
    met = side("u").join(side("v"), "key").filter((F.col("u") < F.col("v")) & (F.col("root_u") != F.col("root_v")) & elsewhere).groupBy("u", "v").agg(F.count("*").alias("c"))
    slim = settle(sketch.select("same", "n", (F.col("n") - F.size("keys")).alias("left"), F.array_max("keys").alias("end")).filter("n > 0").dropDuplicates(["same"]), "ends")
    ends = lambda c: slim.select(F.col("same").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("n", "left", "end")])
    most = F.col("c") + F.when(F.col("end_u") < F.col("end_v"), F.col("left_u")).when(F.col("end_u") > F.col("end_v"), F.col("left_v")).otherwise(F.least("left_u", "left_v"))
    alike = (most >= similarity / (1 + similarity) * (F.col("n_u") + F.col("n_v")) - 1e-6) & (F.least("n_u", "n_v") >= similarity * F.greatest("n_u", "n_v") - 1e-6)
    return met.join(ends("u"), "u").join(ends("v"), "v").filter(alike).select("u", "v")


def compared(texts: DataFrame, pairs: DataFrame, width: int, bits: int) -> DataFrame:
    """(u, v, alike): likeness of the sets of ``bits``-bit digests of the shingles of both texts (by hash)."""

    @F.pandas_udf("array<int>" if bits == 32 else "array<long>")
    def shingles(texts: pd.Series) -> pd.Series:
        whole = (shingle_digests(t, width) for t in texts)
        return pd.Series([np.unique((x >> np.uint64(32)).astype(np.uint32).view(np.int32)) if bits == 32 else x.view(np.int64) for x in whole], dtype=object)

    ends = [pairs.select(F.col(c).alias("same")).distinct() for c in "uv"]
    wanted = broadcast_if_small(settle(ends[0].union(ends[1]).distinct(), "wanted"))
    sets = settle(texts.join(wanted, "same", "left_semi").dropDuplicates(["same"]).select("same", shingles("text").alias("set")), "sets")
    side = lambda c: sets.select(F.col("same").alias(c), F.col("set").alias(f"set_{c}"))
    both = pairs.join(side("u"), "u").join(side("v"), "v")
    shared = F.size(F.array_intersect("set_u", "set_v"))
    return both.select("u", "v", (shared / (F.size("set_u") + F.size("set_v") - shared)).alias("alike"))


def similar_links(texts: DataFrame, pairs: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (u, v) of texts (by hash) whose shingle sets are as similar as asked.

    Digests of 32 bits decide all pairs but those within ``MARGIN`` of the
    threshold, where digests that are equal by chance could tell; these few
    are compared again by digests of 64 bits.
    """
    rough = settle(compared(texts, pairs, width, 32).filter(F.col("alike") >= similarity - MARGIN), "rough")
    close = rough.filter(F.col("alike") < similarity + MARGIN).select("u", "v")
    sure = rough.filter(F.col("alike") >= similarity + MARGIN).select("u", "v")
    return sure.union(compared(texts, close, width, 64).filter(F.col("alike") >= similarity - 1e-9).select("u", "v"))


def linked(docs: DataFrame, known: DataFrame, width: int, similarity: float) -> DataFrame:
    """(node, root) over ``known`` links and all links between texts as similar as asked.

    Texts are first compared with the heads of their postings only, which
    connects most groups at the cost of their members.  Texts that share a
    crowded shingle and are still apart are then compared block by block, and
    at last all pairs that did not meet so and may be similar.
    """
    small_batches(docs.sparkSession)
    as_links = lambda roots: roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
    texts = docs.select(F.xxhash64("text").alias("same"), F.coalesce("text", F.lit("")).alias("text"))
    sketch = settle(shingled(texts, width, similarity), "sketch")
    roots = components(known.union(similar_links(texts, settle(head_pairs(sketch, similarity), "pairs"), width, similarity)))
    placed = settle(cells(shared_posts(sketch, roots), sketch), "placed")
    if not placed.isEmpty():
        roots = components(as_links(roots).union(cell_links(texts, roots, placed, width, similarity)))
    apart = settle(open_pairs(sketch, roots, placed, similarity), "apart")
    if apart.isEmpty():
        return roots
    return components(as_links(roots).union(similar_links(texts, apart, width, similarity)))


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of every group of near-duplicates, with all its columns.

    Two texts belong together if their fingerprints are within two bits, or if
    their word shingles are as similar as asked.  The row with the least
    doc_id stays; rows that share id and text count once.  Groups are settled
    on slim keys.  At the end the keys that go are sent to the texts, up to
    ``DROPPED`` of them; only texts of rows that are there twice, or all beyond
    that number, are moved.
    """
    key = F.xxhash64("doc_id", "text")
    rows = settle(with_fingerprint(docs.select("doc_id", "text"), width=width).select(key.alias("_key"), F.xxhash64("text").alias("same"), "doc_id", "fingerprint"), "fingerprints")
    grouped = rows.join(classes(rows), "fingerprint").select("same", "component_id").distinct()
    heads = grouped.groupBy("component_id").agg(F.min("same").alias("u"))
    by_print = grouped.join(heads, grouped.component_id.eqNullSafe(heads.component_id)).select("u", F.col("same").alias("v")).filter("u <> v")
    roots = linked(docs, by_print, width, similarity).withColumnRenamed("node", "same")
    placed = rows.join(roots, "same", "left").withColumn("root", F.coalesce("root", "same"))
    chosen = placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key")).alias("_best"))
    best = settle(chosen.select("_best._key"), "best")
    counted = rows.groupBy("_key").agg(F.count("*").alias("n"))
    others = broadcast_if_small(settle(counted.join(best, "_key", "left_anti").select("_key"), "others"), DROPPED)
    kept = docs.withColumn("_key", key).join(others, "_key", "left_anti")
    again = settle(counted.filter("n > 1").join(best, "_key", "left_semi").select("_key"), "again")
    if not again.isEmpty():
        again = broadcast_if_small(again, DROPPED)
        kept = union_all([kept.join(again, "_key", "left_anti"), kept.join(again, "_key", "left_semi").dropDuplicates(["_key"])])
    return kept.select(*docs.columns)
