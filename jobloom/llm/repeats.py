"""Repeated byte strings: a suffix order over a content-defined cover.

A byte is removed if some string of ``size`` bytes around it also starts
elsewhere.  Sorting all suffixes would move many times the input, so only a
sample of positions is ordered, as a difference cover does: any two equal
strings of ``size`` bytes hold a sampled position at the same distance from
their starts.  Here the sample is the least hash of the short strings
(``gram`` bytes) inside each window, which depends on the window's bytes
alone.  The steps are those of the difference-cover algorithm:

1. name the sampled positions by the tuple of bytes there; a name found once
   cannot repeat, and all else is dropped;
2. name them anew by all bytes that the windows of the position reach; equal
   names settle all their windows at once, which is most of the work;
3. recurse on what is left, positions with several such names, once per name:
   their windows fall into blocks, each named by the bytes that all its
   windows share and by those they reach.  A block whose shared bytes are
   found once holds no repeat, one that is found whole again is a repeat
   throughout, and others are cut into smaller blocks, down to single windows.

Names are hashes instead of ranks, so that no global sort is needed; a window
is settled by 128 bits or more.

Edge cases: null and empty texts, and texts shorter than ``size``, lose
nothing; overlaps count, also of a text with itself; equal rows are repeats of
each other; keys are hashes of id and text, so ids may repeat or be null; one
passage in a third of the rows costs one row per place; an empty table gives
an empty result.
"""

import functools
import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from jobloom.llm.common import small_batches
from jobloom.runtime import settle, union_all

SIZE, GRAM = 200, 40
BLOCKS = (16, 4, 1)
SEGMENT = 1 << 20
MASK = (1 << 64) - 1
POSITION = np.uint64(SEGMENT * 2 - 1)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


@functools.cache
def powers(base: int, n: int = SEGMENT + 4 * SIZE) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of every string of ``width`` bytes in ``data`` (a segment at most)."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE)[:n], out=sums[1:])
    h = (sums[width:] - sums[:-width]) * powers(INVERSE)[:n - width + 1]
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xCA6B2F3C5D1F4E35)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    return h ^ h >> np.uint64(32)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours, from running minima of blocks."""
    n = len(values)
    rows = -(-n // width)
    grid = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    grid[:n] = values
    grid = grid.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - width + 1], ahead[width - 1:n])


def anchors(data: bytes) -> list[tuple]:
    """(gram, context, at, low, high, times) of every sampled position.

    Windows that start from low to high have their sample at ``at``;
    neighbours with the same names, as periodic text has, become one row.
    """
    out: list = []
    whole = np.frombuffer(data, np.uint8)
    for begin in range(0, len(data) - SIZE + 1, SEGMENT):
        part = whole[begin:begin + SEGMENT + SIZE - 1]
        h = rolling(part, GRAM)
        packed = (h & ~POSITION) | np.arange(len(h), dtype=np.uint64)
        at = (sliding_min(packed, SIZE - GRAM + 1) & POSITION).astype(np.int64)
        edge = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        places, high = at[edge], np.r_[edge[1:], len(at)] - 1
        grams = h[places].view(np.int64)
        for g, a, x, y in zip(grams.tolist(), (places + begin).tolist(), (edge + begin).tolist(), (high + begin).tolist()):
            name = xxhash.xxh3_64_intdigest(data[x:y + SIZE], a - x)
            name -= (name >> 63) << 64
            if out and out[-1][0] == g and out[-1][1] == name and out[-1][4] == x - 1:
                out[-1] = (*out[-1][:4], y, out[-1][5] + 1)
            else:
                out.append((g, name, a, x, y, 1))
    return out


def blocks(gram: int, at: int, low: int, high: int, data: bytes, size: int) -> list[tuple]:
    """(core, union, low, high) of the windows from low to high, in blocks of ``size`` by their distance to ``at``.

    A block's core is what all its windows hold, its union what they reach.
    """
    out: list = []
    for k in range((at - high) // size, (at - low) // size + 1):
        a, b = max(low, at - k * size - size + 1), min(high, at - k * size)
        core = at - k * size - low
        names = (xxhash.xxh3_64_intdigest(data[core:core - size + 1 + SIZE], (gram ^ k) & MASK), xxhash.xxh3_64_intdigest(data[a - low:b - low + SIZE], at - b))
        out.append((*[n - (n >> 63 << 64) for n in names], a, b))
    return out


def merged(spans) -> list[list[int]]:
    """Overlapping and touching spans made one, in order."""
    out: list = []
    for a, b in sorted((s["low"], s["high"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def _structs(rows: list[tuple], names: str) -> list[dict]:
    return [dict(zip(names.split(), r)) for r in rows]


def sample(docs: DataFrame) -> DataFrame:
    """doc_id, _key, n_bytes, whole_sha256 and the sampled positions of every row."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("array<struct<gram: long, context: long, at: int, low: int, high: int, times: int>>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([_structs(anchors(t.encode()), "gram context at low high times") for t in texts], dtype=object)

    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("_key"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("whole_sha256"), run(text).alias("anchors"))


def _cutter(size: int):
    @F.pandas_udf("array<struct<core: long, union: long, low: int, high: int>>")
    def cut(core: pd.Series, at: pd.Series, low: pd.Series, high: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([_structs(blocks(*row, size), "core union low high") for row in zip(core, at, low, high, data)], dtype=object)

    return cut


def _settle_names(rows: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Settle ``rows(core, union, n, low, high, ...)`` by their names.

    A core found once holds no repeat.  Where all of a core have one union,
    or a union is found twice, its windows are repeats: these rows are
    returned first.  The rest, one row per union, is returned second; there n
    tells whether the union itself is settled and only stands for comparison.
    """
    names = rows.groupBy("core").agg(F.sum("n").alias("of_core"), F.min("union").alias("u0"), F.max("union").alias("u1")).filter("of_core > 1")
    met = settle(rows.join(names.select("core", (F.col("u0") != F.col("u1")).alias("several")), "core"), f"{label}-met")
    carried = [c for c in rows.columns if c not in ("core", "union", "n")]
    unions = met.filter("several").groupBy("core", "union").agg(F.sum("n").alias("n"), F.min(F.struct(*carried)).alias("r"))
    unions = settle(unions.select("core", "union", "n", "r.*"), f"{label}-unions")
    open_cores = unions.groupBy("core").agg(F.min("n").alias("least")).filter("least = 1").select("core")
    twice = met.filter("several").join(unions.filter("n > 1").select("core", "union"), ["core", "union"], "left_semi")
    return met.filter("not several").unionByName(twice), unions.join(open_cores, "core", "left_semi")


def repeated(docs: DataFrame, sampled: DataFrame) -> DataFrame:
    """(_key, low, high): stretches that are covered by repeated strings, unmerged."""
    places = sampled.select("_key", F.explode("anchors").alias("a")).select("_key", "a.*")
    places = places.withColumnsRenamed({"gram": "core", "context": "union", "times": "n"})
    settled, rest = _settle_names(places, "places")
    spans = [settled.select("_key", "low", "high")]
    rest = rest.withColumn("high", F.least("high", F.when(F.col("n") > 1, F.col("at")).otherwise(F.col("high"))))  # a periodic row stands for its first position
    reached = F.struct("core", "n", "at", "low", "high")

    @F.pandas_udf("array<binary>")
    def fetch(texts: pd.Series, wanted: pd.Series) -> pd.Series:
        return pd.Series([[data[w["low"]:w["high"] + SIZE] for w in ws] for data, ws in zip(map(str.encode, texts), wanted)], dtype=object)

    texts = with_text(docs, rest.groupBy("_key").agg(F.collect_list(reached).alias("wanted")))
    held = texts.select("_key", F.explode(F.arrays_zip("wanted", fetch("text", "wanted").alias("data"))).alias("z")).select("_key", "z.wanted.*", "z.data")
    for size in BLOCKS:
        held = settle(held.withColumn("id", F.monotonically_increasing_id()), f"held-{size}")
        parts = held.select("id", "n", F.explode(_cutter(size)("core", "at", "low", "high", "data")).alias("b")).select("id", "n", "b.*")
        settled, rest = _settle_names(parts, f"blocks-{size}")
        owners = held.select("id", "_key")
        spans.append(settled.filter("n = 1").join(owners, "id").select("_key", "low", "high"))
        if size > 1:
            parent = held.select("id", "_key", "at", "data", F.col("low").alias("begin"))
            inner = F.substring("data", F.col("low") - F.col("begin") + 1, F.col("high") - F.col("low") + SIZE)
            held = rest.join(parent, "id").select("_key", "core", "n", "at", "low", "high", inner.alias("data"))
    return union_all(spans).select("_key", "low", (F.col("high") + SIZE).alias("high"))


def with_text(docs: DataFrame, keyed: DataFrame) -> DataFrame:
    """One text for every row of ``keyed(_key, ...)``."""
    texts = docs.select(F.xxhash64("doc_id", "text").alias("_key"), F.coalesce("text", F.lit("")).alias("text"))
    return keyed.join(texts, "_key").dropDuplicates(["_key"])


def without_repeats(docs: DataFrame, kept_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans and kept_sha256 of every row; on request what is kept, as ``kept``."""
    docs = docs.select("doc_id", "text")
    sampled = settle(sample(docs), "sampled")
    spans = repeated(docs, sampled).distinct().groupBy("_key").agg(F.collect_list(F.struct("low", "high")).alias("found"))

    @F.pandas_udf("spans array<struct<low: int, high: int>>, kept binary")
    def cut(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        rows = []
        for t, f in zip(texts, found):
            data, gone = t.encode(), merged(f)
            ends = [0, *[x for span in gone for x in span], len(data)]
            kept = b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2]))
            rows.append((_structs(gone, "low high"), kept if kept_bytes else hashlib.sha256(kept).digest()))
        return pd.DataFrame(rows, columns=["spans", "kept"])

    done = with_text(docs, spans).select("_key", cut("text", "found").alias("cut")).select("_key", "cut.*")
    out = sampled.drop("anchors").join(done, "_key", "left")
    removed = F.aggregate(F.coalesce("spans", F.array().cast("array<struct<low: int, high: int>>")), F.lit(0).cast("long"), lambda n, s: n + (s["high"] - s["low"]))
    digest = F.sha2("kept", 256) if kept_bytes else F.lower(F.hex("kept"))
    columns = ["doc_id", "n_bytes", removed.alias("n_removed"), F.greatest(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"), "spans", F.when(F.col("kept").isNull(), F.col("whole_sha256")).otherwise(digest).alias("kept_sha256")]
    return out.select(*columns, *(["kept"] if kept_bytes else []))
