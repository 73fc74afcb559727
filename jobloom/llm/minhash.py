"""Document fingerprints: one-permutation MinHash in SQL functions.

The hashes of a text's word shingles are taken once.  Their top bits name a
bin, and each bin keeps its least hash; sorting the hashes brings a bin's
least one first, so this is a sort and a filter within the row.  An empty bin
borrows from another by optimal densification: every bin has an order of its
own over the others, given by a hash of the two, and takes the first that is
not empty.  The low-order bits of all bins are stored as hexadecimal digits.
Two fingerprints agree in a bin by chance with probability 2 to the minus
number of bits, for which the likeness is corrected.

Edge cases: a text with fewer words than a shingle is one shingle; a null,
empty or blank text has no shingle: its fingerprint is empty, like only to
another empty one; equal texts have equal fingerprints.
"""

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from jobloom.llm.prefix import ranked
from jobloom.runtime import broadcast_if_small, settle

BIN_BITS = 7
BINS = 1 << BIN_BITS
LOW_BITS = 8
WIDTH = 5
QUANTILES, BUCKET_ROWS = 64, 1024


def word_hashes(text: Column) -> Column:
    """A hash per word of a text without white space at its ends."""
    return F.when(text == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: F.xxhash64(w)))


def shingle_hashes(words: str, width: int = WIDTH) -> Column:
    """One hash per shingle of the word hashes in the column ``words``, which must be a plain column: it is read at every place."""
    hashed = F.col(words)
    starts = F.slice(hashed, 1, F.greatest(F.size(hashed) - (width - 1), F.lit(1)))
    return F.transform(starts, lambda h, i: F.xxhash64(h, *[F.get(hashed, i + k) for k in range(1, width)]))


def bin_of(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BIN_BITS)


def with_fingerprint(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Add the packed fingerprint of ``text`` under ``name``; each step is a column of its own.

    A column that is named twice or more is computed once; one that is named
    once would be computed anew for every item of the lambda it stands in.
    """
    t = lambda s: f"_{name}_{s}"
    mask = (1 << LOW_BITS) - 1
    low = lambda h: h.bitwiseAND(F.lit(mask))
    at = rows.withColumn(t("words"), word_hashes(F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))))
    at = at.withColumn(t("sorted"), F.sort_array(shingle_hashes(t("words"))))
    least = F.filter(t("sorted"), lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(F.col(t("sorted")), i - 1))))
    at = at.withColumn(t("least"), least)
    at = at.withColumn(t("full"), F.map_from_arrays(F.transform(t("least"), bin_of), F.transform(t("least"), low)))
    turn = lambda b: F.array_min(F.transform(t("least"), lambda h: F.xxhash64(b, bin_of(h)).bitwiseAND(F.lit(~mask)).bitwiseOR(low(h))))
    filled = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(BINS - 1).cast("long")), lambda b: F.coalesce(F.try_element_at(F.col(t("full")), b), low(turn(b))))
    digits = F.array_join(F.transform(filled, lambda v: F.substring(F.hex(v + (mask + 1)), 2, LOW_BITS // 4)), "")
    at = at.withColumn(name, F.when(F.size(t("full")) > 0, F.lower(digits)).otherwise(F.lit("")))
    return at.drop(t("words"), t("sorted"), t("least"), t("full"))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness, corrected for chance agreement."""
    digits = LOW_BITS // 4
    same = F.aggregate(F.sequence(F.lit(0), F.lit(BINS - 1)), F.lit(0), lambda n, i: n + (F.substring(a, i * digits + 1, F.lit(digits)) == F.substring(b, i * digits + 1, F.lit(digits))).cast("int"))
    chance = 2.0 ** -LOW_BITS
    found = F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - chance) / (1 - chance))
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(found)


def id_bucket(docs: DataFrame) -> Column:
    """A number that grows with doc_id and holds about ``BUCKET_ROWS`` rows.

    Ids are cut at approximate quantiles (a fixed number), and each stretch
    evenly.  Null ids come first, cut by the hash of their text.
    """
    steps = [i / QUANTILES for i in range(1, QUANTILES)]
    seen = docs.agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.percentile_approx("doc_id", steps, 10_000).alias("cuts")).first()
    low, high = (seen["low"], seen["high"]) if seen["low"] is not None else (0, 0)
    edges = [low, *sorted({c for c in seen["cuts"] or [] if low < c}), high + 1]
    parts = math.ceil(seen["n"] / QUANTILES / BUCKET_ROWS) or 1
    at = F.col("doc_id")
    stretch = F.lit(0)
    for edge in edges[1:-1]:
        stretch = stretch + (at >= edge).cast("int")
    begin, end = (F.element_at(F.array(*map(F.lit, values)), stretch + 1) for values in (edges[:-1], edges[1:]))
    inner = F.floor((at - begin) / (end - begin) * parts)
    blank = F.floor(F.shiftrightunsigned("_hash", 11) / F.lit(float(1 << 53)) * QUANTILES * parts)
    return F.coalesce(stretch * parts + F.least(inner, F.lit(parts - 1)), blank - QUANTILES * parts).cast("long")


def with_next(docs: DataFrame) -> DataFrame:
    """Add fingerprint and the struct next (text, fingerprint) to ``docs(doc_id, text)``, in the order of ids.

    The first row follows the last; rows of equal id are ordered by the hash
    of their text.  Texts move once, by stretches of ids, and are sorted
    within them.  The last row of a stretch takes the first of the next one,
    which is found through one slim row per stretch.
    """
    order = ["doc_id", "_hash"]
    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_hash", F.xxhash64("text"))
    placed = whole.withColumn("_stretch", id_bucket(docs))
    firsts = ranked(placed.groupBy("_stretch").agg(F.min(F.struct(*order)).alias("_first")), [F.col("_stretch")], "_place")
    firsts = settle(firsts.select("_stretch", "_place", F.col("_first.doc_id").alias("_id"), F.col("_first._hash").alias("_text")), "stretches")
    before = F.pmod(F.col("_place") - 1, F.lit(max(1, firsts.count())))
    heads = firsts.select(before.alias("_place"), "_id", "_text").join(firsts.select("_place", "_stretch"), "_place").drop("_place")
    head = whole.join(broadcast_if_small(heads), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_text"))).dropDuplicates(["_stretch"])
    led = F.struct("text", "fingerprint")
    head = with_fingerprint(head, "text", "fingerprint").select("_stretch", led.alias("_head"))
    within = Window.partitionBy("_stretch").orderBy(F.col("doc_id").asc_nulls_first(), "_hash")
    follows = with_fingerprint(placed, "text", "fingerprint").withColumn("_follows", F.lead(led).over(within))
    return follows.join(head, "_stretch").select("doc_id", "text", "fingerprint", F.coalesce("_follows", "_head").alias("next"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited, both fingerprints, and the likeness of a text's to its edit's and to the next text's.

    The edit replaces the last half of the code points by the first as many of
    the next text (all of it where it is shorter).
    """
    size = F.length("text")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), size - half), F.substring("next.text", F.lit(1), half))
    both = with_next(docs).select("doc_id", size.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", F.col("next.fingerprint").alias("next_fingerprint"))
    made = with_fingerprint(both, "edited", "edited_fingerprint")
    near = lambda c: likeness(F.col("fingerprint"), F.col(c))
    return made.withColumns({"near_edited": near("edited_fingerprint"), "near_next": near("next_fingerprint")}).drop("next_fingerprint")
