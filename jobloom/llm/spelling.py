"""Spelling variants: words one edit apart, found by PartEnum signatures.

The letters of a word are a multiset, seen as a binary vector with one place
per letter and occurrence ("the second e").  A replaced letter changes two
places, a letter more or less changes one.  The places are cut into parts; two
vectors within Hamming distance d agree on all but d parts, so every choice of
the parts to keep is a signature, and near words share one of them exactly.
Words of one length meet under signatures for distance two; words that differ
by a letter meet, under the length of the shorter, under signatures for
distance one.  An edit leaves the first or the last half of the shorter word
as it is, so a signature is completed by either half.

Signatures are an equi-join in the form of one shuffle: a task reads its
signatures in order, compares the words of each bucket in arrays and hands on
the true pairs alone.  A bucket of more than ``CROWD`` words is not compared
pair by pair.  Its words are posted again under what is left of them without
one letter: words with another letter in one place share such a remainder and
its place, and a word is the remainder of those with a letter more.  Such a
group holds true partners only, so nothing is capped or lost.

Edge cases: a null or blank text has no words; words are counted over all
rows, repeated rows and ids included (a null id reads as nothing before the
colon); ties of the best neighbour go to the word first in code-point order;
words without neighbours stay, with n_near 0; an empty table gives an empty
result.  Further columns of the table are not read, so none can clash.
"""

import functools
import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from jobloom.runtime import settle

CROWD = 512
SLOTS = 64  # letters of the words that are compared in arrays
FLUSH = 500_000
GATHER = 20_000
PRIME, BASE = (1 << 61) - 1, 0x10FFFF + 2
MIX = np.uint64(0x9E3779B97F4A7C15)
# Fixed value: Latin letters from the most to the least frequent in English prose.
FREQUENT = "etaoinshrdlcumwfgypbvkjxqz"


def ascii_lowered(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def misspelt(word: str, checksum: int) -> str:
    """The word without the letter that the checksum points at."""
    at = checksum % len(word)
    return word[:at] + word[at + 1:]


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = 5, every: int | None = None) -> DataFrame:
    """(word, n) over whole texts, of words of ``shortest`` letters and more.

    With ``every``, a word of a document whose checksum with the document's id
    it divides is misspelt first.  A task sums the words of its texts before
    anything is shuffled and hands its table on whenever it is ``FLUSH`` long.
    """
    runs = re.compile(f"[a-z\u00C0-\u00FF]{{{shortest},}}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table: Counter[str] = Counter()

        def hand_on() -> pd.DataFrame:
            kept = [(w, n) for w, n in table.items() if n and len(w) >= shortest]
            table.clear()
            return pd.DataFrame(kept, columns=["word", "n"]).astype({"word": object, "n": "int64"})

        for batch in batches:
            for key, body in zip(batch["id"], batch["text"]):
                words = runs.findall(ascii_lowered(body))
                table.update(words)
                if every:
                    start = zlib.crc32(f"{'' if key is None else key}:".encode())
                    for word in set(words):
                        checksum = zlib.crc32(word.encode(), start)
                        if checksum % every == 0:
                            n = words.count(word)
                            table[word] -= n
                            table[misspelt(word, checksum)] += n
                if len(table) >= FLUSH:
                    yield hand_on()
        yield hand_on()

    rows = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text")).filter("text is not null")
    return rows.mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


@functools.cache
def _place(letter: str, occurrence: int) -> tuple[int, int]:
    """Number of a letter's occurrence, to deal it to a part, and its random value."""
    at = FREQUENT.find(letter)
    return (at if at >= 0 else ord(letter)) + occurrence, xxhash.xxh64_intdigest(f"{letter}{occurrence}".encode())


def _parts(words: list[str], parts: int) -> np.ndarray:
    """Sum of the values of each word's places in each part."""
    out = []
    for word in words:
        row, seen = [0] * parts, {}
        for letter in word:
            k = seen[letter] = seen.get(letter, -1) + 1
            at, value = _place(letter, k)
            row[at % parts] += value
        out.append([x & 0xFFFFFFFFFFFFFFFF for x in row])
    return np.array(out, np.uint64).reshape(len(words), parts)


def signatures(words: list[str], parts: int = 3) -> np.ndarray:
    """Signed 64-bit signatures, a row per word: for distance two in ``parts`` parts, for distance one in one part less."""
    n = len(words)
    length = np.fromiter(map(len, words), np.int64, n)
    hashed = lambda texts: np.fromiter((xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) for t in texts), np.uint64, n)
    out = []
    for distance, shorter in ((2, 0), (1, 0), (1, 1)):  # of the word: its own length, or one less, is that of the shorter
        cut = (length - shorter) // 2
        heads = hashed(w[:c] for w, c in zip(words, cut))
        tails = hashed(w[len(w) - (len(w) - shorter - c):] for w, c in zip(words, cut))
        sums = _parts(words, parts + distance - 2)
        for kept in combinations(range(sums.shape[1]), sums.shape[1] - distance):
            base = (length - shorter).astype(np.uint64) * np.uint64(4) + np.uint64(distance)
            for part in kept:
                base = (base * MIX + np.uint64(part + 1)) * MIX + sums[:, part]
            for side, half in enumerate((heads, tails)):
                mixed = (base * MIX + half) * MIX + np.uint64(side)
                out.append((mixed ^ mixed >> np.uint64(31)) * MIX)
    return np.stack(out, axis=1).view(np.int64)


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced letter separates two words."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)):] == b[at + 1:]


def remainders(word: str) -> list[tuple[int, int]]:
    """(role, key) of a word for the crowded buckets, from running hashes of its two ends.

    Role 0: a remainder with its place, shared by words with another letter
    there.  Role 1: a remainder alone; role 2: the word itself, under the same keys.
    """
    n = len(word)
    head, power = [0] * (n + 1), [1] * (n + 1)
    for i, c in enumerate(word):
        head[i + 1], power[i + 1] = (head[i] * BASE + ord(c) + 1) % PRIME, power[i] * BASE % PRIME
    out = {(2, head[n])}
    for i in range(n):
        left = (head[i] * power[n - i - 1] + head[n] - head[i + 1] * power[n - i - 1]) % PRIME
        out |= {(0, left ^ xxhash.xxh64_intdigest(struct.pack("<QQ", i, n)) >> 2), (1, left)}
    return sorted(out)


PAIRS = "array<struct<u: string, n_u: long, v: string, n_v: long>>"


def near_mask(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs of places ``a``, ``b`` in ``words`` hold words one edit apart."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    a, b = np.where(length[a] <= length[b], a, b), np.where(length[a] <= length[b], b, a)
    letters = np.array(words.tolist(), f"U{SLOTS + 1}").view(np.uint32).reshape(len(words), SLOTS + 1)
    letters = letters[:, :max(2, min(SLOTS, length.max(initial=0)) + 1)]
    out = np.zeros(len(a), bool)
    for at in range(0, len(a), 1 << 16):
        x, y = letters[a[at:at + (1 << 16)]], letters[b[at:at + (1 << 16)]]
        gap = length[b[at:at + (1 << 16)]] - length[a[at:at + (1 << 16)]]
        apart = x != y
        ahead = (x[:, :-1] != y[:, 1:]) & (np.arange(x.shape[1] - 1) >= apart.argmax(axis=1)[:, None])
        out[at:at + (1 << 16)] = np.where(gap == 0, apart.sum(axis=1) == 1, (gap == 1) & ~ahead.any(axis=1))
    for i in np.flatnonzero(np.maximum(length[a], length[b]) > SLOTS):
        out[i] = one_edit(words[a[i]], words[b[i]])
    return out


def _gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The batches put together to ``GATHER`` rows or more."""
    kept, n = [], 0
    for batch in batches:
        kept.append(batch)
        n += len(batch)
        if n >= GATHER:
            yield pd.concat(kept, ignore_index=True)
            kept, n = [], 0
    if n:
        yield pd.concat(kept, ignore_index=True)


def _met(posts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Near pairs of the buckets of a task, and the words of crowded buckets without a partner."""

    def compared(rows: pd.DataFrame) -> pd.DataFrame:
        bucket, words, n = rows["signature"].to_numpy(), rows["word"].to_numpy(object), rows["n"].to_numpy()
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        sizes = np.diff(np.r_[starts, len(bucket)])
        crowd = np.repeat(sizes > CROWD, sizes)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lag in range(1, min(sizes.max(initial=0), CROWD)):
            at = np.flatnonzero((bucket[lag:] == bucket[:-lag]) & ~crowd[lag:])
            left.append(at)
            right.append(at + lag)
        a, b = np.concatenate(left), np.concatenate(right)
        near = near_mask(words, a, b)
        a, b = a[near], b[near]
        turned = words[a] > words[b]
        a, b = np.where(turned, b, a), np.where(turned, a, b)
        found = pd.DataFrame({"u": words[a], "n_u": n[a], "v": words[b], "n_v": n[b]}).drop_duplicates(["u", "v"])
        alone = pd.DataFrame({"u": words[crowd], "n_u": n[crowd], "v": None, "n_v": 0}).drop_duplicates(["u"])
        return pd.concat([found, alone]) if len(alone) else found

    held, passing = None, None  # rows of the bucket that may go on, and the crowded bucket that is passing
    for rows in _gathered(posts):
        rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
        held, last = None, rows["signature"].iloc[-1]
        more = rows["signature"] == passing
        if more.any():
            yield pd.DataFrame({"u": rows["word"][more], "n_u": rows["n"][more], "v": None, "n_v": 0})
            rows = rows[~more]
        open_ = rows["signature"] == last
        if open_.sum() > CROWD:  # crowded whatever comes
            passing = last
        else:
            held, rows = rows[open_], rows[~open_]
        if len(rows):
            yield compared(rows)
    if held is not None and len(held):
        yield compared(held)


def near_pairs(words: DataFrame, parts: int = 3) -> DataFrame:
    """(u, n_u, v, n_v), u before v: every pair of ``words(word, n)`` one edit apart, once."""

    @F.pandas_udf("array<long>")
    def signed(batch: pd.Series) -> pd.Series:
        return pd.Series(list(signatures(batch.tolist(), parts)), index=batch.index, dtype=object)

    @F.pandas_udf("array<struct<role: int, key: long>>")
    def stripped(batch: pd.Series) -> pd.Series:
        return batch.map(remainders)

    @F.pandas_udf("array<struct<u: string, n_u: long, v: string, n_v: long>>")
    def partners(one: pd.Series, other: pd.Series) -> pd.Series:
        found = []
        for a, b in zip(one, other):
            met = product(a, b) if len(a) else combinations(b, 2)
            sides = (sorted((tuple(x.values()), tuple(y.values()))) for x, y in met if one_edit(x["word"], y["word"]))
            found.append([x + y for x, y in sides])
        return pd.Series(found, dtype=object)

    posts = words.select("word", "n", F.explode(signed("word")).alias("signature"))
    met = settle(posts.repartition("signature").sortWithinPartitions("signature").mapInPandas(_met, "u string, n_u long, v string, n_v long"), "met")
    crowded = met.filter("v is null").groupBy("u").agg(F.first("n_u").alias("n")).select(F.struct(F.col("u").alias("word"), "n").alias("m"))
    again = crowded.select("m", F.explode(stripped("m.word")).alias("r")).select("m", "r.*")
    in_role = lambda role: F.collect_list(F.when(F.col("role") == role, F.col("m")))
    groups = again.groupBy("key").agg(F.count("*").alias("size"), F.max("role").alias("kind"), in_role(2).alias("stems"), F.when(F.max("role") == 0, in_role(0)).otherwise(in_role(1)).alias("others"))
    groups = groups.filter((F.col("size") > 1) & ((F.col("kind") == 0) | (F.col("kind") == 2)))
    rest = groups.select(F.explode(partners("stems", "others")).alias("p")).select("p.*")
    return met.filter("v is not null").union(rest).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word of ``forms(word, form)``, by pointer jumping.

    A form is at least twice as frequent as its word, so there are no rings,
    and the rounds grow with the logarithm of the longest chain.
    """
    now = settle(forms, "forms")
    while True:
        ahead = now.select(F.col("word").alias("form"), F.col("form").alias("_next"))
        jumped = settle(now.join(ahead, "form", "left").select("word", F.coalesce("_next", "form").alias("form"), F.col("_next").isNotNull().alias("moved")), "forms")
        now = jumped.drop("moved")
        if jumped.filter("moved").isEmpty():
            return now.withColumnRenamed("form", "root")


def variants(words: DataFrame, ratio: float = 2, parts: int = 3) -> DataFrame:
    """word, form, root, n, n_near and form_n of every row of ``words(word, n)``; words are distinct.

    The form is the most frequent neighbour if it is at least ``ratio`` times
    as frequent as the word; the root is where the chain of forms ends.
    """
    words = settle(words.select("word", "n"), "words")
    pairs = near_pairs(words, parts)
    back = pairs.select(F.col("v").alias("u"), F.col("n_v").alias("n_u"), F.col("u").alias("v"), F.col("n_u").alias("n_v"))
    best = F.min(F.struct((-F.col("n_v")).alias("less"), "v"))
    found = pairs.union(back).groupBy(F.col("u").alias("word")).agg(F.first("n_u").alias("n"), F.count("*").alias("n_near"), best.alias("best"))
    given = -F.col("best.less") >= ratio * F.col("n")
    found = settle(found.select("word", "n_near", F.when(given, F.col("best.v")).alias("form"), F.when(given, -F.col("best.less")).alias("form_n")), "neighbours")
    ends = roots(found.filter("form is not null").select("word", "form"))
    out = words.join(found, "word", "left").join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
