"""Repair of conversation structure by Four-Russians block tables.

A conversation is a string of symbols, one per row: must go (blank or a
duplicate), or the initial of its role (s, u, a, other) with or without a
truncated text.  The roles it may have form a small automaton (nothing yet, a
system turn, a user turn, an assistant turn), and for every suffix of the
string a vector says what the cheapest repair of that suffix costs from each
of its four states.  Without its least entry, a vector is one of a few dozen,
so what a block of ``BLOCK`` symbols does to it is looked up in a table made
once: the vector before the block, and the cost it adds.

Conversations are read from their end, a lookup per block, which leaves the
vector at every block's end.  Then they are traced from their start: a block
is expanded backward from the vector at its end into one vector per symbol,
and the edits of a symbol depend on its state and the vector behind it alone.
Costs to come are known exactly, so of all cheapest repairs the one whose
edits are first in ASCII order is followed without going back.

Equal rows of one turn are counted before they move, earlier equal texts are
found by an aggregate over (conversation, digest of role and text), and no
texts move for the search of a repair.  The search holds a few bytes per row of
one conversation, as its result does; the repaired texts stream past in order.

Edge cases: a null role, text, id or turn reads as one space where a string of
it is asked for (so a null text is blank); rows without a turn come first;
rows of one turn are ordered by role and text (its first ``HEAD`` code points,
then its digest); equal rows of a turn stand together, so all but one are duplicates; an empty table gives an empty result;
columns other than the four named are not read.
"""

import functools
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = 4
START, SYSTEM, USER, ASSISTANT = range(4)
AHEAD = (USER, USER, ASSISTANT, USER)  # where a user or assistant turn leads from each state
ROLES = {USER: "user", ASSISTANT: "assistant"}
GO = 0  # the symbol of a row that must go; others are 1 + 2 * initial (s, u, a, other) + truncated
SYMBOLS = 1 + 2 * 4
FAR = 1 << 20
HEAD = 64


class Costs(NamedTuple):
    delete: int = 2
    insert: int = 5
    keep: int = 0
    rerole: int = 1
    truncated: int = 5


def _kept(symbol: int, state: int) -> int | None:
    """State after a row that keeps its role, or None."""
    initial = (symbol - 1) // 2
    if symbol == GO or initial == 3:
        return None
    if initial == 0:
        return SYSTEM if state == START else None
    to = initial + 1
    return to if AHEAD[state] == to else None


def _with_inserts(vector: list[int], costs: Costs) -> tuple[int, ...]:
    out = list(vector)
    for _ in range(4):
        for state in range(4):
            out[state] = min(out[state], costs.insert + out[AHEAD[state]])
    return tuple(out)


def _edits(symbol: int, state: int, costs: Costs) -> list[tuple[str, int, int]]:
    """Edits that use up a row: letter, cost and next state."""
    out = [("D", costs.delete, state)]
    if symbol != GO:
        more = costs.truncated * ((symbol - 1) % 2)
        kept = _kept(symbol, state)
        if kept is not None:
            out.append(("K", costs.keep + more, kept))
        out.append(("R", costs.rerole + more, AHEAD[state]))
    return out


def _before(symbol: int, vector: tuple[int, ...], costs: Costs) -> tuple[int, ...]:
    return _with_inserts([min(c + vector[to] for _, c, to in _edits(symbol, state, costs)) for state in range(4)], costs)


def _letters(symbol: int, state: int, after: tuple[int, ...], costs: Costs) -> tuple[str, int]:
    """Edits of one row, ASCII-least among the cheapest, and the state behind it."""
    vector, out = _before(symbol, after, costs), ""
    while True:
        options = [(letter, to) for letter, c, to in _edits(symbol, state, costs) if c + after[to] == vector[state]]
        if costs.insert + vector[AHEAD[state]] == vector[state]:
            options.append(("I", AHEAD[state]))
        letter, state = min(options)
        out += letter
        if letter != "I":
            return out, state


class Tables(NamedTuple):
    vectors: list[tuple]       # least entry 0; the first stands behind the last row
    one: list[list[int]]       # vector before a symbol, by vector and symbol
    cost_one: list[list[int]]  # what the symbol adds
    block: list[list[int]]     # vector before a block, by vector and block
    cost: list[list[int]]      # what the block adds
    letters: list              # (edits, next state), by vector behind, symbol and state
    close: list[str]           # edits behind the last row, by state


@functools.cache
def tables(costs: Costs = Costs(), block: int = BLOCK) -> Tables:
    """Transitions of the normalised vectors that occur, for symbols and blocks."""
    vectors = [_with_inserts([0, FAR, FAR, 0], costs)]
    place, one, cost_one = {vectors[0]: 0}, [], []
    for vector in vectors:  # grows while new ones are found
        ids, adds = [], []
        for symbol in range(SYMBOLS):
            before = _before(symbol, vector, costs)
            least = min(before)
            slim = tuple(x - least for x in before)
            if slim not in place:
                place[slim] = len(vectors)
                vectors.append(slim)
            ids.append(place[slim])
            adds.append(least)
        one.append(ids)
        cost_one.append(adds)
    step, add = np.array(one), np.array(cost_one)
    whole, total = np.arange(len(vectors))[:, None], np.zeros((len(vectors), 1), np.int64)
    for _ in range(block):  # a block is read from its end: its first symbol comes last, and is its highest digit
        total = np.concatenate([total + add[whole, s] for s in range(SYMBOLS)], axis=1)
        whole = np.concatenate([step[whole, s] for s in range(SYMBOLS)], axis=1)
    letters = [[[_letters(symbol, state, v, costs) for state in range(4)] for symbol in range(SYMBOLS)] for v in vectors]
    close = []
    for state in range(4):
        n = 0
        while state not in (START, ASSISTANT):
            state, n = AHEAD[state], n + 1
        close.append("I" * n)
    return Tables(vectors, one, cost_one, whole.tolist(), total.tolist(), letters, close)


def cheapest(symbols: bytes, costs: Costs = Costs(), block: int = BLOCK) -> tuple[int, str]:
    """Cost and edits of the cheapest repair, ASCII-least among equals."""
    t = tables(costs, block)
    n = len(symbols)
    whole = n // block
    digits = np.frombuffer(symbols, np.uint8)[:whole * block].reshape(whole, block) @ (SYMBOLS ** np.arange(block - 1, -1, -1))
    at, total = 0, 0
    rest = []  # vectors behind the symbols after the last whole block
    for symbol in reversed(symbols[whole * block:]):
        rest.append(at)
        total += t.cost_one[at][symbol]
        at = t.one[at][symbol]
    ends = []
    for number in reversed(digits.tolist()):
        ends.append(at)
        total += t.cost[at][number]
        at = t.block[at][number]
    total += t.vectors[at][START]
    out, state = [], START
    for i in range(whole):
        piece = symbols[i * block:(i + 1) * block]
        behind = [ends[whole - 1 - i]]
        for symbol in reversed(piece[1:]):
            behind.append(t.one[behind[-1]][symbol])
        for symbol, vector in zip(piece, reversed(behind)):
            edits, state = t.letters[vector][symbol][state]
            out.append(edits)
    for symbol, vector in zip(symbols[whole * block:], reversed(rest)):
        edits, state = t.letters[vector][symbol][state]
        out.append(edits)
    return total, "".join(out) + t.close[state]


def _string(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(turns: DataFrame) -> DataFrame:
    """Rows with the damage that the checksum of conversation and turn asks for; ``copies`` counts equal rows of a turn."""
    rows = turns.select("conv_id", "turn", _string("role").alias("role"), _string("text").alias("text"))
    harm = F.crc32(F.concat(_string("conv_id"), F.lit(":"), _string("turn")).cast("binary")) % 20
    text = F.when(harm == 1, "").when(harm == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.withColumn("harm", harm).filter("harm <> 0").select(
        "conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.when(F.col("harm") == 3, 2).otherwise(1).alias("copies"))


SPACE = r"[\x20\x09-\x0D]"


def faults(rows: DataFrame) -> DataFrame:
    """Slim rows of ``rows(conv_id, turn, role, text, copies)``: order, symbol and fault of every distinct row of a turn, and its number."""
    bare = F.regexp_replace("text", SPACE + "+$", "")
    digest = F.unhex(F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text")))
    slim = rows.select(
        "conv_id", "turn", F.col("turn").isNotNull().alias("timed"), "role", digest.alias("digest"), F.left("text", F.lit(HEAD)).alias("head"), "copies",
        (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("truncated"),
    )
    same = slim.groupBy("conv_id", "turn", "timed", "digest").agg(
        F.sum("copies").alias("copies"), *[F.first(c).alias(c) for c in ("role", "head", "blank", "truncated")])
    first = same.groupBy("conv_id", "digest").agg(F.min(F.struct("timed", "turn")).alias("first"))
    null_safe = lambda c: same[c].eqNullSafe(first[c])
    joined = same.join(first, null_safe("conv_id") & (same.digest == first.digest)).select(same["*"], first["first"])
    again = ~F.struct("timed", "turn").eqNullSafe(F.col("first"))
    letter = F.left("role", F.lit(1))
    initial = F.when(letter == "s", 0).when(letter == "u", 1).when(letter == "a", 2).otherwise(3)
    symbol = F.when(F.col("blank") | again, GO).otherwise(1 + 2 * initial + F.col("truncated").cast("int"))
    return joined.select("conv_id", "turn", "timed", "role", "head", "digest", "copies", "blank", "truncated", again.alias("again"), initial.cast("int").alias("initial"), symbol.cast("int").alias("symbol"))


ORDER = ["timed", "turn", "role", "head", "digest"]
FOUND = "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _by_conversation(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows of a conversation in one task and in order; they are read as a stream."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def _searched(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts and cheapest repair of every conversation of a sorted stream."""
    legal = {(0, 1), (1, 2), (2, 1)}
    key, counts, symbols, last, turns = None, None, bytearray(), None, None
    done = []

    def close():
        cost, audit = cheapest(bytes(symbols))
        low, high, distinct = turns
        gaps = 0 if low is None else high - low + 1 - distinct
        done.append((key[0], gaps, *counts, cost, audit))

    for frame in frames:
        columns = [frame[c].tolist() for c in ("conv_id", "turn", "timed", "copies", "blank", "again", "truncated", "initial", "symbol")]
        for conv, turn, timed, copies, blank, again, cut, initial, symbol in zip(*columns):
            if key is None or key[0] != conv:
                if key is not None:
                    close()
                key, counts, symbols, last, turns = (conv,), [0, 0, 0, 0], bytearray(), None, (None, None, 0)
            if timed:
                low, high, distinct = turns
                turns = (turn if low is None else low, turn, distinct + (high != turn))
            counts[0] += copies if blank else 0
            counts[1] += 0 if blank else copies - (not again)
            counts[2] += not blank and not again and cut
            counts[3] += (last is not None and (last, initial) not in legal) + (copies - 1) * ((initial, initial) not in legal)
            last = initial
            symbols.append(symbol)
            symbols.extend(bytes(copies - 1))
        if done:
            yield pd.DataFrame(done, columns=["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])
            done = []
    if key is not None:
        close()
        yield pd.DataFrame(done, columns=["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])


def _as_ids(out: DataFrame, like: DataFrame) -> DataFrame:
    """Ids in the type of ``like``; they pass Python as strings, so that nulls and large numbers stay what they are."""
    return out.withColumn("conv_id", F.col("conv_id").cast(like.schema["conv_id"].dataType))


def repairs(rows: DataFrame) -> DataFrame:
    """conv_id, counts of faults, cost and edits of the cheapest repair of every conversation of ``rows``."""
    read = _by_conversation(faults(rows), ORDER).select(
        F.col("conv_id").cast("string"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), "timed", "copies", "blank", "again", "truncated", "initial", "symbol")
    return _as_ids(read.mapInPandas(_searched, FOUND), rows)


def _told(audit: str, role: str, text: str, at: int, state: int) -> tuple[list[tuple[str, str]], int, int]:
    """Turns that the edits of one row give, and where the edits and the state stand then."""
    out = []
    while True:
        letter = audit[at]
        at += 1
        if letter == "D":
            return out, at, state
        if letter == "K":
            return [*out, (role, text)], at, SYSTEM if role[:1] == "s" else AHEAD[state]
        state = AHEAD[state]
        if letter == "R":
            return [*out, (ROLES[state], text)], at, state
        out.append((ROLES[state], ""))


def _rewritten(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Repaired turns of a sorted stream in which the edits of a conversation come before its rows."""
    audit, at, state, conv, seq = "", 0, START, None, 0

    def rest():
        nonlocal at, state, seq
        out = []
        while at < len(audit):  # inserts behind the last row
            state, at = AHEAD[state], at + 1
            out.append((conv, seq, ROLES[state], ""))
            seq += 1
        return out

    as_frame = lambda out: pd.DataFrame(out, columns=["conv_id", "seq", "role", "text"])
    for frame in frames:
        out = []
        for key, edits, role, text, copies in zip(*[frame[c].tolist() for c in ("conv_id", "audit", "role", "text", "copies")]):
            if edits is not None:
                out += rest()
                audit, at, state, conv, seq = edits, 0, START, key, 0
                continue
            for _ in range(int(copies)):
                told, at, state = _told(audit, role, text, at, state)
                for new_role, new_text in told:
                    out.append((conv, seq, new_role, new_text))
                    seq += 1
        if out:
            yield as_frame(out)
    yield as_frame(rest())


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, seq, role, text of every turn after the repairs ``found``, in order within the partitions."""
    digest = F.unhex(F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text")))
    texts = rows.select(
        "conv_id", F.lit(1).alias("kind"), F.col("turn").isNotNull().alias("timed"), "turn", "role", F.left("text", F.lit(HEAD)).alias("head"), digest.alias("digest"),
        "text", F.col("copies").cast("long").alias("copies"), F.lit(None).cast("string").alias("audit"))
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in texts.schema.fields if f.name not in ("conv_id", "kind", "copies", "audit")]
    edits = found.select("conv_id", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("copies"), "audit", *blank)
    ordered = _by_conversation(texts.unionByName(edits), ["kind", *ORDER])
    read = ordered.select(F.col("conv_id").cast("string"), "audit", "role", "text", "copies")
    return _as_ids(read.mapInPandas(_rewritten, "conv_id string, seq long, role string, text string"), rows)


def _digested(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of the joined turns of every conversation of a stream in order."""
    key, digest, done = None, None, []
    for frame in frames:
        for conv, seq, role, text in zip(*[frame[c].tolist() for c in ("conv_id", "seq", "role", "text")]):
            if seq == 0:
                if key is not None:
                    done.append((key[0], digest.hexdigest()))
                key, digest = (conv,), hashlib.sha256()
            digest.update(f"{chr(10) if seq else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        if done:
            yield pd.DataFrame(done, columns=["conv_id", "sha256"])
            done = []
    if key is not None:
        yield pd.DataFrame([(key[0], digest.hexdigest())], columns=["conv_id", "sha256"])


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, sha256 of conversations whose turns (conv_id, seq, role, text) stand in order within the partitions."""
    return _as_ids(turns.withColumn("conv_id", F.col("conv_id").cast("string")).mapInPandas(_digested, "conv_id string, sha256 string"), turns)
