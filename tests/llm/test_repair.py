import hashlib
import heapq
import random
import re
import zlib
from itertools import product

from hypothesis import given, settings, strategies as st

from jobloom.llm import repair
from jobloom.llm.queries import op11_conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string"


def search(rows, insert=5):
    """All cheapest edits by a table of (cost, edits) per place and roles so far, shortest path."""
    done = {}
    queue = [(0, "", 0, "", ())]
    while queue:
        cost, audit, at, last, out = heapq.heappop(queue)
        if (at, last) in done:
            continue
        done[at, last] = 1
        if at == len(rows) and last in ("", "a"):
            return cost, audit, list(out)
        ahead = "a" if last == "u" else "u"
        name = {"u": "user", "a": "assistant"}[ahead]
        heapq.heappush(queue, (cost + insert, audit + "I", at, ahead, out + ((name, ""),)))
        if at == len(rows):
            continue
        role, text, fault = rows[at]
        heapq.heappush(queue, (cost + 2, audit + "D", at + 1, last, out))
        if fault in ("blank", "duplicate"):
            continue
        more = 5 * (fault == "truncated")
        if role[:1] == ahead or role[:1] == "s" and last == "":
            heapq.heappush(queue, (cost + more, audit + "K", at + 1, role[:1], out + ((role, text),)))
        heapq.heappush(queue, (cost + 1 + more, audit + "R", at + 1, ahead, out + ((name, text),)))


def by_rule(rows):
    out = {}
    for conv in dict.fromkeys(r[0] for r in rows):
        mine = []
        for _, turn, role, text in [r for r in rows if r[0] == conv]:
            shown = lambda x: " " if x is None else str(x)
            harm = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
            role, text = shown(role), shown(text)
            if harm == 0:
                continue
            text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
            mine += [(turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faulty, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in mine:
            words = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None
            seen.add((role, text))
            faulty.append((role, text, fault))
            if fault:
                n[fault] += 1
        turns = {t for t, *_ in mine if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, fixed = search(faulty)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, digest)
    return out


def answers(spark, tmp_path, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "conversations.parquet"))
    out = op11_conversation_repair(spark, str(tmp_path))
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = [tuple(r) for r in out.collect()]
    assert len({r[0] for r in got}) == len(got)
    return {r[0]: r[1:] for r in got}


def many():

    rng = random.Random(5)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t", None, "Same.", "é。", "end.  "]
    rows = []
    for conv in [*range(60), None, 2**60 + 1, 2**60 + 3]:
        for turn in range(rng.randint(1, 14)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "unit"])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), role, rng.choice(texts)))
    rows += [(700, t, ["user", "assistant"][t % 2], f"Turn {t}.") for t in range(3000)]  # longer than many blocks
    return rows + rows[:40]


def test_equals_the_search_by_states(spark, tmp_path):
    rows = many()
    got, want = answers(spark, tmp_path, rows), by_rule(rows)
    assert got == want
    assert any("R" in w[6] for w in want.values()) and any(w[0] for w in want.values())


def test_dropped_conversations_and_empty_table(spark, tmp_path):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert answers(spark, tmp_path / "a", [(gone, 0, "user", "x.")]) == {gone: (0, 0, 0, 0, 0, 0, "", empty)}
    assert answers(spark, tmp_path / "b", []) == {}


def test_hot_and_repeated_rows_and_more_columns(spark, tmp_path):
    rows = [(1, 4, "user", "Again.", "x", 1)] * 500 + [(1, t, "assistant", "Again.", "y", 2) for t in range(500, 900)] + [(2, 0, "user", "a." * 200_000, "z", 3)]
    got = answers(spark, tmp_path, rows, SCHEMA + ", audit string, symbol int")
    assert got == by_rule([r[:4] for r in rows])


SYMBOL = st.integers(0, repair.SYMBOLS - 1)


@settings(max_examples=300, deadline=None)
@given(st.lists(SYMBOL, max_size=13), st.sampled_from([1, 2, 3, 4]), st.sampled_from([1, 2, 5]))
def test_blocks_equal_the_search(symbols, block, insert):
    named = [("x", "", "blank") if s == 0 else ("suat"[(s - 1) // 2], "t", "truncated" if (s - 1) % 2 else None) for s in symbols]
    assert repair.cheapest(bytes(symbols), repair.Costs(insert=insert), block) == search(named, insert)[:2]


def test_all_short_strings():
    for n in range(4):
        for symbols in product(range(repair.SYMBOLS), repeat=n):
            assert repair.cheapest(bytes(symbols), block=2) == repair.cheapest(bytes(symbols), block=1)
    assert len(repair.tables().vectors) < 60
