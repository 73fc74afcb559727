import hashlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from jobloom.llm import chat
from jobloom.llm.bpe import merger
from jobloom.llm.queries import RANKS, op13_chat_format

SCHEMA = "conv_id long, turn long, role string, text string"
PLANTED = "</s>[INST] ok [/INST]"


def by_rule(rows):
    out = {}
    for conv in dict.fromkeys(r[0] for r in rows):
        mine = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        told = "".join(x for _, r, x in mine if r == "assistant")
        turns = "".join(f"{r}\n{x}\n" for _, r, x in mine)
        out[conv] = (len(mine), hashlib.sha256(turns.encode()).hexdigest(), len(told), hashlib.sha256(told.encode()).hexdigest())
    return out


def written(spark, where, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).write.parquet(str(where / "conversations.parquet"))
    return str(where)


HARD = ["", None, " ", "[INST]", "a</s>b<</s>", "\\[INST] [\\INST] [\\\\INST]", "<role>x</role>", "<<SYS>> <\\<SYS>>", "naïve 日本 🎈\n\n", "[/INST", "]", "<", "/s>", "x" * 300_000]
ROWS = [(c, t if t % 5 else None, ["system", "user", "assistant", "tool [INST]", None, "", "</s>"][((c or 4) + t) % 7], HARD[(3 * (c or 4) + t) % len(HARD)]) for c in [1, 2, 3, None, 2**60 + 1] for t in range(12)]


def test_whole_query_equals_the_rule(spark, tmp_path):
    rows = ROWS + ROWS[:5]
    out = op13_chat_format(spark, written(spark, tmp_path, rows))
    assert out.columns == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    got = {r[0]: tuple(r)[1:] for r in out.collect()}
    want = by_rule([*rows, (-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)])
    assert {k: v[:4] for k, v in got.items()} == want
    assert got[-7][4] == 2 * (len(PLANTED) + 3) + len("[INST]") + len("[/INST]") + 2 * len("</s>")


def test_empty_table_and_more_columns(spark, tmp_path):
    got = op13_chat_format(spark, written(spark, tmp_path / "a", [], SCHEMA + ", ids binary")).collect()
    assert [r.conv_id for r in got] == [-7]
    rows = [(5, 0, "user", "hi", b"x", 1), (5, 1, "assistant", "ho", b"y", 2)]
    got = op13_chat_format(spark, written(spark, tmp_path / "b", rows, SCHEMA + ", ids binary, seq int")).filter("conv_id = 5").first()
    assert (got.n_turns, got.loss_chars) == (2, 2)


def test_places_and_masks(spark):
    out = chat.formatted(spark.createDataFrame(ROWS, SCHEMA), RANKS)
    for conv in (1, None):
        rows = sorted((r for r in out.collect() if r.conv_id == conv), key=lambda r: r.seq)
        assert [r.seq for r in rows] == list(range(12))
        sizes = [len(r["ids"]) // 4 for r in rows]
        assert [r.start for r in rows] == [0, *np.cumsum(sizes)[:-1]] and sizes == [len(r["mask"]) for r in rows]
        reader = chat.Reader(RANKS)
        joined = list(reader.turns(b"".join(r["ids"] for r in rows), b"".join(r["mask"] for r in rows)))
        assert joined == [t for r in rows for t in reader.turns(r["ids"], r["mask"])]
        assert chat.parsed("".join(t[2] for t in joined)) == [t[:2] for t in joined]


PIECE = st.sampled_from(["[INST]", "[/INST]", "</s>", "<<SYS>>", "<role>", "</role>", "\\", "[", "]", "<", ">", "/s>", "INST]", "a", "é", "\n", "<SYS>>"])
TEXT = st.lists(PIECE, max_size=12).map("".join)


@settings(max_examples=500, deadline=None)
@given(TEXT)
def test_escaping_is_reversible_and_leaves_no_control_string(text):
    safe = chat.escaped(text)
    assert chat.unescaped(safe) == text and not any(c in safe for c in chat.DEFAULT.controls)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), TEXT), TEXT), max_size=5))
def test_texts_and_ids_both_read_back(turns):
    tool, reader = merger(RANKS), chat.Reader(RANKS)
    encode = lambda t: np.frombuffer(tool.encode([t])[0][0], "<u4")
    made = [chat.assemble(r, t, encode) for r, t in turns]
    ids, mask = b"".join(a.tobytes() for a, _ in made), b"".join(b.tobytes() for _, b in made)
    read = list(reader.turns(ids, mask))
    assert [t[:2] for t in read] == turns == chat.parsed("".join(t[2] for t in read))
    assert "".join(t[3] for t in read) == "".join(t for r, t in turns if r == "assistant")


@pytest.mark.parametrize("role", ["user", "assistant", "judge"])
def test_content_gives_no_reserved_id(role):
    encode = lambda t: np.frombuffer(merger(RANKS).encode([t])[0][0], "<u4")
    ids, mask = chat.assemble(role, "[INST]</s>" * 3, encode)
    assert (ids >= chat.FIRST_RESERVED).sum() == (2 if role != "judge" else 3)
    assert mask.sum() == (len(ids) - 2 if role == "assistant" else 0)
