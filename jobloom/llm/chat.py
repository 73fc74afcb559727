"""Chat formatting by token-level assembly.

A turn is encoded on its own and reserved ids are spliced around it: one that
opens a turn of its role, and one that closes it.  Roles without an id of
their own are spelt out between the id for any role and the id that ends a
name.  Encoded text never yields a reserved id, so no content can open or
close a turn; a string of the template inside a text is escaped all the same,
so that the formatted text may be parsed as well: a backslash goes behind the
first character of the string, and behind the backslashes that already stand
there.  ``unescaped`` takes one away again.

The mask comes from prefix sums over marks at the places where learnt text
begins and ends; places of turns in the conversation are prefix sums over the
lengths of the turns before.  A conversation stays a row per turn with its
place: turns are encoded wherever their rows are, and only sorted and summed by
conversation, as a stream.

Edge cases: null text and null role are empty; rows come by turn (null first),
then role and text, so repeated rows stand side by side and all stay; an empty
text still has its turn; an empty table gives an empty result; columns beyond
the four named are not read.
"""

import functools
import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from jobloom.llm.bpe import merger

FIRST_RESERVED = 1 << 20  # above the ids of every vocabulary here


class Template(NamedTuple):
    """What opens and closes turns; no string may hold another or share an end with the start of one."""

    opens: tuple = (("system", "<<SYS>>"), ("user", "[INST]"), ("assistant", "[/INST]"))
    other: str = "<role>"
    named: str = "</role>"
    close: str = "</s>"
    learnt: str = "assistant"

    @property
    def controls(self) -> list[str]:
        return [s for _, s in self.opens] + [self.other, self.named, self.close]

    @property
    def ids(self) -> dict[str, int]:
        return {s: FIRST_RESERVED + i for i, s in enumerate(self.controls)}


DEFAULT = Template()


@functools.cache
def _patterns(template: Template) -> tuple[re.Pattern, re.Pattern]:
    longest = sorted(template.controls, key=len, reverse=True)
    either = lambda between: re.compile("|".join(f"({re.escape(s[0])}){between}({re.escape(s[1:])})" for s in longest))
    return either(r"(\\*)"), either(r"\\(\\*)")


def escaped(text: str, template: Template = DEFAULT) -> str:
    """The text with a backslash inside every control string, escaped or not."""
    return _patterns(template)[0].sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescaped(text: str, template: Template = DEFAULT) -> str:
    """The text that ``escaped`` was given."""
    return _patterns(template)[1].sub(lambda m: m[0][0] + m[0][2:], text)


def parsed(whole: str, template: Template = DEFAULT) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted text."""
    role = {s: name for name, s in template.opens}
    pieces = re.split("(" + "|".join(map(re.escape, sorted(template.controls, key=len, reverse=True))) + ")", whole)[1:]
    out, name = [], ""
    for control, text in zip(pieces[::2], pieces[1::2]):
        if control in role:
            out.append((role[control], unescaped(text, template)))
        elif control == template.other:
            name = unescaped(text, template)
        elif control == template.named:
            out.append((name, unescaped(text, template)))
    return out


def assemble(role: str, text: str, encode, template: Template = DEFAULT) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a turn and its mask; ``encode`` gives the ids of a plain text."""
    ids = template.ids
    opener = dict(template.opens).get(role)
    head = [ids[opener]] if opener else [ids[template.other], *encode(escaped(role, template)), ids[template.named]]
    body = encode(escaped(text, template))
    whole = np.r_[head, body, ids[template.close]].astype("<u4")
    marks = np.zeros(len(whole) + 1, np.int64)
    if role == template.learnt:
        marks[len(head)] += 1
        marks[len(head) + len(body)] -= 1
    return whole, np.cumsum(marks)[:-1].astype(np.uint8)


def formatted(turns: DataFrame, path: str, template: Template = DEFAULT) -> DataFrame:
    """conv_id, seq, start, ids, mask of every turn of ``turns(conv_id, turn, role, text)``.

    ``ids`` (32-bit, little-endian) and ``mask`` (a byte per id) are packed;
    ``seq`` is the turn's number and ``start`` the place of its first id in the
    conversation.  ``path`` names the rank file on every machine.
    """

    @F.pandas_udf("ids binary, mask binary")
    def run(roles: pd.Series, texts: pd.Series) -> pd.DataFrame:
        tool = merger(path)
        roles, texts = roles.tolist(), texts.tolist()
        plain = [escaped(t, template) for t in texts]
        known = dict(zip(plain, (np.frombuffer(i, "<u4") for i, _ in tool.encode(plain))))
        encode = lambda t: known[t] if t in known else np.frombuffer(tool.encode([t])[0][0], "<u4")
        rows = [assemble(r, t, encode, template) for r, t in zip(roles, texts)]
        return pd.DataFrame([(a.tobytes(), b.tobytes()) for a, b in rows], columns=["ids", "mask"])

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"))
    made = rows.withColumn("made", run("role", "text")).select("conv_id", "turn", "role", F.left("text", F.lit(64)).alias("head"), F.md5("text").alias("digest"), "made.*")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "head", "digest")
    before = F.sum((F.octet_length("ids") / 4).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return made.select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("seq"), F.coalesce(before, F.lit(0)).alias("start"), "ids", "mask")


class Reader:
    """Turns and learnt text read back from the ids of a conversation, turn by turn."""

    def __init__(self, path: str, template: Template = DEFAULT):
        self.tool, self.template = merger(path), template
        self.names = {i: s for s, i in template.ids.items()}
        self.roles = {template.ids[s]: role for role, s in template.opens}

    def text(self, ids: np.ndarray) -> str:
        return self.tool.decode(ids.astype("<u4").tobytes()).decode("utf-8", "surrogatepass")

    def turns(self, packed: bytes, mask: bytes) -> Iterator[tuple[str, str, str, str]]:
        """(role, text, formatted text, learnt text) of every turn in a stretch of ids."""
        ids, learnt = np.frombuffer(packed, "<u4"), np.frombuffer(mask, np.uint8).astype(bool)
        template = self.template
        ends = np.flatnonzero(ids == template.ids[template.close]) + 1
        for a, b in zip(np.r_[0, ends[:-1]], ends):
            one = ids[a:b]
            if int(one[0]) in self.roles:
                role, at = self.roles[int(one[0])], 1
                shown = self.names[int(one[0])]
            else:
                at = int(np.flatnonzero(one == template.ids[template.named])[0]) + 1
                spelt = self.text(one[1:at - 1])
                role, shown = unescaped(spelt, template), template.other + spelt + template.named
            body = self.text(one[at:-1])
            told = unescaped(self.text(one[learnt[a:b]]), template)
            yield role, unescaped(body, template), shown + body + template.close, told


def read_back(rows: DataFrame, path: str, template: Template = DEFAULT) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from the ids and masks alone.

    A conversation's turns pass one task in order, one at a time: its digests
    are sums over all its text.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, done, key = Reader(path, template), [], None
        columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        close = lambda: done.append((key[0], n, turns.hexdigest(), chars, loss.hexdigest(), shown))
        n = chars = shown = 0
        turns = loss = None
        for frame in frames:
            for conv, ids, mask in zip(frame["conv_id"].tolist(), frame["ids"].tolist(), frame["mask"].tolist()):
                if key is None or key[0] != conv:
                    if key is not None:
                        close()
                    key, n, chars, shown, turns, loss = (conv,), 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                for role, text, whole, told in reader.turns(ids, mask):
                    turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    loss.update(told.encode("utf-8", "surrogatepass"))
                    n, chars, shown = n + 1, chars + len(told), shown + len(whole)
            if done:
                yield pd.DataFrame(done, columns=columns)
                done.clear()
        if key is not None:
            close()
            yield pd.DataFrame(done, columns=columns)

    kind = rows.schema["conv_id"].dataType
    ordered = rows.select("conv_id", "seq", "ids", "mask").repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    out = ordered.select(F.col("conv_id").cast("string"), "ids", "mask").mapInPandas(
        run, "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.withColumn("conv_id", F.col("conv_id").cast(kind))
