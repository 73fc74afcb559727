"""Personal data: patterns, and information-theoretic sanitisation.

The patterns give the protected entities.  How much a term tells about an
entity is estimated from the corpus: p(e | t) is the share of the term's
occurrences that stand within reach of the entity, and PMI(t; e) over the
entity's own information content, -log p(e), is the part of it that the term
discloses.  Terms above the upper threshold are removed, those above the
lower one generalised to their kind.  A term counts only if it accompanies
the entity in several surroundings that differ in most of their terms, so that
copies of one text or passage, exact or near, are no evidence.  A term that
discloses an entity does so wherever it stands, also in texts without the
entity, and is treated everywhere.

Edge cases: a null or empty text has no spans; equal rows have equal spans;
entities and terms may be very frequent (counts combine before the shuffle);
terms are looked for in the whole corpus; an empty table gives an empty
result.
"""

import re
import zlib
from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from jobloom.llm.common import small_batches
from jobloom.runtime import BROADCAST_ROWS, broadcast_if_small, settle

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
TERM = re.compile(r"[^\W_]+")
TERM_SQL = r"[\p{L}\p{N}]+"
ENOUGH = 16


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from their @ sign: linear in any text."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in LOCAL:
            begin -= 1
        match = DOMAIN.match(text, at) if begin < at else None
        if match:
            out.append((begin, match.end()))
        free = match.end() if match else at
        at = text.find("@", max(free, at + 1))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    small = lambda part: len(part := part.lstrip("0")) < 3 or len(part) == 3 and part <= "255"
    return [m.span() for m in IP.finditer(text) if all(map(small, m.group().split(".")))]


def luhn(digits: str) -> bool:
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CARD.finditer(text) if m.end() - m.start() < 40 and 13 <= len(d := NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d)]


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    return [(kind, a, b) for kind, find in zip(KINDS, (emails, ips, cards, phones)) for a, b in find(text)]


def surroundings(text: str, spans: list[tuple[str, int, int]], reach: int) -> list[dict]:
    """Terms within ``reach`` terms of each span, outside all spans, with a digest of what surrounds it."""
    out = []
    if not spans:
        return out
    begins, ends = [], []
    for a, b in sorted((a, b) for _, a, b in spans):
        begins.append(a)
        ends.append(max(b, ends[-1] if ends else 0))
    for kind, a, b in spans:
        low, high = max(0, a - 40 * reach), min(len(text), b + 40 * reach)
        whole = [m.span() for m in TERM.finditer(text, low, high) if (m.start() > low or low == 0) and (m.end() < high or high == len(text))]
        before, after = [x for x in whole if x[1] <= a][-reach:], [x for x in whole if x[0] >= b][:reach]
        near = [(x, y) for x, y in before + after if not (k := bisect_left(begins, y)) or ends[k - 1] <= x]
        digest = zlib.crc32(" ".join(text[x:y] for x, y in near).encode())
        entity = f"{kind}:{text[a:b] if kind in ('email', 'ip') else NOT_DIGIT.sub('', text[a:b])}".lower()
        out += [{"entity": entity, "window": digest, "term": text[x:y].lower(), "first": x, "last": y} for x, y in near]
    return out


FOUND = "spans array<struct<kind: string, first: long, last: long>>, near array<struct<entity: string, window: long, term: string, first: long, last: long>>"


def find(docs: DataFrame, reach: int = 4, text: str = "text") -> DataFrame:
    """Add the struct ``pii``: base spans, and the terms around them."""
    small_batches(docs.sparkSession)

    @F.pandas_udf(FOUND)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts.fillna(""):
            spans = base_spans(t)
            rows.append(([dict(zip(("kind", "first", "last"), s)) for s in spans], surroundings(t, spans, reach)))
        return pd.DataFrame(rows, columns=["spans", "near"])

    return docs.withColumn("pii", run(F.col(text)))


def disclosing(found: DataFrame, docs: DataFrame, support: int = 3, companions: float = 1 / 3, generalise: float = 0.5, remove: float = 0.9, text: str = "text") -> DataFrame:
    """(entity, term, disclosed, action): the terms that tell too much about an entity.

    ``found`` has the column ``near``; the terms are counted over the texts of
    ``docs``.  Only terms seen near one entity in ``support`` surroundings, and
    whose further surroundings bring that share ``companions`` of new neighbours on
    average (near copies bring few; past ``ENOUGH`` surroundings no more are asked,
    as words of a language recur), are looked up; if they are few they go to the
    texts, else counts come to them.
    """
    near = found.select(F.explode("near").alias("n")).select("n.*")
    joint = near.groupBy("entity", "term", "window").agg(F.count("*").alias("n")).groupBy("entity", "term").agg(F.sum("n").alias("joint"), F.count("*").alias("windows"))
    windows = near.groupBy("entity", "window").agg(F.collect_set("term").alias("terms"))  # the terms within reach
    beside = windows.select("entity", F.explode("terms").alias("term"), "terms").select("entity", "term", F.explode("terms").alias("other")).filter("term <> other")
    others = beside.groupBy("entity", "term", "other").agg(F.count("*").alias("n")).groupBy("entity", "term").agg(F.count("*").alias("others"), F.sum("n").alias("beside"))
    each, more = F.col("beside") / F.col("windows"), F.least("windows", F.lit(ENOUGH)) - 1
    varied = others.join(joint, ["entity", "term"]).filter(F.col("others") >= each * (1 + companions * more) - 1e-9)
    pairs = settle(joint.filter(F.col("windows") >= support).join(varied.select("entity", "term"), ["entity", "term"], "left_semi"), "pairs")
    empty = pairs.isEmpty()
    wanted = pairs.select("term").distinct()
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM_SQL), F.lit(0))).alias("term"))
    counted = words.limit(0) if empty else words.join(broadcast_if_small(wanted), "term", "left_semi")
    frequency = counted.groupBy("term").agg(F.count("*").alias("n_term"))
    entities = near.groupBy("entity").agg(F.count("*").alias("n_entity"))
    total = near.agg(F.count("*").alias("total"))
    known = pairs.join(frequency, "term").join(entities, "entity").crossJoin(F.broadcast(total))  # one row
    p_e = F.col("n_entity") / F.col("total")
    p_e_t = F.least(F.lit(1.0), F.col("joint") / F.col("n_term"))
    disclosed = F.when(p_e < 1, F.log2(p_e_t / p_e) / -F.log2(p_e)).otherwise(F.lit(0.0))
    action = F.when(F.col("disclosed") >= remove, "remove").when(F.col("disclosed") >= generalise, "generalise")
    return known.filter(p_e_t >= generalise).withColumn("disclosed", disclosed).withColumn("action", action).filter("action is not null").select("entity", "term", "disclosed", "action")


def _key():
    return F.xxhash64("doc_id", "text")


def term_marks(found: DataFrame, told: DataFrame) -> DataFrame:
    """(_key, marks): the disclosing terms of every text that has any."""
    near = found.select("_key", F.explode("near").alias("n")).select("_key", "n.*")
    hit = near.join(told, ["entity", "term"]).groupBy("_key", "first", "last").agg(F.max("action").alias("action"))
    return hit.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("first", "last", "action"))).alias("marks"))


MARKS = "array<struct<first: long, last: long, action: string>>"


def marks_of(text: str, told: dict[str, str]) -> list[tuple[int, int, str]]:
    """Every occurrence of a told term outside base spans."""
    hits = [(m.start(), m.end(), action) for m in TERM.finditer(text) if (action := told.get(m.group().lower()))]
    if not hits:
        return hits
    begins, ends = [], []
    for a, b in sorted((a, b) for _, a, b in base_spans(text)):
        begins.append(a)
        ends.append(max(b, ends[-1] if ends else 0))
    return [(x, y, action) for x, y, action in hits if not (k := bisect_left(begins, y)) or ends[k - 1] <= x]


def with_marks(docs: DataFrame, told: DataFrame, name: str = "marks") -> DataFrame:
    """Add the places of all terms of ``told``, which tell wherever they stand; null if a text has none.

    A bounded number of terms goes to the texts; more are joined to the terms of
    the texts, of which each is sent once per text.
    """
    terms = told.groupBy("term").agg(F.max("action").alias("action"))
    few = terms.limit(BROADCAST_ROWS + 1).collect()
    if len(few) <= BROADCAST_ROWS:
        shared = docs.sparkSession.sparkContext.broadcast({r.term: r.action for r in few})

        @F.pandas_udf(MARKS)
        def run(texts: pd.Series) -> pd.Series:
            return pd.Series([[dict(zip(("first", "last", "action"), m)) for m in marks_of(t, shared.value)] or None for t in texts.fillna("")], dtype=object)

        return docs.withColumn(name, run("text"))

    @F.pandas_udf("array<string>")
    def words(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted({w.lower() for w in TERM.findall(t)}) for t in texts.fillna("")], dtype=object)

    @F.pandas_udf(MARKS)
    def placed(texts: pd.Series, found: pd.Series) -> pd.Series:
        none = lambda f: f is None or len(f) == 0
        return pd.Series([None if none(f) else [dict(zip(("first", "last", "action"), m)) for m in marks_of(t, {x["term"]: x["action"] for x in f})] or None for t, f in zip(texts.fillna(""), found)], dtype=object)

    held = docs.select(_key().alias("_key"), F.explode(words("text")).alias("term")).distinct().join(terms, "term")
    held = held.groupBy("_key").agg(F.collect_list(F.struct("term", "action")).alias("_told"))
    return docs.withColumn("_key", _key()).join(held, "_key", "left").withColumn(name, placed("text", "_told")).drop("_key", "_told")


def search(docs: DataFrame, reach: int = 4, everywhere: bool = False, **limits) -> DataFrame:
    """doc_id, spans and marks of every row of ``docs(doc_id, text)``; marks of terms beside their entity, or ``everywhere``."""
    slim = docs.select("doc_id", "text")
    found = settle(find(slim, reach).select("doc_id", _key().alias("_key"), "pii.*"), "found")
    told = settle(disclosing(found, docs, **limits), "told")
    if not everywhere:
        return found.join(term_marks(found, told), "_key", "left").select("doc_id", "spans", "marks")
    marks = settle(with_marks(slim, told).filter("marks is not null").select(_key().alias("_key"), "marks").dropDuplicates(["_key"]), "marks")
    return found.join(marks, "_key", "left").select("doc_id", "spans", "marks")


def redacted(text: str, marks: list[tuple[int, int, str]]) -> str:
    """The text with base spans and marked terms replaced; overlaps become one."""
    spans = [(a, b, f"[{kind.upper()}]") for kind, a, b in base_spans(text)] + [(a, b, "[TERM]" if action == "generalise" else "") for a, b, action in marks]
    out, free = [], 0
    for a, b, said in sorted(spans, key=lambda s: (s[0], -s[1])):
        if a >= free:
            out += [text[free:a], said]
        free = max(free, b)
    return "".join(out) + text[free:]


def sanitised(docs: DataFrame, reach: int = 4, **limits) -> DataFrame:
    """``docs`` with personal data replaced; n_chars, where there is one, follows the text."""
    slim = docs.select("doc_id", "text")
    found = settle(find(slim, reach).select(_key().alias("_key"), "pii.*").filter(F.size("spans") > 0), "found")
    told = settle(disclosing(found, slim, **limits), "told")

    @F.pandas_udf("string")
    def run(texts: pd.Series, marked: pd.Series) -> pd.Series:
        none = lambda m: m is None or len(m) == 0
        return pd.Series([t if t is None else redacted(t, [] if none(m) else [(x["first"], x["last"], x["action"]) for x in m]) for t, m in zip(texts, marked)], dtype=object)

    out = with_marks(docs, told, "_marks").withColumn("text", run("text", "_marks"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
