"""Personal data against the plain patterns."""

import hashlib
import random
import re

from jobloom.llm import pii
from jobloom.llm.queries import op7_personal_data


def plain(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        total = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d)))
        if 13 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_patterns():
    rng = random.Random(6)
    for alphabet in ("ab@.-_%é 1", "0129.25 ", "0 1-2345 6789", "+12 (3).4-5 ", "a@b.c+1 23.4-5"):
        for _ in range(4000):
            text = "".join(rng.choices(alphabet, k=rng.randrange(50)))
            assert pii.base_spans(text) == plain(text), text
    for text in ("a@b.c@d.e", "a@b@c.d", "1.2.3.4.5.6.7.8", "1.2.3.256", "000000255.1.1.1", "4111 1111-1111 1111", "+1 (988) 555-2485", "a..@b.c-.d"):
        assert pii.base_spans(text) == plain(text), text


def test_long_texts_are_linear():
    for text in ("a" * 2_000_000, "1" * 500_000, "1." * 500_000, "1 " * 300_000, "a@" * 300_000, "+1 " * 300_000):
        pii.base_spans(text)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op7_personal_data(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = plain(texts[r.doc_id])
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest() and r.spans.startswith(said)


def test_disclosing_terms(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    mail = "zoe@mail.example.com"
    rows = [(i, f"{word()} {word()} Zoebella wrote from {mail} the {word()} {word()}") for i in range(8)]
    rows += [(100 + i, f"{word()} the {word()} x{i}@mail.example.com {word()}") for i in range(30)]
    rows += [(200 + i, f"same words stand beside copy@mail.example.com here always") for i in range(20)]
    rows += [(240 + i, f"near copies {'of' if i % 3 else 'or'} this passage name near@mail.example.com {'to' if i % 2 else 'for'} all who read it") for i in range(12)]
    rows += [(300, None), (301, ""), (302, "the Zoebella alone"), (303, "the from wrote " * 40)]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, n_chars long, marks string")
    got = {r.doc_id: r for r in pii.search(docs).collect()}
    texts = dict(rows)
    terms = {texts[i][m["first"]:m["last"]] for i, r in got.items() for m in r.marks or []}
    assert terms == {"Zoebella"} and not got[302].marks and len(got) == len(rows)
    out = {r.doc_id: r for r in pii.sanitised(docs).collect()}
    assert "Zoebella" not in out[0].text and "[EMAIL]" in out[0].text and out[0].n_chars == len(out[0].text)
    assert out[200].text == "same words stand beside [EMAIL] here always" and out[300].text is None and out[301].text == ""
    assert pii.sanitised(docs.limit(0)).count() == 0 and pii.search(docs.limit(0)).count() == 0
    assert pii.sanitised(docs.union(docs)).count() == 2 * len(rows)
    assert pii.redacted("a 1.2.3.4@b.cd x", []) == "a [EMAIL] x"


def test_terms_are_treated_everywhere(spark, monkeypatch):
    rng = random.Random(10)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    far = lambda: " ".join(word() for _ in range(40))
    rows = [(i, f"{word()} {word()} Zoebella from zoe@mail.example.com the {word()} {word()} {far()}" + " zoebella" * (i == 0)) for i in range(8)]
    rows += [(50 + i, f"{word()} {word()} Yorick at yor@mail.example.com the {word()} of") for i in range(3)]
    rows += [(100 + i, f"{word()} the from of at {word()} x{i}@mail.example.com {word()}") for i in range(30)]
    rows += [(240 + i, f"near {word()} this passage name near@mail.example.com for all who read") for i in range(12)]
    rows += [(300, None), (302, "the Zoebella alone"), (303, "the at from of wrote " * 40), (304, "zoebella@else.example.com and Yorick")]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, _marks string").drop("_marks")
    for bound in (pii.BROADCAST_ROWS, 0):
        monkeypatch.setattr(pii, "BROADCAST_ROWS", bound)
        got = {r.doc_id: r for r in pii.search(docs, everywhere=True).collect()}
        texts = dict(rows)
        said = {i: [texts[i][m["first"]:m["last"]] for m in r.marks or []] for i, r in got.items()}
        assert said[0] == ["Zoebella", "zoebella"] and said[302] == ["Zoebella"] and said[304] == ["Yorick"] and said[50] == ["Yorick"]
        assert {w for x in said.values() for w in x} == {"Zoebella", "zoebella", "Yorick"} and len(got) == len(rows)
        out = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
        assert not any("zoebella" in t.lower() for i, t in out.items() if t) and out[300] is None and out[304].startswith("[EMAIL] and ") and "Yorick" not in out[304]
