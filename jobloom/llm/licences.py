"""Licence scan with a positional rare-token index.

Every template is posted under its rarest words only, with their offsets.  A
file looks up those words; each hit proposes the place where the template
would start (position less offset), and hits of different words that agree on
a place support it.  Supported places are verified: short phrases word for
word, long templates by their mandatory key phrases, found in order of
position within the place's reach.  Rarity is measured over all documents.

Edge cases: a null or empty text has no words and no places; overlapping
places of one phrase all count; repeated rows are scanned alike; an empty
table yields no rows, and rarity then rests on the templates alone.
"""

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from jobloom.llm.common import LOWER, UPPER, ascii_lower, small_batches

WORD_CLASS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = re.compile(WORD_CLASS)
LOWERED = str.maketrans(UPPER, LOWER)

# Phrases whose every place is wanted, with their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Phrases of one line that name a licence.
SHORT_PHRASES = {
    "mit license": "mit",
    "apache license version 2 0": "apache-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu general public license version 2": "gpl-2.0",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "creative commons attribution": "cc",
    "boost software license": "bsl-1.0",
}

# Openings of licence texts and the key phrases that must occur.
LONG_TEMPLATES = {
    "mit-text": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
                 ("permission is hereby granted free of charge", "without restriction")),
    "bsd-text": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
                 ("redistribution and use in source and binary forms", "must retain the above copyright notice")),
    "isc-text": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
                 ("permission to use copy modify", "appear in all copies")),
    "apache-text": ("you may not use this file except in compliance with the license you may obtain a copy of the license at unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
                    ("you may not use this file except in compliance with the license", "unless required by applicable law")),
    "gpl-text": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version of the license or at your option any later version",
                 ("redistribute it and or modify it under the terms of the gnu general public license", "free software foundation")),
    "unlicense-text": ("this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose",
                       ("free and unencumbered software released into the public domain",)),
}


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple
    keys: tuple  # of words; empty: the whole template, word for word
    base: bool


def default_templates() -> list[Template]:
    short = [Template(label, tuple(p.split()), (), p in BASE_PHRASES) for p, label in {**BASE_PHRASES, **SHORT_PHRASES}.items()]
    return short + [Template(label, tuple(t.split()), tuple(tuple(k.split()) for k in keys), False) for label, (t, keys) in LONG_TEMPLATES.items()]


def rarity(docs: DataFrame, templates: list[Template], text: str = "text") -> dict[str, float]:
    """IDF of every template word over all documents; as many rows as the templates have words."""
    vocabulary = sorted({w for t in templates for w in t.words})
    seen = F.array_intersect(F.split(ascii_lower(F.coalesce(F.col(text), F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.array(*map(F.lit, vocabulary)))
    rows = docs.select(F.explode(F.array_append(seen, F.lit(""))).alias("word")).groupBy("word").count().collect()
    df = {r["word"]: r["count"] for r in rows}
    total = df.pop("", 0)
    return {w: math.log((1 + total) / (1 + df.get(w, 0))) + 1e-9 for w in vocabulary}


class Index:
    """Postings of the rarest words: word to (template, offset)."""

    def __init__(self, templates: list[Template], idf: dict[str, float], posted: int = 8, slack: int = 12):
        self.templates, self.idf, self.slack = templates, idf, slack
        self.postings = defaultdict(list)
        self.need = []
        for number, t in enumerate(templates):
            rare = sorted(set(t.words), key=lambda w: (-idf[w], w))[:posted if t.keys else 1]
            self.need.append(max(1, len(rare) // 2))
            for offset, w in enumerate(t.words):
                if w in rare:
                    self.postings[w].append((number, offset))
        self.weight = [sum(idf[w] for w in set(t.words)) for t in templates]

    def places(self, words: list[str]) -> list[tuple]:
        """(label, start, end, score, base) of all verified places."""
        support: dict[int, dict[int, set]] = defaultdict(lambda: defaultdict(set))
        for i, w in enumerate(words):
            if w in self.postings:
                for number, offset in self.postings[w]:
                    support[number][i - offset].add(w)
        out = []
        for number, starts in support.items():
            t = self.templates[number]
            size = len(t.words)
            if not t.keys:
                out += [(t.label, s, s + size, 1.0, t.base) for s in starts if s >= 0 and tuple(words[s:s + size]) == t.words]
            else:
                out += self.long_places(number, words, starts)
        return sorted(out, key=lambda p: (p[1], p[2], p[0]))

    def long_places(self, number: int, words: list[str], starts: dict[int, set]) -> list[tuple]:
        t, out, ahead = self.templates[number], [], -1
        order = sorted(starts)
        tally: Counter = Counter()
        left = 0
        for right, s in enumerate(order):  # places within the slack back each other
            tally.update(starts[s])
            while order[left] < s - self.slack:
                tally -= Counter(starts[order[left]])
                left += 1
            if len(tally) < self.need[number] or s <= ahead:
                continue
            a, b = max(0, order[left] - self.slack), s + len(t.words) + self.slack
            window = words[a:b]
            if all(any(tuple(window[i:i + len(k)]) == k for i, w in enumerate(window) if w == k[0]) for k in t.keys):
                there = set(window)
                score = sum(self.idf[w] for w in set(t.words) if w in there) / self.weight[number]
                out.append((t.label, max(0, s), min(len(words), s + len(t.words)), min(1.0, score), False))
                ahead = s + len(t.words)
        return out


PLACES = "n_words long, places array<struct<label: string, first: long, last: long, score: double, base: boolean>>"


def scan(docs: DataFrame, templates: list[Template] | None = None, text: str = "text") -> DataFrame:
    """Add the struct ``licences``: number of words and all places found."""
    small_batches(docs.sparkSession)
    templates = templates or default_templates()
    index = Index(templates, rarity(docs, templates, text))

    @F.pandas_udf(PLACES)
    def run(texts: pd.Series) -> pd.DataFrame:
        found = [(len(words), [dict(zip(("label", "first", "last", "score", "base"), p)) for p in index.places(words)]) for words in (WORD.findall(t.translate(LOWERED)) for t in texts.fillna(""))]
        return pd.DataFrame(found, columns=["n_words", "places"])

    return docs.withColumn("licences", run(F.col(text)))


def summary(scanned: DataFrame) -> DataFrame:
    """Per row: counts, first and last base place, labels, and the best score."""
    places = F.col("licences.places")
    base = F.filter(places, lambda p: p["base"])
    starts = F.transform(base, lambda p: p["first"])
    labels = lambda a: F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(a, lambda p: p["label"]))))
    return scanned.withColumns({
        "n_words": F.col("licences.n_words"), "n_base": F.size(base).cast("long"),
        "first_word": F.array_min(starts), "last_word": F.array_max(starts),
        "base_labels": labels(base), "labels": labels(places),
        "score": F.coalesce(F.array_max(F.transform(places, lambda p: p["score"])), F.lit(0.0)),
    }).drop("licences")
