"""Licence texts in files, by a positional index of each licence's rarest words.

How many documents hold a word decides what is indexed: of every template the words of
highest inverse document frequency, and the rarest word of each of its mandatory phrases,
with their places. A file's occurrences of indexed words are looked up; the places that
several of them agree on, relative to each other, are where a passage may begin. Only there
are the template's words and its mandatory phrases verified.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# The base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Telling passages of public licences, and phrases that must stand in them.
_GPL = (
    "free software you can redistribute it and or modify it under the terms of the gnu {kind} public license as "
    "published by the free software foundation either version {version} of the license or at your option any later version"
)
_COMMONS = (
    "this work is licensed under the creative commons {kind} 4 0 international license to view a copy of this license visit"
)


def _gpl(kind: str, version: str) -> tuple[str, tuple[str, ...]]:
    return _GPL.format(kind=kind, version=version), (f"gnu {kind} public license", f"either version {version} of the license")


def _commons(kind: str) -> tuple[str, tuple[str, ...]]:
    return _COMMONS.format(kind=kind), (f"creative commons {kind} 4 0",)


TEMPLATES: dict[str, tuple[str, tuple[str, ...]]] = {
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this "
        "software and associated documentation files to deal in the software without "
        "restriction including without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the software",
        ("permission is hereby granted free of charge", "without restriction"),
    ),
    "apache": (
        "licensed under the apache license version 2 0 the license you may not use this file "
        "except in compliance with the license you may obtain a copy of the license at",
        ("licensed under the apache license", "compliance with the license"),
    ),
    "gpl-2.0": _gpl("general", "2"),
    "gpl-3.0": _gpl("general", "3"),
    "lgpl-2.1": _gpl("lesser general", "2 1"),
    "lgpl-3.0": _gpl("lesser general", "3"),
    "agpl-3.0": _gpl("affero general", "3"),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are "
        "permitted provided that the following conditions are met redistributions of source "
        "code must retain the above copyright notice this list of conditions",
        ("redistribution and use in source and binary forms",),
    ),
    "bsd-3-clause": (
        "neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written permission",
        ("may be used to endorse or promote products derived from this software",),
    ),
    "bsd-4-clause": (
        "all advertising materials mentioning features or use of this software must display the "
        "following acknowledgement this product includes software developed by",
        ("all advertising materials mentioning features",),
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or "
        "without fee is hereby granted provided that the above copyright notice and this "
        "permission notice appear in all copies",
        ("with or without fee is hereby granted",),
    ),
    "mpl": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a "
        "copy of the mpl was not distributed with this file you can obtain one at",
        ("mozilla public license",),
    ),
    "mpl-1.1": (
        "the contents of this file are subject to the mozilla public license version 1 1 the license "
        "you may not use this file except in compliance with the license",
        ("mozilla public license version 1 1",),
    ),
    "cddl": (
        "the contents of this file are subject to the terms of the common development and "
        "distribution license the license you may not use this file except in compliance with the license",
        ("common development and distribution license",),
    ),
    "epl-1.0": (
        "this program and the accompanying materials are made available under the terms of the "
        "eclipse public license v1 0 which accompanies this distribution and is available at",
        ("eclipse public license v1 0",),
    ),
    "epl-2.0": (
        "this program and the accompanying materials are made available under the terms of the "
        "eclipse public license 2 0 which is available at",
        ("eclipse public license 2 0",),
    ),
    "eupl": (
        "licensed under the eupl version 1 2 or as soon they will be approved by the european "
        "commission subsequent versions of the eupl the licence you may not use this work except in "
        "compliance with the licence",
        ("versions of the eupl",),
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain anyone is free "
        "to copy modify publish use compile sell or distribute this software",
        ("released into the public domain",),
    ),
    "zlib": (
        "in no event will the authors be held liable for any damages arising from the use of this "
        "software permission is granted to anyone to use this software for any purpose including "
        "commercial applications and to alter it and redistribute it freely",
        ("including commercial applications", "alter it and redistribute it freely"),
    ),
    "bsl-1.0": (
        "boost software license version 1 0 permission is hereby granted free of charge to any "
        "person or organization obtaining a copy of the software and accompanying documentation "
        "covered by this license to use reproduce display distribute execute and transmit the software",
        ("accompanying documentation covered by this license",),
    ),
    "artistic-1.0": (
        "the intent of this document is to state the conditions under which a package may be copied "
        "such that the copyright holder maintains some semblance of artistic control over the "
        "development of the package",
        ("some semblance of artistic control",),
    ),
    "artistic-2.0": (
        "this license establishes the terms under which a given free software package may be copied "
        "modified distributed and or redistributed the intent is that the copyright holder maintains "
        "some artistic control over the development of that package",
        ("maintains some artistic control",),
    ),
    "cc0": (
        "to the extent possible under law the author has dedicated all copyright and related and "
        "neighboring rights to this software to the public domain worldwide this software is "
        "distributed without any warranty",
        ("related and neighboring rights",),
    ),
    "cc-by": _commons("attribution"),
    "cc-by-sa": _commons("attribution sharealike"),
    "cc-by-nc": _commons("attribution noncommercial"),
    "cc-by-nd": _commons("attribution noderivatives"),
    "wtfpl": (
        "everyone is permitted to copy and distribute verbatim or modified copies of this license "
        "document and changing it is allowed as long as the name is changed",
        ("as long as the name is changed",),
    ),
    "openssl": (
        "redistributions of any form whatsoever must retain the following acknowledgment this "
        "product includes software developed by the openssl project for use in the openssl toolkit",
        ("openssl project",),
    ),
    "postgresql": (
        "permission to use copy modify and distribute this software and its documentation for any "
        "purpose without fee and without a written agreement is hereby granted provided that the "
        "above copyright notice and this paragraph and the following two paragraphs appear in all copies",
        ("without a written agreement is hereby granted",),
    ),
    "ofl-1.1": (
        "this font software is licensed under the sil open font license version 1 1 this license is "
        "copied below and is also available with a faq at",
        ("sil open font license",),
    ),
    "psf": (
        "this license agreement is between the python software foundation psf and the individual or "
        "organization licensee accessing and otherwise using this software in source or binary form "
        "and its associated documentation",
        ("python software foundation",),
    ),
}
# A label that stands for a passage unless one of others is found with it.
WITHOUT = {"bsd": ("bsd-2-clause", ("bsd-3-clause", "bsd-4-clause"))}
RARE = 8  # words of a template that are indexed, beside those of its phrases
LEAST_VOTES = 3  # different indexed words that must agree on one place of a template
SHARE = 0.7  # of a template's words that must stand at their places
DRIFT = 4  # words a place may be off, for words added or left out
PHRASE_SCORE = 0.5  # of a file with a base phrase alone

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and anything beyond ASCII; A-Z as lower case."""
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


class Templates:
    """The licence passages and phrases as words."""

    def __init__(self) -> None:
        self.words = {label: words_of(text) for label, (text, _) in TEMPLATES.items()}
        self.phrases = {label: [words_of(p) for p in keys] for label, (_, keys) in TEMPLATES.items()}
        self.base = [(words_of(p), label) for p, label in PHRASES.items()]

    def vocabulary(self) -> set[bytes]:
        """All licence words: a list fixed by the templates and the base phrases."""
        passages = [set(words) for words in self.words.values()]
        return set().union(*passages, *[p for keys in self.phrases.values() for p in keys], *[p for p, _ in self.base])


class Index:
    """Postings ``word -> [(template, place)]`` of the words that the corpus makes rare."""

    def __init__(self, templates: Templates, idf: Mapping[bytes, float]):
        self.templates = templates
        rarity = lambda word: (-idf.get(word, 0.0), word)
        self.rare: dict[str, set[bytes]] = {}
        self.postings: dict[bytes, list[tuple[str, int]]] = defaultdict(list)
        for label, words in templates.words.items():
            rarest = sorted(set(words), key=rarity)[:RARE]
            self.rare[label] = {*rarest, *[min(p, key=rarity) for p in templates.phrases[label]]}
            for place, word in enumerate(words):
                if word in self.rare[label]:
                    self.postings[word].append((label, place))

    def starts(self, words: list[bytes], known: set[bytes]) -> dict[str, list[int]]:
        """Per template the places of the file where enough of its indexed words agree."""
        possible = {l for l, rare in self.rare.items() if len(rare & known) >= LEAST_VOTES}
        if not possible:
            return {}
        asked = {w: [p for p in self.postings[w] if p[0] in possible] for w in known & self.postings.keys()}
        votes: dict[str, dict[int, set[bytes]]] = {label: defaultdict(set) for label in possible}
        for at, word in enumerate(words):
            for label, place in asked.get(word, ()):
                votes[label][at - place].add(word)
        found = {}
        for label, agreed in votes.items():
            near = lambda s: set().union(*[agreed[s + d] for d in range(-DRIFT, DRIFT + 1) if s + d in agreed])  # noqa: E731, B023
            found[label] = [s for s in sorted(agreed) if len(near(s)) >= LEAST_VOTES]
        return found

    def matches(self, words: list[bytes], known: set[bytes]) -> dict[str, float]:
        """``label -> share``: the best share of a template's words where it is found."""
        found: dict[str, float] = {}
        for label, starts in self.starts(words, known).items():
            wanted, phrases = self.templates.words[label], self.templates.phrases[label]
            if not starts or not all(known.issuperset(p) for p in phrases):
                continue
            stand = [_places(words, p) for p in phrases]
            for start in starts:
                low, high = max(0, start - DRIFT), start + len(wanted) + DRIFT
                if not all(_inside(s, low, high - len(p)) for s, p in zip(stand, phrases, strict=True)):
                    continue
                hits = (Counter(wanted) & Counter(words[low:high])).total()
                if hits >= SHARE * len(wanted):
                    found[label] = max(found.get(label, 0.0), hits / len(wanted))
        for label, (plain, others) in WITHOUT.items():
            if label in found and not any(o in found for o in others):
                found[plain] = found[label]
        return found


def _places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Starts at which the phrase's words stand one after the other."""
    found, at = [], -1
    while True:
        try:
            at = words.index(phrase[0], at + 1)
        except ValueError:
            return found
        if words[at : at + len(phrase)] == phrase:
            found.append(at)


def _inside(places: list[int], low: int, high: int) -> bool:
    """Whether one of the sorted places lies from ``low`` to ``high``."""
    at = bisect_left(places, low)
    return at < len(places) and places[at] <= high


def word_frequencies(texts: DataFrame) -> tuple[int, dict[bytes, int]]:
    """Number of documents, and how many hold each licence word (a fixed list of words)."""
    templates = Templates()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = templates.vocabulary()
        for batch in batches:
            counts: Counter[bytes] = Counter()
            for text in batch.column(0):
                counts.update(wanted.intersection(words_of(text.as_py())))
            counts[b""] = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array([w.decode() for w in counts]), pa.array(list(counts.values()), pa.int64())],
                ["word", "n"],
            )

    rows = texts.select("text").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r.word.encode(): r.n for r in rows.collect()}
    return found.pop(b"", 0), found


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per input row: base phrases, labels of base and templates, and a score.

    The first scan counts in how many documents each licence word stands, which decides
    the words that are indexed; the second looks up a file's indexed words, wherever they
    stand, and verifies the places they agree on. A passage is found where at least
    ``LEAST_VOTES`` of its indexed words keep their relative places, give or take ``DRIFT``
    words, its phrases stand inside, and ``SHARE`` of its words are there, whatever else the file
    holds. The score is the best share found, or ``PHRASE_SCORE`` for a base phrase alone,
    else 0. Null text counts as empty; repeated rows count each.
    """
    templates = Templates()
    total, frequency = word_frequencies(docs)
    idf = {w: math.log((total + 1) / (frequency.get(w, 0) + 1)) for w in templates.vocabulary()}
    kind = dict(docs.dtypes)["doc_id"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, index = templates.vocabulary(), Index(templates, idf)
        for batch in batches:
            out = []
            for text in batch.column(1):
                words = words_of(text.as_py())
                known = wanted.intersection(words)
                starts, base = [], set()
                for phrase, label in templates.base:
                    if known.issuperset(phrase):
                        places = _places(words, phrase)
                        starts += places
                        if places:
                            base.add(label)
                found = index.matches(words, known) if len(known) >= LEAST_VOTES else {}
                score = max([PHRASE_SCORE if base else 0.0, *found.values()])
                out.append(
                    (
                        len(words),
                        len(starts),
                        min(starts, default=None),
                        max(starts, default=None),
                        ",".join(sorted(base)),
                        ",".join(sorted(base | set(found))),
                        score,
                    )
                )
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(
        scan,
        f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint,"
        " base_labels string, labels string, score double",
    )
