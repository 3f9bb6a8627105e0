"""License scans with a positional index of rare words.

Templates are passages of common licences, notices and SPDX lines. Document frequencies of their words (a
bounded vocabulary) are counted over the whole corpus. The index holds every word of the templates (word ->
template, position). A file's own licence words are looked up in order of their inverse document frequency,
the rarest first: each of their occurrences votes for the place where a template would begin in the file. A template
is looked up no further once the file's words that are left, together with the heaviest ``LEAST_VOTES - 1``, can't reach
``LEAST_SCORE``: a place that does reach it then has ``LEAST_VOTES`` votes already. So no number of
lookups is fixed, and no place is missed. Templates that lack a word of their phrases, or that all
words of the file can't bring to the score, are never looked up.

Places with votes of ``LEAST_VOTES`` distinct template positions are aligned word by word (``SLACK`` words of drift are
allowed for), and a template counts as found when its mandatory phrases stand there and its
IDF-weighted share of matched words, the score, reaches ``LEAST_SCORE``.

Beside the templates, the plain phrases of ``BASE_PHRASES`` are found wherever their words stand
consecutively. They always count, with score 1.

Defined results: null and empty texts have no words and no labels, score 0 and null first and last
words. Repeated rows are scanned row by row.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import apart, map_arrow, texts_of

LEAST_VOTES = 3
SLACK = 2
LEAST_SCORE = 0.8

#: Phrases and labels that always count (fixed values).
BASE_PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    mandatory: tuple[str, ...]


#: Passages of public licence texts (fixed values).
PASSAGES = (
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "free of charge")),
    Template("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("substantial portions of the software",)),
    Template("apache", "licensed under the apache license version 2 0", ("apache license",)),
    Template("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ("in compliance with the license",)),
    Template("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ("required by applicable law or agreed to in writing",)),
    Template("gpl", "this work is licensed under the gnu general public license version 3", ("gnu general public license",)),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ("free software", "general public license")),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("lesser general public license",)),
    Template("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ("affero general public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products derived from this software",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4",)),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("related or neighboring rights",)),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", ("eclipse public license",)),
    Template("cddl", "the contents of this file are subject to the terms of the common development and distribution license", ("common development and distribution license",)),
    Template("eupl", "licensed under the european union public licence", ("european union public licence",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("in no event will the authors be held liable",)),
    Template("boost", "boost software license version 1 0", ("boost software license",)),
    Template("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("any person or organization obtaining a copy",)),
    Template("wtfpl", "do what the fuck you want to public license", ("you want to public license",)),
    Template("artistic", "you may distribute this package under the terms of the artistic license", ("the artistic license",)),
    Template("ofl", "this font software is licensed under the sil open font license version 1 1", ("open font license",)),
    Template("psf", "this license agreement is between the python software foundation and the individual or organization accessing and otherwise using this software", ("python software foundation",)),
    Template("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", ("without a written agreement is hereby granted",)),
)

#: Public SPDX identifiers by label (fixed values).
SPDX = {
    "mit": "MIT MIT-0",
    "apache": "Apache-1.1 Apache-2.0",
    "gpl": "GPL-2.0 GPL-3.0",
    "lgpl": "LGPL-2.0 LGPL-2.1 LGPL-3.0",
    "agpl": "AGPL-3.0",
    "bsd": "0BSD BSD-2-Clause BSD-3-Clause",
    "mpl": "MPL-1.1 MPL-2.0",
    "epl": "EPL-1.0 EPL-2.0",
    "cddl": "CDDL-1.0 CDDL-1.1",
    "eupl": "EUPL-1.1 EUPL-1.2",
    "isc": "ISC",
    "unlicense": "Unlicense",
    "zlib": "Zlib",
    "boost": "BSL-1.0",
    "cc0": "CC0-1.0",
    "wtfpl": "WTFPL",
    "artistic": "Artistic-1.0 Artistic-2.0",
    "ofl": "OFL-1.1",
    "psf": "PSF-2.0",
    "postgresql": "PostgreSQL",
}
#: Kinds and versions of Creative Commons licences (fixed values).
CC_KINDS = ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd")
CC_VERSIONS = ("2.0", "2.5", "3.0", "4.0")


def line_templates() -> tuple[Template, ...]:
    """SPDX lines and the short names of Creative Commons licences; they must stand as they are."""
    lines = [(label, f"spdx license identifier {name}") for label, names in SPDX.items() for name in names.split()]
    lines += [(f"cc-{kind}", f"cc {kind} {version}") for kind in CC_KINDS for version in CC_VERSIONS]
    return tuple(Template(label, line, (line,)) for label, line in lines)


TEMPLATES = PASSAGES + line_templates()

#: Separators become spaces and A-Z lower case, byte by byte; bytes of other characters are kept.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """The lower-case words: letters a-z, digits and all characters beyond ASCII."""
    return text.encode().translate(_BYTES).split()


class LicenseIndex:
    """Postings of each template's rare words, and the weights of all words."""

    def __init__(self, templates: tuple[Template, ...], weights: dict[bytes, float]):
        self.labels = [t.label for t in templates]
        self.templates = [words_of(t.text) for t in templates]
        self.mandatory = [[words_of(p) for p in t.mandatory] for t in templates]
        self.weights = weights
        self.totals = [sum(weights[w] for w in words) for words in self.templates]
        self.vocabulary = {w for words in self.templates for w in words}
        self.needed = [{w for p in phrases for w in p} for phrases in self.mandatory]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for number, words in enumerate(self.templates):
            for position, word in enumerate(words):
                self.postings[word].append((number, position))
        self.counts = [Counter(words) for words in self.templates]
        # What the positions that are not enough for a vote can weigh; a little less is asked for, as sums are rounded.
        self.few = [sum(sorted((weights[w] for w in words), reverse=True)[: LEAST_VOTES - 1]) for words in self.templates]
        self.least = [(LEAST_SCORE - 1e-9) * total for total in self.totals]
        self.base = [(b" " + b" ".join(words_of(p)) + b" ", len(words_of(p)), label) for p, label in BASE_PHRASES]

    def left(self, present: set[bytes]) -> dict[int, float]:
        """The templates that a file's words can bring to the score, and what these weigh together."""
        weights, left = self.weights, {}
        for number, needed in enumerate(self.needed):
            if needed <= present:
                weight = sum(n * weights[w] for w, n in self.counts[number].items() if w in present)
                if weight >= self.least[number]:
                    left[number] = weight
        return left

    def votes(self, words: list[bytes]) -> dict[tuple[int, int], set[int]]:
        """For templates and the places where they would begin, the template positions that agree.

        The file's words are looked up from the rarest on, for each template until the others can't
        decide any more.
        """
        present = self.vocabulary.intersection(words)
        left = self.left(present)
        found: dict[tuple[int, int], set[int]] = defaultdict(set)
        if not left:
            return found
        places: dict[bytes, list[int]] = defaultdict(list)
        for at, word in enumerate(words):
            if word in present:
                places[word].append(at)
        for word in sorted(present, key=lambda w: (-self.weights[w], w)):
            asked = [(number, position) for number, position in self.postings[word] if number in left]
            for number, position in asked:
                for at in places[word]:
                    found[number, at - position].add(position)
            for number in {number for number, _ in asked}:
                left[number] -= self.counts[number][word] * self.weights[word]
                if self.few[number] + left[number] < self.least[number]:
                    del left[number]
            if not left:
                break
        return found

    def base_places(self, words: list[bytes]) -> tuple[list[int], set[str]]:
        """The word positions of the base phrases, and their labels."""
        places: list[int] = []
        labels: set[str] = set()
        if b"license" in words:
            joined = b" " + b" ".join(words) + b" "
            for phrase, _, label in self.base:
                word = before = 0
                for found in re.finditer(b"(?=%s)" % re.escape(phrase), joined):
                    word += joined.count(b" ", before, found.start())
                    before = found.start()
                    places.append(word)
                    labels.add(label)
        return places, labels

    def found(self, words: list[bytes]) -> dict[str, float]:
        """The labels of the templates found among the words, with their best scores."""
        votes = self.votes(words)
        best: dict[str, float] = {}
        drift = range(-SLACK, SLACK + 1)
        for number, start in sorted({(number, at + d) for number, at in votes for d in drift}):
            near = set().union(*(votes.get((number, start + d), ()) for d in drift))
            if len(near) < min(LEAST_VOTES, len(self.templates[number])):
                continue
            score = self.score(number, start, words)
            label = self.labels[number]
            if score >= LEAST_SCORE and score > best.get(label, 0.0):
                best[label] = score
        return best

    def score(self, number: int, start: int, words: list[bytes]) -> float:
        """The weighted share of a template's words near their places; 0 without its phrases."""
        template = self.templates[number]
        window = words[max(0, start - SLACK) : max(0, start + len(template) + 2 * SLACK)]
        for phrase in self.mandatory[number]:
            if not any(window[i : i + len(phrase)] == phrase for i in range(len(window) - len(phrase) + 1)):
                return 0.0
        matched = sum(self.weights[w] for p, w in enumerate(template) if w in words[max(0, start + p - SLACK) : max(0, start + p + SLACK + 1)])
        return min(1.0, matched / self.totals[number])


def vocabulary_weights(docs: DataFrame, templates: tuple[Template, ...], text: str = "text") -> dict[bytes, float]:
    """Inverse document frequencies of the templates' words, over all documents."""
    vocabulary = {w for t in templates for w in words_of(t.text)}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = dict.fromkeys(vocabulary, 0)
        rows = 0
        for batch in batches:
            rows += batch.num_rows
            for t in texts_of(batch):
                for word in vocabulary.intersection(words_of(t)):
                    counts[word] += 1
        yield pa.RecordBatch.from_arrays([pa.array(["", *(w.decode() for w in counts)]), pa.array([rows, *counts.values()], pa.int64())], names=["word", "n"])

    counted = map_arrow(docs.select(F.col(f"`{text}`").alias("_text")), task, "word string, n long").groupBy("word").agg(F.sum("n"))
    found = dict(counted.collect())  # one row for each word of the templates
    rows = found.pop("", 0)
    return {w: math.log1p((rows + 1) / (found.get(w.decode(), 0) + 1)) for w in vocabulary}


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text: str = "text", keep: list[str] = ()) -> DataFrame:
    """The kept columns of each row, its base places and all labels of its whole text."""
    weights = vocabulary_weights(docs, templates, text)
    keep = list(keep)
    schema = "".join(f"`{k}` {docs.schema[k].dataType.simpleString()}, " for k in keep)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = LicenseIndex(templates, weights)
        for batch in batches:
            rows = []
            for t in texts_of(batch):
                words = words_of(t)
                places, base = index.base_places(words)
                scores = index.found(words)
                rows.append((len(words), sorted(places), sorted(base), sorted(base | set(scores)), 1.0 if base else max(scores.values(), default=0.0)))
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.float64()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[*keep, "n_words", "places", "base", "found", "score"])

    return map_arrow(
        docs.select(F.col(f"`{text}`").alias(apart(keep)), *[F.col(f"`{k}`") for k in keep]),
        task,
        f"{schema}n_words long, places array<long>, base array<string>, found array<string>, score double",
    )


def license_report(docs: DataFrame) -> DataFrame:
    """Base places, labels and score of every document."""
    return scan_licenses(docs, keep=["doc_id"]).select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").alias("first_word"),
        F.array_max("places").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join("found", ",").alias("labels"),
        "score",
    )
