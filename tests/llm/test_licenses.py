"""Licence scans against plain phrase search, and templates with changed words."""

import random
import re

import pytest
from llm_tables import documents, some_words

from tallyframe.llm.licenses import LEAST_SCORE, PASSAGES, TEMPLATES, LicenseIndex, license_report, words_of

PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
TEXTS = [
    "Released under the MIT License.",
    "Licensed under the Apache License, Version 2.0. mit LICENSE mit-license",
    "the GNU General\nPublic*License é mit licenseé",
    "Licensed under CC BY-NC 4.0.",
    "license mit apache general public",
    "",
    None,
    "mit license " * 3000,
    " ".join(some_words(1, 500)) + " Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files " + " ".join(some_words(2, 500)),
    "permission is hereby denied to any person obtaining a copy of this software",
    "MİT lıcense KELVIN \u212a license",
]


def plain(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places, labels = [], set()
    for phrase, label in PHRASES:
        parts = phrase.split()
        hits = [i for i in range(len(words)) if words[i : i + len(parts)] == parts]
        places += hits
        labels |= {label} if hits else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_equals_plain_search(spark):
    rows = license_report(documents(spark, TEXTS)).collect()
    for r in rows:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain(TEXTS[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1


def test_templates_are_found_and_look_alikes_are_not(spark):
    labels = {r["doc_id"]: r["labels"] for r in license_report(documents(spark, TEXTS)).collect()}
    assert labels[3] == "cc-by-nc" and labels[8] == "mit" and labels[9] == labels[4] == labels[10] == ""


def test_every_template_is_found_with_a_word_changed(spark):
    texts = [" ".join(some_words(i, 100)) + " " + t.text + " " + " ".join(some_words(i + 50, 100)) for i, t in enumerate(TEMPLATES)]
    for r in license_report(documents(spark, texts)).collect():
        assert TEMPLATES[r["doc_id"]].label in r["labels"].split(",")


@pytest.mark.parametrize("rarest", range(-1, len(TEMPLATES), 7))
@pytest.mark.parametrize("step", [0.0, 0.1, 1.0])
def test_all_templates_of_one_text_are_found(rarest, step):
    """In each order of rarity: one template's words, and among these the later or the earlier ones, are the rarest."""
    vocabulary = sorted({w for t in TEMPLATES for w in words_of(t.text)})
    own = words_of(TEMPLATES[rarest].text) if rarest >= 0 else []
    texts = [" filler here ".join(t.text for t in order) for order in (TEMPLATES, TEMPLATES[::-1])]
    for order in (vocabulary, vocabulary[::-1]):
        index = LicenseIndex(TEMPLATES, {w: 1.0 + step * i / 10 + 3.0 * (w in own) for i, w in enumerate(order)})
        for text in texts:
            assert index.found(words_of(text)) == dict.fromkeys({t.label for t in TEMPLATES}, 1.0)
        for number, t in enumerate(TEMPLATES):
            words = words_of(t.text)
            every = [LicenseIndex.score(index, number, start, words) for start in range(-2, 3)]
            assert index.found(words)[t.label] == max(every)


def test_two_licences_of_one_text(spark):
    bsd, mit = next(t.text for t in PASSAGES if t.label == "bsd"), TEMPLATES[1].text
    texts = [f"{bsd} {mit}", *(mit for _ in range(20))]
    labels = {r["doc_id"]: r["labels"] for r in license_report(documents(spark, texts)).collect()}
    assert labels[0] == "bsd,mit"


def test_words_and_empty_table(spark):
    assert words_of("Aé-Ünicode_9\x7f日本 x") == ["aé".encode(), "Ünicode".encode(), b"9", "日本".encode(), b"x"]
    assert license_report(documents(spark, [])).count() == 0


def aligned_everywhere(index, words):
    """The labels by aligning every template at every place."""
    best = {}
    for number, label in enumerate(index.labels):
        size = len(index.templates[number])
        for start in range(-size, len(words) + 1):
            score = index.score(number, start, words)
            if score >= LEAST_SCORE and score > best.get(label, 0.0):
                best[label] = score
    return best


def test_equal_to_aligning_every_template_at_every_place():
    r = random.Random(11)
    vocabulary = sorted({w for t in TEMPLATES for w in words_of(t.text)})
    for round_ in range(60):
        index = LicenseIndex(TEMPLATES, {w: r.choice([0.1, 1.0, r.random() * 9]) for w in vocabulary})
        words = []
        for t in r.sample(TEMPLATES, 3):
            own = words_of(t.text)
            for _ in range(r.randrange(3)):
                place = r.randrange(len(own))
                own[place : place + r.randrange(2)] = r.choice([[], [b"other"], [r.choice(vocabulary)]])
            words += [r.choice([b"x", b"the", b"license", b"software"]) for _ in range(r.randrange(6))] + own
        assert index.found(words) == aligned_everywhere(index, words)


def test_lookups_go_from_the_rarest_word_and_stop():
    index = LicenseIndex(TEMPLATES, {w: 9.0 if w in (b"redistribution", b"modification", b"permitted", b"conditions", b"binary") else 0.1 for t in TEMPLATES for w in words_of(t.text)})
    number = next(n for n, t in enumerate(TEMPLATES) if t.label == "bsd")
    own = words_of(TEMPLATES[number].text)
    voted = set().union(*(positions for (n, _), positions in index.votes(own).items() if n == number))
    # After four of the five, the last and two more can't reach the score.
    assert {own[p] for p in voted} == {b"modification", b"permitted", b"conditions", b"binary"}


@pytest.mark.parametrize(
    "text, label",
    [
        ("SPDX-License-Identifier: MIT", "mit"), ("// SPDX-License-Identifier: GPL-2.0-or-later", "gpl"), ("SPDX-License-Identifier: LGPL-2.1", "lgpl"), ("licensed under CC BY 4.0", "cc-by"),
        ("licensed under CC BY-SA 3.0.", "cc-by-sa"), ("CC-BY-NC-ND 4.0", "cc-by-nc-nd"), ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc"),
        ("This is free and unencumbered software released into the public domain.", "unlicense"), ("the terms of the GNU Affero General Public License as published by the Free Software Foundation", "agpl,gpl"),
        ("made available under the terms of the Eclipse Public License, this program and the accompanying materials are", ""), ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "epl"),
        ("SPDX-License-Identifier: Unknown-1.0", ""), ("the license identifier of mit", ""),
    ],
)
def test_lines_and_passages(text, label):
    index = LicenseIndex(TEMPLATES, {w: 1.0 for t in TEMPLATES for w in words_of(t.text)})
    words = words_of(text)
    assert ",".join(sorted(index.base_places(words)[1] | set(index.found(words)))) == label


def test_at_least_twenty_licences():
    assert len({t.label for t in TEMPLATES}) >= 20 and len(TEMPLATES) < 200
