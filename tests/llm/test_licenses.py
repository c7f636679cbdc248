from __future__ import annotations

import random
import re
import time
from re import _constants as ops
from re import _parser

import pytest

from ledgerflow.llm import licenses
from ledgerflow.llm.common import table
from ledgerflow.llm.queries import op9_licenses

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(
    "text, label",
    [
        ("This work is licensed under the GNU General Public License, version 3.", "gpl-3.0"),
        ("licensed under the GNU Lesser General Public License v2.1", "lgpl-2.1"),
        ("All rights\n  reserved.", "reserved"),
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"),
        ("Released under the MIT License.", "mit"),
        ("Licensed under the Apache License, Version 2.0", "apache-2.0"),
        ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2.0"),
        ("see https://creativecommons.org/licenses/by-sa/4.0/", "cc-by-sa-4.0"),
        ("GPLv3", "gpl-3.0"),
        ("BSD 3-Clause License", "bsd-3-clause"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit"),
        ("Creative Commons Attribution-NonCommercial 4.0 International", "cc-by-nc-4.0"),
        ("Alle Rechte vorbehalten", "reserved"),
        ("er kam mit dem Hund", None),
        ("the license of poets", None),
        ("", None),
    ],
)
def test_rules(text, label):
    found = licenses.detections(text.lower())
    assert [d[0] for d in found] == ([label] if label else [])


def test_rules_are_gated_and_many():
    rules = licenses.rules()
    assert len(rules) > 300 and all(r.needs for r in rules)


def test_gate_loses_nothing():
    texts = [r"spdx-license-identifier: mpl-2.0", "under the mozilla public license 2.0", "mit no attribution license", "cc   by 4.0", "x11 license", "ms-pl", "sil open font license 1.1"]
    for text in texts:
        ungated = {r.label for r in licenses.rules() for _ in r.pattern.finditer(text)}
        assert {d[0] for d in licenses.detections(text)} <= ungated and licenses.detections(text)


def test_no_standing_detection_contains_another():
    text = "licensed under the gnu lesser general public license, version 2.1, or the general public license version 2; all rights reserved; cc by-sa 4.0 "
    found = licenses.detections(text * 3)
    spans = [(a, b) for _, _, a, b in found]
    assert len(found) == 12
    assert not any(a <= c and d <= b and (a, b) != (c, d) for a, b in spans for c, d in spans)


def test_long_gaps_stay_linear():
    started = time.time()
    for filler in (" ", "(", "v ", "cc ", "license "):
        licenses.detections("gpl license cc by creative commons attribution" + filler * 20_000)
        licenses.phrase_places(b"cc" + filler.encode() * 200_000)
    assert time.time() - started < 60


def slow_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", lowered)


def slow_places(words):
    return sorted(
        (i, label) for phrase, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()
    )


def check(rows, got):
    assert len(rows) == len(got)
    for text, r in zip(rows, got):
        words = slow_words(text)
        places = slow_places(words)
        assert r["n_words"] == len(words) and r["n_base"] == len(places)
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        base = {label for _, label in places}
        assert r["base_labels"] == ",".join(sorted(base))
        labels = r["labels"].split(",") if r["labels"] else []
        assert labels == sorted(set(labels)) and base <= set(labels)
        assert (r["score"] > 0) == bool(labels) and 0 <= r["score"] <= 1


def test_query_against_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    got = op9_licenses(spark, SF).collect()
    check([texts[r["doc_id"]] for r in got], got)


def test_odd_rows(spark):
    texts = [None, "", " ", "CC-BY cc\u00a0by ccby cc by", "all rights reserved " * 50_000, "\u00c9 General public license\x00cc, by", "cc", "by nothing"]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(3, texts[3], "x", 1), (None, texts[5], "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string, n_words int").coalesce(1)
    got = licenses.labelled(licenses.scan(docs)).collect()
    check([r[1] for r in rows], got)
    assert licenses.labelled(licenses.scan(docs.limit(0))).count() == 0


def sample(draw, parsed):
    """A string that the parsed expression describes, lookarounds aside."""
    made = ""
    for op, value in parsed:
        if op is ops.LITERAL:
            made += chr(value)
        elif op is ops.BRANCH:
            made += sample(draw, draw.choice(value[1]))
        elif op is ops.SUBPATTERN:
            made += sample(draw, value[-1])
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT):
            low = value[0]
            made += "".join(sample(draw, value[2]) for _ in range(draw.randint(low, min(value[1], low + 1))))
        elif op is ops.IN:
            signs = " _-/ab19sc()\u00e9"
            allowed = [c for c in signs if in_class(c, value)]
            made += draw.choice(allowed) if allowed else chr(next(v for o, v in value if o is ops.LITERAL))
        elif op is ops.NOT_LITERAL:
            made += "a" if value != ord("a") else "b"
    return made


def in_class(sign, items):
    negated, held = False, False
    for op, value in items:
        if op is ops.NEGATE:
            negated = True
        elif op is ops.LITERAL:
            held |= ord(sign) == value
        elif op is ops.RANGE:
            held |= value[0] <= ord(sign) <= value[1]
        elif op is ops.CATEGORY:
            held |= {ops.CATEGORY_SPACE: sign.isspace(), ops.CATEGORY_NOT_SPACE: not sign.isspace()}[value]
    return held != negated


def test_every_rule_passes_the_gate_alone():
    draw, matched = random.Random(9), set()
    for order, rule in enumerate(licenses.rules()):
        parsed = _parser.parse(rule.pattern.pattern)
        for _ in range(12):
            text = sample(draw, parsed)
            if rule.pattern.search(text):
                matched.add(order)
                assert all(any(w in text for w in words) for words in rule.needs), (rule, text)
                assert licenses.detections(text), (rule, text)
    assert len(matched) == len(licenses.rules())


@pytest.mark.parametrize(
    "text, label",
    [
        ("Copyright 1998 Acme", "copyright"), ("(c) 1999", "copyright"), ("\u00a9 1987 Acme", "copyright"), ("https://scripts.sil.org/ofl", "ofl"), ("https://mariadb.com/bsl11", "busl"),
        ("simplified bsd", "bsd-2-clause"), ("Creative Commons Zero", "cc0"), ("ms_pl", "ms-pl"), ("cc_by4.0", "cc-by-4.0"),
    ],
)
def test_single_signs(text, label):
    assert label in {d[0] for d in licenses.detections(text.lower())}


@pytest.mark.parametrize(
    "text, label",
    [
        ("3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products", "bsd-3-clause"),
        (" * Neither the name of Acme Inc. nor the\n * names of its contributors may be used to endorse or\n * promote products derived", "bsd-3-clause"),
        ("Neither the name of " + "the University of Somewhere, " * 12 + "\nnor others may be used to endorse or promote products", "bsd-3-clause"),
        ("No part of this publication\nmay be reproduced", "proprietary"),
        ("No part of this book, its cover, its pictures, its tables, its index, its notes\nor its supplements\nmay be copied", "proprietary"),
        ("No part of it is new.\nCopies may be reproduced", None),
    ],
)
def test_wrapped_sentences(text, label):
    assert {d[0] for d in licenses.detections(text.lower())} == ({label} if label else set())


def test_repeated_starts_stay_linear():
    started = time.time()
    for text in ("neither the name of endorse products ", "no part of it ", "no part of" + " " * 500, "neither the name of x. endorse products\n"):
        licenses.detections(text * (200_000 // len(text)) + " may be used reproduced")
    assert time.time() - started < 60


@pytest.mark.parametrize("piece", [",scripts.sil.org/ofl", " docs.python.org/x", "docs.python.org/", "boost.org/license_", " elastic.co/licensing/elastic-license", "opensource.org/license", " apache license"])
def test_repeated_addresses_stay_linear(piece):
    spent = []
    for n in (20_000, 40_000):
        started = time.process_time()
        licenses.detections(piece * n)
        spent.append(time.process_time() - started)
    assert spent[1] < 3 * spent[0] + 0.5


def test_rules_are_quick_to_make():
    # Each worker process makes them once.
    started = time.process_time()
    licenses.rules.__wrapped__()
    assert time.process_time() - started < 5
