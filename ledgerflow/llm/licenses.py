"""License scans by ordered signature rules.

A rule is a regular expression with a label, a priority and the literals that a text must hold for it to match, which are read
off the parsed expression. One pass of a keyword automaton finds the anchors of a text; most texts have none and are done. Only
rules whose literals are there run, over the whole text. Detections are then taken by priority, longer ones first; one that lies within a
detection already taken is suppressed. The rules are written as families (a name, its versions, its short form, its
address) times the forms in which a license is stated, which gives some hundreds.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, after lower-casing A-Z. Fixed phrases are
counted apart from the rules, wherever their words stand one after another.

Nulls and ties: a null text counts as empty and has no words; detections that tie on priority, length and start go by
rule order. Repeated rows give repeated results. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from re import _constants as ops
from re import _parser
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import batches_of

BYTES_AT_ONCE = 4 << 20
#: The ASCII signs of no word; classes are written with these, since wide ranges make expressions slow to compile.
OTHER = r"\x00-/:-`{-\x7f"
WORD, GAP = f"[^{OTHER}]", f"[{OTHER}]+"
BEGIN, END = f"(?<!{WORD})", f"(?!{WORD})"

#: Fixed phrases and the labels they stand for.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Priorities of the forms, first wins, and how sure each makes a license.
FORMS = {"tag": (0, 1.0), "grant": (1, 1.0), "statement": (2, 0.95), "address": (3, 0.9), "name": (4, 0.75), "short": (5, 0.6), "notice": (6, 0.5)}
PHRASE_ONLY = 0.4

# Fixed values. label stem; name; versions ("" for none); short form or ""; address or "".
# In names and short forms a blank stands for any gap between words.
FAMILIES = (
    ("apache", "apache (?:software )?licen[sc]e", "1.0 1.1 2.0", "apache", r"apache\.org/licenses/license-"),
    ("mit", "(?:mit|expat) licen[sc]e", "", "", r"opensource\.org/licen[sc]es?/mit"),
    ("mit-0", "mit no attribution(?: licen[sc]e)?", "", "mit 0", r"opensource\.org/licen[sc]es?/mit-0"),
    ("bsd", "bsd(?: style)? licen[sc]e", "", "", r"opensource\.org/licen[sc]es?/bsd-license"),
    ("bsd-2-clause", "(?:bsd (?:2|two) clause|(?:2|two) clause bsd|simplified bsd|freebsd)(?: licen[sc]e)?", "", "", r"opensource\.org/licen[sc]es?/bsd-2-clause"),
    ("bsd-3-clause", "(?:bsd (?:3|three) clause|(?:3|three) clause bsd|(?:new|modified|revised) bsd)(?: licen[sc]e)?", "", "", r"opensource\.org/licen[sc]es?/bsd-3-clause"),
    ("bsd-4-clause", "(?:bsd (?:4|four) clause|(?:4|four) clause bsd|original bsd)(?: licen[sc]e)?", "", "", ""),
    ("0bsd", "(?:zero clause bsd|bsd zero clause)(?: licen[sc]e)?", "", "0bsd", r"opensource\.org/licen[sc]es?/0bsd"),
    ("gpl", "general public licen[sc]e", "1.0 2.0 3.0", "gpl", r"gnu\.org/licen[sc]es/(?:old-licenses/)?gpl-"),
    ("lgpl", "(?:lesser|library) general public licen[sc]e", "2.0 2.1 3.0", "lgpl", r"gnu\.org/licen[sc]es/(?:old-licenses/)?lgpl-"),
    ("agpl", "affero general public licen[sc]e", "1.0 3.0", "agpl", r"gnu\.org/licen[sc]es/agpl-"),
    ("gfdl", "free documentation licen[sc]e", "1.1 1.2 1.3", "gfdl", r"gnu\.org/licen[sc]es/(?:old-licenses/)?fdl-"),
    ("mpl", "mozilla public licen[sc]e", "1.0 1.1 2.0", "mpl", r"mozilla\.org/(?:en-us/)?mpl/"),
    ("epl", "eclipse public licen[sc]e", "1.0 2.0", "epl", r"eclipse\.org/legal/epl-v?"),
    ("cpl", "common public licen[sc]e", "1.0", "", ""),
    ("ipl", "ibm public licen[sc]e", "1.0", "", ""),
    ("cddl", "common development and distribution licen[sc]e", "1.0 1.1", "cddl", r"opensource\.org/licen[sc]es?/cddl-"),
    ("eupl", "european union public licen[sc]e", "1.0 1.1 1.2", "eupl", ""),
    ("cecill", "cecill(?: free software)? licen[sc]e", "1.0 1.1 2.0 2.1", "cecill", ""),
    ("artistic", "artistic licen[sc]e", "1.0 2.0", "", r"opensource\.org/licen[sc]es?/artistic-"),
    ("afl", "academic free licen[sc]e", "1.1 1.2 2.0 2.1 3.0", "", ""),
    ("osl", "open software licen[sc]e", "1.0 2.0 2.1 3.0", "", ""),
    ("isc", "isc licen[sc]e", "", "", r"opensource\.org/licen[sc]es?/isc"),
    ("zlib", "zlib(?: libpng)? licen[sc]e", "", "", r"opensource\.org/licen[sc]es?/zlib"),
    ("bsl", "boost software licen[sc]e", "1.0", "", r"boost\.org/license_"),
    ("unlicense", "the unlicense", "", "", r"unlicense\.org"),
    ("wtfpl", "do what the fuck you want to public licen[sc]e", "1.0 2.0", "wtfpl", r"wtfpl\.net"),
    ("ofl", "sil open font licen[sc]e", "1.0 1.1", "", r"scripts\.sil\.org/ofl"),
    ("ms-pl", "microsoft public licen[sc]e", "", "ms pl", r"opensource\.org/licen[sc]es?/ms-pl"),
    ("ms-rl", "microsoft reciprocal licen[sc]e", "", "ms rl", r"opensource\.org/licen[sc]es?/ms-rl"),
    ("postgresql", "postgresql licen[sc]e", "", "", r"opensource\.org/licen[sc]es?/postgresql"),
    ("psf", "python software foundation licen[sc]e", "2.0", "", r"docs\.python\.org/(?:(?!docs\.python\.org/)\S)*license"),
    ("ruby", "ruby licen[sc]e", "", "", ""),
    ("php", "php licen[sc]e", "3.0 3.01", "", r"php\.net/license/"),
    ("openssl", "openssl licen[sc]e", "", "", r"openssl\.org/source/license"),
    ("x11", "x11 licen[sc]e", "", "", ""),
    ("ncsa", "(?:university of illinois|ncsa)(?: open source)? licen[sc]e", "", "", r"opensource\.org/licen[sc]es?/ncsa"),
    ("upl", "universal permissive licen[sc]e", "1.0", "", r"opensource\.org/licen[sc]es?/upl"),
    ("vim", "vim licen[sc]e", "", "", ""),
    ("mulan", "mulan(?: permissive software| psl) licen[sc]e", "1.0 2.0", "", ""),
    ("busl", "business source licen[sc]e", "1.1", "busl", r"mariadb\.com/bsl"),
    ("sspl", "server side public licen[sc]e", "1.0", "sspl", ""),
    ("elastic", "elastic licen[sc]e", "2.0", "", r"elastic\.co/licensing/elastic-license"),
    ("odbl", "open (?:data commons open )?database licen[sc]e", "1.0", "odbl", r"opendatacommons\.org/licenses/odbl"),
    ("odc-by", "open data commons attribution licen[sc]e", "1.0", "odc by", r"opendatacommons\.org/licenses/by"),
    ("pddl", "public domain dedication and licen[sc]e", "1.0", "pddl", r"opendatacommons\.org/licenses/pddl"),
    ("ogl", "open government licen[sc]e", "1.0 2.0 3.0", "", r"nationalarchives\.gov\.uk/doc/open-government-licence"),
    ("cc0", "(?:cc0|creative commons zero)(?: universal| public domain dedication)*", "1.0", "cc0", r"creativecommons\.org/publicdomain/zero"),
    ("cc-by", "creative commons attribution(?: international| unported| generic| public| licen[sc]e)*", "1.0 2.0 2.5 3.0 4.0", "cc by", r"creativecommons\.org/licenses/by/"),
    ("cc-by-sa", "creative commons attribution share ?alike(?: international| unported| generic| public| licen[sc]e)*", "1.0 2.0 2.5 3.0 4.0", "cc by sa", r"creativecommons\.org/licenses/by-sa/"),
    ("cc-by-nc", "creative commons attribution non ?commercial(?: international| unported| generic| public| licen[sc]e)*", "1.0 2.0 2.5 3.0 4.0", "cc by nc", r"creativecommons\.org/licenses/by-nc/"),
    ("cc-by-nd", "creative commons attribution no ?deriv(?:ative)?s?(?: international| unported| generic| public| licen[sc]e)*", "1.0 2.0 2.5 3.0 4.0", "cc by nd", r"creativecommons\.org/licenses/by-nd/"),
    ("cc-by-nc-sa", "creative commons attribution non ?commercial share ?alike(?: international| unported| generic| public| licen[sc]e)*", "1.0 2.0 2.5 3.0 4.0", "cc by nc sa", r"creativecommons\.org/licenses/by-nc-sa/"),
    ("cc-by-nc-nd", "creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: international| unported| generic| public| licen[sc]e)*", "1.0 2.0 2.5 3.0 4.0", "cc by nc nd", r"creativecommons\.org/licenses/by-nc-nd/"),
)

def _gapped(name: str) -> str:
    """Blanks become gaps; a gap before an optional group belongs to the group already."""
    return name.replace(" ?", f"(?:{GAP})?").replace(" ", GAP)


#: A sign between words that does not end a sentence; a full stop does before white space, but behind some short forms.
WITHIN = rf"(?:[\x00-\x20\x22-\x2d/:->@-`{{-\x7f]|[.!?](?!\s)|(?:(?<=\binc)|(?<=\bltd)|(?<=\bcorp)|(?<=\bco)|(?<=\bllc)|(?<=\bno))\.)"


def _words_up_to_the_next(start: str) -> str:
    """Words of one sentence, over any number of lines, as far as the same start is not repeated: so texts stay linear."""
    return rf"(?:(?!{GAP}{_gapped(start)}){WITHIN}++{WORD}++)+?"


def _within_a_line(most: int) -> str:
    """Words of at most so many signs on one line, sentence or not."""
    return rf"[{OTHER}]++[^\n]{{0,{most - 1}}}?{WORD}(?!{WORD})"


# Sentences that grant or reserve rights. label; form; expression.
SENTENCES = (
    ("mit", "grant", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "grant", "permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", "grant", "redistribution and use in source and binary forms"),
    ("bsd-3-clause", "grant", rf"neither the name of(?:{_within_a_line(200)}|{_words_up_to_the_next('neither the name of')})? may be used to endorse or promote products"),
    ("bsd-4-clause", "grant", "all advertising materials mentioning features or use of this software"),
    ("unlicense", "grant", "this is free and unencumbered software released into the public domain"),
    ("zlib", "grant", "altered source versions must be plainly marked as such"),
    ("gpl", "grant", "under the terms of the gnu general public licen[sc]e as published by the free software foundation"),
    ("lgpl", "grant", "under the terms of the gnu (?:lesser|library) general public licen[sc]e as published by the free software foundation"),
    ("agpl", "grant", "under the terms of the gnu affero general public licen[sc]e as published by the free software foundation"),
    ("mpl-2.0", "grant", r"this source code form is subject to the terms of the mozilla public licen[sc]e v 2\.0"),
    ("public-domain", "statement", "(?:released|dedicated|placed)(?: in| into| to)? the public domain"),
    ("proprietary", "statement", "(?:proprietary|confidential) and (?:proprietary|confidential)"),
    ("proprietary", "statement", rf"(?:may not|must not|no part of(?:{_within_a_line(80)}|{_words_up_to_the_next('no part of')})? may) be (?:reproduced|copied|redistributed)"),
    ("reserved", "statement", "all rights (?:are )?reserved"),
    ("reserved", "statement", "tous droits réservés"),
    ("reserved", "statement", "todos los derechos reservados"),
    ("reserved", "statement", "alle rechte vorbehalten"),
    ("copyright", "notice", r"(?:copyright|\(c\)|©) (?:\(c\) |© )?(?:19|20)[0-9]{2}"),
)


@dataclass(frozen=True)
class Rule:
    label: str
    form: str
    pattern: re.Pattern
    #: Of each of these a matching text holds at least one.
    needs: tuple[tuple[str, ...], ...]


def _literals(expression) -> list[tuple[str, ...]]:
    """For a parsed expression, sets of literals of each of which every match holds one."""
    return [c for c in _clauses(expression, "") if all(len(w) > 1 or not w.isascii() for w in c)]


def _clauses(parsed, run: str) -> list[tuple[str, ...]]:
    """The same, with what directly precedes; single signs are in."""
    found: list[tuple[str, ...]] = []
    for op, value in parsed:
        if op is ops.LITERAL:
            run += chr(value)
            continue
        if op in (ops.AT, ops.ASSERT, ops.ASSERT_NOT):
            continue
        inner = []
        if op is ops.BRANCH:
            each = [_clauses(p, run) for p in value[1]]
            if all(each):
                best = [max(clauses, key=lambda c: (min(map(len, c)), -len(c))) for clauses in each]
                inner = [tuple(dict.fromkeys(w for c in best for w in c))]
        elif op is ops.SUBPATTERN:
            inner = _clauses(value[-1], run)
        elif op is ops.ATOMIC_GROUP:
            inner = _clauses(value, run)
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT) and value[0] > 0:
            inner = _clauses(value[2], "")
        if run:
            found.append((run,))
        found += inner
        run = ""
    return [*found, (run,)] if run else found


def _version(version: str) -> str:
    major, _, minor = version.partition(".")
    tail = rf"\.{minor}" if minor.strip("0") else rf"(?:\.{minor})?"
    return rf"(?:{GAP})?(?:(?:version|ver|v)(?:{GAP})?)?{major}{tail}(?!\.?[0-9])"


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules in order."""
    under = _gapped("(?:licensed|released|distributed|available|published|provided|covered) (?:under|by) (?:the terms of )?(?:the |an? )?(?:gnu )?")
    under = under.replace(f"{GAP})?", f"{GAP})?")
    made = []

    def add(label: str, form: str, expression: str) -> None:
        needs = tuple(dict.fromkeys(_literals(_parser.parse(BEGIN + expression))))
        made.append(Rule(label, form, re.compile(BEGIN + expression), needs))

    for stem, name, versions, short, address in FAMILIES:
        gapped, brief = _gapped(name), _gapped(short)
        for version in ["", *versions.split()]:
            label, tail = (f"{stem}-{version}", _version(version)) if version else (stem, "")
            close = END if not version else ""
            add(label, "tag", rf"spdx-license-identifier:\s*{re.escape(label)}(?:-only|-or-later|\+)?(?![\w.])")
            add(label, "statement", under + gapped + tail + close)
            add(label, "name", gapped + tail + close)
            if address:
                where = address if not version else address + rf"(?:(?!{address})\S)*?{re.escape(version)}" if not address.endswith(("/", "-", "_")) else address + re.escape(version)
                add(label, "address", where + ("" if version else f"(?!-|{WORD})" if not versions else ""))
            if short and (version or " " in short or stem in ("gpl", "lgpl", "agpl", "cc0", "wtfpl", "0bsd")):
                add(label, "statement", under + brief + tail + close)
                add(label, "short", brief + tail + close)
    for label, form, expression in SENTENCES:
        add(label, form, _gapped(expression) + (END if form != "grant" else ""))
    return tuple(made)


#: Literals that are rare in other texts, preferred as anchors.
RARE = (
    "licen", "spdx", "gpl", "cc by", "cc-by", "cc0", "creative", "commons", "copyright", "©", "(c)", "hereby", "permission", "redistribution", "unencumbered",
    "domain", "proprietary", "reserved", "droits", "derechos", "vorbehalten", "wtfpl", "mozilla", "apache", "eclipse", "bsd", "mpl", "epl", "cddl",
    "eupl", "cecill", "gfdl", "busl", "sspl", "odbl", "odc", "pddl", "ms-pl", "ms-rl", "mit-0", "mit 0", "ms pl", "ms rl", "reproduced", "copied", "redistributed", "advertising", "neither", "altered", "source code form",
)


@lru_cache(maxsize=1)
def gates() -> tuple[ahocorasick.Automaton, tuple[re.Pattern, ...]]:
    """Anchors, and expressions for short forms of several short words: a text without any of both matches no rule."""
    heads = sorted({" ".join(short.split()[:2]) for _, _, _, short, _ in FAMILIES if " " in short})
    words = set()
    for rule in rules():
        if any(_gapped(head) in rule.pattern.pattern for head in heads):
            continue
        known = [c for c in rule.needs if all(any(w in literal for w in RARE) for literal in c)]
        if known:
            words.update(w for literal in known[0] for w in RARE if w in literal)
        else:
            # Few and long ones.
            words.update(max(rule.needs, key=lambda c: (min(min(map(len, c)), 4), -len(c), min(map(len, c)))))
    made = ahocorasick.Automaton()
    for word in sorted(words):
        made.add_word(word, word)
    made.make_automaton()
    return made, tuple(re.compile(_gapped(head)) for head in heads)


def _passes(lowered: str) -> bool:
    anchors, heads = gates()
    return next(anchors.iter(lowered), None) is not None or any(head.search(lowered) for head in heads)


def detections(lowered: str) -> list[tuple[str, str, int, int]]:
    """(label, form, start, end) of the detections that stand, by start; offsets in characters."""
    if not _passes(lowered):
        return []
    found, held = [], {}
    for order, rule in enumerate(rules()):
        for words in rule.needs:
            if words not in held:
                held[words] = any(w in lowered for w in words)
            if not held[words]:
                break
        else:
            rank = FORMS[rule.form][0]
            found += [(rank, m.start() - m.end(), m.start(), order, m.end()) for m in rule.pattern.finditer(lowered)]
    taken: list[tuple[int, int, int]] = []
    reach = _Cover()
    for _, _, start, order, end in sorted(found):
        if not reach.contains(start, end):
            reach.add(start, end)
            taken.append((start, end, order))
    return [(rules()[order].label, rules()[order].form, start, end) for start, end, order in sorted(taken)]


class _Cover:
    """Intervals none of which contains another; tells whether one of them contains a new one."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def contains(self, start: int, end: int) -> bool:
        at = bisect_right(self.starts, start) - 1
        return at >= 0 and self.ends[at] >= end

    def add(self, start: int, end: int) -> None:
        at = bisect_left(self.starts, start)
        # Those that the new one contains can answer nothing that it can't.
        last = at
        while last < len(self.starts) and self.ends[last] <= end:
            last += 1
        self.starts[at:last], self.ends[at:last] = [start], [end]


_BYTE_WORD = rb"0-9a-z\x80-\xff"
_PHRASES = tuple(
    (label, phrase.split()[0].encode(), re.compile(rb"(?<![%b])%b(?![%b])" % (_BYTE_WORD, (b"[^%b]+" % _BYTE_WORD).join(phrase.encode().split()), _BYTE_WORD)))
    for phrase, label in PHRASES
)
_IS_WORD = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])


def phrase_places(lowered: bytes) -> list[tuple[int, str]]:
    """(index of the first word, label) of every place of a fixed phrase."""
    at = [(m.start(), label) for label, first, pattern in _PHRASES if first in lowered for m in pattern.finditer(lowered)]
    if not at:
        return []
    is_word = _IS_WORD[np.frombuffer(lowered, np.uint8)]
    starts = is_word.copy()
    starts[1:] &= ~is_word[:-1]
    before = np.cumsum(starts)
    return sorted((int(before[start]) - 1, label) for start, label in at)


def word_counts(texts: list[bytes]) -> np.ndarray:
    """Words of each text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    is_word = _IS_WORD[np.frombuffer(b"".join(texts), np.uint8)]
    starts = is_word.copy()
    starts[1:] &= ~is_word[:-1]
    edges = np.r_[0, np.cumsum(sizes)]
    begins = edges[:-1][sizes > 0]
    starts[begins] = is_word[begins]
    running = np.r_[0, np.cumsum(starts)]
    return running[edges[1:]] - running[edges[:-1]]


DETECTION = "array<struct<label:string,form:string,start:long,end:long>>"


def scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, places, detections, score) of every text.

    `places` are the fixed phrases as (word, label); `detections` what the rules found, by character; `score` is the
    certainty of the surest of both, 0 without any.
    """
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    place_type = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
    found_type = pa.list_(pa.struct([("label", pa.string()), ("form", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batches_of(batch, "text", BYTES_AT_ONCE):
                lowered = [(t or "").encode().lower() for t in part.column("text").to_pylist()]
                places = [phrase_places(t) for t in lowered]
                found = [detections(t.decode()) for t in lowered]
                score = [max([FORMS[d[1]][1] for d in ds] + [PHRASE_ONLY] * bool(ps), default=0.0) for ps, ds in zip(places, found)]
                columns = [
                    part.column("id"), pa.array(word_counts(lowered)),
                    pa.array([[{"word": w, "label": label} for w, label in ps] for ps in places], place_type),
                    pa.array([[dict(zip(("label", "form", "start", "end"), d)) for d in ds] for ds in found], found_type),
                    pa.array(score, pa.float64()),
                ]
                yield pa.record_batch(columns, ["id", "n_words", "places", "detections", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_words long, places array<struct<word:long,label:string>>, detections {DETECTION}, score double"
    return rows.mapInArrow(read, schema).withColumnRenamed("id", key)


def labelled(scanned: DataFrame) -> DataFrame:
    """A scan with n_base, first_word, last_word and the labels as sorted comma-joined strings."""
    words, base = F.transform("places", lambda p: p["word"]), F.array_distinct(F.transform("places", lambda p: p["label"]))
    own = F.transform("detections", lambda d: d["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return scanned.withColumns(
        {
            "n_base": F.size("places").cast("long"), "first_word": F.array_min(words), "last_word": F.array_max(words),
            "base_labels": joined(base), "labels": joined(F.concat(base, own)),
        }
    )
