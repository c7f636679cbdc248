from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from ledgerflow.llm import decontam
from ledgerflow.llm.common import table
from ledgerflow.llm.queries import op8_decontam

SF = "/root/testdata/sf0.01"


def slow_words(text):
    return re.findall("[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def slow_matches(text, items, least=0.8):
    """{item: best similarity} over every window of the item's size."""
    words, found = slow_words(text), {}
    for item, content in items:
        other = slow_words(content)
        if not other or not words:
            continue
        width = min(5, len(other))
        if len(words) < width:
            continue
        shingles = lambda w: Counter(tuple(w[i : i + width]) for i in range(len(w) - width + 1))
        right, best = shingles(other), 0.0
        if not shingles(words).keys() & right.keys():
            continue
        for start in range(max(1, len(words) - len(other) + 1)):
            left = shingles(words[start : start + len(other)])
            common = sum((left & right).values())
            best = max(best, common / (sum(left.values()) + sum(right.values()) - common))
        if best >= least:
            found[item] = best
    return found


def test_words_equal_the_definition():
    texts = ["", "One, two;three", "\u00c9t\u00e9  4x4 -- ", "a" * 700 + " " + "b" * 3, None, " x"]
    split = decontam.split_words(texts)
    for row, text in enumerate(texts):
        low, high = np.searchsorted(split.rows, [row, row + 1])
        assert [w.decode() for w in split.words(low, high)] == slow_words(text)
    again = decontam.split_words(["zzz", *texts])
    assert (again.hashes[1:] == split.hashes).all()


def test_blocks_find_all_fingerprints_within_the_radius():
    draw = np.random.default_rng(2)
    fps = draw.integers(1 << 63, size=60, dtype=np.uint64)
    probes = np.array([f ^ np.uint64(sum(1 << int(b) for b in draw.choice(64, n, replace=False))) for n, f in zip(range(60), fps)], np.uint64)
    found = {(a, b) for a, b, _ in decontam.BlockTable(fps, 16).near(probes)}
    assert found == {(i, j) for i in range(60) for j in range(60) if (int(probes[i]) ^ int(fps[j])).bit_count() <= 16}
    assert (16, 16) in found and (17, 17) not in found


def test_window_fingerprints_equal_the_definition():
    shingles = np.random.default_rng(3).integers(1 << 63, size=40, dtype=np.uint64) * np.uint64(2)
    for size in (1, 7, 40):
        for at, fp in enumerate(decontam.window_fingerprints(shingles, size).tolist()):
            votes = [sum(int(h) >> b & 1 for h in shingles[at : at + size]) for b in range(64)]
            assert fp == sum(1 << b for b in range(64) if 2 * votes[b] > size)


ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega one two three four"),
         (2, "Short item"), (3, "a b c d e f g h i j k l m n o p"), (4, None), (5, ""), (6, "!!!"), (None, "no id at all here but text")]


def test_planted_passages():
    draw = random.Random(4)
    filler = [f"w{i}" for i in range(3000)]
    bench = decontam.Benchmark([i for i in ITEMS if i[0] is not None and i[1]])
    words = ITEMS[0][1].split()
    for trial in range(60):
        passage = list(words)
        for _ in range(trial % 3):
            passage[draw.randrange(len(passage))] = "changed"
        text = " ".join(draw.choices(filler, k=draw.randint(0, 200)) + passage + draw.choices(filler, k=draw.randint(0, 200)))
        text = text.upper().replace(" ", draw.choice([" ", "  ", ", ", "\n"]))
        found = {item: score for item, _, score in bench.matches([text])[0]}
        assert found.keys() == slow_matches(text, ITEMS[:3]).keys()
    text = "x y " + ITEMS[1][1] + " z"
    assert bench.matches([text, None, "", "short item", "short", " ".join(words[:26])])[0] == [(2, 2, 1.0)]


def test_query_against_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    got = {(r["doc_id"], r["item_id"]) for r in op8_decontam(spark, SF).collect()}
    assert got and got == {(d, i) for d, text in docs.items() for i in slow_matches(text, items)}


@pytest.mark.parametrize("part_bytes", [decontam.PART_BYTES, 60])
def test_odd_rows_and_parts(spark, part_bytes):
    texts = [None, "", "short", ITEMS[0][1], ITEMS[0][1].upper(), "x " * 200_000 + ITEMS[2][1], (ITEMS[2][1] + " ") * 3000]
    rows = [(i, t, "k", 1) for i, t in enumerate(texts)] + [(3, texts[3], "k", 1), (None, texts[3], "k", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item string, similarity int")
    bench = spark.createDataFrame([(*i, 1) for i in ITEMS] + [(1, ITEMS[0][1], 1)], "item_id long, text string, doc_id int")
    got = sorted((str(r["doc_id"]), r["item_id"]) for r in decontam.contamination(docs, bench, part_bytes=part_bytes).collect())
    assert got == [("3", 1), ("3", 1), ("4", 1), ("5", 3), ("6", 3), ("None", 1)]
    kept = decontam.decontaminated(docs, bench, part_bytes=part_bytes)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2]
    assert decontam.contamination(docs.limit(0), bench).count() == 0
    assert decontam.contamination(docs, bench.limit(0)).count() == 0
    assert decontam.decontaminated(docs, bench.limit(0)).count() == len(rows)
