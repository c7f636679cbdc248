from __future__ import annotations

import random
import re
from itertools import permutations

import numpy as np
import pytest

from ledgerflow.llm import audit
from tests.conftest import collect

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def fails(rows):
    """The set of letters that each row fails, filter by filter."""
    out = []
    for i, text, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        found = set()
        if len(words) < 100:
            found.add("A")
        if 100 * len(set(words)) < 80 * len(words):
            found.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text):
            found.add("C")
        if re.search(r"[#$%&*|]", text):
            found.add("D")
        if i is not None and any(j is not None and j < i and (other or "") == text for j, other, _ in rows):
            found.add("E")
        out.append(found)
    return out


def brute(rows, labels):
    """Every order applied to the rows, left to right."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    failed, out = fails(rows), []
    for part in sorted({p or "" for *_, p in rows}):
        mine = [(i, f) for (i, _, p), f in zip(rows, failed) if (p or "") == part]
        removed_over = dict.fromkeys("ABCDE", 0)
        found = []
        for order in permutations("ABCDE"):
            left = mine
            for step, letter in enumerate(order, 1):
                gone = [(i, f) for i, f in left if letter in f]
                left = [(i, f) for i, f in left if letter not in f]
                removed_over[letter] += len(gone)
                failing = sum(letter in f for _, f in mine)
                found.append([
                    part, "".join(order), step, len(left), len(gone), failing - len(gone), sum(f == {letter} for _, f in mine),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone),
                ])
        out += [(*row, removed_over[row[1][row[2] - 1]]) for row in found]
    return sorted(out)


def table(seed):
    draw = random.Random(seed)
    plain = [f"w{i}" for i in range(400)]
    texts = [
        " ".join(draw.sample(plain, 120)), " ".join(draw.choices(plain[:60], k=150)), "SHOUT " * 5, "a # b", "", None, " \t\r\n\x0b\x0c ", "café " * 130,
        " ".join(draw.sample(plain, 130)).upper(), " ".join(draw.sample(plain, 100)) + " |", "x" * 300_000, "Aa" * 9 + "aa",
    ]
    rows = [(i, draw.choice(texts) if draw.random() < 0.7 else " ".join(draw.sample(plain, draw.randint(90, 140))), draw.choice(["en", "en", "de", None, ""])) for i in range(150)]
    rows += [(None, texts[0], "en"), (None, "a # b", "en"), (3, rows[3][1], "de"), (3, texts[0], "fr"), (900, texts[0], "clean")]
    draw.shuffle(rows)
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for i in range(0, 150, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (5000, 1, 1)]
    return rows, labels


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "x", 7, 1) for r in rows], "doc_id long, text string, lang string, part string, bits int, id int").repartition(3)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("hot_keys", [2, 1000])
def test_equals_every_order_applied(spark, monkeypatch, seed, hot_keys):
    monkeypatch.setitem(audit.with_facts.__kwdefaults__, "hot_keys", hot_keys)
    rows, labels = table(seed)
    got = collect(audit.filter_audit(*frames(spark, rows, labels)), *COLUMNS)
    assert got == brute(rows, labels)


def test_many_ranges_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(audit, "RANGE_BITS", 2)
    rows, labels = table(3)
    docs, marks = frames(spark, rows, labels)
    failed = audit.failures(docs, marks).cache()
    lists = audit.postings(failed).collect()
    assert all(r["ids"] == sorted(set(r["ids"])) and len({i >> 2 for i in r["ids"]}) == 1 for r in lists)
    assert sum(len(r["ids"]) for r in lists if r["list"] == "A") == sum("A" in f for f in fails(rows))
    assert collect(audit.audit(failed), *COLUMNS) == brute(rows, labels)
    failed.unpersist()


def test_a_part_without_failures_and_empty_tables(spark):
    clean = " ".join(f"w{i}" for i in range(120))
    docs, labels = frames(spark, [(1, clean, "en")], [])
    got = audit.filter_audit(docs, labels).collect()
    assert len(got) == 600 and all(r["kept"] == 1 and r["removed"] == r["shapley"] == 0 for r in got)
    assert audit.filter_audit(docs.limit(0), labels).count() == 0


def test_unions_of_sorted_lists():
    draw = random.Random(4)
    lists = [np.array(sorted(draw.sample(range(500), k)), np.int64) for k in (0, 3, 200, 77, 490)]
    for bits, ids in audit.unions(lists).items():
        assert ids.tolist() == sorted(set().union(*[lists[i].tolist() for i in range(5) if bits >> i & 1]))
