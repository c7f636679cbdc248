from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from ledgerflow.llm import conversations as cv

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
LEGAL = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """(cost, audit, lines): a search by cost, then by audit, over what has been written so far; no vectors."""
    start = (0, "", 0, "", ())
    heap, seen = [start], set()
    while heap:
        cost, audit, at, shape, lines = heapq.heappop(heap)
        # Only the last initial, and whether there is any, matter for what may follow.
        mark = (at, shape[-1:])
        if mark in seen:
            continue
        seen.add(mark)
        if at == len(rows) and LEGAL.fullmatch(shape):
            return cost, audit, lines
        def follow(extra, letter, step, initial, line):
            new = shape + initial
            if any(LEGAL.fullmatch(new + rest) for rest in ("", "a", "ua")):
                heapq.heappush(heap, (cost + extra, audit + letter, at + step, new, lines + ((line,) if initial else ())))
        for role in ("user", "assistant"):
            follow(3, "I", 0, role[0], f"{role}:")
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, shape, lines))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if role[:1] in ("s", "u", "a"):
                    follow(more, "K", 1, role[0], f"{role}:{text}")
                for other in ("user", "assistant"):
                    follow(3 + more, "R", 1, other[0], f"{other}:{text}")
    raise AssertionError


def brute(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        kept = convs[conv]
        role, text = " " if role is None else role, " " if text is None else text
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        kept += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    out = []
    for conv, kept in convs.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        seen, told = set(), []
        for _, role, text in kept:
            body = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            told.append((role, text, fault))
        turns = [t for t, *_ in kept if t is not None]
        cost, audit, lines = cheapest(told)
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(told, told[1:])]
        out.append((
            conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[sum(f == k for *_, f in told) for k in ("blank", "duplicate", "truncated")],
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def conversation(draw, conv, turns):
    texts = ["Well. ", "No end", "", " \t\x0b", "Yes!", "Why?\n", "café  .", "A. B"] + [f"Line {i}." for i in range(40)]
    roles = ["user", "assistant"] * 6 + ["system", "tool", "", None, "agent", "s"]
    rows, at = [], draw.choice([0, 3])
    for i in range(turns):
        role = ["user", "assistant"][i % 2] if draw.random() < 0.8 else draw.choice(roles)
        rows.append((conv, at, role, None if draw.random() < 0.02 else draw.choice(texts)))
        at += draw.choice([1, 1, 1, 1, 2])
    return rows


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, pos int, name string").repartition(parts)


def found(spark, rows):
    result = cv.repaired(cv.damaged(frame(spark, rows)))
    return sorted((tuple(r) for r in result.select(*COLUMNS).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(11)
    made = [row for conv in range(250) for row in conversation(draw, conv, draw.choice([1, 2, 3, 5, 8, 13]))]
    made += conversation(draw, None, 7) + [(900, None, "user", "No turn.")]
    made += [(901, 0, "user", "x" * 3_000_000 + "."), (901, 1, "assistant", "Long.")]
    made += [(i, 0, "user", "Same first turn.") for i in range(1000, 1060)]
    return made


def test_equals_a_search_over_edits(spark, rows):
    assert found(spark, rows) == brute(rows)


def test_long_conversations_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(cv, "CHUNK_BITS", 3)
    monkeypatch.setattr(cv, "CHUNK", 8)
    draw = random.Random(5)
    rows = conversation(draw, 1, 700) + conversation(draw, 2, 40) + conversation(draw, None, 60) + conversation(draw, 3, 4)
    # Copies of one row: all but the first are duplicates, wherever they lie.
    rows += [(4, i, "user", "Again.") for i in range(300)]
    assert found(spark, rows) == brute(rows)


def test_empty_table_and_conversations_that_vanish(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Gone.")]
    assert found(spark, rows) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())] == brute(rows)
    assert cv.repaired(cv.damaged(frame(spark, rows).limit(0))).count() == 0


def test_speculative_runs_agree_after_fix_up():
    draw = random.Random(3)
    symbols = bytes(draw.randrange(12) for _ in range(3000))
    exact = cv.backward(symbols, cv.FINAL)
    guess = cv.backward(symbols, (0, 0, 0, 0))
    fixed = cv.backward(symbols, cv.FINAL, guess)
    assert np.array_equal(exact, fixed)
    # Most of the guess was right already: the run back stops early.
    assert (exact != guess).any(axis=1).sum() < 100
