from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from ledgerflow.llm import suffixes


def brute(rows, length):
    """Every window of every text is counted; what a repeated one covers goes."""
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (key, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, np.int8)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = 1
        kept = bytes(b for b, g in zip(t, gone) if not g)
        edges = np.flatnonzero(np.diff(np.r_[0, gone]))
        out.append((key, len(t), [tuple(map(int, p)) for p in edges.reshape(-1, 2)], hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, **how):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, tid string, lead int").repartition(5)
    got = suffixes.without_repeats(docs, **how).collect()
    return sorted(((r["doc_id"], r["n_bytes"], [tuple(s) for s in r["spans"]], r["kept_sha256"]) for r in got), key=str)


def corpus(seed, length, count):
    """Texts with shared passages at both ends and inside, overlapping cuts of one source, copies, near copies and runs."""
    draw = random.Random(seed)
    sign = lambda n: "".join(draw.choices("abcdefgh é", k=n))
    source, passages = sign(12 * length), [sign(draw.randint(length - 4, 3 * length)) for _ in range(4)]
    texts = []
    for _ in range(count):
        kind = draw.randrange(7)
        start = draw.randrange(10 * length)
        own = sign(draw.randint(0, 2 * length))
        texts.append((
            own, own + draw.choice(passages) + sign(30), draw.choice(passages) + own, source[start : start + draw.randint(length // 2, 3 * length)],
            own + source[start : start + 2 * length] + draw.choice(passages), draw.choice(passages) * 2, sign(5) + "ab" * draw.randint(0, length) + sign(5),
        )[kind])
    base = sign(6 * length)
    texts += [base, base, base[: 3 * length] + "#" + base[3 * length :], base[: 4 * length] + "##" + base[4 * length + 1 :], base[5:]]
    texts += [None, "", " " * (4 * length), " " * (length - 1), "x" * length, "x" * length, "y" * (length + 1), "same", "same"]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, texts[3])]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,bucket_rows,hot_keys", [(1, 10_000, 1000), (2, 7, 1000), (3, 7, 2), (4, 40, 12)])
def test_equals_counting_every_window(spark, seed, bucket_rows, hot_keys):
    rows = corpus(seed, 40, 120)
    assert found(spark, rows, length=40, lead=8, bucket_rows=bucket_rows, hot_keys=hot_keys) == brute(rows, 40)


def test_a_passage_in_nearly_all_texts(spark):
    draw = random.Random(9)
    passage = "".join(draw.choices("abcdefgh", k=90))
    rows = [(i, "".join(draw.choices("abcdefgh", k=60)) + passage + "".join(draw.choices("abcdefgh", k=60))) for i in range(300)]
    got = found(spark, rows, length=40, lead=8, bucket_rows=25)
    assert got == brute(rows, 40)
    assert all(s for _, _, s, _ in got)


def test_production_length_and_kept_text(spark):
    draw = random.Random(6)
    word = lambda n: " ".join("".join(draw.choices("abcdefghijkl", k=5)) for _ in range(n))
    shared = word(90)
    rows = [(i, word(200) + shared + word(50)) for i in range(6)] + [(7, word(300)), (8, shared[:399]), (9, "é" * 1000)]
    got = found(spark, rows)
    assert got == brute(rows, 400)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(rows)
    for r in suffixes.without_repeats(docs, with_text=True).collect():
        data, kept, place = texts[r["doc_id"]].encode(), b"", 0
        for start, stop in r["spans"]:
            kept, place = kept + data[place:start], stop
        assert hashlib.sha256(kept + data[place:]).hexdigest() == r["kept_sha256"]
        if r["kept"] is not None:
            assert r["kept"] == kept + data[place:]


def test_empty_table_and_long_runs(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.without_repeats(docs).count() == 0
    rows = [(1, " " * 3_000_000), (2, "\n" * 1_500_000 + "a"), (3, "b" + " " * 450)]
    got = {k: (n, s) for k, n, s, _ in found(spark, rows)}
    assert got == {1: (3_000_000, [(0, 3_000_000)]), 2: (1_500_001, [(0, 1_500_000)]), 3: (451, [(1, 451)])}


def test_multikey_order_and_common_lengths():
    draw = random.Random(2)
    strings = [bytes(draw.choices(b"ab", k=draw.randint(0, 20))) for _ in range(500)]
    rows = suffixes.padded(strings, 20)
    order, common = suffixes.multikey_order(rows)
    whole = [r.tobytes() for r in rows[order]]
    assert whole == sorted(whole)
    for a, b, n in zip(whole, whole[1:], common[1:]):
        assert a[:n] == b[:n] and (n == 20 or a[n] != b[n])


def test_equal_windows_have_equal_leads():
    draw = random.Random(8)
    part = bytes(draw.choices(b"abcd", k=900))
    places = []
    for before in (b"", b"zzz" * 50):
        data = before + part
        leads = {}
        for at, low, high, _ in suffixes.led_windows(np.frombuffer(data, np.uint8), 400, 64):
            for a, u, v in zip(at, low, high):
                leads |= {int(a) - s: s for s in range(u, v + 1)}
        assert sorted(leads) == list(range(len(data) - 399))
        places.append([leads[len(before) + i] for i in range(501)])
    assert places[0] == places[1]
