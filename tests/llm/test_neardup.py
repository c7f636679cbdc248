from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerflow.llm import neardup


def slow_fingerprint(text, width=3):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lowered + " ":
        if c in " \t\n\x0b\x0c\r":
            words, word = words + [word] * bool(word), ""
        else:
            word += c
    if not words:
        return 0
    width = min(width, len(words))
    hashes = [xxhash.xxh64(" ".join(words[i : i + width]).encode(), seed=42).intdigest() for i in range(len(words) - width + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps, radius=3):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(fps))]


def same_classes(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one TWO", "a b c d e f", "\u00c4\u00d6 stra\u00dfe\u00a0x\u2003y z", "w " * 3000])
def test_fingerprint_equals_the_definition(text):
    assert neardup.simhash(text) % (1 << 64) == slow_fingerprint(text)


def test_native_hash_is_the_same(spark):
    row = spark.createDataFrame([("a b c",)], "t string").select(F.xxhash64("t")).first()
    assert row[0] % (1 << 64) == xxhash.xxh64(b"a b c", seed=42).intdigest()


def test_pigeonhole_masks():
    masks = [m % (1 << 64) for m in neardup.block_masks(6, 3)]
    assert len(masks) == 20
    draw = random.Random(1)
    for _ in range(500):
        change = sum(1 << b for b in draw.sample(range(64), 3))
        assert any(not change & m for m in masks)


def clouds(draw, centres, each, most):
    for _ in range(centres):
        centre = draw.getrandbits(64)
        for _ in range(each):
            yield centre ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, most)))


@pytest.mark.parametrize("seed, chunk", [(1, neardup.CHUNK), (2, 7), (3, 40)])
def test_links_connect_what_close_pairs_connect(spark, seed, chunk):
    draw = random.Random(seed)
    fps = sorted({*clouds(draw, 8, 60, 4), *clouds(draw, 200, 2, 5), 0, (1 << 64) - 1})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    links = neardup.close_links(frame, chunk=chunk).collect()
    assert all(((a ^ b) % (1 << 64)).bit_count() <= 3 for a, b in links)
    roots = {r["node"]: r["root"] for r in neardup.components(spark.createDataFrame(links, "src long, dst long")).collect()}
    assert same_classes([roots.get(x, x) for x in signed], slow_components(fps))
    assert all(roots[x] <= x for x in roots)


def test_chain_has_one_root(spark):
    n = 300
    order = list(range(n))
    random.Random(4).shuffle(order)
    links = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)], "src long, dst long")
    found = {r["node"]: r["root"] for r in neardup.components(links).collect()}
    assert found == {i: 0 for i in range(1, n)}


def test_forest_is_small():
    draw = random.Random(6)
    members = np.array(sorted(set(clouds(draw, 1, 400, 2))), np.uint64)
    assert len(neardup.forest(members, 3)) < len(members)


BASE = "the quick brown fox jumps over the lazy dog while many other animals look on and wonder what it is that they see "


@pytest.fixture(scope="module")
def docs(spark):
    draw = random.Random(8)
    texts = [None, "", "  ", BASE * 30, BASE.upper() * 30, BASE * 30 + "end", "x"] + [" ".join(f"w{draw.randint(0, 9999)}" for _ in range(200)) for _ in range(40)]
    rows = [(i, t, "en", 0, 1) for i, t in enumerate(texts)] + [(3, texts[3], "en", 0, 1), (None, texts[10], "en", 0, 1), (None, "alone and without any id", "en", 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, fp int, component int").repartition(4)


def test_rows_and_classes(spark, docs):
    got = neardup.near_duplicates(docs).collect()
    rows = docs.collect()
    assert len(got) == len(rows)
    fps = [slow_fingerprint(r["text"]) for r in rows]
    roots = slow_components(fps)
    lowest = {k: min((r["doc_id"] for r, x in zip(rows, roots) if x == k and r["doc_id"] is not None), default=None) for k in roots}
    expected = sorted((str(r["doc_id"]), f, str(lowest[k])) for r, f, k in zip(rows, fps, roots))
    assert sorted((str(r["id"]), r["fp"] % (1 << 64), str(r["component"])) for r in got) == expected


def test_one_document_of_each_group_stays(spark, docs):
    rows = docs.collect()
    kept = neardup.keep_first(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert len(got) == len(set(slow_components([slow_fingerprint(r["text"]) for r in rows])))
    assert {0, 3, 6, 10} <= {r["doc_id"] for r in got} and 4 not in {r["doc_id"] for r in got}
    assert sum(r["doc_id"] == 3 for r in got) == 1


def test_empty_table(spark, docs):
    assert neardup.near_duplicates(docs.limit(0)).count() == 0
    assert neardup.keep_first(docs.limit(0)).count() == 0
