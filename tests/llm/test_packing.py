from __future__ import annotations

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerflow.llm import packing
from ledgerflow.llm.queries import op1_pack

VOCABULARY, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def one_by_one(lengths: list[int], capacity: int = packing.CAPACITY) -> list[list[int]]:
    """The bins made one at a time, which is what the plan over counts stands for."""
    left: dict[int, int] = {}
    for length in lengths:
        left[length] = left.get(length, 0) + 1
    bins = []
    while any(left.values()):
        longest = max(x for x, n in left.items() if n)
        left[longest] -= 1
        chosen = [longest, *packing.fullest(left, capacity - longest)]
        for length in chosen[1:]:
            left[length] -= 1
        bins.append(chosen)
    return bins


@pytest.mark.parametrize("seed", range(6))
def test_plan_equals_one_bin_at_a_time(seed):
    draw = random.Random(seed)
    lengths = [min(200, int(draw.lognormvariate(3.5, 1)) + 1) for _ in range(400)]
    plan = packing.slack_plan(collections.Counter(lengths), 200)
    assert [chosen for chosen, times in plan for _ in range(times)] == one_by_one(lengths, 200)


def test_fullest_is_optimal():
    draw = random.Random(5)
    for _ in range(200):
        counts = {draw.randint(1, 40): draw.randint(1, 3) for _ in range(6)}
        room = draw.randint(0, 100)
        sums = {0}
        for length, n in counts.items():
            sums = {s + length * k for s in sums for k in range(n + 1) if s + length * k <= room}
        chosen = packing.fullest(counts, room)
        assert sum(chosen) == max(sums)
        assert all(n <= counts[length] for length, n in collections.Counter(chosen).items())


def test_ids_equal_the_tokenizers_library():
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    reference.encode_special_tokens = True
    encoding = packing.encoder(VOCABULARY, PATTERN)
    texts = ["", " ", "a" * 3000, " " * 3000, "<|endoftext|> x", "na\u00efve \u4f60\u597d \U0001f600!", "it's 12,000.5\r\n\t x", "word " * 500, "\u0085a\u2028b"]
    for text in texts:
        expected = reference.encode(text, add_special_tokens=False).ids
        assert packing.token_ids(text, encoding)[:-1].tolist() == expected, text[:20]
    long = " ".join(f"word{chr(97 + i % 26)} thing, {i}" for i in range(30_000))
    assert len(list(packing.stretches(long))) > 1
    assert packing.token_ids(long, encoding)[:-1].tolist() == reference.encode(long, add_special_tokens=False).ids


def test_long_white_space_equals_the_tokenizers_library(spark):
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    reference = Tokenizer.from_file(tokenizer)
    n = packing.LONG_RUN
    runs = [" " * 2_000_000, "\n" * 1_500_000, "\t" * n, "\xa0" * (n + 7), " \n\t\r" * n, "\u2003\u3000" * n, " " * (n - 1), "\x1c" * (2 * n), "\x85" * n]
    texts = [before + run + after for run in runs for before, after in (("x", "y"), ("", ""), ("it's ", " z"), ("a.", "\n<|endoftext|> b"), ("<|endoftext|>", "<|endoftext|>"), ("1", "\u200bq"))]
    texts += [" " * n + "word" + "\n" * n + "9" + "\t" * n, "word " * 40_000 + " " * (3 * n) + "end " * 40_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    packed = packing.pack_texts(docs, VOCABULARY, PATTERN, tokenizer=tokenizer)
    found = sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in packed.collect())
    expected = []
    for i, text in enumerate(texts):
        ids = np.array([*reference.encode(text, add_special_tokens=False).ids, packing.END_ID], "<u4")
        expected += [(i, start, len(piece), zlib.crc32(piece.tobytes())) for start, piece in packing.pieces(ids)]
    assert found == sorted(expected)


@pytest.fixture(scope="module")
def docs(spark):
    draw = random.Random(2)
    texts = [None, "", "same text", "same text", "long " * 9000] + [" ".join(draw.choices("alpha beta gamma delta".split(), k=draw.randint(1, 900))) for _ in range(120)]
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)] + [(3, "same text", "x", 1)], "doc_id long, text string, length string, id int")


def test_pieces_are_whole_and_sequences_gapless(spark, docs):
    encoding = packing.encoder(VOCABULARY, PATTERN)
    packed = packing.pack_texts(docs, VOCABULARY, PATTERN, with_ids=True).cache()
    rows, texts = packed.collect(), {r["doc_id"]: r["text"] for r in docs.collect()}
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        whole = packing.token_ids(texts[r["doc_id"]], encoding)
        part = whole[r["start"] : r["start"] + r["length"]]
        assert r["ids"] == part.astype(int).tolist()
        assert r["ids_crc32"] == zlib.crc32(part.astype("<u4").tobytes())
    for spans in bins.values():
        place = 0
        for offset, length in sorted(spans):
            assert offset == place
            place += length
        assert place <= packing.CAPACITY
    lengths = [r["length"] for r in rows]
    assert len(bins) == len(one_by_one(lengths))
    joined = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    assert all(len(joined[k]) == sum(n for _, n in spans) for k, spans in bins.items())
    long = sorted((r["piece"], r["start"], r["length"]) for r in rows if r["doc_id"] == 4)
    assert len(long) > 1 and all(length == packing.CAPACITY for _, _, length in long[1:])
    assert sum(r["doc_id"] == 3 for r in rows) == 2
    packed.unpersist()


def test_empty_table(spark, docs):
    assert packing.pack_texts(docs.limit(0), VOCABULARY, PATTERN).count() == 0


def test_added_tokens_inside_a_text(spark, tmp_path):
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    long = "word thing " * 20_000
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y", " <|endoftext|>  \n<|endoftext", "<|ENDOFTEXT|>", long + "<|endoftext|>" + long + "tail"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for packed in (op1_pack(spark, str(tmp_path)), corpus_pipeline.packed(spark, docs, "")):
        found = sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in packed.collect())
        expected = []
        for i, text in enumerate(texts):
            ids = np.array([*reference.encode(text, add_special_tokens=False).ids, packing.END_ID], "<u4")
            expected += [(i, start, len(piece), zlib.crc32(piece.tobytes())) for start, piece in packing.pieces(ids)]
        assert found == sorted(expected)
