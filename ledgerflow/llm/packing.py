"""Best-fit packing of token sequences by minimum bin slack.

Every text becomes a run of token ids with an end id; runs longer than a sequence are cut into whole
sequences behind a shorter first piece. Which pieces share a sequence depends on lengths alone. So the
lengths are counted, one row per length, and the plan is made from these counts, at most `capacity`
of them whatever the size of the corpus. A bin opens with the longest length that is left; a
dynamic program over bit sets of reachable sums, with the counts as bounds, then finds the fullest
feasible combination. The same combination stays the fullest until one of its lengths runs out, so it is
taken that many times at once, which gives the same bins as one by one.

The plan says, for each length, which bins take its pieces by rank. Pieces are ranked within their length from
counts per stored file and length, so no task holds a length, however common it is.

Nulls and ties: a null text counts as empty and has the end id alone; repeated rows are packed each for
itself; pieces of one length are interchangeable. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.llm.common import batches_of, materialize

CAPACITY = 2048
END_ID = 0
BYTES_AT_ONCE = 4 << 20
#: Texts are encoded in stretches of about so many characters, cut only before a blank between a letter
#: and a letter, where the vocabulary's pattern always parts words.
STRETCH = 1 << 17
_SAFE_CUT = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
#: Runs of white space, by its Unicode property, that are encoded by themselves.
LONG_RUN = 1 << 12
_LONG_RUNS = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)


def added_tokens(path: str) -> dict[str, int]:
    """The strings that a tokenizer's JSON file takes out of a text as tokens of their own, with their ids."""
    with open(path, encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError("added tokens that depend on the text around them are not supported")
    return {t["content"]: t["id"] for t in added}


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str, tokenizer: str | None = None) -> tiktoken.Encoding:
    """A byte-level vocabulary from a file of base64 tokens and ranks, with the added tokens of a tokenizer's JSON file; without it, their strings are ordinary text."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added_tokens(tokenizer) if tokenizer else {})


@lru_cache(maxsize=4)
def one_word(encoding: tiktoken.Encoding) -> tiktoken.Encoding:
    """The same vocabulary for a text that the pattern takes as one word."""
    ranks = {token: encoding.encode_single_token(token) for token in encoding.token_byte_values()}
    return tiktoken.Encoding("word", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})


def stretches(text: str, most: int = STRETCH) -> Iterator[str]:
    start = 0
    while len(text) - start > most:
        cut = _SAFE_CUT.search(text, start + most)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encoded(text: str, encoding: tiktoken.Encoding) -> Iterator[list[int]]:
    """Ids of a text in parts.

    The pattern looks ahead from every sign of a run of white space, for which the library's memory is bounded; so long runs are cut out by the
    pattern's own rule: a run is one word, but for its last sign if a word follows. An added token ends a text.
    """
    start = 0
    for run in _LONG_RUNS.finditer(text):
        ends = run.end() == len(text) or any(text.startswith(t, run.end()) for t in encoding.special_tokens_set)
        stop = run.end() if ends else run.end() - 1
        for part in stretches(text[start : run.start()]):
            yield encoding.encode(part, allowed_special="all")
        yield one_word(encoding).encode_ordinary(text[run.start() : stop])
        start = stop
    for part in stretches(text[start:]):
        yield encoding.encode(part, allowed_special="all")


def token_ids(text: str | None, encoding: tiktoken.Encoding, end_id: int = END_ID) -> np.ndarray:
    parts = [np.array(ids, "<u4") for ids in encoded(text or "", encoding)]
    return np.concatenate([*parts, np.array([end_id], "<u4")])


def pieces(ids: np.ndarray, capacity: int = CAPACITY) -> Iterator[tuple[int, np.ndarray]]:
    """(start, ids) of each piece; only the first may be shorter than a sequence if there are several."""
    first = len(ids) % capacity or capacity
    yield 0, ids[:first]
    for start in range(first, len(ids), capacity):
        yield start, ids[start : start + capacity]


def cut_texts(
    docs: DataFrame, vocabulary: str, pattern: str, *, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
    end_id: int = END_ID, with_ids: bool = False, tokenizer: str | None = None,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32 and, if asked for, ids) of every piece of every text.

    Without the ids a piece takes a few bytes, so the packing never moves a text or its tokens.
    """
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(vocabulary, pattern, tokenizer)
        for batch in batches:
            for part in batches_of(batch, "text", BYTES_AT_ONCE):
                found = [
                    (row, number, start, len(ids), zlib.crc32(ids.tobytes()), ids if with_ids else None)
                    for row, value in enumerate(part.column("text").to_pylist())
                    for number, (start, ids) in enumerate(pieces(token_ids(value, encoding, end_id), capacity))
                ]
                at, number, start, length, crc, ids = (list(c) for c in zip(*found))
                columns = {
                    "id": part.column("id").take(pa.array(at)), "piece": pa.array(number, pa.int32()), "start": pa.array(start, pa.int64()),
                    "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.array([x.astype("<i4") for x in ids], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(
        cut, f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    )


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """The lengths of a fullest combination that fits, longer ones preferred, as bounded subset sums over bit sets."""
    limit, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x, n in counts.items() if n and x <= room), reverse=True):
        left, taken = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            taken = min(taken, left)
            before = reach
            reach |= (reach << taken * length) & limit
            if reach != before:
                steps.append((length, taken, before))
            left -= taken
            taken *= 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, []
    for length, taken, before in reversed(steps):
        if not before >> total & 1:
            chosen += [length] * taken
            total -= length * taken
    return chosen


def slack_plan(counts: dict[int, int], capacity: int = CAPACITY) -> Iterator[tuple[list[int], int]]:
    """(lengths of a bin, number of such bins), until every piece is in a bin."""
    left = {length: n for length, n in counts.items() if n}
    while left:
        longest = max(left)
        left[longest] -= 1
        chosen = [longest, *fullest(left, capacity - longest)]
        left[longest] += 1
        need = {length: chosen.count(length) for length in chosen}
        times = min(left[length] // n for length, n in need.items())
        for length, n in need.items():
            left[length] -= n * times
            if not left[length]:
                del left[length]
        yield chosen, times


def placements(plan: Iterator[tuple[list[int], int]]) -> pd.DataFrame:
    """For each length the runs of ranks: (length, low rank, bins' first number, pieces per bin, offset in the bin)."""
    rows, next_bin, ranked = [], 0, {}
    for chosen, times in plan:
        offset = 0
        for length in dict.fromkeys(chosen):
            each = chosen.count(length)
            low = ranked.get(length, 0)
            rows.append((length, low, next_bin, each, offset))
            ranked[length] = low + each * times
            offset += each * length
        next_bin += times
    return pd.DataFrame(rows, columns=["length", "low", "bin", "each", "offset"], dtype="int64")


def ranks_in_length(stored: DataFrame) -> DataFrame:
    """A stored table with `rank`, the number of rows of the same length before each, from 0.

    Rows are numbered within (length, file), and files within a length by the sum of the counts before them.
    """
    rows = stored.withColumn("file", F.col("_metadata.file_path")).withColumn("at", F.col("_metadata.row_index"))
    counts = rows.groupBy("length", "file").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    numbered = rows.withColumn("nth", F.row_number().over(Window.partitionBy("length", "file").orderBy("at")))
    return numbered.join(before, ["length", "file"]).withColumn("rank", F.col("before") + F.col("nth") - 1).drop("file", "at", "before", "nth")


def pack(stored: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """A stored table with a column `length` (1 to capacity), with sequence_id and offset of every row."""
    # At most `capacity` rows.
    counts = {r["length"]: r["n"] for r in stored.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = placements(slack_plan(counts, capacity))
    by_length = {length: runs.to_numpy() for length, runs in plan.groupby("length")}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lengths, ranks = batch["length"].to_numpy(), batch["rank"].to_numpy()
            sequence, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            order = np.argsort(lengths, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else ():
                length = lengths[rows[0]]
                runs = by_length[length]
                run = runs[np.searchsorted(runs[:, 1], ranks[rows], side="right") - 1]
                inside, each = ranks[rows] - run[:, 1], run[:, 3]
                sequence[rows] = run[:, 2] + inside // each
                offset[rows] = run[:, 4] + inside % each * length
            yield batch.drop(columns="rank").assign(sequence_id=sequence, offset=offset)

    ranked = ranks_in_length(stored)
    kept = [f for f in ranked.schema.fields if f.name != "rank"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "sequence_id long", "offset long"])
    return ranked.select(*[f.name for f in kept], "rank").mapInPandas(place, schema)


def pack_texts(
    docs: DataFrame, vocabulary: str, pattern: str, *, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
    end_id: int = END_ID, with_ids: bool = False, tokenizer: str | None = None,
) -> DataFrame:
    """(key, piece, start, length, ids_crc32, [ids,] sequence_id, offset) of every piece of every text."""
    cut = cut_texts(docs, vocabulary, pattern, key=key, text=text, capacity=capacity, end_id=end_id, with_ids=with_ids, tokenizer=tokenizer)
    packed = pack(materialize(cut, "packing-pieces"), capacity=capacity)
    return packed.select(*cut.columns, "sequence_id", "offset").withColumnRenamed("id", key)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) from packed pieces that carry their ids; a sequence holds at most one capacity of them."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
