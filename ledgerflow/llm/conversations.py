"""Repair of conversation structure: the cheapest edits that give every conversation a legal order of roles.

A conversation is legal if the initials of its roles are an optional s and pairs of u and a, at least one, or if it is empty. Rows may be kept,
given the other role, deleted, or preceded by new rows; the least cost is that of a shortest path through four states (nothing yet,
after s, after u, after a). Of all cheapest lists of edits the one whose initials come first in ASCII is taken.

Rows are range-partitioned and sorted by conversation and turn, and every partition is read as a stream. A conversation of up to
`CHUNK` rows that lies within a partition is solved where it is met. Longer ones, and those at a partition's ends, are solved
by rank-convergence parallel Viterbi: their rows are cut into chunks, each of which goes backwards from a speculative vector of costs, all at
the same time. Fix-up passes then hand each chunk the vector that the next one starts with; a chunk whose vector differs from the one it
used by a constant alone is done, and a rerun stops at the first row whose vector differs from the former one by a constant alone. These vectors drive the trace of the edits: a
chunk starts from a speculative state, and passes hand on the state that the chunk before ends with until none changes. So one conversation with a third
of all rows is many chunks in many tasks. Only its hash, which is defined over one long string, is computed in a row, as a stream of
constant memory; its audit is one value by definition.

Nulls and ties: null roles and texts count as one space, null turns come first and count for no gap; rows of no conversation (null id) are
one conversation. Rows of one turn are ordered by role, then by a hash of the text. Repeated rows are duplicates. An empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import materialize, with_facts

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows of a chunk, as a power of two, and characters held of one conversation.
CHUNK_BITS = 12
CHUNK = 1 << CHUNK_BITS
TEXT_AT_ONCE = 8 << 20
#: monotonically_increasing_id leaves so many bits to the rows of a partition.
PART_BITS = 33
BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
NAMES = {"u": "user", "a": "assistant"}

#: States: nothing yet, after s, after u, after a. FOLLOWS is the state that an inserted or rerolled row leads to, and its initial.
FOLLOWS = ((2, "u"), (2, "u"), (3, "a"), (2, "u"))
KEEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: What is left to pay after the last row.
FINAL = (0, 2 * INSERT, INSERT, 0)
#: A symbol is an initial's place in here plus 4 times a fault: none, truncated, to be deleted.
INITIALS = "sua?"
SOUND, CUT, GONE = 0, 1, 2
LEGAL_PAIRS = ("su", "ua", "au")

RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Edit(NamedTuple):
    """What happens at one row: the initials inserted before it, the edit's own initial, and the initial of the row's role after it."""

    inserted: str
    kind: str
    role: str


def _choices(symbol: int, state: int, after: tuple[int, ...]) -> list[tuple[str, int, int]]:
    """(edit, cost with all that follows, state it leads to) of a row's own edits, the ASCII-least first."""
    initial, fault = INITIALS[symbol & 3], symbol >> 2
    found = [("D", DELETE + after[state], state)]
    if fault != GONE:
        extra = TRUNCATED if fault == CUT else 0
        if (kept := KEEPS[state].get(initial)) is not None:
            found.append(("K", extra + after[kept], kept))
        changed = FOLLOWS[state][0]
        found.append(("R", REROLE + extra + after[changed], changed))
    return found


@lru_cache(maxsize=1 << 16)
def step_back(symbol: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to go from each state before a row, given those after it; insertions before the row are counted in."""
    own = [min(c[1] for c in _choices(symbol, state, after)) for state in range(4)]
    u, a = min(own[2], INSERT + own[3]), min(own[3], INSERT + own[2])
    return min(own[0], INSERT + u), min(own[1], INSERT + u), u, a


def level(vector: tuple[int, ...]) -> tuple[int, ...]:
    """A vector with its constant taken off."""
    least = min(vector)
    return tuple(v - least for v in vector)


def backward(symbols: bytes, end: tuple[int, ...], known: np.ndarray | None = None) -> np.ndarray:
    """Level vectors before each row and after the last, as small integers; `known` are those of an earlier run from another end.

    A row whose vector is the known one ends the run: what lies before it differs by a constant alone.
    """
    vectors = np.empty((len(symbols) + 1, 4), np.int8) if known is None else known.copy()
    after = level(end)
    vectors[len(symbols)] = after
    for row in range(len(symbols) - 1, -1, -1):
        after = level(step_back(symbols[row], after))
        if known is not None and tuple(known[row].tolist()) == after:
            break
        vectors[row] = after
    return vectors


@lru_cache(maxsize=1 << 16)
def _step_on(symbol: int, state: int, after: tuple[int, ...]) -> tuple[Edit, int, int]:
    """(edit at a row, its cost, the state after it) on the ASCII-least of the cheapest ways."""
    inserted, cost = "", 0
    while True:
        left = step_back(symbol, after)[state]
        choices = _choices(symbol, state, after)
        follows, initial = FOLLOWS[state]
        choices.insert(1, ("I", INSERT + step_back(symbol, after)[follows], follows))
        kind, _, to = next(c for c in choices if c[1] == left)
        cost += left - (step_back(symbol, after)[to] if kind == "I" else after[to])
        if kind != "I":
            role = {"D": "", "K": INITIALS[symbol & 3], "R": initial}[kind]
            return Edit(inserted, kind, role), cost, to
        inserted, state = inserted + initial, to


def trace(symbols: bytes, vectors: np.ndarray, state: int) -> tuple[list[Edit], int, int]:
    """(edits, their cost, the state after the last row) from a state before the first row."""
    edits, total = [], 0
    after = [tuple(v) for v in vectors[1:].tolist()]
    for row, symbol in enumerate(symbols):
        edit, cost, state = _step_on(symbol, state, after[row])
        edits.append(edit)
        total += cost
    return edits, total, state


def closing(state: int) -> str:
    """The initials inserted after the last row."""
    return {0: "", 1: "ua", 2: "a", 3: ""}[state]


def written(edits: list[Edit]) -> str:
    return "".join("I" * len(e.inserted) + e.kind for e in edits)


@lru_cache(maxsize=1 << 14)
def solve(symbols: bytes) -> tuple[list[Edit], str, int, str]:
    """(edits, audit, cost, initials inserted at the end) of a whole conversation."""
    edits, cost, state = trace(symbols, backward(symbols, FINAL), 0)
    last = closing(state)
    return edits, written(edits) + "I" * len(last), cost + INSERT * len(last), last


def symbol_of(role: str, fault: int) -> int:
    at = INITIALS[:3].find(role[0]) if role else -1
    return (3 if at < 0 else at) + 4 * fault


def new_rows(initials: str) -> list[str]:
    return [NAMES[i] + ":" for i in initials]


class _Conversation:
    """The rows of one conversation that a partition's stream has shown so far."""

    def __init__(self, key):
        self.key, self.rows, self.size = key, [], 0

    def add(self, row: tuple) -> None:
        self.rows.append(row)
        self.size += len(row[3])

    def is_long(self) -> bool:
        return len(self.rows) >= CHUNK or self.size > TEXT_AT_ONCE

    def result(self) -> tuple:
        rows = [(turn, role, text) for _, turn, role, text, gone in self.rows if not gone]
        turns = {turn for turn, _, _ in rows if turn is not None}
        seen, symbols, counts = set(), bytearray(), [0, 0, 0]
        for _, role, text in rows:
            body = text.rstrip(BLANKS)
            fault = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ENDS else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            symbols.append(symbol_of(role, SOUND if fault is None else CUT if fault == 2 else GONE))
        initials = [role[:1] for _, role, _ in rows]
        illegal = sum(a + b not in LEGAL_PAIRS for a, b in zip(initials, initials[1:]))
        edits, audit, cost, last = solve(bytes(symbols))
        lines = []
        for (_, role, text), edit in zip(rows, edits):
            lines += new_rows(edit.inserted)
            if edit.kind != "D":
                lines.append(f"{NAMES[edit.role] if edit.kind == 'R' else role}:{text}")
        digest = hashlib.sha256("\n".join(lines + new_rows(last)).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        return self.key, gaps, *counts, illegal, cost, audit, digest


def damaged(rows: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, turn, role, text, gone) with one row in five damaged by a checksum of its place; dropped rows stay as `gone`, without a text."""
    space = F.lit(" ")
    place = F.concat(F.coalesce(F.col(key).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn).cast("string"), space))
    code = F.crc32(place.cast("binary")) % 20
    base = rows.select(
        F.col(key).alias("key"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), space).alias("role"),
        F.coalesce(F.col(text), space).alias("text"), code.alias("code"),
    )
    worn = F.when(F.col("code") <= 1, "").when(F.col("code") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    return base.select(
        "key", "turn", F.when(F.col("code") == 0, "").when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), worn.alias("text"),
        (F.col("code") == 0).alias("gone"), F.explode(F.array_repeat(F.lit(1), F.when(F.col("code") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def _scan(kind: str):
    """mapInArrow over a sorted partition: results of whole conversations, and the rows of all others."""
    schema = f"key {kind}, {RESULT}, pos long, turn long, role string, text string, gone boolean"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, is_open = None, True, False
        done, passed = [], []

        def close(last: bool) -> None:
            nonlocal first
            if now is not None and not is_open:
                if first or last:
                    passed.extend((now.key, *row) for row in now.rows)
                else:
                    done.append(now.result())
            first = first and now is None

        def flush(template: pa.Schema) -> Iterator[pa.RecordBatch]:
            nothing_known, nothing_passed = [None] * 8, [None] * 5
            rows = [(*r, *nothing_passed) for r in done] + [(k, *nothing_known, *r) for k, *r in passed]
            done.clear()
            passed.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), template)], schema=template)

        template = None
        for batch in batches:
            if template is None:
                texts = ("audit", "repaired_sha256")
                counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
                template = pa.schema(
                    [("key", batch.schema.field("key").type), *[(c, pa.int64()) for c in counts], *[(c, pa.string()) for c in texts],
                     ("pos", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("gone", pa.bool_())]
                )
            columns = [batch.column(c).to_pylist() for c in ("key", "pos", "turn", "role", "text", "gone")]
            held = 0
            for key, *row in zip(*columns):
                if now is None or key != now.key:
                    close(last=False)
                    now, is_open = _Conversation(key), False
                if is_open:
                    passed.append((key, *row))
                else:
                    now.add(tuple(row))
                    if now.is_long():
                        passed.extend((key, *r) for r in now.rows)
                        is_open, now.rows = True, []
                held += len(row[3])
                if held > TEXT_AT_ONCE:
                    yield from flush(template)
                    held = 0
            yield from flush(template)
        if template is not None:
            close(last=True)
            yield from flush(template)

    return scan, schema


def _ordered(rows: DataFrame) -> DataFrame:
    order = [F.col("key").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "hash", "tie"]
    keyed = rows.withColumn("hash", F.xxhash64("text")).withColumn("tie", F.monotonically_increasing_id())
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "key", F.monotonically_increasing_id().alias("pos"), "turn", "role", "text", "gone"
    )


def faults(rows: DataFrame) -> DataFrame:
    """Rows of open conversations with their first fault: blank, duplicate, truncated or null."""
    digest = F.sha2(F.to_json(F.struct("name", "role", "text")), 256)
    stored = materialize(rows.withColumn("digest", digest), "conversation-rows")
    first = stored.groupBy("digest").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    told = with_facts(stored, materialize(first, "conversation-first"), "digest")
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    ended = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(blank, "blank").when(F.col("pos") > F.col("first"), "duplicate").when(~ended, "truncated")
    return told.withColumn("fault", fault).drop("digest", "first")


def _chunks(rows: DataFrame) -> DataFrame:
    """(name, chunk, next, at, symbols): runs of rows of one conversation, at most `CHUNK` each, with the number of the run that follows."""
    initial = F.instr(F.lit(INITIALS[:3]), F.substring("role", 1, 1)) - 1
    place = F.when((F.col("role") == "") | (initial < 0), 3).otherwise(initial)
    flaw = F.when(F.col("fault").isNull(), SOUND).when(F.col("fault") == "truncated", CUT).otherwise(GONE)
    runs = rows.groupBy("name", F.shiftright("pos", CHUNK_BITS).alias("chunk")).agg(
        F.array_sort(F.collect_list(F.struct("pos", (place + 4 * flaw).alias("symbol")))).alias("rows")
    )
    runs = materialize(
        runs.select("name", "chunk", F.col("rows.pos").alias("at"), F.col("rows.symbol").alias("symbols")), "conversation-runs"
    )
    known = runs.select("name", "chunk")
    # A run goes on in the next block of its partition, or in the first block of the next partition that has rows: one row per partition.
    part = F.shiftright("chunk", PART_BITS - CHUNK_BITS)
    parts = [r["part"] for r in runs.select(part.alias("part")).distinct().sort("part").collect()]
    begins = F.broadcast(
        runs.sparkSession.createDataFrame(
            [(p, q << (PART_BITS - CHUNK_BITS)) for p, q in zip(parts, parts[1:])], "part long, begin long"
        )
    )
    wanted = runs.withColumn("part", part).join(begins, "part", "left").drop("part")
    here = known.select("name", (F.col("chunk") - 1).alias("chunk"), F.col("chunk").alias("here"))
    there = known.select("name", F.col("chunk").alias("begin"), F.col("chunk").alias("there"))
    linked = wanted.join(here, ["name", "chunk"], "left").join(there, ["name", "begin"], "left")
    return linked.select("name", "chunk", F.coalesce("here", "there").alias("next"), "at", "symbols")


def _vector(values) -> tuple[int, ...]:
    return tuple(int(v) for v in values)


def _run_back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Level vectors of every chunk whose end vector is new; `ends` is what the next chunk starts with, null for a speculative start."""
    for batch in batches:
        vectors, starts = [], []
        for symbols, following, ends, known in zip(batch["symbols"], batch["next"], batch["ends"], batch["vectors"]):
            last = following is None or pd.isna(following)
            end = FINAL if last else (0, 0, 0, 0) if ends is None else _vector(ends)
            former = None if known is None else np.frombuffer(known, np.int8).reshape(-1, 4)
            symbols = bytes(symbols.tolist())
            if former is None or tuple(former[-1].tolist()) != level(end):
                former = backward(symbols, end, former)
            vectors.append(former.tobytes())
            starts.append(former[0].tolist())
        yield batch.drop(columns=["ends", "vectors"]).assign(vectors=vectors, starts=starts)


def converged_vectors(chunks: DataFrame) -> DataFrame:
    """Chunks with the level vectors of all their rows, exact up to a constant per row."""
    schema = "name string, chunk long, next long, at array<long>, symbols array<int>, vectors binary, starts array<int>"
    columns = ["name", "chunk", "next", "at", "symbols"]
    first = chunks.withColumn("ends", F.lit(None).cast("array<int>")).withColumn("vectors", F.lit(None).cast("binary"))
    state = materialize(first.mapInPandas(_run_back, schema), "conversation-vectors")
    while True:
        handed = state.select("name", F.col("chunk").alias("next"), F.col("starts").alias("ends"))
        given = state.join(handed, ["name", "next"], "left")
        # The last four bytes of a chunk's vectors are the level vector that it started from.
        used = F.hex(F.substring("vectors", -4, 4))
        wanted = F.array_join(F.transform("ends", lambda v: F.lpad(F.hex(v), 2, "0")), "")
        if given.where(F.col("next").isNotNull() & (used != wanted)).isEmpty():
            return state
        state = materialize(given.select(*columns, "ends", "vectors").mapInPandas(_run_back, schema), "conversation-vectors")


def _run_on(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        exits = [
            trace(bytes(s.tolist()), np.frombuffer(v, np.int8).reshape(-1, 4), int(entry))[2]
            for s, v, entry in zip(batch["symbols"], batch["vectors"], batch["entry"])
        ]
        yield batch.assign(exit=exits)


def entry_states(state: DataFrame) -> DataFrame:
    """Chunks with the state before their first row: that after the chunk before them, or the first state of all."""
    schema = "name string, chunk long, next long, at array<long>, symbols array<int>, vectors binary, entry int, exit int"
    columns = ["name", "chunk", "next", "at", "symbols", "vectors"]
    before = state.where("next IS NOT NULL").select("name", F.col("next").alias("chunk"), F.lit(3).alias("entry"))
    guessed = state.join(before, ["name", "chunk"], "left").select(*columns, F.coalesce("entry", F.lit(0)).alias("entry"))
    traced = materialize(guessed.mapInPandas(_run_on, schema), "conversation-states")
    while True:
        handed = traced.where("next IS NOT NULL").select("name", F.col("next").alias("chunk"), F.col("exit").alias("told"))
        given = traced.join(handed, ["name", "chunk"], "left").withColumn("told", F.coalesce("told", F.lit(0)))
        if given.where("told <> entry").isEmpty():
            return traced
        traced = materialize(
            given.select(*columns, F.col("told").alias("entry")).mapInPandas(_run_on, schema), "conversation-states"
        )


EDITED = "name string, chunk long, piece string, cost long, illegal long, head string, tail string, next long, at array<long>, before array<string>, kind array<string>, role array<string>, last string"


def _edits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for r in batch.itertuples(index=False):
            symbols = bytes(r.symbols.tolist())
            edits, cost, state = trace(symbols, np.frombuffer(r.vectors, np.int8).reshape(-1, 4), int(r.entry))
            last = closing(state) if r.next is None or pd.isna(r.next) else ""
            initials = [INITIALS[s & 3] for s in symbols]
            rows.append((
                r.name, r.chunk, written(edits) + "I" * len(last), cost + INSERT * len(last), sum(a + b not in LEGAL_PAIRS for a, b in zip(initials, initials[1:])),
                initials[0], initials[-1], r.next, r.at, [e.inserted for e in edits], [e.kind for e in edits], [e.role for e in edits], last,
            ))
        frame = pd.DataFrame(rows, columns=[c.split()[0] for c in EDITED.split(", ")])
        yield frame.assign(next=frame["next"].astype("Int64"))


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 per name over lines that come in order; nothing but the hash's own state is held."""
    name, digest, fresh = None, None, True

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"name": [name], "repaired_sha256": [digest.hexdigest()]})

    for batch in batches:
        for key, lines in zip(batch.column("name").to_pylist(), batch.column("lines").to_pylist()):
            if key != name:
                if name is not None:
                    yield out()
                name, digest, fresh = key, hashlib.sha256(), True
            for line in lines:
                digest.update((line if fresh else "\n" + line).encode())
                fresh = False
    if name is not None:
        yield out()


def _names(initials: Column) -> Column:
    """An array of the lines that inserted rows give."""
    return F.transform(
        F.filter(F.split(initials, ""), lambda i: i != ""), lambda i: F.when(i == "u", NAMES["u"] + ":").otherwise(NAMES["a"] + ":")
    )


def _solved_open(rows: DataFrame) -> DataFrame:
    """(key, results) of the conversations whose rows, in chunks, are spread over tasks."""
    names = materialize(rows.select("key", F.to_json(F.struct("key")).alias("name"), "pos", "turn", "role", "text", "gone"), "conversation-open")
    told = materialize(faults(names.where("NOT gone").drop("gone", "key")), "conversation-faults")
    edited = materialize(entry_states(converged_vectors(_chunks(told))).mapInPandas(_edits, EDITED), "conversation-edits")

    following = edited.select("name", F.col("chunk").alias("next"), F.col("head").alias("follower"))
    seam = F.when(F.col("follower").isNotNull() & ~F.concat("tail", "follower").isin(*LEGAL_PAIRS), 1).otherwise(0)
    audits = edited.drop("at", "before", "kind", "role").join(following, ["name", "next"], "left").groupBy("name").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "piece"))), lambda p: p["piece"]), "").alias("audit"),
        F.sum("cost").alias("cost"), F.sum(F.col("illegal") + seam).alias("illegal"),
    )
    turns = told.where("turn IS NOT NULL").groupBy("name", "turn").agg(F.lit(1).alias("one")).groupBy("name").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps")
    )
    counts = told.groupBy("name").agg(*[F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")])

    each = edited.select("last", F.explode(F.arrays_zip("at", "before", "kind", "role")).alias("e"), F.element_at("at", -1).alias("end"))
    each = each.select(
        F.col("e.at").alias("pos"), F.col("e.before").alias("before"), F.col("e.kind").alias("kind"), F.col("e.role").alias("now"),
        F.when(F.col("e.at") == F.col("end"), F.col("last")).otherwise("").alias("after"),
    )
    role = F.when(F.col("kind") == "R", F.when(F.col("now") == "u", NAMES["u"]).otherwise(NAMES["a"])).otherwise(F.col("role"))
    own = F.when(F.col("kind") == "D", F.array().cast("array<string>")).otherwise(F.array(F.concat(role, F.lit(":"), F.col("text"))))
    lines = told.join(each, "pos").select("name", "pos", F.concat(_names(F.col("before")), own, _names(F.col("after"))).alias("lines"))
    # One string's hash takes its lines one after another.
    in_order = lines.repartition("name").sortWithinPartitions("name", "pos").select("name", "lines")
    hashes = in_order.mapInArrow(_hashes, "name string, repaired_sha256 string")

    found = names.select("key", "name").distinct()
    for part in (audits, turns, counts, hashes):
        found = found.join(part, "name", "left")
    zero = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return found.select(
        "key", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in zero], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def repaired(rows: DataFrame, *, key: str = "conv_id") -> DataFrame:
    """(key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    `rows` hold key, turn, role, text and gone, as `damaged` returns them; rows that are gone only name their conversation.
    """
    scan, schema = _scan(rows.schema["key"].dataType.simpleString())
    scanned = materialize(_ordered(rows).mapInArrow(scan, schema), "conversations")
    results = [c.split()[0] for c in RESULT.split(", ")]
    whole = scanned.where("audit IS NOT NULL").select("key", *results)
    rest = _solved_open(scanned.where("audit IS NULL").select("key", "pos", "turn", "role", "text", "gone"))
    return whole.unionByName(rest).withColumnRenamed("key", key)
