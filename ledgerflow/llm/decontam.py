"""Benchmark decontamination by SimHash of item-sized windows.

Every benchmark item has a SimHash over its word shingles. A document is read through windows of as many words as an
item has; a window's fingerprint is looked up among the items of that size by blocks: fingerprints within
`RADIUS` bits agree on at least one of `RADIUS + 1` blocks, so the blocks find all of them. For what they find, the exact
similarity of the weighted shingle sets (common over joint weight, a shingle weighing as often as it occurs)
decides.

A window that shares no shingle with an item of its size has similarity zero with all of them. So only windows that
hold a shingle of such an item are fingerprinted; which these are is one vectorised lookup over a batch of texts.

The benchmark goes to the tasks in parts of at most `PART_BYTES` of text; a larger one takes several passes over the
documents, a part each. Nothing is shuffled, and no document is joined with another.

Words are runs of letters and digits of the lower-cased text; all characters beyond ASCII count as letters. An item of
fewer words than a shingle is one shingle; one without words matches nothing. A document shorter than an
item is one window.

Nulls and ties: a null text counts as empty and matches nothing. Repeated rows get the same result each; of windows that
match the first with the smallest distance is reported. Items without an id are left out. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import batches_of, numbered

WORDS = 5
SIMILARITY = 0.8
RADIUS = 16
PART_BYTES = 8 << 20
BYTES_AT_ONCE = 1 << 20
#: Windows fingerprinted at a time.
WINDOWS = 4096

_IS_WORD = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
_ODD = np.random.default_rng(11).integers(1 << 62, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """The words of several texts: bytes joined by blanks, and per word its place, its end, its text and its hash."""

    joined: bytes
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    hashes: np.ndarray

    def words(self, low: int, high: int) -> list[bytes]:
        return [self.joined[a:b] for a, b in zip(self.starts[low:high].tolist(), self.ends[low:high].tolist())]


def split_words(texts: list[str | None]) -> Words:
    encoded = [(t or "").lower().encode() for t in texts]
    joined = b" ".join(encoded) + b" "
    data = np.frombuffer(joined, np.uint8)
    is_word = _IS_WORD[data]
    edges = np.flatnonzero(is_word[1:] != is_word[:-1]) + 1
    if is_word[0]:
        edges = np.r_[0, edges]
    starts, ends = edges[0::2], edges[1::2]
    at = np.flatnonzero(is_word)
    place = at - np.repeat(starts, ends - starts)
    values = (data[at].astype(np.uint64) + np.uint64(1)) * _ODD[place & 255]
    begins = np.r_[0, np.cumsum(ends - starts)[:-1]]
    hashes = _mix(np.add.reduceat(values, begins)) if len(starts) else np.zeros(0, np.uint64)
    text_ends = np.cumsum([len(t) + 1 for t in encoded])
    return Words(joined, starts, ends, np.searchsorted(text_ends, starts, side="right"), hashes)


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    count = max(0, len(hashes) - width + 1)
    total = np.zeros(count, np.uint64)
    for j in range(width):
        total = total * _STEP + hashes[j : j + count]
    return _mix(total)


def window_fingerprints(shingles: np.ndarray, size: int) -> np.ndarray:
    """The SimHash of every run of `size` shingles."""
    bits = np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    running = np.vstack([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
    votes = running[size:] - running[:-size]
    return np.packbits(2 * votes > size, axis=1, bitorder="little").reshape(-1, 8).copy().view("<u8").ravel()


def similarity(a: list[bytes], b: list[bytes], width: int) -> float:
    """Common over joint weight of two word sequences' shingles."""
    left, right = (Counter(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) for words in (a, b))
    common = sum((left & right).values())
    return common / (sum(left.values()) + sum(right.values()) - common)


class BlockTable:
    """Fingerprints by the value of each of `radius + 1` blocks of bits."""

    def __init__(self, fps: np.ndarray, radius: int):
        self.fps, self.radius = fps, radius
        edges = [64 * i // (radius + 1) for i in range(radius + 2)]
        self.blocks = [(np.uint64(low), np.uint64((1 << (high - low)) - 1)) for low, high in zip(edges, edges[1:])]
        self.tables: list[dict[int, list[int]]] = []
        for shift, mask in self.blocks:
            table = defaultdict(list)
            for at, value in enumerate((fps >> shift & mask).tolist()):
                table[value].append(at)
            self.tables.append(table)

    def near(self, probes: np.ndarray) -> list[tuple[int, int, int]]:
        """(probe, fingerprint, distance) of all pairs within the radius."""
        found = set()
        for (shift, mask), table in zip(self.blocks, self.tables):
            for at, value in enumerate((probes >> shift & mask).tolist()):
                for other in table.get(value, ()):
                    found.add((at, other))
        if not found:
            return []
        pairs = np.array(sorted(found))
        away = np.bitwise_count(probes[pairs[:, 0]] ^ self.fps[pairs[:, 1]])
        close = away <= self.radius
        return [(int(a), int(b), int(d)) for (a, b), d in zip(pairs[close], away[close])]


class Items:
    """The items of one shingle width."""

    def __init__(self, width: int, items: list[tuple[object, list[bytes], np.ndarray]], radius: int):
        self.width = width
        self.ids = [i for i, _, _ in items]
        self.words = [w for _, w, _ in items]
        hashed = [shingle_hashes(h, width) for _, _, h in items]
        self.sizes = np.array([len(h) for h in hashed])
        self.by_size: dict[int, tuple[list[int], BlockTable]] = {}
        for size in np.unique(self.sizes).tolist():
            members = np.flatnonzero(self.sizes == size).tolist()
            fps = np.concatenate([window_fingerprints(hashed[m], size) for m in members])
            self.by_size[size] = (members, BlockTable(fps, radius))
        # Which sizes of items hold a shingle; and a bit map that most other shingles fail.
        sizes_of = defaultdict(set)
        for size, hashes in zip(self.sizes.tolist(), hashed):
            for h in hashes.tolist():
                sizes_of[h].add(size)
        self.known = np.array(sorted(sizes_of), np.uint64)
        self.sizes_of = [sorted(sizes_of[h]) for h in self.known.tolist()]
        self.bits = max(16, int(len(self.known)).bit_length() + 7)
        self.map = np.zeros(1 << self.bits, bool)
        self.map[self.slot(self.known)] = True

    def slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def hits(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, index of the known shingle) of every shingle that an item holds."""
        at = np.flatnonzero(self.map[self.slot(shingles)])
        found = np.searchsorted(self.known, shingles[at])
        right = self.known[np.minimum(found, len(self.known) - 1)] == shingles[at]
        return at[right], found[right]


class Benchmark:
    """Items ready to be found in texts."""

    def __init__(self, rows: list[tuple[object, str | None]], *, words: int = WORDS, radius: int = RADIUS, least: float = SIMILARITY):
        self.least = least
        by_width = defaultdict(list)
        split = split_words([t for _, t in rows]) if rows else None
        for number, (key, _) in enumerate(rows):
            low, high = np.searchsorted(split.rows, [number, number + 1])
            if high > low:
                by_width[min(words, int(high - low))].append((key, split.words(low, high), split.hashes[low:high]))
        self.groups = [Items(width, items, radius) for width, items in sorted(by_width.items())]

    def matches(self, texts: list[str | None]) -> list[list[tuple[object, int, float]]]:
        """For each text the (item, first word, similarity) of items that a window matches, one of each."""
        found: list[dict] = [{} for _ in texts]
        split = split_words(texts)
        for items in self.groups:
            shingles = shingle_hashes(split.hashes, items.width)
            last = len(split.rows) - items.width + 1
            whole = split.rows[: max(0, last)] == split.rows[items.width - 1 :][: max(0, last)]
            at, known = items.hits(shingles)
            inside = whole[at]
            wanted = defaultdict(list)
            for position, shingle in zip(at[inside].tolist(), known[inside].tolist()):
                for size in items.sizes_of[shingle]:
                    wanted[int(split.rows[position]), size].append(position)
            for (row, size), positions in wanted.items():
                low, high = np.searchsorted(split.rows, [row, row + 1])
                for item, first, score in self._windows(items, split, shingles, int(low), int(high), size, positions):
                    if score > found[row].get(item, (0, 0.0))[1]:
                        found[row][item] = (first - int(low), score)
        return [[(items_id, first, score) for items_id, (first, score) in sorted(f.items())] for f in found]

    def _windows(self, items, split, shingles, low, high, size, positions) -> Iterator[tuple[object, int, float]]:
        """Matches of the windows of one text, [low, high) in words, that hold one of the positions."""
        end = high - items.width + 1
        span = min(size, end - low)
        marks = np.zeros(end - low - span + 2, np.int32)
        for p in positions:
            marks[max(0, p - low - span + 1)] += 1
            marks[min(p - low, end - low - span) + 1] -= 1
        starts = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
        members, table = items.by_size[size]
        near = defaultdict(list)
        for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
            for part in range(0, len(run), WINDOWS):
                first, count = int(run[part]), min(WINDOWS, len(run) - part)
                fps = window_fingerprints(shingles[low + first : low + first + count + span - 1], span)
                for probe, member, away in table.near(fps):
                    near[member].append((away, first + probe))
        for member, windows in near.items():
            for _, first in sorted(windows):
                words = split.words(low + first, low + first + span + items.width - 1)
                score = similarity(words, items.words[members[member]], items.width)
                if score >= self.least:
                    yield items.ids[members[member]], low + first, score
                    break


def parts(benchmark: DataFrame, *, item: str = "item_id", text: str = "text", part_bytes: int = PART_BYTES, **how) -> Iterator[Benchmark]:
    """The benchmark in parts of about `part_bytes` of text; one part is on the driver at a time."""
    rows = benchmark.where(F.col(item).isNotNull() & (F.length(text) > 0)).select(F.col(item).alias("id"), F.col(text).alias("text")).distinct()
    held = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-held // part_bytes)
    for number in range(count):
        part = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == number).collect()
        yield Benchmark(sorted((r["id"], r["text"]) for r in part), **how)


def contamination(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", item: str = "item_id", text: str = "text", **how) -> DataFrame:
    """(key, item, first_word, similarity) of every document and item that one of its windows matches."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, item {benchmark.schema[item].dataType.simpleString()}, first_word long, similarity double"
    item_type = pa.string() if schema.split("item ")[1].startswith("string") else pa.int64()
    found = None
    for part in parts(benchmark, item=item, **how):
        shared = docs.sparkSession.sparkContext.broadcast(part)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in batches_of(batch, "text", BYTES_AT_ONCE):
                    pairs = [(row, *m) for row, ms in enumerate(shared.value.matches(piece.column("text").to_pylist())) for m in ms]
                    if pairs:
                        at, items, first, score = (list(c) for c in zip(*pairs))
                        columns = [piece.column("id").take(pa.array(at)), pa.array(items, item_type), pa.array(first, pa.int64()), pa.array(score)]
                        yield pa.record_batch(columns, ["id", "item", "first_word", "similarity"])

        links = rows.mapInArrow(search, schema)
        found = links if found is None else found.unionByName(links)
    if found is None:
        found = docs.sparkSession.createDataFrame([], schema)
    return found.withColumnsRenamed({"id": key, "item": item})


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, item: str = "item_id", text: str = "text", **how) -> DataFrame:
    """The documents without those that match an item."""
    names, column = docs.columns, f"c{docs.columns.index(text)}"
    rows = numbered(docs)
    for part in parts(benchmark, item=item, **how):
        shared = docs.sparkSession.sparkContext.broadcast(part)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in batches_of(batch, column, BYTES_AT_ONCE):
                    free = [not m for m in shared.value.matches(piece.column(column).to_pylist())]
                    yield piece.filter(pa.array(free))

        rows = rows.mapInArrow(clean, rows.schema)
    return rows.toDF(*names)
