"""Removal of long repeats: every byte covered by a string of `LENGTH` bytes that also starts anywhere else.

A window is `LENGTH` bytes of one text. Its lead is that `LEAD`-byte string in it whose hash is the smallest, the leftmost of equals, so equal windows have
equal leads at the same place. The suffixes that begin with a lead stand for all windows: each has the run of windows that it leads,
and a context, the bytes that these cover. One text has about one such suffix in 170 bytes.

1. Contexts that occur more than once, by their digests, are repeated as a whole; no bytes are moved for them. Contexts whose lead no other context
   shares are settled too. Leads with more than a thousandth of all suffixes are taken apart by context beforehand, so no task holds one of them.
2. The other contexts, each once, are range-partitioned by their suffix: Spark samples splitters, so that buckets are of one size, and a suffix that
   very many contexts share is dealt to several buckets. In a bucket the suffixes are sorted token by token, only those still equal to a neighbour going on
   to the next token, and so are the bytes before them, backwards. The common lengths of neighbours then tell for each place of the lead in a
   window which windows are equal.
3. Contexts with windows that equal the first or the last suffix of a bucket, as far as the window reaches, may have equals in another bucket. They are
   dealt again, by lead and the bytes before it, and compared as before. Windows that reach a boundary in both ways are compared across
   boundaries by digest, one row per bucket and different window.

Texts with copies are repeated as a whole, by digest. Only texts that are partly repeated or hold a context to be sorted are shuffled.

Nulls and ties: a null text counts as empty; texts under `LENGTH` bytes are kept, copies too. Repeated rows are copies of each other. Rows without an id
are returned as others. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.llm.common import HOT_KEYS, batches_of, materialize, with_facts

LENGTH = 400
LEAD = 64
#: Windows looked at in one go, and bytes of text taken from a batch at a time.
BLOCK = 1 << 19
BYTES_AT_ONCE = 4 << 20
#: Suffixes of one bucket, about.
BUCKET_ROWS = 20_000
#: Odd multipliers of the hash, one per doubling of the hashed length.
MULTIPLIERS = tuple((0x9E3779B97F4A7C15 * (2 * i + 1) ^ 0xD6E8FEB86659FD93 << i) & (1 << 64) - 1 | 1 for i in range(16))
#: Bits that a position inside a block takes in the packed minimum.
PLACE_BITS = 20


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` bytes (a power of two) from each position on."""
    hashes, width, level = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(MULTIPLIERS[0]), 1, 1
    while width < size:
        hashes = hashes[:-width] * np.uint64(MULTIPLIERS[level]) + hashes[width:]
        hashes ^= hashes >> np.uint64(29)
        width, level = 2 * width, level + 1
    return hashes


def led_windows(data: np.ndarray, length: int, lead: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(position of a lead, its least and greatest distance from the start of a window that it leads, its hash), block by block.

    The windows of a text are those that start at 0 to its size less `length`; each has one lead.
    """
    reach = length - lead + 1
    for low in range(0, len(data) - length + 1, BLOCK):
        hashes = gram_hashes(data[low : low + BLOCK + length - 1], lead)
        places = np.arange(len(hashes), dtype=np.uint64)
        least, width = (hashes >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | places, 1
        while 2 * width <= reach:
            least, width = np.minimum(least[:-width], least[width:]), 2 * width
        least = np.minimum(least[: len(least) - (reach - width)], least[reach - width :])
        found = (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
        last = np.r_[first[1:], len(found)] - 1
        at = found[first]
        yield low + at, at - last, at - first, hashes[at].view(np.int64)


def merged(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals as disjoint ones that do not touch, in order."""
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], np.maximum.accumulate(stops[order])
    fresh = np.flatnonzero(np.r_[True, starts[1:] > stops[:-1]])
    return starts[fresh], stops[np.r_[fresh[1:], len(starts)] - 1]


SUFFIXES = "tid binary, at long, low int, high int, lead long, context long, times int"


def suffixes(texts: DataFrame, *, length: int = LENGTH, lead: int = LEAD) -> DataFrame:
    """(tid, at, low, high, lead, context, times) of the suffixes of texts (tid, text); a text that a task meets again is passed over.

    A context that one block of a text holds several times (`times` 2) has one row; the bytes of all its places are one row without a lead for each
    run of them, from `at` to `at + high`. So long runs of one sign give few rows.
    """

    def each(data: bytes) -> Iterator[tuple[np.ndarray, ...]]:
        for at, low, high, leads in led_windows(np.frombuffer(data, np.uint8), length, lead):
            digest = xxhash.xxh3_64_intdigest
            spans = zip((at - high).tolist(), (at - low + length).tolist(), ((low << 16) | high).tolist())
            contexts = np.array([digest(data[a:b], seed) for a, b, seed in spans], np.uint64).view(np.int64)
            _, first, where, counts = np.unique(contexts, return_index=True, return_inverse=True, return_counts=True)
            again = counts[where] > 1
            yield at[first], low[first], high[first], leads[first], contexts[first], np.minimum(counts, 2)
            if again.any():
                start, stop = merged((at - high)[again], (at - low + length)[again])
                yield start, np.zeros_like(start), stop - start, None, None, np.full_like(start, 2)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for part in batches_of(batch, "text", BYTES_AT_ONCE):
                for tid, text in zip(part.column("tid").to_pylist(), part.column("text").cast(pa.binary()).to_pylist()):
                    if len(text) < length or tid in seen:
                        continue
                    seen.add(tid)
                    for at, low, high, leads, contexts, times in each(text):
                        n = len(at)
                        none = pa.nulls(n, pa.int64())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([tid] * n, pa.binary()), pa.array(at), pa.array(low, pa.int32()), pa.array(high, pa.int32()),
                             none if leads is None else pa.array(leads), none if contexts is None else pa.array(contexts), pa.array(times, pa.int32())],
                            names=[c.split()[0] for c in SUFFIXES.split(", ")],
                        )

    return texts.select("tid", "text").mapInArrow(found, SUFFIXES)


def notable(stored: DataFrame, *, hot_keys: int = HOT_KEYS) -> DataFrame:
    """Suffixes that matter: `repeated` if their context occurs elsewhere, `sorts` if they stand for a context whose lead others share too.

    A lead is shuffled as one unless it is hot; then its contexts are counted first, before any row is moved.
    """
    rows = stored.where("lead IS NOT NULL")
    total = rows.count()
    counted = rows.groupBy("lead").agg(F.count("*").alias("_rows"))
    hot = F.broadcast(materialize(counted.where(F.col("_rows") * hot_keys > total).select("lead"), "suffix-hot"))

    by_lead, by_context = Window.partitionBy("lead"), Window.partitionBy("lead", "context")
    cold = rows.join(hot, "lead", "left_anti").withColumn("all", F.count("*").over(by_lead))
    cold = cold.withColumn("n", F.count("*").over(by_context)).withColumn("nth", F.row_number().over(by_context.orderBy("tid", "at")))
    cold = cold.withColumn("repeated", (F.col("n") > 1) | (F.col("times") > 1)).withColumn("sorts", (F.col("all") > F.col("n")) & (F.col("nth") == 1))

    heavy = materialize(rows.join(hot, "lead").withColumn("pair", F.struct("lead", "context")), "suffix-heavy")
    facts = heavy.groupBy("pair").agg(F.count("*").alias("n"), F.min(F.struct("tid", "at")).alias("first"))
    told = with_facts(heavy, materialize(facts, "suffix-pairs"), "pair", hot_keys=hot_keys)
    told = told.withColumn("repeated", (F.col("n") > 1) | (F.col("times") > 1)).withColumn("sorts", F.struct("tid", "at") == F.col("first"))
    columns = ["tid", "at", "low", "high", "repeated", "sorts"]
    return cold.select(*columns).unionByName(told.select(*columns)).where("repeated OR sorts")


CONTEXT = "tid binary, at long, low int, high int, repeated boolean, fwd binary, back binary"


def contexts(touched: DataFrame, *, length: int = LENGTH) -> DataFrame:
    """(tid, at, low, high, repeated, fwd, back): the bytes of each context from its lead on, and those before it, backwards."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batches_of(batch, "text", BYTES_AT_ONCE):
                rows = []
                for tid, text, refs in zip(part.column("tid").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), part.column("refs").to_pylist()):
                    for r in refs:
                        at, low, high = r["at"], r["low"], r["high"]
                        rows.append((tid, at, low, high, r["repeated"], text[at : at - low + length], text[at - high : at][::-1]))
                if rows:
                    kinds = (pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary())
                    names = ["tid", "at", "low", "high", "repeated", "fwd", "back"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return touched.select("tid", "text", "refs").mapInArrow(cut, CONTEXT)


def padded(strings: list[bytes], width: int) -> np.ndarray:
    """The strings as rows of bytes, filled up with zeros."""
    return np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(len(strings), width)


def multikey_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the rows, common length of each with the one before it, 0 for the first).

    Tokens of eight bytes are compared one after another; rows that differ from all others in a token take no part in the next.
    """
    count, width = rows.shape
    tokens = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, -width % 8)))).view(">u8").astype(np.uint64)
    order, group, left = np.arange(count), np.zeros(count, np.int64), np.arange(count)
    for depth in range(tokens.shape[1]):
        if not len(left):
            break
        token = tokens[order[left], depth]
        by = np.lexsort((token, group[left]))
        order[left], token = order[left][by], token[by]
        # A group is named by the place of its first row.
        fresh = np.r_[True, (token[1:] != token[:-1]) | (group[left][1:] != group[left][:-1])]
        group[left] = left[np.maximum.accumulate(np.where(fresh, np.arange(len(left)), 0))]
        single = fresh & np.r_[fresh[1:], True]
        left = left[~single]
    common = np.zeros(count, np.int64)
    for low in range(1, count, 4096):
        high = min(low + 4096, count)
        differs = rows[order[low:high]] != rows[order[low - 1 : high - 1]]
        common[low:high] = np.where(differs.any(1), differs.argmax(1), width)
    return order, common


def common_length(rows: np.ndarray, other: np.ndarray) -> np.ndarray:
    differs = rows != other
    return np.where(differs.any(1), differs.argmax(1), rows.shape[1])


class Bucket:
    """The contexts of one bucket, sorted from the lead on and, backwards, by what comes before it."""

    def __init__(self, rows: pa.Table, length: int, lead: int):
        self.length, self.lead, self.count = length, lead, rows.num_rows
        self.tids, self.ats, self.fwds, self.backs = (rows.column(c).to_pylist() for c in ("tid", "at", "fwd", "back"))
        self.low, self.high, self.repeated = (rows.column(c).to_numpy() for c in ("low", "high", "repeated"))
        self.fwd, self.back = padded(self.fwds, length), padded(self.backs, max(length - lead, 1))
        self.order, self.common = multikey_order(self.fwd)
        self.back_order, self.back_common = multikey_order(self.back)

    def classes(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each place of the lead in a window: (place, rows, a row of each class of equal windows, the class of each row, sizes)."""
        ahead, behind = np.empty(self.count, np.int64), np.empty(self.count, np.int64)
        for shift in range(self.length - self.lead + 1):
            rows = np.flatnonzero((self.low <= shift) & (shift <= self.high))
            if not len(rows):
                continue
            ahead[self.order] = np.cumsum(self.common < self.length - shift)
            behind[self.back_order] = np.cumsum(self.back_common < shift)
            pairs = ahead[rows] * (self.count + 1) + behind[rows]
            _, first, where, sizes = np.unique(pairs, return_index=True, return_inverse=True, return_counts=True)
            yield shift, rows, rows[first], where, sizes

    def stretches(self, known: np.ndarray) -> Iterator[tuple]:
        """(tid, start, stop) of what the known windows (row, place of the lead) of rows that are not repeated as a whole cover."""
        known[self.repeated] = False
        turns = np.diff(np.pad(known, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        rows, begins = np.nonzero(turns == 1)
        _, ends = np.nonzero(turns == -1)
        for row, begin, end in zip(rows.tolist(), begins.tolist(), ends.tolist()):
            yield self.tids[row], self.ats[row] - (end - 1), self.ats[row] - begin + self.length

    def ahead_of_edges(self) -> np.ndarray:
        """How far each suffix equals the bucket's first or last one."""
        first, last = self.fwd[self.order[0]], self.fwd[self.order[-1]]
        return np.maximum(common_length(self.fwd, first), common_length(self.fwd, last))

    def behind_edges(self) -> np.ndarray:
        """How far the bytes before each lead equal those of the first or the last row by lead and these bytes; -1 for another lead."""
        leads = self.fwd[:, : self.lead]
        order, _ = multikey_order(np.hstack([leads, self.back]))
        far = [
            np.where((leads == leads[edge]).all(1), common_length(self.back, self.back[edge]), -1) for edge in (order[0], order[-1])
        ]
        return np.maximum(*far)

    def window(self, row: int, shift: int) -> bytes:
        return self.backs[row][:shift][::-1] + self.fwds[row][: self.length - shift]


FOUND = "tid binary, start long, stop long"


def _forward(bucket: Bucket, alone: bool) -> Iterator[tuple]:
    """Rows of FOUND and CONTEXT: stretches, and the contexts whose windows may go on in another bucket, from the least such place of the lead on."""
    known = np.zeros((bucket.count, bucket.length - bucket.lead + 1), bool)
    for shift, rows, _, where, sizes in bucket.classes():
        known[rows, shift] = (sizes > 1)[where]
    if not alone:
        since = np.maximum(bucket.low, bucket.length - bucket.ahead_of_edges())
        for row in np.flatnonzero(since <= bucket.high).tolist():
            yield (
                bucket.tids[row], None, None, bucket.ats[row], int(since[row]), int(bucket.high[row]), bool(bucket.repeated[row]),
                bucket.fwds[row], bucket.backs[row],
            )
    for stretch in bucket.stretches(known):
        yield (*stretch, *[None] * 6)


def _backward(bucket: Bucket) -> Iterator[tuple]:
    """Rows (tid, start, stop, digest): stretches without a digest, and a row with one for each different window that may go on in another bucket.

    Where the bucket itself knows a window to be repeated, its row has no tid and vouches for its copies elsewhere.
    """
    known = np.zeros((bucket.count, bucket.length - bucket.lead + 1), bool)
    edges = bucket.behind_edges()
    for shift, rows, firsts, where, sizes in bucket.classes():
        vouched = sizes > 1
        known[rows, shift] = vouched[where]
        np.logical_or.at(vouched, where, bucket.repeated[rows])
        goes_on = edges[firsts] >= shift
        for row, is_known in zip(firsts[goes_on].tolist(), vouched[goes_on].tolist()):
            digest = xxhash.xxh3_128_digest(bucket.window(row, shift), seed=shift)
            start = bucket.ats[row] - shift
            yield (None, None, None, digest) if is_known else (bucket.tids[row], start, start + bucket.length, digest)
    for stretch in bucket.stretches(known):
        yield (*stretch, None)


def _buckets(dealt: DataFrame, rows_of, schema: str, length: int, lead: int) -> DataFrame:
    """What `rows_of` makes of each partition of contexts."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        for some in batched(rows_of(Bucket(pa.Table.from_batches(held), length, lead)), 1 << 16):
            names = [c.split()[0] for c in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, ARROW[k.split()[1]]) for c, k in zip(zip(*some), schema.split(", "))], names=names)

    return dealt.mapInArrow(compare, schema)


ARROW = {"binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}


def sorted_repeats(stored: DataFrame, *, length: int = LENGTH, lead: int = LEAD, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(tid, start, stop): stretches of stored contexts whose windows other contexts hold too."""
    buckets = max(1, -(-stored.count() // bucket_rows))
    dealt = stored.repartitionByRange(buckets, "fwd", "back", "tid", "at")
    first = materialize(
        _buckets(dealt, lambda b: _forward(b, buckets == 1), f"{FOUND}, {CONTEXT.removeprefix('tid binary, ')}", length, lead), "suffix-windows"
    )
    found = first.where("fwd IS NULL").select("tid", "start", "stop")
    left = first.where("fwd IS NOT NULL").drop("start", "stop")
    rows = left.count()
    if not rows:
        return found
    # Contexts of one lead that lie in several buckets are dealt again, by what comes before the lead.
    again = left.repartitionByRange(-(-rows // bucket_rows), F.substring("fwd", 1, lead), "back", "tid", "at")
    second = materialize(_buckets(again, _backward, f"{FOUND}, digest binary", length, lead), "suffix-windows")
    # One row per bucket and window at most, so a list is no longer than the number of buckets.
    waiting = F.collect_list(F.when(F.col("tid").isNotNull(), F.struct("tid", "start", "stop")))
    across = second.where("digest IS NOT NULL").groupBy("digest").agg(F.count("*").alias("n"), waiting.alias("waiting")).where("n > 1")
    across = across.select(F.explode("waiting").alias("w")).select("w.*")
    return found.unionByName(second.where("digest IS NULL").select("tid", "start", "stop")).unionByName(across)


KEPT = "tid binary, spans array<struct<start: bigint, stop: bigint>>, kept_sha256 string"


def _cut(with_text: bool):
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batches_of(batch, "text", BYTES_AT_ONCE):
                out = []
                for tid, text, found in zip(part.column("tid").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), part.column("found").to_pylist()):
                    spans = np.array([(s["start"], s["stop"]) for s in found], np.int64)
                    starts, stops = (x.tolist() for x in merged(spans[:, 0], spans[:, 1]))
                    kept = b"".join(text[a:b] for a, b in zip([0, *stops], [*starts, len(text)]))
                    rows = [{"start": a, "stop": b} for a, b in zip(starts, stops)]
                    out.append((tid, rows, hashlib.sha256(kept).hexdigest()) + ((kept,) if with_text else ()))
                kinds = (pa.binary(), span, pa.string(), pa.binary())
                names = ["tid", "spans", "kept_sha256", "kept"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names[: len(out[0])])

    return cut


def _text_id(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def without_repeats(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH, lead: int = LEAD, bucket_rows: int = BUCKET_ROWS,
    hot_keys: int = HOT_KEYS, with_text: bool = False,
) -> DataFrame:
    """(key, n_bytes, spans, kept_sha256): the maximal runs of bytes that go, as array of (start, stop), and a hash of what stays.

    With `with_text` the bytes that stay come along as `kept`, null where all or nothing goes.
    """
    texts = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("tid", _text_id(F.col("text")))
    rows = materialize(
        texts.select("key", "tid", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha")), "suffix-documents"
    )
    copies = materialize(
        rows.where(F.col("n_bytes") >= length).groupBy("tid").agg(F.count("*").alias("n"), F.first("n_bytes").alias("n_bytes")).where("n > 1"), "suffix-copies"
    )

    stored = materialize(suffixes(texts, length=length, lead=lead), "suffixes")
    marked = materialize(notable(stored, hot_keys=hot_keys), "suffix-notable")
    inner = stored.where("lead IS NULL").select("tid", F.col("at").alias("start"), (F.col("at") + F.col("high")).alias("stop"))
    whole = marked.where("repeated").select("tid", (F.col("at") - F.col("high")).alias("start"), (F.col("at") - F.col("low") + length).alias("stop"))

    ref = F.when(F.col("sorts"), F.struct("at", "low", "high", "repeated"))
    wanted = marked.select("tid", ref.alias("ref")).unionByName(inner.select("tid", F.lit(None).cast("struct<at: bigint, low: int, high: int, repeated: boolean>").alias("ref")))
    wanted = wanted.groupBy("tid").agg(F.collect_list("ref").alias("refs"))
    wanted = wanted.join(copies.select("tid", F.lit(True).alias("copied")), "tid", "left").where("copied IS NULL OR size(refs) > 0").drop("copied")
    # Copies of a text are combined before the shuffle.
    one_each = texts.groupBy("tid").agg(F.first("text").alias("text"))
    touched = materialize(one_each.join(wanted, "tid"), "suffix-texts")

    cut = materialize(contexts(touched, length=length), "suffix-contexts")
    found = whole.unionByName(inner).unionByName(sorted_repeats(cut, length=length, lead=lead, bucket_rows=bucket_rows))
    # A text's stretches are no more than its suffixes and windows.
    found = found.groupBy("tid").agg(F.collect_list(F.struct("start", "stop")).alias("found"))
    partly = touched.select("tid", "text").join(found, "tid").join(copies.select("tid"), "tid", "left_anti")
    schema = KEPT + ", kept binary" * with_text
    results = partly.select("tid", "text", "found").mapInArrow(_cut(with_text), schema)

    everything = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop")))
    copied = copies.select("tid", everything.alias("spans"), F.sha2(F.lit("").cast("binary"), 256).alias("kept_sha256"))
    facts = materialize(results.unionByName(copied, allowMissingColumns=True), "suffix-results")
    none = F.array().cast("array<struct<start: bigint, stop: bigint>>")
    return with_facts(rows, facts, "tid", hot_keys=hot_keys).select(
        F.col("key").alias(key), "n_bytes", F.coalesce("spans", none).alias("spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
        *["kept"] * with_text,
    )
