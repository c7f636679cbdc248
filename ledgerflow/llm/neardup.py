"""Near duplicates by SimHash fingerprints, pigeonhole blocks and verified Hamming distance.

A fingerprint has a bit set where more than half of the text's shingle hashes have it. Two fingerprints
that differ in at most `radius` bits agree wholly on at least `blocks - radius` of `blocks` blocks, so
joining on every such combination of blocks finds every close pair; the distance is then verified.

Only distinct fingerprints are joined: copies are one row from the start. Within a bucket no pairs
are listed. Every member is first compared with the bucket's smallest fingerprint, which settles most
buckets. Buckets with members that are not close to it are searched breadth-first, each member
against those not reached yet, and give a spanning forest, at most one link per member. A bucket
beyond `CHUNK` members is cut into chunks and each pair of chunks is searched by itself, so that no task
holds more than two chunks. Components then follow from the links by alternating stars.

Nulls and ties: a null text counts as empty, and empty texts have fingerprint zero, linked like any
other; texts with fewer words than a shingle are one shingle. Repeated rows are all returned, each
with the class of its fingerprint. A row whose id is null belongs to its class but cannot name it; a class
of such rows alone has a null component. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import batches_of, fresh_name, materialize

WORDS = 3
SEED = 42
RADIUS = 3
BLOCKS = 6
CHUNK = 16_384
#: Shingles hashed at a time, and bytes of text taken from a batch at a time.
HASHES_AT_ONCE = 1 << 18
BYTES_AT_ONCE = 4 << 20


def simhash(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a text, as a signed integer.

    A-Z are lower-cased and ASCII white space parts words, as bytes.lower and bytes.split do it.
    """
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined, width = b" ".join(parts), min(words, len(parts))
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes)[: len(parts) - width + 1], ends[width - 1 :]
    votes, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for low in range(0, len(starts), HASHES_AT_ONCE):
        high = low + HASHES_AT_ONCE
        spans = zip(starts[low:high].tolist(), ends[low:high].tolist())
        hashes = np.array([digest(joined[a:b], seed) for a, b in spans], dtype="<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(starts), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(id, fp) of every row."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batches_of(batch, "text", BYTES_AT_ONCE):
                found = [simhash(t, words, seed) for t in part.column("text").to_pylist()]
                yield pa.record_batch([part.column("id"), pa.array(found, pa.int64())], ["id", "fp"])

    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(hashed, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def distance(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.bit_count(a.bitwiseXOR(b))


def block_masks(blocks: int, radius: int) -> list[int]:
    """For each choice of `blocks - radius` blocks the bits that it covers, as signed integers."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [(1 << high) - (1 << low) for low, high in zip(edges, edges[1:])]
    chosen = (sum(c) for c in combinations(masks, blocks - radius))
    return [m - (1 << 64) if m >> 63 else m for m in chosen]


def forest(members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (member, parent) that connect exactly what chains of close members connect."""
    links, left = [], members
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            parent = queue.pop()
            near = np.bitwise_count(np.bitwise_xor(left, parent)) <= radius
            if near.any():
                found = left[near]
                links += [(int(x), int(parent)) for x in found]
                queue += list(found)
                left = left[~near]
    return links


def bucket_forests(radius: int):
    """mapInPandas over rows sorted by bucket: the forest of each bucket, which may span batches."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_bucket, held = None, []

        def links() -> pd.DataFrame:
            return pd.DataFrame(forest(np.concatenate(held).astype(np.uint64), radius), columns=["src", "dst"], dtype="uint64").astype("int64")

        for batch in batches:
            if batch.empty:
                continue
            fps = batch["fp"].to_numpy(np.int64)
            buckets = batch["bucket"].to_numpy()
            starts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
            done = []
            for start, stop in zip(starts, [*starts[1:], len(fps)]):
                if buckets[start] != open_bucket:
                    if held:
                        done.append(links())
                    open_bucket, held = buckets[start], []
                held.append(fps[start:stop])
            if done:
                yield pd.concat(done)
        if held:
            yield links()

    return search


def close_links(fps: DataFrame, *, radius: int = RADIUS, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """(src, dst) links between distinct fingerprints that connect all pairs within the radius."""
    masks = F.array(*[F.lit(m).cast("long") for m in block_masks(blocks, radius)])
    keyed = fps.select("fp", F.posexplode(masks).alias("choice", "mask")).select(
        "fp", F.struct("choice", F.col("fp").bitwiseAND(F.col("mask")).alias("bits")).alias("key")
    )
    shared = keyed.groupBy("key").agg(F.min("fp").alias("leader"), F.count("*").alias("n")).where("n > 1")
    members = materialize(
        keyed.join(shared, "key").withColumn("near", distance("fp", "leader") <= radius), "neardup-members"
    )
    stars = members.where("near AND fp <> leader").select(F.col("fp").alias("src"), F.col("leader").alias("dst"))

    # Buckets of two are settled, and so are those whose members are all close to the leader.
    far = members.where("n > 2 AND NOT near").select("key").distinct()
    chunks = F.ceil(F.col("n") / chunk).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.struct(F.least(j, F.col("own")), F.greatest(j, F.col("own"))))
    searched = (
        members.where("n > 2").join(far, "key", "left_semi")
        .select("fp", "key", chunks.alias("chunks")).withColumn("own", own)
        .select("fp", "key", F.explode(pairs).alias("pair"))
        # Two buckets that collide here are searched as one; the verified distance keeps that right.
        .select("fp", F.xxhash64("key", "pair").alias("bucket"))
    )
    dealt = searched.repartition("bucket").sortWithinPartitions("bucket")
    return stars.unionByName(dealt.mapInPandas(bucket_forests(radius), "src long, dst long")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches, by alternating large and small stars.

    Each round is written to the shared folder, so that lineage stays short and no executor's loss costs more
    than a round. Minima are combined before they are shuffled; the joins can be split where a node is hot.
    """

    def written(edges: DataFrame) -> tuple[DataFrame, tuple]:
        edges = materialize(edges.distinct(), "neardup-stars")
        seen = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("src", "dst")).alias("x")).first()
        return edges, tuple(seen)

    edges, state = written(
        links.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    )
    while state[0]:
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low"))
        large = both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        # The smaller of a node's neighbours, and the node itself, go to the smallest of them.
        large = materialize(large.distinct(), "neardup-stars")
        small = large.groupBy("src").agg(F.min("dst").alias("low"))
        moved = large.join(small, "src").where("dst <> low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        edges, now = written(moved.unionByName(small.select("src", F.col("low").alias("dst"))))
        if now == state:
            break
        state = now
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("root"))


def near_duplicates(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = WORDS, seed: int = SEED,
    radius: int = RADIUS, blocks: int = BLOCKS,
) -> DataFrame:
    """(id, fp, component): every row with its fingerprint and the smallest id that it reaches."""
    rows = materialize(fingerprints(docs, key=key, text=text, words=words, seed=seed), "neardup-fingerprints")
    classes = materialize(rows.groupBy("fp").agg(F.min("id").alias("low")), "neardup-classes")
    found = components(close_links(classes.select("fp"), radius=radius, blocks=blocks))
    # A root's own row is not among its nodes.
    rooted = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("low").alias("component"))
    by_class = rooted.join(named, "root").select("fp", "component")
    return rows.join(by_class, "fp").select("id", "fp", "component")


def keep_first(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One document of each group: the one with the smallest id (then text hash), once if its row is repeated.

    What goes is joined against the documents, not what stays, because it is the smaller side.
    """
    identity = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.xxhash64(text).alias("hash"))
    rows = docs.select(identity.alias("_id"), F.col(text).alias("_text"))
    groups = materialize(near_duplicates(rows, key="_id", text="_text", **how), "neardup-groups")
    # Names that no column of the documents has.
    gone_id, gone_hash = (fresh_name(docs, n) for n in ("gone_id", "gone_hash"))
    named = F.col("id.id").alias(gone_id), F.col("id.hash").alias(gone_hash)
    gone = groups.where("id <> component").select(*named).distinct()
    again = groups.where("id = component").groupBy("id").count().where("count > 1").select(*named)
    same = F.col(key).eqNullSafe(F.col(gone_id)) & (F.xxhash64(text) == F.col(gone_hash))
    once = docs.join(gone.unionByName(again), same, "left_anti")
    repeated = docs.join(again, same, "left_semi").dropDuplicates([key, text])
    return once.unionByName(repeated)
