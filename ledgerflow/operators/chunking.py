"""Documents -> overlapping chunks.

A document is one row, so its chunks are computed inside that row with array functions: no
shuffle, no window, no Python, and the work spreads over the scan's partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.functions import text as tx

# Longest narrative paragraph kept whole, and longest carried-over tail.
WINDOW_CHARS = 320
CARRY_CHARS = 160

# Windows gathered before they are moved to the finished list; keeps appending linear.
_PAGE = 64

_STATE = "struct<done:array<array<string>>,page:array<string>,text:string,last:string,chars:int>"


def sentence_windows(sentences: Column, limit: int = WINDOW_CHARS) -> Column:
    """Pack sentences greedily; a full window starts the next one with its last sentence.

    The size counts sentence characters without the joining blanks, and a window may exceed the
    limit when the repeated sentence and the next one are long.
    """
    start = F.struct(
        F.array().cast("array<array<string>>").alias("done"),
        F.array().cast("array<string>").alias("page"),
        F.lit("").alias("text"),
        F.lit("").alias("last"),
        F.lit(0).alias("chars"),
    ).cast(_STATE)

    def step(state: Column, sentence: Column) -> Column:
        size = F.length(sentence)
        closes = (state["text"] != "") & (state["chars"] + size > limit)
        page_full = closes & (F.size(state["page"]) >= _PAGE)
        return F.struct(
            F.when(page_full, F.concat(state["done"], F.array(state["page"]))).otherwise(state["done"]).alias("done"),
            F.when(page_full, F.array(state["text"]))
            .when(closes, F.concat(state["page"], F.array(state["text"])))
            .otherwise(state["page"])
            .alias("page"),
            F.when(closes, F.concat(state["last"], F.lit(" "), sentence))
            .when(state["text"] == "", sentence)
            .otherwise(F.concat(state["text"], F.lit(" "), sentence))
            .alias("text"),
            sentence.alias("last"),
            F.when(closes, F.length(state["last"]) + size).otherwise(state["chars"] + size).alias("chars"),
        ).cast(_STATE)

    def finish(state: Column) -> Column:
        rest = F.when(state["text"] == "", F.array().cast("array<string>")).otherwise(F.array(state["text"]))
        return F.concat(F.flatten(state["done"]), state["page"], rest)

    return F.aggregate(sentences, start, step, finish)


def explode_rows(rows: DataFrame, array: str, into: str, position: str | None = None) -> DataFrame:
    """One row per element of a computed array; rows with an empty array vanish.

    The outer form keeps the optimizer from adding a "not empty" filter below the explode, which
    would compute the whole array a second time.
    """
    element = F.explode_outer(array).alias(into) if position is None else F.posexplode_outer(array).alias(position, into)
    others = [c for c in rows.columns if c != array]
    return rows.select(*others, element).where(F.col(into).isNotNull())


def with_paragraphs(documents: DataFrame, into: str = "paragraphs") -> DataFrame:
    """Add the document's paragraphs with their kind; only flagged documents have table fragments."""
    blocks = documents.withColumn("_blocks", tx.paragraphs(tx.normalize(F.col("text"))))
    flagged = F.coalesce(F.col("contains_table_like_text"), F.lit(False))

    def classify(block: Column) -> Column:
        kind = F.when(flagged & tx.is_table_like(block), "table_fragment").otherwise("narrative")
        return F.struct(kind.alias("kind"), block.alias("text"))

    return blocks.withColumn(into, F.transform("_blocks", classify)).drop("_blocks")


def with_fragments(paragraphs: DataFrame, into: str = "fragments") -> DataFrame:
    """Cut long narrative paragraphs into sentence windows; everything else stays whole."""

    def cut(paragraph: Column) -> Column:
        long_narrative = (paragraph["kind"] == "narrative") & (F.length(paragraph["text"]) > WINDOW_CHARS)
        pieces = F.when(long_narrative, sentence_windows(tx.sentences(paragraph["text"]))).otherwise(F.array(paragraph["text"]))
        return F.transform(pieces, lambda piece: F.struct(paragraph["kind"].alias("kind"), piece.alias("text")))

    return paragraphs.withColumn(into, F.flatten(F.transform("paragraphs", cut))).drop("paragraphs")


def chunk_documents(documents: DataFrame) -> DataFrame:
    """All chunks, each led by the tail of the narrative fragment before it."""
    cut = with_fragments(with_paragraphs(documents))

    def chunk(fragment: Column, index: Column) -> Column:
        previous = F.get("fragments", index - 1)
        tail = F.left(F.substring_index(previous["text"], ". ", -1), F.lit(CARRY_CHARS))
        carried = (previous["kind"] == "narrative") & (tail != "")
        led = F.when(carried, F.concat(tail, F.lit("\n"), fragment["text"])).otherwise(fragment["text"])
        return F.struct(index.alias("chunk_index"), fragment["kind"].alias("chunk_kind"), led.alias("text"))

    listed = cut.withColumn("chunks", F.transform("fragments", chunk)).drop("fragments", "text")
    return explode_rows(listed, "chunks", "chunk").select(
        F.concat("document_id", F.lit("::chunk::"), F.col("chunk.chunk_index").cast("string")).alias("chunk_id"),
        "tenant_id", "document_id", "title", "doc_type", "classification", "retention_state", "source_uri",
        "chunk.chunk_index", "chunk.chunk_kind", "chunk.text",
    )
