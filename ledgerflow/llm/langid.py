"""Language identification: family first, then pairs of closely related languages.

Features are hashed byte trigrams of the whole lower-cased text with everything that is not a letter as a
blank; counts are damped by a square root and scaled to unit length. One-versus-rest linear support vector machines
choose the family; within it, one linear machine per pair of languages votes, margins breaking ties.

The machines are fitted on a bounded sample of training rows: about `SAMPLE_ROWS` in all and never twice as many, as many from
each language, drawn by a hash of the id. Only their feature vectors reach the driver. Every
text is then scored as a whole, a batch at a time, without a shuffle.

Nulls and ties: a null text and a text without a letter are `und` with score 0, and so is everything if there
is nothing to learn from. Rows with a null language are predicted, not learned from. Repeated rows get the same
answer; languages that tie go to the first by name. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerflow.llm.common import batches_of, numbered

UNKNOWN = "und"
DIMENSIONS = 2048
SAMPLE_ROWS = 1600
BYTES_AT_ONCE = 2 << 20
ROWS_AT_ONCE = 256

# Language codes by family. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ast ca es fr gl it la oc pt ro sc",
    "slavic": "be bg bs cs hr mk pl ru sh sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu se",
    "turkic": "az kk ky tr tt uz",
    "indic": "bn gu hi mr ne pa si ur",
    "iranian": "fa ku ps tg",
    "semitic": "am ar he mt",
    "dravidian": "kn ml ta te",
    "austronesian": "id jv ms mg su tl",
    "sinitic": "zh yue wuu",
}


def family_of(language: str) -> str:
    base = language.replace("_", "-").split("-")[0].lower()
    return next((name for name, codes in FAMILIES.items() if base in codes.split()), base)


def _letters_table() -> np.ndarray:
    known = np.full(256, ord(" "), np.uint8)
    for byte in range(256):
        if byte >= 0x80 or chr(byte).isalpha():
            known[byte] = byte | 0x20 if byte < 0x80 else byte
    return known


_LETTERS = _letters_table()


def trigram_features(texts: pa.Array, dimensions: int = DIMENSIONS) -> np.ndarray:
    """A unit row of hashed trigram weights for every text."""
    padded = pc.binary_join_element_wise(pa.scalar(" "), pc.fill_null(texts, ""), pa.scalar(" "), pa.scalar(""))
    padded = pa.concat_arrays([padded]).cast(pa.large_string())
    offsets = np.frombuffer(padded.buffers()[1], np.int64)[padded.offset : padded.offset + len(padded) + 1]
    data = np.frombuffer(padded.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    letters = _LETTERS[data]
    # Capital Latin letters of the two-byte range.
    capital = np.zeros(len(data), bool)
    capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    letters[capital] += 0x20
    wide = letters.astype(np.uint32)
    # Spread by a multiplication, as 16.16 fixed point; a trigram belongs to the text in which it begins.
    mixed = (wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]) * np.uint32(2654435761)
    hashes = (mixed >> np.uint32(32 - int(dimensions).bit_length() + 1)).astype(np.int64)
    sizes = np.diff(offsets)
    rows = np.repeat(np.arange(len(sizes)), sizes)[: len(hashes)]
    inside = np.ones(len(hashes), bool)
    ends = (offsets[1:] - offsets[0])[:-1]
    for back in (1, 2):
        inside[np.maximum(ends - back, 0)[ends - back < len(hashes)]] = False
    inside &= ~((wide[:-2] == 32) & (wide[1:-1] == 32)) & ~((wide[1:-1] == 32) & (wide[2:] == 32))
    counts = np.bincount((rows * dimensions + hashes)[inside], minlength=len(sizes) * dimensions)
    weights = np.sqrt(counts.reshape(len(sizes), dimensions).astype(np.float32))
    return weights / np.maximum(np.linalg.norm(weights, axis=1, keepdims=True), 1e-9)


def linear_svm(rows: np.ndarray, signs: np.ndarray, *, cost: float = 20.0, rounds: int = 100) -> np.ndarray:
    """Weights (bias last) of a linear machine with squared hinge loss, both classes weighing the same."""
    rows, signs = np.hstack([rows, np.ones((len(rows), 1), rows.dtype)]).astype(np.float32), signs.astype(np.float32)
    weight = np.where(signs > 0, 0.5 / max(1, (signs > 0).sum()), 0.5 / max(1, (signs < 0).sum())).astype(np.float32) * cost
    # The rows have length sqrt(2) at most, which bounds the curvature.
    step = np.float32(1.0 / (1.0 + 4.0 * weight.sum()))
    point = ahead = np.zeros(rows.shape[1], np.float32)
    for turn in range(rounds):
        slack = np.maximum(0.0, 1.0 - signs * (rows @ ahead))
        moved = ahead - step * (ahead - 2.0 * rows.T @ (weight * signs * slack))
        ahead = moved + np.float32(turn / (turn + 3.0)) * (moved - point)
        point = moved
    return point


@dataclass
class Model:
    """`families`: a machine per family; `pairs`: within a family, a machine per pair, positive for the first."""

    languages: dict[str, list[str]] = field(default_factory=dict)
    families: dict[str, np.ndarray] = field(default_factory=dict)
    pairs: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def predict(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language, score) of each row; the score is the family's and then the language's share."""
        rows = np.hstack([rows, np.ones((len(rows), 1), rows.dtype)])
        names = list(self.languages)
        if len(names) == 1:
            chosen, sure = np.zeros(len(rows), int), np.ones(len(rows))
        else:
            margins = np.stack([rows @ self.families[n] for n in names], axis=1)
            chosen = margins.argmax(1)
            lead = np.sort(margins, axis=1)
            sure = 1.0 / (1.0 + np.exp(-(lead[:, -1] - lead[:, -2])))
        found = np.empty(len(rows), object)
        for number, name in enumerate(names):
            at = np.flatnonzero(chosen == number)
            members = self.languages[name]
            if not len(at):
                continue
            votes, margin = np.zeros((len(at), len(members))), np.zeros((len(at), len(members)))
            for (i, a), (j, b) in combinations(enumerate(members), 2):
                side = 2.0 / (1.0 + np.exp(-2.0 * (rows[at] @ self.pairs[a, b]))) - 1.0
                votes[:, i] += side >= 0
                votes[:, j] += side < 0
                margin[:, i] += side
                margin[:, j] -= side
            best = (votes + margin / (2 * len(members) + 1)).argmax(1)
            found[at] = np.array(members, object)[best]
            if len(members) > 1:
                sure[at] *= (1.0 + margin[np.arange(len(at)), best] / (len(members) - 1)) / 2.0
        return found, np.clip(sure, 0.0, 1.0)


def fit_model(rows: np.ndarray, languages: list[str]) -> Model:
    labels, model = np.array(languages, object), Model()
    for language in sorted(set(languages)):
        model.languages.setdefault(family_of(language), []).append(language)
    groups = np.array([family_of(x) for x in languages], object)
    for name, members in model.languages.items():
        if len(model.families) == 1 and len(model.languages) == 2:
            model.families[name] = -next(iter(model.families.values()))
        else:
            model.families[name] = linear_svm(rows, np.where(groups == name, 1.0, -1.0))
        for a, b in combinations(members, 2):
            at = (labels == a) | (labels == b)
            model.pairs[a, b] = linear_svm(rows[at], np.where(labels[at] == a, 1.0, -1.0))
    return model


def fit(docs: DataFrame, *, key: str, text: str, language: str, training: Column, sample_rows: int = SAMPLE_ROWS) -> Model:
    """The model of at most `sample_rows` training rows with a letter in their text."""
    known = docs.where(training & F.col(language).isNotNull())
    # A language beyond the number of rows could not have one in the sample.
    counts = known.groupBy(F.col(language).alias("lang")).count().orderBy(F.desc("count"), "lang").limit(sample_rows).collect()
    if not counts:
        return Model()
    quota = max(1, sample_rows // len(counts))
    shares = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, quota / r["count"]))])
    # Each row decides by itself, so nothing is ranked: the share of its language of the range of hashes.
    drawn = F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 52)) < F.try_element_at(shares, F.col(language)) * float(1 << 52)
    sample = known.where(drawn & F.col(text).rlike(r"\p{L}"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batches_of(batch, "text", BYTES_AT_ONCE):
                rows = trigram_features(part.column("text")).astype(np.float32)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), DIMENSIONS).cast(pa.list_(pa.float32()))
                yield pa.record_batch([part.column("lang"), part.column("hash"), flat], ["lang", "hash", "features"])

    rows = sample.select(F.col(language).alias("lang"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    rows = rows.mapInArrow(vectors, "lang string, hash long, features array<float>")
    # As many rows as asked for, give or take; rows that repeat an id could go beyond the bound.
    found = sorted(rows.limit(2 * sample_rows).collect(), key=lambda r: (r["lang"], r["hash"]))
    if not found:
        return Model()
    return fit_model(np.array([r["features"] for r in found], np.float32), [r["lang"] for r in found])


def predict(docs: DataFrame, model: Model, *, text: str = "text", into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The documents with the language and the score `into` two columns, in place of columns that have these names."""
    rows = docs.drop(*[name for name in into if name in docs.columns])
    names, column = rows.columns, f"c{rows.columns.index(text)}"
    rows = numbered(rows)
    schema = T.StructType([*rows.schema.fields, T.StructField("found", T.StringType()), T.StructField("sure", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slice_ in batches_of(batch, column, BYTES_AT_ONCE):
                for low in range(0, slice_.num_rows, ROWS_AT_ONCE):
                    part = slice_.slice(low, ROWS_AT_ONCE)
                    texts = part.column(column)
                    lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
                    found, sure = np.full(part.num_rows, UNKNOWN, object), np.zeros(part.num_rows)
                    if model.languages and lettered.any():
                        at = np.flatnonzero(lettered)
                        found[at], sure[at] = model.predict(trigram_features(texts.take(pa.array(at))))
                    yield pa.record_batch([*part.columns, pa.array(found, pa.string()), pa.array(sure)], schema.names)

    return rows.mapInArrow(score, schema).toDF(*names, *into)
