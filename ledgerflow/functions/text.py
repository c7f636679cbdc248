"""Text expressions whose whitespace and word classes are spelled out, not left to the regex engine."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters counted as white space, word characters and line ends.
SPACE = r"[\t\n\x0b\f\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
LINE_END = r"\r\n|[\n\r\x0b\f\x1c-\x1e\x{85}\x{2028}\x{2029}]"

# The same white space as plain characters.
SPACES = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

ASCII_TOKEN = "([a-z0-9]+)"
WORD_TOKEN = r"([\p{L}\p{N}]+)"


def strip(text: Column) -> Column:
    """Drop all leading and trailing white space (plain `trim` would drop blanks only)."""
    return F.btrim(text, F.lit(SPACES))


def is_blank(text: Column) -> Column:
    """NULL, empty or blanks only; other white space counts as content."""
    return text.isNull() | (F.trim(text) == "")


def _replace_where(text: Column, sign: str, pattern: str, replacement: str) -> Column:
    """Regex replacement, tried only on texts that contain a sign of a match."""
    return F.when(F.contains(text, F.lit(sign)), F.regexp_replace(text, pattern, replacement)).otherwise(text)


def normalize(text: Column) -> Column:
    """Unix line ends, no tabs, no blanks before a line end, at most one empty line in a row."""
    unix = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\t"), F.lit(" "))
    return strip(_replace_where(_replace_where(unix, " \n", " +\n", "\n"), "\n\n\n", "\n{3,}", "\n\n"))


def paragraphs(normalized: Column) -> Column:
    """Stripped, non-empty blocks between empty lines."""
    blocks = F.transform(F.split(normalized, "\n\n"), strip)
    return F.filter(blocks, lambda block: block != "")


def is_table_like(paragraph: Column) -> Column:
    """Two or more non-empty lines, one of them with a gap of two or more spaces between words."""
    gap = f"{WORD}{SPACE}{{2,}}{WORD}"
    lines = F.filter(F.transform(F.split(paragraph, LINE_END), strip), lambda line: line != "")
    # A line with a gap implies a gap in the paragraph, which is cheaper to look for.
    return paragraph.rlike(gap) & (F.size(lines) >= 2) & F.exists(lines, lambda line: line.rlike(gap))


def sentences(paragraph: Column) -> Column:
    """Stripped sentences; a sentence ends after . ! or ? followed by white space."""
    pieces = F.transform(F.split(paragraph, f"(?<=[.!?]){SPACE}+"), strip)
    return F.filter(pieces, lambda piece: piece != "")


def distinct_tokens(text: Column, pattern: str = ASCII_TOKEN) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(1)))


def tokens(text: Column, pattern: str = ASCII_TOKEN) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(1))


def phrase_pattern(phrases: list[str] | tuple[str, ...]) -> str:
    """One pattern that finds any of the phrases as whole words."""
    alternatives = "|".join(f"{SPACE}+".join(re.escape(w) for w in phrase.split()) for phrase in phrases)
    return f"(^|{NOT_WORD})({alternatives})({NOT_WORD}|$)"


def has_phrase(text: Column, phrases: list[str] | tuple[str, ...]) -> Column:
    return F.lower(text).rlike(phrase_pattern(phrases))


def matching_phrases(text: Column, phrases: list[str] | tuple[str, ...]) -> Column:
    """The phrases found in the text, in list order."""
    return F.array_compact(F.array(*[F.when(has_phrase(text, [p]), F.lit(p)) for p in phrases]))


def pad_cell(cell: Column, width: int = 20) -> Column:
    """Left-justify; a longer cell is kept whole."""
    return F.when(F.length(cell) < width, F.rpad(cell, width, " ")).otherwise(cell)
