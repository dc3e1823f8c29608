"""Text and hash expressions over columns; no Python runs on rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{20000}-\x{2a6df}"


def normalise_newlines(t: Column) -> Column:
    return F.regexp_replace(t, r"\r\n?", "\n")


def strip_controls(t: Column) -> Column:
    return F.regexp_replace(t, r"[\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}\x{7f}-\x{9f}]", "")


def drop_replacement(t: Column) -> Column:
    """Without a leading byte order mark and replacement characters."""
    return F.regexp_replace(F.regexp_replace(t, r"^\x{FEFF}+", ""), r"\x{FFFD}", "")


def strip(t: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def share_of(t: Column, char_class: str) -> Column:
    """Share of the characters in ``[char_class]``; 0 for empty text."""
    n = F.length(t)
    return F.when(n > 0, (n - F.length(F.regexp_replace(t, f"[{char_class}]+", ""))) / n).otherwise(F.lit(0.0))


def cjk_ratio(t: Column) -> Column:
    return share_of(t, CJK)


def letter_ratio(t: Column) -> Column:
    return share_of(t, r"\p{L}")


def symbol_ratio(t: Column, keep: str = r"\s.,;:!?'\"()\-") -> Column:
    """Share of characters that are neither letters, digits nor in ``keep``."""
    return share_of(t, r"^\p{L}\p{N}_" + keep)


def collapse_blank_lines(t: Column) -> Column:
    """Line ends lose blanks, runs of blank lines become one, the text's ends lose blanks."""
    t = F.regexp_replace(t, r"[ \t\x{3000}]+(?=\n|$)", "")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^[ \t\x{3000}\n]+|[ \t\x{3000}\n]+$", "")


def key60(t: Column) -> Column:
    """The first 15 hex digits of SHA-1 as a number."""
    return F.conv(F.substring(F.sha1(t), 1, 15), 16, 10).cast("long")


def key64(t: Column) -> Column:
    """The first 16 hex digits of SHA-1, kept as text (a signed long can't hold them)."""
    return F.substring(F.sha1(t), 1, 16)


def split_bucket(key: Column, seed: str = "42", buckets: int = 1000) -> Column:
    return F.conv(F.substring(F.sha2(F.concat(F.lit(seed + ":"), key), 256), 1, 8), 16, 10).cast("long") % buckets


def split_of(key: Column, test: int = 5, val: int = 15) -> Column:
    r = split_bucket(key)
    return F.when(r < test, "test").when(r < val, "val").otherwise("train")


def paragraphs(t: Column) -> Column:
    """Stripped paragraphs that aren't empty."""
    return F.filter(F.transform(F.split(t, r"\n+"), strip), lambda p: p != "")


def windows(t: Column, size: int = 24, step: int = 8) -> Column:
    """Windows of ``size`` characters every ``step``: interleaved runs, so that the text is walked a few times only."""
    runs = [F.regexp_extract_all(F.substr(t, F.lit(1 + k)), F.lit(f"(?s).{{{size}}}"), F.lit(0)) for k in range(0, size, step)]
    return F.concat(*runs)
