"""Text expressions: tokens, sentences, normal forms. All are columns, so they stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a Unicode-aware pattern; Spark's bare ``\s`` and ``\w`` are ASCII.
SPACES = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"
NOT_SPACES = r"[^\s\x0b\x1c-\x1f\x85\p{Z}]+"
WORD = r"[\p{L}\p{N}_]+"
SENTENCE_END = r"(?<=[.!?])[\s\x0b\x1c-\x1f\x85\p{Z}]+"
#: Marks the start of a word in character sequences, and the reserved tokens in id order. Fixed values.
BOUNDARY = "▁"
SPECIALS = ("<pad>", "<unk>", "<bos>", "<eos>")


def _col(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once; Spark computes what stands inside a lambda anew for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column | str) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(_col(text), f"^{SPACES}|{SPACES}$", "")


def split_words(text: Column | str) -> Column:
    """Runs of non-space characters, in order."""
    return F.filter(F.split(_col(text), SPACES), lambda w: w != "")


def word_count(text: Column | str) -> Column:
    """Number of the words that ``split_words`` gives; null: 0."""
    return F.coalesce(F.regexp_count(_col(text), F.lit(NOT_SPACES)), F.lit(0))


def tokens(text: Column | str) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.transform(F.regexp_extract_all(_col(text), F.lit(WORD), F.lit(0)), F.lower)


def sentences(text: Column | str) -> Column:
    """Split after ``.``, ``!`` or ``?`` before white space; empty parts are dropped."""
    return F.filter(F.transform(F.split(strip(text), SENTENCE_END), strip), lambda s: s != "")


def normalized(text: Column | str) -> Column:
    """Lower case with single spaces and none at the ends."""
    return F.lower(F.array_join(split_words(text), " "))


def symbols(word: Column) -> Column:
    """The boundary mark and the word's characters."""
    return F.concat(F.array(F.lit(BOUNDARY)), F.filter(F.split(word, ""), lambda c: c != ""))


def title_first(text: Column) -> Column:
    """First character in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))
