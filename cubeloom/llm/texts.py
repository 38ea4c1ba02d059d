"""Words of texts as column expressions; a word is a run free of blanks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The six blanks, as a character class of Java's regular expressions.
_BLANK, _WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null. Each word shrinks to its first character, so no list of words is built."""
    shrunk = F.regexp_replace(text, f"{_BLANK}*+({_WORD}){_WORD}*+|{_BLANK}++", "$1")
    return F.coalesce(F.length(shrunk), F.lit(0)).cast("long")


def letter_bytes(text: Column) -> Column:
    """Bytes of ASCII letters and of all characters beyond ASCII; 0 for null."""
    return F.coalesce(F.octet_length(F.regexp_replace(text, r"[\x00-\x40\x5B-\x60\x7B-\x7F]++", "")), F.lit(0)).cast("long")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word, n at least 1; all of it if it has fewer.

    Every word gets an end mark, made from a digest of the text, which it therefore doesn't hold.
    """
    mark = F.concat(F.lit("\x01"), F.substring(F.md5(text.cast("binary")), 1, 12), F.lit("\x01"))
    marked = F.regexp_replace(text, F.lit(f"({_WORD}++)"), F.concat(F.lit("$1"), mark))
    return F.replace(F.call_function("substring_index", marked, mark, n.cast("int")), mark, F.lit(""))
