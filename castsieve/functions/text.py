"""Text helpers shared by all column functions.

Spark's ``trim`` only knows the space and Java's ``\\s``/``\\w`` are ASCII by
default, while playlists are full of other scripts; these helpers pin one
Unicode meaning for blank, case and containment.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode White_Space characters.
WHITESPACE = "".join(
    map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)

# Letters whose upper case is longer than one character (or leaves the script),
# which one-to-one case folding keeps as they are.  Each is parked on a private
# code point while the rest of the text is upper-cased.
_ONE_TO_ONE = "ıſ"
_KEEP = "".join(c for c in map(chr, range(0x80, 0x10000)) if len(c.upper()) > 1) + _ONE_TO_ONE
_PARK = "".join(chr(0xE000 + i) for i in range(len(_KEEP)))

# A word character of the basic plane; everything else separates words.
WORD_CHARS = r"\p{L}\p{Mn}\p{Nd}\p{Pc}"


def as_column(value: Column | str) -> Column:
    """A column, or a literal for plain text."""
    return value if isinstance(value, Column) else F.lit(value)


def trim(text: Column) -> Column:
    """Strip Unicode white space from both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return F.coalesce(trim(text) == "", F.lit(True))


def blank_to_null(text: Column) -> Column:
    """Trimmed text, or null when nothing is left."""
    return F.nullif(trim(text), F.lit(""))


def fold(text: Column | str) -> Column:
    """Upper-case one character at a time: equal folds mean equal ignoring case.

    Text without any of the exceptional letters only pays for ``upper``; text that
    has characters of the parking range itself is folded one by one.
    """
    text = as_column(text)
    upper = F.upper(text)
    same_length = F.length(upper) == F.length(text)
    exceptional = [F.contains(text, F.lit(c)) for c in _ONE_TO_ONE]
    plain = (F.octet_length(text) == F.length(text)) | (same_length & ~exceptional[0] & ~exceptional[1])
    parked = F.upper(F.translate(text, _KEEP, _PARK))
    letters = F.transform(
        F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)),
        lambda c: F.when(F.contains(F.lit(_KEEP), c), c).otherwise(F.upper(c)),
    )
    return (
        F.when(plain, upper)
        .when(text.rlike("[\uE000-\uF8FF]"), F.array_join(letters, ""))
        .otherwise(F.translate(parked, _PARK, _KEEP))
    )


def sort_key(text: Column) -> Column:
    """Bytes that order text ignoring case, by UTF-16 code unit."""
    return F.encode(fold(text), "UTF-16BE")


def starts_ci(text: Column, prefix: str) -> Column:
    """Text starts with an ASCII prefix, ignoring case."""
    return F.upper(F.substring(text, 1, len(prefix))) == prefix.upper()


def contains_ci(text: Column, part: Column | str) -> Column:
    """Text contains a part, ignoring case."""
    return F.contains(fold(text), fold(part))


def quote_regex(text: str) -> str:
    """A regular expression matching exactly this text."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def any_of(words: list[str]) -> str:
    """A regular expression matching any of the words, grouped by first letter."""
    by_first: dict[str, list[str]] = {}
    for word in words:
        by_first.setdefault(word[0], []).append(word[1:])
    return "|".join(
        quote_regex(first) + "(?:" + "|".join(quote_regex(rest) for rest in rests) + ")"
        for first, rests in by_first.items()
    )
