"""Category, language and rename functions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import PySparkException

from .fixed_values import CATEGORY_KEYWORDS, COUNTRY_BRACKET, COUNTRY_PREFIX, LANGUAGES
from .names import display_name
from .text import any_of, fold, quote_regex, trim



def _keyword_pattern(keywords: list[str], whole_words: bool) -> str:
    pattern = any_of([k.upper() for k in keywords])
    return rf"(?U)(?<!\w)(?:{pattern})(?!\w)" if whole_words else pattern


def _first_category(folded: Column, table: dict[str, list[str]], whole_words: bool) -> Column:
    """First category, in table order, with a keyword in the folded text."""
    return F.coalesce(
        *[
            F.when(folded.rlike(_keyword_pattern(keywords, whole_words)), F.lit(category))
            for category, keywords in table.items()
        ]
    )


def with_category(
    df: DataFrame, table: dict[str, list[str]] | None = None, whole_words: bool = False
) -> DataFrame:
    """Set ``category`` by keyword: the group decides, else all texts, else "Unknown".

    A keyword counts anywhere in the text, also inside a word, unless
    ``whole_words`` is set.  One test over all keywords keeps rows without any
    out of the per-category tests.
    """
    table = table or CATEGORY_KEYWORDS
    texts = [F.coalesce(c, F.lit("")) for c in ("name", "tvg_name", "group_name")]
    any_keyword = _keyword_pattern([k for ks in table.values() for k in ks], whole_words)
    found = F.when(
        F.col("_folded_text").rlike(any_keyword),
        F.coalesce(
            _first_category(F.col("_folded_group"), table, whole_words),
            _first_category(F.col("_folded_text"), table, whole_words),
        ),
    )
    return (
        df.withColumn("_text", F.concat_ws(" ", *texts))
        .withColumns({"_folded_text": fold(F.col("_text")), "_folded_group": fold(F.col("group_name"))})
        .withColumn("category", F.coalesce(found, F.lit("Unknown")))
        .drop("_text", "_folded_text", "_folded_group")
    )


def _language_value(code: str, language: str, country: str | None) -> Column:
    return F.struct(
        F.lit(code).alias("code"),
        F.lit(language).alias("name"),
        F.lit(country).cast("string").alias("country"),
    )


def with_language(df: DataFrame) -> DataFrame:
    """Set ``language``, a ``struct<code,name,country>``, null if unknown.

    Tried in turn: a two-letter prefix, the first bracketed two-letter code, a
    longer mark anywhere in group or name.
    """
    shown = F.col("_shown")
    marks = [mark for mark, *_ in LANGUAGES]
    listed = F.array(*map(F.lit, marks))
    languages = F.array(*[_language_value(*value) for _, *value in LANGUAGES])
    bracketed = F.substring(F.regexp_extract(shown, COUNTRY_BRACKET, 0), 2, 2)

    def known(code: Column) -> Column:
        return F.nullif(F.array_position(listed, F.upper(code)), F.lit(0))

    anywhere = F.coalesce(
        *[
            F.when(F.contains("_folded_text", F.lit(mark)), F.lit(place))
            for place, mark in enumerate(marks, 1)
            if len(mark) > 2
        ]
    )
    place = F.coalesce(known(F.regexp_extract(shown, COUNTRY_PREFIX, 1)), known(bracketed), anywhere)
    return (
        df.withColumn("_shown", display_name(F.col("name"), F.col("tvg_name")))
        .withColumn("_text", F.concat_ws("\x00", F.coalesce("group_name", F.lit("")), "_shown"))
        .withColumn("_folded_text", fold(F.col("_text")))
        .withColumn("_place", place.cast("int"))
        .withColumn("language", F.when(F.col("_place").isNotNull(), F.try_element_at(languages, F.col("_place"))))
        .drop("_shown", "_text", "_folded_text", "_place")
    )


def pattern_is_valid(spark: SparkSession, pattern: str) -> bool:
    """True if Spark accepts the regular expression."""
    try:
        spark.range(1).select(F.lit("").rlike(_ignoring_case(pattern))).collect()
    except PySparkException:
        return False
    return True


def _ignoring_case(pattern: str) -> str:
    return "(?iu)" + pattern


def matches_regex(text: Column, pattern: str) -> Column:
    """A user's regular expression matches somewhere, ignoring case."""
    return text.rlike(_ignoring_case(pattern))


def rename_literal(text: Column, pattern: str, replacement: str) -> Column:
    """Replace a text, ignoring case, then trim."""
    quoted = replacement.replace("\\", "\\\\").replace("$", "\\$")
    return trim(F.regexp_replace(text, _ignoring_case(quote_regex(pattern)), quoted))


def rename_regex(text: Column, pattern: str, replacement: str) -> Column:
    """Replace matches of a regular expression, ignoring case, then trim."""
    return trim(F.regexp_replace(text, _ignoring_case(pattern), java_replacement(pattern, replacement)))


def java_replacement(pattern: str, replacement: str) -> str:
    """A replacement text with ``$1``, ``${name}``, ``$&``, ``$$`` in Spark's spelling.

    Groups are numbered unnamed first, then named.  A reference to a group the
    pattern lacks stays literal.  The context references ``$```, ``$'`` and
    ``$_`` have no counterpart and are refused.
    """
    found = re.findall(r"\\.|\[(?:\\.|[^\]])*\]|(\((?!\?)|\(\?<(\w+)>)", pattern, re.S)
    names = [name for opener, name in found if opener]
    unnamed_first = sorted(range(len(names)), key=lambda i: names[i] != "")
    references = {str(n + 1): f"${i + 1}" for n, i in enumerate(unnamed_first)}
    references |= {name: f"${i + 1}" for i, name in enumerate(names) if name}
    references |= {"0": "$0", "&": "$0"}
    references["+"] = references[str(len(names))]

    out, after_reference = "", False
    for token in re.findall(r"\$\d+|\$\{\w+\}|\$[$&+`'_]|.", replacement, re.S):
        if token in ("$`", "$'", "$_"):
            raise ValueError(f"replacement reference {token} is not supported")
        reference = references.get(token[1:].strip("{}")) if len(token) > 1 else None
        if reference:
            out += reference
        else:
            for char in "$" if token == "$$" else token:
                # A digit right after a reference must not extend its number.
                escape = char in "\\$" or (after_reference and char.isdigit())
                out += ("\\" if escape else "") + char
        after_reference = reference is not None
    return out
