"""Reading a captured response: is the stream alive, and what is in it.

All functions work on the columns of a response row (``link, attempt, status,
icy_br, body``) with built-in expressions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fixed_values import (
    AUDIO_CODECS,
    ERROR_PAGE_STARTS,
    ERROR_PAGE_TEXTS,
    MANIFEST_BANDWIDTH,
    MANIFEST_CODECS,
    MANIFEST_RESOLUTION,
    PAGE_PREFIX_BYTES,
    SIGNATURE_HEX_CHARS,
    SIGNATURE_MIN_BYTES,
    VIDEO_CODECS,
    XHTML_START,
)
from .text import quote_regex
from .urls import is_probeable

_PAGE_START = "(?i)^(?:" + "|".join(quote_regex(t) for t in ERROR_PAGE_STARTS) + ")"
_PAGE_TEXT = "(?i)" + "|".join(quote_regex(t) for t in ERROR_PAGE_TEXTS)


def is_success(status: Column) -> Column:
    return F.coalesce(status.between(200, 299), F.lit(False))


def page_text(body: Column) -> Column:
    """Start of a body as text, one character per byte, without leading blanks."""
    text = F.decode(F.substring(body, 1, PAGE_PREFIX_BYTES), "ISO-8859-1")
    return F.regexp_replace(text, r"^[ \t-\r]+", "")


def is_error_page(text: Column) -> Column:
    """True if the text is a web page or an error message, not a stream."""
    return text.rlike(_PAGE_START) | text.rlike(XHTML_START) | text.rlike(_PAGE_TEXT)


def header_bitrate(icy_br: Column) -> Column:
    """Bits per second from an ``icy-br`` header, wrapping like 32-bit integers."""
    whole = F.when(icy_br.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(icy_br).try_cast("int"))
    bits = whole.cast("bigint") * 1000
    return (F.pmod(bits + 2**31, F.lit(2**32)) - 2**31).cast("int")


def _last_codec(parts: Column, table: list[tuple[str, str]]) -> Column:
    def name(part: Column) -> Column:
        pairs = table[1:]
        first = F.when(part.startswith(table[0][0]), table[0][1])
        return reduce(lambda chain, pair: chain.when(part.startswith(pair[0]), pair[1]), pairs, first)

    return F.try_element_at(F.filter(F.transform(parts, name), lambda c: c.isNotNull()), F.lit(-1))


def _codec_parts(codecs: Column) -> Column:
    return F.transform(F.split(codecs, ","), lambda part: F.lower(F.trim(part)))


def video_codec(codecs: Column) -> Column:
    """Video codec of a comma-separated codec list; the last one counts."""
    return _last_codec(_codec_parts(codecs), VIDEO_CODECS)


def audio_codec(codecs: Column) -> Column:
    """Audio codec of a comma-separated codec list; the last one counts."""
    return _last_codec(_codec_parts(codecs), AUDIO_CODECS)


def with_verdict(responses: DataFrame) -> DataFrame:
    """Add ``is_alive`` and ``stream_info`` to captured responses.

    The header wins over the body field by field; a manifest with a number that
    does not fit 32 bits counts as dead; an info without any field is null.
    """
    text, manifest, alive = F.col("_text"), F.col("_manifest"), F.col("is_alive")
    numbers = {"width": (MANIFEST_RESOLUTION, 1), "height": (MANIFEST_RESOLUTION, 2), "bitrate": (MANIFEST_BANDWIDTH, 1)}
    digits = {
        f"_{name}_digits": F.when(manifest, F.regexp_extract(text, pattern, group))
        for name, (pattern, group) in numbers.items()
    }
    unreadable = reduce(
        lambda a, b: a | b,
        [
            (F.coalesce(F.col(f"_{name}_digits"), F.lit("")) != "") & F.col(f"_{name}").isNull()
            for name in numbers
        ],
    )
    success = is_probeable(F.col("link")) & is_success(F.col("status")) & (F.length("body") > 0)
    fields = {
        "width": F.col("_width"),
        "height": F.col("_height"),
        "bitrate": F.coalesce(F.col("_header_bitrate"), F.col("_bitrate")),
        "video_codec": F.coalesce(
            video_codec(F.col("_codecs")),
            F.when(F.col("_start").startswith("47"), "MPEG-TS"),
            F.when(F.col("_start") == "464C56", "FLV"),
        ),
        "audio_codec": F.coalesce(
            audio_codec(F.col("_codecs")),
            F.when(F.col("_start").rlike("^FF[EF]"), "MP3"),
            F.when(F.col("_start") == "494433", "MP3/AAC"),
        ),
    }
    found = [F.col(f"_found_{name}") for name in fields]
    info = F.struct(*[F.col(f"_found_{name}").alias(name) for name in fields])
    judged = (
        responses.withColumns(
            {
                "_text": page_text(F.col("body")),
                "_start": F.when(F.length("body") >= 3, F.hex(F.substring("body", 1, 3))),
                "_header_bitrate": header_bitrate(F.col("icy_br")),
            }
        )
        .withColumn("_manifest", F.upper(F.substring(text, 1, 7)) == "#EXTM3U")
        .withColumns(digits | {"_codecs": F.when(manifest, F.regexp_extract(text, MANIFEST_CODECS, 1))})
        .withColumns({f"_{name}": F.col(f"_{name}_digits").try_cast("int") for name in numbers})
        .withColumn("is_alive", F.coalesce(success & ~is_error_page(text) & ~unreadable, F.lit(False)))
        .withColumns({f"_found_{name}": F.when(alive, field) for name, field in fields.items()})
    )
    return judged.select(
        *responses.columns,
        "is_alive",
        F.when(reduce(lambda a, b: a | b, [c.isNotNull() for c in found]), info).alias("stream_info"),
    )


def content_signature(status: Column, body: Column) -> Column:
    """Short hash of all bytes captured, null for failures and tiny bodies."""
    digest = F.upper(F.sha2(body, 256))
    return F.when(
        is_success(status) & (F.length(body) >= SIGNATURE_MIN_BYTES),
        F.substring(digest, 1, SIGNATURE_HEX_CHARS),
    )


def success_rate(working: Column, total: Column) -> Column:
    """Share of working links in percent, 0 for none at all."""
    return F.coalesce(F.try_divide(working * 100.0, total), F.lit(0.0))
