"""Link functions: normalisation, tracking parameters, validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fixed_values import LOCAL_ADDRESSES, LOCAL_HOSTS, NON_MEDIA_EXTENSIONS, STREAM_SCHEMES, TRACKING_PREFIXES
from .text import fold, quote_regex, trim

_TRACKING = "^(?:" + "|".join(quote_regex(p) for p in TRACKING_PREFIXES) + ")"

# Parts of an absolute link.
_LABEL = r"[\p{L}\p{Nd}_][\p{L}\p{Mn}\p{Nd}_-]{0,62}"
_HOST_NAME = rf"{_LABEL}(?:\.{_LABEL})*\.?"
_IPV6 = r"\[[0-9a-f:.%]+\]"
_USER = r"(?:[^/?#\\@]*@)?"
# Empty, or a number up to 65535.
_PORT = r"(?::0*(?:\d{0,4}|[1-5]\d{4}|6[0-4]\d{3}|65[0-4]\d\d|655[0-2]\d|6553[0-5]))?"
_REST = r"(?:[/?#\\].*)?$"

_HOST_END = r"(?:[:/?#\\]|$)"


def _number(value: int) -> str:
    """A number as part of an IPv4 address may be written: decimal, octal or hexadecimal."""
    return rf"(?:{value:d}|0+{value:o}|0x0*{value:x})" if value else "(?:0+|0x0+)"


def _address(value: int) -> str:
    """All spellings of an IPv4 address: one to four numbers, the last one taking the bytes that are left."""
    forms = []
    for parts in range(1, 5):
        left = 8 * (4 - (parts - 1))
        heads = [(value >> (24 - 8 * k)) & 255 for k in range(parts - 1)]
        forms.append(r"\.".join(_number(n) for n in [*heads, value & ((1 << left) - 1)]))
    return "|".join(forms)


# Names of this machine, and its addresses in any spelling.
_LOCAL = "|".join([*(quote_regex(h) for h in LOCAL_HOSTS), *map(_address, LOCAL_ADDRESSES)])
_NOT_LOCAL = rf"(?!(?:{_LOCAL}){_HOST_END})"
# Hosts have three characters or more, but a number of one or two digits is an address as well.
_SHORT_ADDRESS = rf"(?:[1-9]\d?|0[1-7])(?={_HOST_END})"
_NOT_NON_MEDIA = r"(?![^?#]*\.(?:" + "|".join(NON_MEDIA_EXTENSIONS) + r")(?:[?#]|$))"

# One pass decides: scheme, host of at least three characters and not this
# machine, port, and a path that does not end like a picture, page or archive.
_STREAM_URL = (
    rf"(?iu)^(?:{'|'.join(STREAM_SCHEMES)})://{_USER}{_NOT_LOCAL}"
    rf"(?:{_IPV6}|(?=[^:/?#\\]{{3}}){_HOST_NAME}|{_SHORT_ADDRESS}){_PORT}{_NOT_NON_MEDIA}{_REST}"
)
_WEB_URL = rf"(?iu)^https?://{_USER}(?:{_IPV6}|{_HOST_NAME}){_PORT}{_REST}"


def is_tracking_param(param: Column) -> Column:
    """True for a lower-cased ``key=value`` that does not identify the stream."""
    return param.rlike(_TRACKING)


def is_stream_url(url: Column) -> Column:
    """True for an absolute link that can be a media stream.  Expects trimmed text."""
    return F.coalesce(url.rlike(_STREAM_URL), F.lit(False))


def is_probeable(url: Column) -> Column:
    """True for an absolute http(s) link; nothing else can be fetched."""
    return F.coalesce(trim(url).rlike(_WEB_URL), F.lit(False))


def _identifying_params(query: Column) -> Column:
    """Parameters of a query text without the tracking ones, sorted, joined again."""
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~is_tracking_param(p))
    keyed = F.transform(kept, lambda p: F.struct(F.upper(p).alias("key"), p.alias("param")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: s["param"]), "&")


def with_normalized_url(df: DataFrame, link: str, out: str) -> DataFrame:
    """Add one spelling per stream: case, slashes, ports, ``www.``, parameter order.

    Tracking parameters go, the others are sorted.  Blank gives "".
    """
    mark = F.instr("_url", "?")
    base = F.substring_index("_url", "?", 1)
    kept = (
        F.when(F.col("_query").isNull(), F.col("_url"))
        .when(F.col("_query") == "", base)
        .otherwise(F.concat(base, F.lit("?"), F.col("_query")))
    )
    for old, new in ((":80/", "/"), (":443/", "/"), ("://www.", "://")):
        kept = F.replace(kept, F.lit(old), F.lit(new))
    # Steps of their own: an expression used several times is computed once.
    return (
        df.withColumn("_url", F.rtrim(F.lower(trim(F.coalesce(link, F.lit("")))), F.lit("/")))
        .withColumn(
            "_query", F.when(mark > 1, _identifying_params(F.substr(F.col("_url"), mark + 1)))
        )
        .withColumn(out, kept)
        .drop("_url", "_query")
    )


def with_link_key(df: DataFrame, link: str = "link", out: str = "link_key") -> DataFrame:
    """Add a key that is equal for links to the same stream."""
    return with_normalized_url(df, link, out).withColumn(out, fold(F.col(out)))
