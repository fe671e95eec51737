"""Category, language, rename and content-duplicate operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.enrich import (
    pattern_is_valid,
    rename_literal,
    rename_regex,
    with_category,
)
from ..functions.fixed_values import UNCATEGORIZED
from ..functions.names import display_name
from ..functions.text import fold
from ..workspace import materialize
from .lookup import lookup

DUPLICATE_OF = "duplicate-of"


def auto_categorize(
    df: DataFrame, table: dict[str, list[str]] | None = None, whole_words: bool = False
) -> DataFrame:
    """Set the category; it also becomes the group of rows without one."""
    category = F.col("category")
    no_group = (F.col("group_name") == "") | (fold(F.col("group_name")) == UNCATEGORIZED.upper())
    filled = F.when((category != "Unknown") & no_group, category).otherwise(F.col("group_name"))
    return with_category(df, table, whole_words).withColumn("group_name", filled)


def categorize_by_table(df: DataFrame, keywords: DataFrame, whole_words: bool = False) -> DataFrame:
    """Set ``category`` by a table of keywords of any size; the rule is that of ``with_category``.

    ``keywords`` holds ``category, rank, keyword``: of all keywords in a text the
    lowest rank decides, equal ranks by category.  The group decides before all
    texts; without a keyword the category is "Unknown".  Keywords count anywhere,
    ignoring case; null and empty ones are left out.

    Texts that are equal are looked at once.  Every keyword stands under the one of
    its runs of three characters that occurs in the fewest texts; texts meet keywords
    on those runs only, by an equality join, and what meets is compared.  The work
    grows with the texts and with what they have in common with keywords, not with
    their product.
    """
    folded = fold(F.trim(F.col("keyword")))
    known = keywords.select("category", "rank", folded.alias("keyword")).where("keyword != ''").groupBy("keyword").agg(
        F.min(F.struct("rank", "category")).alias("best")
    )
    known = materialize(known, "keywords")
    lengths = [r[0] for r in known.select(F.least(F.length("keyword"), F.lit(_RUN))).distinct().collect()]
    texts = [F.coalesce(c, F.lit("")) for c in ("name", "tvg_name", "group_name")]
    given = df.withColumns({"_all": fold(F.concat_ws(" ", *texts)), "_group": fold(F.coalesce("group_name", F.lit("")))})
    given = given.withColumns({f"{c}_key": F.unhex(F.md5(F.col(c).cast("binary"))) for c in ("_all", "_group")})
    both = F.explode(F.array(*[F.struct(F.col(f"{c}_key").alias("key"), F.col(c).alias("text")) for c in ("_all", "_group")]))
    different = given.select(both.alias("t")).groupBy("t.key").agg(F.first("t.text").alias("text")).where("text != ''")
    different = materialize(different, "texts")

    runs = different.select("key", F.explode(_runs(F.col("text"), lengths)).alias("run"))
    counts = runs.groupBy("run").agg(F.count("key").alias("texts"))
    # A keyword with a run that no text has is in none.
    own = known.select("keyword", F.explode(_runs(F.col("keyword"), lengths, own_length=True)).alias("run"))
    rarest = own.join(counts, "run", "left").groupBy("keyword").agg(
        F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "run")).alias("rarest")
    )
    index = rarest.where("rarest.texts > 0").join(known, "keyword").select(F.col("rarest.run").alias("run"), "keyword", "best")
    index = materialize(index, "index")
    met = runs.join(index, "run").join(different, "key")
    inside = F.contains("text", "keyword")
    if whole_words:
        quoted = F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.replace("keyword", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?!\w)"))
        inside = inside & F.regexp_like("text", quoted)
    found = met.where(inside).groupBy("key").agg(F.min("best").alias("best")).select("key", "best.category")
    found = materialize(found, "categories")
    for c in ("_group", "_all"):
        named = found.select(F.col("key").alias(f"{c}_key"), F.col("category").alias(f"{c}_category"))
        given = given.join(named, f"{c}_key", "left")
    category = F.coalesce("_group_category", "_all_category", F.lit("Unknown"))
    return given.withColumn("category", category).select(df.columns if "category" in df.columns else [*df.columns, "category"])


# Characters by which texts and keywords meet.
_RUN = 3


def _runs(text: Column, lengths: list[int], own_length: bool = False) -> Column:
    """The different runs of the given lengths; of shorter texts, or with ``own_length``, of their own length only."""

    def of_length(n: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
        wanted = F.least(F.length(text), F.lit(_RUN)) == n if own_length else F.length(text) >= n
        return F.when(wanted, F.transform(places, lambda i: F.substring(text, i, F.lit(n)))).otherwise(none)

    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(none, *[of_length(n) for n in lengths]))


def rename_channels(
    df: DataFrame, pattern: str | None, replacement: str | None = None, use_regex: bool = False
) -> DataFrame:
    """Replace text in names; every name becomes the shown name on the way.

    Off without a pattern; an invalid regular expression leaves rows unchanged.
    """
    if not pattern or (use_regex and not pattern_is_valid(df.sparkSession, pattern)):
        return df
    rename = rename_regex if use_regex else rename_literal
    return df.withColumns(
        {
            "name": rename(display_name(F.col("name"), F.col("tvg_name")), pattern, replacement or ""),
            "tvg_name": rename(F.col("tvg_name"), pattern, replacement or ""),
        }
    )


def flag_content_duplicates(df: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """Mark every later row with a content hash already seen; drop none.

    ``earlier`` holds ``content_hash, name`` of first rows that came before all of
    these.

    The mark is an attribute with the name of the first row.  First rows are
    found by a partially aggregated group-by, so equal content in a large share
    of the rows does not gather in one task.
    """
    originals = (
        df.where("content_hash is not null")
        .groupBy("content_hash")
        .agg(
            F.min("id").alias("_first_id"),
            F.min_by("name", "id").alias("_original"),
            F.count("*").alias("_rows"),
        )
    )
    if earlier is None:
        originals = originals.where("_rows > 1").drop("_rows")
    else:
        before = earlier.select("content_hash", F.col("name").alias("_before"), F.lit(True).alias("_seen"))
        originals = originals.join(before, "content_hash", "left").where("_rows > 1 or _seen").select(
            "content_hash",
            F.when(F.col("_seen"), F.lit(-1)).otherwise(F.col("_first_id")).cast("long").alias("_first_id"),
            F.when(F.col("_seen"), F.col("_before")).otherwise(F.col("_original")).alias("_original"),
        )
    originals = materialize(originals, "originals")
    extras = F.coalesce("extra_attributes", F.create_map().cast("map<string,string>"))
    original = F.col("_original")
    flagged = F.when(
        F.map_contains_key(extras, DUPLICATE_OF),
        F.transform_values(extras, lambda k, v: F.when(k == DUPLICATE_OF, original).otherwise(v)),
    ).otherwise(F.map_concat(extras, F.create_map(F.lit(DUPLICATE_OF), original)))
    return (
        lookup(df, originals, "content_hash", F.col("id"))
        .withColumn(
            "extra_attributes",
            F.when(F.col("id") > F.col("_first_id"), flagged).otherwise(F.col("extra_attributes")),
        )
        .select(*df.columns)
    )
