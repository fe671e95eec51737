"""Lines that repeat, exactly or nearly, by an exact set-similarity join.

A line is the set of its lower-cased words.  A line goes if an earlier line, kept
or not, has a Jaccard similarity of ``percent`` or more with it; lines come in the
order of document id and place.  Lines of fewer than ``least`` different words take
no part and stay; by default every line with a word takes part.

1. Words are counted over all texts, by hash in counters whose number grows with
   the number of texts; this makes a global order, rare words first.
2. Every line is cut once: its signature, number of words and prefix, the rarest
   words, as many as its length asks for.  A word that occurs once in all texts
   cannot be shared and is left out of the prefix.
3. Lines of equal text form a class, placed at its first line; all its other lines
   go, so frequent lines cost nothing further.
4. Families of similar lines are settled around their first class: each class is
   compared with two earlier classes at most, the earliest that share one of
   its two least word hashes each.  Classes found to go need no other partner.
5. The classes still open are joined with earlier ones on the words of their prefixes,
   filtered in the join by length, by the positions of the word in both lines and by
   a sketch of all words that bounds the overlap.  A pair counts only if its later class is
   open.  The number of a class begins with the stretch of ids its first line is in, so the join
   knows which class is later; within a stretch both ways are kept.
6. Before a pair is verified, the words that the two prefixes share bound the overlap
   of the whole sets.  What passes is verified on all words of both lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, StringType

from ..workspace import materialize, release
from .common import text_key, whole_text

# Lines of fewer different words stay.
LEAST = 1
# Counters, as a power of two: about 16 per text within these bounds.
# Only the order of words depends on them, never the result.
COUNTER_BITS = (10, 18)
# Up to this many rows of keys (some 40 bytes each) are broadcast, more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
# Words whose hashes are the least of a line, by which families are found.
_LEAST_WORDS = 2
# The ids are cut into so many stretches, as a power of two, by a sample of about _STRETCH_IDS.
# Only the pairs that the join keeps for later steps depend on them, never the result.
STRETCH_BITS = 6
_STRETCH_IDS = 4096
# Bits of a class's number below its stretch.
_NUMBER_BITS = 63 - STRETCH_BITS
# Bits of a word's hash below its level.
_HASH_BITS = 59


def _plain(text: str) -> Column:
    """A text in lower case with blanks for other white space inside lines."""
    value = F.lower(whole_text(text))
    for blank in "\t\r\f\v":
        value = F.replace(value, F.lit(blank), F.lit(" "))
    return value


def _words(line: Column) -> Column:
    """The different words of a plain line as sorted 64-bit hashes."""
    hashes = F.transform(F.split(line, " "), lambda w: F.xxhash64(w))
    return F.sort_array(F.array_distinct(F.array_remove(hashes, F.xxhash64(F.lit("")))))


def repeated_lines(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", percent: int = 80, least: int = LEAST
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_lines``, ``removed`` (numbers of the lines that go, from 0).

    Null and empty texts have one empty line, which stays.  Rows of equal id come
    one after another in any order; of repeated rows one keeps its lines.  Null ids
    come first.  Other columns are ignored, whatever their names.  An empty table
    gives an empty result.
    """
    return _decided(docs, id_column, text, percent, least).select(F.col("_id").alias(id_column), "n_lines", "removed")


def without_repeated_lines(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", percent: int = 80, least: int = LEAST
) -> DataFrame:
    """The rows of ``docs`` without the lines that go, all other columns as they are.

    Rows that lose every line that has a word are dropped; null, empty and wordless
    texts stay as they are.
    """
    found = _decided(docs, id_column, text, percent, least)
    # Rows that are equal in id and text are told apart by their number only.
    gone = found.where(F.size("removed") > 0).groupBy("_id", "_key").agg(
        F.sort_array(F.collect_list(F.struct("_copy", "removed"))).alias("_gone")
    )
    names = {c: f"_{k}" for k, c in enumerate(docs.columns)}
    rows = docs.select(
        *[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.col(f"`{id_column}`").alias("_id"), text_key(text).alias("_key")
    )
    same = Window.partitionBy("_id", "_key").orderBy(F.lit(0))
    rows = rows.withColumn("_copy", F.row_number().over(same))
    joined = rows.join(gone, rows["_id"].eqNullSafe(gone["_id"]) & (rows["_key"] == gone["_key"]), "left")
    mine = F.filter("_gone", lambda g: g["_copy"] == rows["_copy"])
    value = F.col(names[text])
    removed = F.when(F.size(mine) > 0, mine[0]["removed"])
    lines = F.split(value, "\n", -1)
    left = F.filter(lines, lambda line, k: ~F.array_contains(removed, k))
    joined = joined.select(
        *[F.col(n) for c, n in names.items() if c != text],
        F.when(removed.isNull(), value).otherwise(F.array_join(left, "\n")).alias(names[text]),
        removed.isNull().alias("_whole"),
    )
    kept = joined.where(F.col("_whole") | (F.trim(F.translate(names[text], "\n\t\r\f\v", "     ")) != ""))
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])


def _signature(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("s1"), F.xxhash64(F.lit(1), line).alias("s2")]


def _decided(docs: DataFrame, id_column: str, text: str, percent: int, least: int) -> DataFrame:
    """``_id``, ``_key``, ``_row``, ``n_lines``, ``removed`` and ``_copy`` per row, written."""
    n_rows = docs.count()
    levels, bits = _levels(docs, text, n_rows)
    own = F.col(f"`{id_column}`")
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        own.alias("_id"),
        text_key(f"`{text}`").alias("_key"),
        _stretch(own, _bounds(docs.select(own.alias("_id")), n_rows)).alias("stretch"),
        F.transform(F.split(_plain(f"`{text}`"), "\n", -1), lambda x: _described(x, levels, bits, percent)).alias("lines"),
    )
    rows = materialize(rows, "lines")
    lines = rows.select("_id", "_row", "stretch", F.posexplode("lines").alias("k", "line"))
    classes = lines.where(F.col("line.n") >= max(1, least)).groupBy("line.s1", "line.s2").agg(
        F.min(F.struct("_id", "_row", "k", "stretch")).alias("place"),
        F.count("k").alias("times"),
        *[F.first(f"line.{c}").alias(c) for c in ("n", "least", "prefix", "sketch")],
    )
    number = F.shiftleft(F.col("place.stretch").cast("long"), _NUMBER_BITS).bitwiseOR(F.monotonically_increasing_id())
    classes = classes.withColumn("c", number).withColumn("place", F.col("place").dropFields("stretch"))
    classes = materialize(classes, "classes")
    comparison = _Comparison(docs, id_column, text, classes, percent)

    settled = comparison.later(_family_heads(classes))
    rest = comparison.later(_sharing(classes, settled, percent), settled)

    # Lines that go: all but the first of a class, and the first of a class with an earlier partner.
    gone = settled.unionByName(rest).withColumn("gone", F.lit(True))
    judged = classes.select("c", "s1", "s2", "times", "place").join(gone, "c", "left")
    judged = judged.where((F.col("times") > 1) | F.col("gone")).select("s1", "s2", "place", "gone")
    lines = lines.select("_row", "k", "line.s1", "line.s2")
    is_first = (F.col("_row") == F.col("place._row")) & (F.col("k") == F.col("place.k"))
    removed = lines.join(judged, ["s1", "s2"]).where(~is_first | F.col("gone"))
    removed = removed.groupBy("_row").agg(F.sort_array(F.collect_list("k")).alias("removed"))
    per_row = rows.select("_row", "_id", "_key", F.size("lines").cast("long").alias("n_lines"))
    copies = Window.partitionBy("_id", "_key").orderBy("_row")
    decided = per_row.join(removed, "_row", "left").select(
        "_id", "_key", "n_lines", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"), "_row"
    )
    decided = materialize(decided, "decided")
    release(rows, classes, settled, rest)
    return decided.withColumn("_copy", F.row_number().over(copies))


def _described(line: Column, levels: Column, bits: int, percent: int) -> Column:
    """``s1``, ``s2``, ``n`` (different words), ``least`` and ``prefix`` of a plain line.

    Words are cut down to 31 bits where they only have to find partners.
    """

    def ordered(word: Column) -> Column:
        level = levels[F.shiftrightunsigned(word, 64 - bits)]
        return F.shiftleft(level.cast("long"), _HASH_BITS).bitwiseOR(F.shiftrightunsigned(word, 64 - _HASH_BITS))

    def short(word: Column) -> Column:
        return word.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")

    def flipped(bits: Column, word: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), word.bitwiseAND(F.lit(63)).cast("int"))
        return bits.bitwiseXOR(bit)

    def with_words(t: Column) -> Column:
        size = F.size(t)
        length = (size - F.ceil(percent * size / 100) + 1).cast("int")
        prefix = F.slice(F.sort_array(F.transform(t, ordered)), F.lit(1), F.when(size > 0, length).otherwise(0))
        several = F.transform(F.filter(prefix, lambda o: o >= (1 << _HASH_BITS)), short)
        return F.struct(
            *_signature(line),
            size.alias("n"),
            F.transform(F.slice(t, 1, _LEAST_WORDS), short).alias("least"),
            several.alias("prefix"),
            # Every bit tells whether an odd number of words falls on it.
            F.reduce(t, F.lit(0).cast("long"), flipped).alias("sketch"),
        )

    # A list of one element, so that the words are worked out once.
    return F.get(F.transform(F.array(_words(line)), with_words), F.lit(0))


def _bounds(ids: DataFrame, n_rows: int) -> list:
    """The first ids of all stretches of ids but the first, in order; none for ids of unusual types."""
    if not isinstance(ids.schema["_id"].dataType, (NumericType, StringType, DateType)):
        return []
    some = ids.where(F.pmod(F.xxhash64("_id"), F.lit(max(1, n_rows // _STRETCH_IDS))) == 0).where(F.col("_id").isNotNull())
    held = some.distinct().agg(F.sort_array(F.collect_list("_id")).alias("held"))
    stretches = 1 << STRETCH_BITS
    at = [F.floor(F.size("held") * k / stretches).cast("int") for k in range(1, stretches)]
    return held.select(F.array_compact(F.array(*[F.get("held", k) for k in at]))).first()[0]


def _stretch(own: Column, bounds: list) -> Column:
    """The number of the stretch an id is in, 0 for null."""
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= own)) if bounds else F.lit(0)


def _levels(docs: DataFrame, text: str, n_rows: int) -> tuple[Column, int]:
    """A constant array with the level of every counter, 0 for one occurrence, and the bits of a counter's number.

    Words are counted over all texts; at most 2^18 levels reach the driver, packed by the thousand.
    """
    bits = min(max(n_rows.bit_length() + 4, COUNTER_BITS[0]), COUNTER_BITS[1])
    words = docs.select(F.explode(F.split(F.replace(_plain(f"`{text}`"), F.lit("\n"), F.lit(" ")), " ")).alias("w"))
    slot = F.shiftrightunsigned(F.xxhash64("w"), 64 - bits).alias("slot")
    level = F.least(F.floor(F.log2("count")), F.lit(15)).cast("int").alias("level")
    slots = words.where("w != ''").groupBy(slot).count().select("slot", level)
    packed = slots.groupBy(F.shiftright("slot", 10).cast("int").alias("at")).agg(
        F.array_join(F.collect_list(F.concat_ws(":", F.col("slot").bitwiseAND(F.lit(1023)), "level")), " ").alias("levels")
    )
    known = ["0"] * (1 << bits)
    for row in packed.collect():
        for pair in row["levels"].split(" "):
            slot, level = pair.split(":")
            known[(row["at"] << 10) + int(slot)] = level
    return F.split(F.lit(",".join(known)), ",").cast("array<int>"), bits


def _family_heads(classes: DataFrame) -> DataFrame:
    """``x``, ``y``: every class ``y`` with the earliest class ``x`` of each of its two least words."""
    keys = classes.select("c", "place", F.explode("least").alias("w"))
    heads = keys.groupBy("w").agg(F.min(F.struct("place", "c")).alias("h"), F.count("c").alias("n")).where("n > 1")
    heads = materialize(heads.select("w", "h"), "heads")
    near = keys.join(heads, "w").where(F.col("c") != F.col("h.c"))
    return near.select(F.col("h.c").alias("x"), F.col("c").alias("y")).distinct()


def _sharing(classes: DataFrame, settled: DataFrame, percent: int) -> DataFrame:
    """``x``, ``y``: pairs of classes that share a word of their prefixes at fitting positions, the later one not settled.

    Of pairs within a stretch of ids, one of them is not settled.
    """
    gone = settled.withColumn("gone", F.lit(True))
    dropped = _prefix_length("n", percent) - F.size("prefix")
    postings = classes.select("c", "n", "prefix", "sketch").join(gone, "c", "left").select(
        F.posexplode("prefix").alias("at", "w"), "c", "n", "sketch", F.coalesce("gone", F.lit(False)).alias("gone"), dropped.alias("dropped")
    )
    postings = postings.select("w", "c", "n", "sketch", (F.col("at") + F.col("dropped")).alias("at"), "gone")
    a, b = (postings.select("w", *[F.col(c).alias(f"{c}_{s}") for c in ("c", "n", "sketch", "at", "gone")]) for s in "ab")
    na, nb = F.col("n_a"), F.col("n_b")
    same_stretch = F.shiftright("c_a", _NUMBER_BITS) == F.shiftright("c_b", _NUMBER_BITS)
    pairs = a.join(
        b,
        (a["w"] == b["w"])
        & (F.col("c_a") < F.col("c_b"))
        # Of different stretches, b is the later one.
        & (~F.col("gone_b") | (same_stretch & ~F.col("gone_a")))
        & (F.least(na - F.col("at_a"), nb - F.col("at_b")) >= _needed(na, nb, percent))
        & (100 * F.least(na, nb) >= percent * F.greatest(na, nb))
        # A bit that differs stands for a word of one line only.
        & (F.floor((na + nb - F.bit_count(F.col("sketch_a").bitwiseXOR(F.col("sketch_b")))) / 2) >= _needed(na, nb, percent)),
    )
    return pairs.select(F.col("c_a").alias("x"), F.col("c_b").alias("y")).distinct()


def _prefix_length(n: str, percent: int) -> Column:
    return (F.col(n) - F.ceil(percent * F.col(n) / 100) + 1).cast("int")


def _needed(n: Column, m: Column, percent: int) -> Column:
    """How many words sets of n and m words must share."""
    return F.ceil(percent * (n + m) / F.lit(100 + percent))


def _small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


class _Comparison:
    """Verification of pairs of classes on their whole sets."""

    def __init__(self, docs: DataFrame, id_column: str, text: str, classes: DataFrame, percent: int):
        self.docs = docs.select(F.col(f"`{id_column}`").alias("_id"), F.col(f"`{text}`").alias("_text"))
        self.classes, self.percent = classes, percent

    def later(self, pairs: DataFrame, settled: DataFrame | None = None) -> DataFrame:
        """``c`` of the classes that are similar to an earlier one of their pair, but for those settled; written."""
        open_pairs = self._possible(pairs, settled)
        asked = open_pairs.select(F.explode(F.array("x", "y")).alias("c")).distinct()
        asked = materialize(asked.join(self.classes.select("c", "s1", "s2", "place"), "c"), "asked")
        # Only documents that hold the first line of a class asked for are cut into lines.
        # Rows of equal id may have other lines at a place, so the signature counts as well.
        small = _small(asked)
        ids = _small(asked.select(F.col("place._id").alias("_asked")).distinct())
        held = self.docs.join(ids, F.col("_id").eqNullSafe(F.col("_asked")), "left_semi")
        lines = held.select("_id", F.posexplode(F.split(_plain("_text"), "\n", -1)).alias("k", "line"))
        lines = lines.select("_id", "k", "line", *_signature(F.col("line")))
        found = lines.join(small, ["s1", "s2"])
        found = found.where(F.col("_id").eqNullSafe(F.col("place._id")) & (F.col("k") == F.col("place.k")))
        sets = found.groupBy("c").agg(F.first("line").alias("line"))
        sets = materialize(sets.select("c", _words(F.col("line")).alias("t")), "compared")
        x, y = (sets.select(F.col("c").alias(s), F.col("t").alias(f"t{s}")) for s in "xy")
        both = open_pairs.join(x, "x").join(y, "y")
        common = F.size(F.array_intersect("tx", "ty"))
        similar = 100 * common >= self.percent * (F.size("tx") + F.size("ty") - common)
        later = materialize(both.where(similar).select(F.col("y").alias("c")).distinct(), "later")
        release(open_pairs, asked, sets)
        return later

    def _possible(self, pairs: DataFrame, settled: DataFrame | None) -> DataFrame:
        """The pairs, the earlier class as ``x``, whose prefixes share enough words; written.

        Of two prefixes in the same order of words, one ends first: up to there all
        common words are in both, beyond it there are only the rest of its words.
        Words that are equal in their 31 bits only are allowed for.
        """
        length = _prefix_length("n", self.percent)
        facts = self.classes.select("c", F.struct("place", "c", "n", "prefix", (F.col("n") - length).alias("rest")).alias("f"))
        x, y = (facts.select(F.col("c").alias(s), F.col("f").alias(f"f{s}")) for s in "xy")
        both = pairs.join(x, "x").join(y, "y")
        shared = F.size(F.array_intersect("fx.prefix", "fy.prefix"))
        alike = [F.size(f"f{s}.prefix") - F.size(F.array_distinct(f"f{s}.prefix")) for s in "xy"]
        n, m = F.col("fx.n"), F.col("fy.n")
        bound = shared + F.least(*alike) + F.greatest("fx.rest", "fy.rest")
        both = both.where((bound >= _needed(n, m, self.percent)) & (100 * F.least(n, m) >= self.percent * F.greatest(n, m)))
        swapped = F.col("fy.place") < F.col("fx.place")
        placed = both.select(
            F.when(swapped, F.col("y")).otherwise(F.col("x")).alias("x"), F.when(swapped, F.col("x")).otherwise(F.col("y")).alias("y")
        )
        if settled is not None:
            placed = placed.join(settled.select(F.col("c").alias("y")), "y", "left_anti")
        return materialize(placed.select("x", "y"), "pairs")
