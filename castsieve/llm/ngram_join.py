"""Documents joined by the Jaccard similarity of their word n-grams.

Exact, by a token-group matrix:

1. Equal sets of n-grams become one class, so copies of a text cost nothing
   further.  The n-grams of a class are put in a global order, rare ones first;
   two sets that are similar enough share one within short prefixes of this order.
   Only sets of similar size meet.
2. Similar documents are partitioned into groups: every class is compared with the
   class of each prefix token that has the fewest rarer tokens, and classes linked
   that way form a group.
   This is linear in the prefixes and swallows large families of near copies.
3. The matrix holds, for every prefix token, the groups whose union of prefixes
   has it, with their range of sizes and the most tokens that can still follow.
   Two groups meet only if they share a token and these bounds allow an overlap
   large enough; inside a group nothing is compared any more.
4. Only for groups that qualify are the members with that token paired, filtered by
   their own sizes and positions and by a bitmap that bounds the overlap, and
   compared exactly on their whole sets.

Links of steps 2 and 4 give the components.  No pairs within a group are formed and
no list of candidates is cut off.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..workspace import materialize, release, scratch
from .common import importable_on_executors, slices, text_key
from .components import components
from .hashing import SPACED, mix, shingles, words

# Counters of n-grams by hash; only the order depends on them, never the result.
COUNTER_BITS = 20
_BLOCKS = 1024
# Bits per token, at least, of the bitmap that bounds an overlap; the fewest longs it has.
_BITS_PER_TOKEN = 2
_LEAST_LONGS = 8
# Up to this many identifiers (8 bytes each; a quarter of it for ids with a text key) are
# broadcast, more are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def similar_groups(
    docs: DataFrame, n: int = 5, percent: int = 80, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles``, ``component_id``, ``first``.

    A document is the set of its runs of ``n`` lower-cased (A-Z) words, or its whole
    word sequence when it has fewer.  Two are linked when
    ``100 * intersection >= percent * union``; ``component_id`` is the smallest id
    reachable by links.  ``first`` marks one row per component, one with that id.
    Null and wordless texts are linked with nothing.  Repeated rows are linked with
    each other.  Rows without an id count, but a component's id is null only if all
    its ids are.  Other columns are ignored, whatever their names.  An empty table
    gives an empty result.
    """
    return _grouped(docs, n, percent, id_column, text).select(
        F.col("_id").alias(id_column), F.col("n").alias("n_shingles"), "component_id", "first"
    )


def _grouped(docs: DataFrame, n: int, percent: int, id_column: str, text: str) -> DataFrame:
    given = _Documents(docs, n, id_column, text)
    rows, classes = _classes(given, percent)
    links = _links(given, rows, classes, percent)
    with scratch(docs.sparkSession):
        found = materialize(components(links), "components", lasting=True)
    roots = found.withColumnRenamed("node", "c")
    named = classes.select("sig", "c", "first_id", "first_row").join(roots, "c", "left").withColumn(
        "root", F.coalesce("root", "c")
    )
    # Of components of several classes, the smallest id; of all others their own.
    best = F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "first_row")).alias("best")
    named = named.join(named.groupBy("root").agg(best), "root").select(
        "sig", F.col("best.first_id").alias("component_id"), F.col("best.first_row").alias("_first")
    )
    alone = F.col("n") == 0
    return rows.select("_row", "_id", "_key", "n", "sig").join(named, "sig", "left").select(
        "_id",
        "_key",
        "n",
        F.when(alone, F.col("_id")).otherwise(F.col("component_id")).alias("component_id"),
        (alone | (F.col("_row") == F.col("_first"))).alias("first"),
    )


class _Documents:
    """Texts and their sets of n-grams, worked out anew for every pass instead of stored."""

    def __init__(self, docs: DataFrame, n: int, id_column: str, text: str):
        importable_on_executors(docs.sparkSession)
        self.n = n
        self.kind = docs.schema[id_column].dataType.simpleString()
        self.id_type = to_arrow_type(docs.schema[id_column].dataType)
        self.texts = docs.select(F.col(f"`{id_column}`").alias("_id"), text_key(f"`{text}`").alias("_key"), F.col(f"`{text}`").alias("_text"))


def _sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    found = words(texts, SPACED)
    return [np.unique(shingles(found.hashes[a:b], n)) for a, b in zip(found.first, found.first[1:])]


def _sizes(size: int, percent: int) -> list[int]:
    """Classes of sizes: sets similar enough have one in common.

    A class spans eight steps of the largest ratio of two sizes; a set in the last
    step of a class is in the next one as well.
    """
    if percent >= 100:
        return [size]
    step = math.floor(math.log(size) / math.log(100 / percent) + 1e-9)
    return [step // 8] + [step // 8 + 1] * (step % 8 == 7)


def _classes(given: _Documents, percent: int) -> tuple[DataFrame, DataFrame]:
    """A written row per document, and the written classes of equal sets."""
    n = given.n
    order = given.texts.sparkSession.sparkContext.broadcast(_rarity(given))
    names = ["_row", "_id", "_key", "n", "sig", "length", "prefix", "b0", "b1", "bitmap"]
    types = [pa.int64(), given.id_type, pa.string(), pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int64())]
    types += [pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def describe(batches):
        for values in slices(batches):
            out = []
            for row, doc_id, key, tokens in zip(values["_row"], values["_id"], values["_key"], _sets(values["_text"], n)):
                size = len(tokens)
                if not size:
                    out.append((row, doc_id, key, 0, None, 0, [], 0, 0, []))
                    continue
                sig = hashlib.blake2b(tokens.astype("<u8").tobytes(), digest_size=16).digest()
                level = order.value[(tokens >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]
                length = size - -(-percent * size // 100) + 1
                rare = tokens[np.lexsort((tokens, level))[:length]]
                # Only sets of one class of sizes meet on a token.
                prefix = np.concatenate([mix(rare + np.uint64(k)) for k in _sizes(size, percent)])
                bitmap = _bitmap(tokens)
                # Two words folded out of all, to go with every token.
                b0, b1 = np.bitwise_xor.reduce(bitmap.reshape(-1, 2), axis=0).tolist()
                out.append((row, doc_id, key, size, sig, length, prefix.view(np.int64).tolist(), b0, b1, bitmap.tolist()))
            yield _batch(out, names, types)

    numbered = given.texts.withColumn("_row", F.monotonically_increasing_id())
    schema = f"_row long, _id {given.kind}, _key string, n long, sig binary, length int, prefix array<long>, "
    schema += "b0 long, b1 long, bitmap array<long>"
    rows = materialize(numbered.mapInArrow(describe, schema), "rows")
    smallest = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_row")).alias("best")
    classes = rows.where("n > 0").groupBy("sig").agg(
        F.min("_row").alias("c"), smallest, *[F.first(c).alias(c) for c in ("n", "length", "prefix", "b0", "b1", "bitmap")]
    )
    classes = classes.select(
        "sig", "c", F.col("best._id").alias("first_id"), F.col("best._row").alias("first_row"), "n", "length", "prefix", "b0", "b1", "bitmap"
    )
    return rows, materialize(classes, "classes")


def _bitmap(tokens: np.ndarray) -> np.ndarray:
    """Longs of which every bit tells whether an odd number of tokens falls on it.

    Their number is a power of two that grows with the set, so that large sets are
    told apart as well as small ones; folding the halves upon each other gives the
    bitmap of half the size.
    """
    longs = _LEAST_LONGS
    while 64 * longs < _BITS_PER_TOKEN * len(tokens):
        longs *= 2
    bits = np.bincount((tokens % np.uint64(64 * longs)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(bits.astype(np.uint8)).view("<i8")


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _rarity(given: _Documents) -> np.ndarray:
    """A level per counter, low for rare n-grams, counted over all rows.

    Tasks count by hash and send their counters in blocks; the sum has a fixed size.
    """
    n, width = given.n, (1 << COUNTER_BITS) // _BLOCKS

    def count(batches):
        total = np.zeros(1 << COUNTER_BITS, dtype=np.int32)
        for values in slices(batches):
            for tokens in _sets(values["_text"], n):
                # The hashes of a set are all different, but their counters need not be.
                np.add.at(total, (tokens >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), 1)
        blocks = [b.astype("<i8").tobytes() for b in total.reshape(_BLOCKS, width)]
        yield pa.RecordBatch.from_pydict({"block": list(range(_BLOCKS)), "counts": blocks}, schema=_COUNTS)

    def add(batches):
        sums = {}
        for values in slices(batches):
            for block, counts in zip(values["block"], values["counts"]):
                sums[block] = sums.get(block, 0) + np.frombuffer(counts, dtype="<i8")
        found = sorted(sums)
        yield pa.RecordBatch.from_pydict({"block": found, "counts": [sums[b].tobytes() for b in found]}, schema=_COUNTS)

    counted = given.texts.select("_text").mapInArrow(count, "block int, counts binary")
    summed = counted.repartition("block").mapInArrow(add, "block int, counts binary").collect()
    total = np.zeros((_BLOCKS, width), dtype=np.int64)
    for row in summed:
        total[row.block] = np.frombuffer(row.counts, dtype="<i8")
    return np.floor(2 * np.log2(np.maximum(total.ravel(), 1))).astype(np.uint8)


_COUNTS = pa.schema([("block", pa.int32()), ("counts", pa.binary())])


def _needed(percent: int, one: Column, other: Column) -> Column:
    """The least overlap of two sets of these sizes that are similar enough."""
    return F.ceil(percent * (one + other) / F.lit(100 + percent))


def _possible(n: str, sketch: str, m: str, other: str, percent: int) -> Column:
    """Whether sketches leave room for the overlap: a bit that differs is a token of one set only."""
    apart = sum(F.bit_count(F.col(f"{sketch}.b{k}").bitwiseXOR(F.col(f"{other}.b{k}"))) for k in (0, 1))
    return F.floor((F.col(n) + F.col(m) - apart) / 2) >= _needed(percent, F.col(n), F.col(m))


def _links(given: _Documents, rows: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    sketch = F.struct("b0", "b1").alias("sketch")
    # Most tokens of a prefix are in no other.  Only token, class and place are shuffled to find the
    # shared ones, whatever their number; sizes and sketches join those that are left.
    postings = classes.select("c", "length", F.posexplode("prefix").alias("at", "token"))
    # A prefix may stand there for two classes of sizes.
    postings = postings.select("token", "c", (F.col("at") % F.col("length")).alias("at"))
    several = postings.groupBy("token").count().where("count > 1").select("token")
    found = materialize(postings.join(several, "token", "left_semi"), "tokens")
    shared = found.join(classes.select("c", "n", sketch), "c")
    # The shorter of two sets needs a shorter prefix only.
    inner = F.col("n") - F.ceil(2 * percent * F.col("n") / F.lit(100 + percent)) + 1
    shared = shared.withColumn("rest", F.col("n") - F.col("at")).withColumn("inner", F.col("at") < inner).drop("at")
    shared = materialize(shared, "shared")
    release(found)
    lists = shared.groupBy("token").agg(F.min(F.struct((F.col("n") - F.col("rest")).alias("at"), "n", "c", "rest", "sketch")).alias("head"))

    # Step 2: groups around one class of every token, the one with the fewest rarer tokens of its
    # own: in a family of near copies that is the one that differs least from the others.
    head = F.col("head")
    near = shared.join(lists, "token").where(
        (F.col("c") != head["c"])
        & (100 * F.least(head["n"], F.col("n")) >= percent * F.greatest(head["n"], F.col("n")))
        & (F.least("rest", head["rest"]) >= _needed(percent, F.col("n"), head["n"]))
        & _possible("n", "sketch", "head.n", "head.sketch", percent)
    ).select(head["c"].alias("x"), F.col("c").alias("y"))
    first = _verified(near.distinct(), given, rows, classes, percent)
    with scratch(rows.sparkSession):
        groups = components(first).withColumnRenamed("node", "c")
        members = shared.join(groups, "c", "left").withColumn("root", F.coalesce("root", "c"))
        members = materialize(members, "members", lasting=True)
    release(shared)

    # Step 3: the matrix of tokens and groups.
    matrix = members.groupBy("token", "root").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.max("rest").alias("rest")
    )
    one, other = (
        matrix.select("token", *[F.col(c).alias(f"{c}_{side}") for c in ("root", "low", "high", "rest")])
        for side in ("a", "b")
    )
    bound = F.least("rest_a", "rest_b") >= _needed(percent, F.col("low_a"), F.col("low_b"))
    sizes = (100 * F.col("high_a") >= percent * F.col("low_b")) & (100 * F.col("high_b") >= percent * F.col("low_a"))
    meeting = one.join(other, (one["token"] == other["token"]) & (F.col("root_a") < F.col("root_b")) & sizes & bound)
    meeting = meeting.select(one["token"].alias("token"), "root_a", "root_b")

    # Step 4: members of groups that qualify.
    def side(name: str) -> DataFrame:
        return members.select(
            "token", *[F.col(c).alias(f"{c}_{name}") for c in ("root", "c", "n", "rest", "inner", "sketch")]
        )

    shorter_a = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("c_a") < F.col("c_b")))
    fits = (
        F.when(shorter_a, F.col("inner_a")).otherwise(F.col("inner_b"))
        & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        & (F.least("rest_a", "rest_b") >= _needed(percent, F.col("n_a"), F.col("n_b")))
        & _possible("n_a", "sketch_a", "n_b", "sketch_b", percent)
    )
    opened, right = meeting.join(side("a"), ["token", "root_a"]), side("b")
    own = (opened["token"] == right["token"]) & (opened["root_b"] == right["root_b"])
    pairs = opened.join(right, own & fits).select(F.least("c_a", "c_b").alias("x"), F.greatest("c_a", "c_b").alias("y")).distinct()
    second = _verified(pairs, given, rows, classes, percent)
    release(members)
    return first.unionByName(second)


def _folded(bitmap: str, other: str) -> Column:
    """A bitmap, folded to the size of the other one if it is larger.

    Sets that are similar enough differ by less than a factor of two for all
    similarities above one half; further folds are made for others.
    """
    size = F.size(other)
    places = F.sequence(F.lit(0), F.greatest((F.size(bitmap) / size).cast("int") - 1, F.lit(0)))
    part = lambda k: F.slice(bitmap, k * size + 1, size)
    added = F.reduce(
        F.slice(places, 2, F.size(places)), part(F.lit(0)), lambda a, k: F.zip_with(a, part(k), lambda x, y: x.bitwiseXOR(y))
    )
    return F.when(F.size(bitmap) > size, added).otherwise(F.col(bitmap))


def _verified(pairs: DataFrame, given: _Documents, rows: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs of classes whose whole sets are similar enough; written."""
    def sketch(name: str) -> DataFrame:
        return classes.select(F.col("c").alias(name), F.col("n").alias(f"n_{name}"), F.col("bitmap").alias(f"bitmap_{name}"))

    both = pairs.join(sketch("x"), "x").join(sketch("y"), "y")
    one, other = _folded("bitmap_x", "bitmap_y"), _folded("bitmap_y", "bitmap_x")
    apart = F.reduce(F.zip_with(one, other, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, k: n + k)
    # Every bit that differs stands for a token that only one of the sets has.
    possible = F.floor((F.col("n_x") + F.col("n_y") - apart) / 2) >= _needed(percent, F.col("n_x"), F.col("n_y"))
    pairs = materialize(both.where(possible).select("x", "y"), "pairs")
    asked = pairs.select(F.explode(F.array("x", "y")).alias("_row")).distinct()
    asked = materialize(asked.join(rows.select("_row", "_id", "_key"), "_row"), "asked")
    wanted = asked.select(F.col("_row").alias("c"), F.col("_id").alias("i"), F.col("_key").alias("k"))
    wanted = F.broadcast(wanted) if asked.count() <= BROADCAST_ROWS // 4 else wanted
    own = given.texts["_id"].eqNullSafe(wanted["i"]) & (given.texts["_key"] == wanted["k"])
    texts = given.texts.join(wanted, own).select("c", "_text")
    n = given.n

    def load(batches):
        for values in slices(batches):
            tokens = [t.astype("<u8").tobytes() for t in _sets(values["_text"], n)]
            yield _batch(list(zip(values["c"], tokens)), ["_row", "set"], [pa.int64(), pa.binary()])

    loaded = materialize(texts.mapInArrow(load, "_row long, set binary"), "loaded")
    whole = loaded
    if loaded.count() > asked.count():
        # Rows of equal id and text have one set.
        whole = materialize(loaded.groupBy("_row").agg(F.first("set").alias("set")), "compared")

    def compare(batches):
        for values in slices(batches):
            out = []
            for x, y, one, other in zip(*(values[c] for c in ("x", "y", "set_x", "set_y"))):
                a, b = np.frombuffer(one, dtype="<u8"), np.frombuffer(other, dtype="<u8")
                common = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * common >= percent * (len(a) + len(b) - common):
                    out.append((x, y))
            yield _batch(out, ["x", "y"], [pa.int64(), pa.int64()])

    both = pairs.join(whole.select(F.col("_row").alias("x"), F.col("set").alias("set_x")), "x").join(
        whole.select(F.col("_row").alias("y"), F.col("set").alias("set_y")), "y"
    )
    links = materialize(both.select("x", "y", "set_x", "set_y").mapInArrow(compare, "x long, y long"), "links")
    release(pairs, asked, loaded, whole)
    return links


def without_similar(
    docs: DataFrame, n: int = 5, percent: int = 80, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row of every component of similar rows, the one of the smallest id, with all its columns.

    Rows that are linked with nothing stay, null and wordless texts among them.  Of
    repeated rows one stays, as far as they have words.
    """
    found = materialize(_grouped(docs, n, percent, id_column, text), "groups")
    # Rows of equal id and text are told apart by nothing: all go, or one of them stays.
    equal = found.where("n > 0").groupBy("_id", "_key").agg(
        F.max("first").alias("stays"), (F.count(F.lit(1)) > 1).alias("repeated")
    )
    names = {c: f"_{k}" for k, c in enumerate(docs.columns)}
    rows = docs.select(
        *[F.col(f"`{c}`").alias(name) for c, name in names.items()],
        F.col(f"`{id_column}`").alias("_id"),
        text_key(text).alias("_key"),
    )
    judged = materialize(equal.where("not stays or repeated"), "judged")

    def among(keys: DataFrame, how: str, rows: DataFrame) -> DataFrame:
        keys = keys.select(F.col("_id").alias("i"), F.col("_key").alias("k"))
        keys = F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
        return rows.join(keys, rows["_id"].eqNullSafe(keys["i"]) & (rows["_key"] == keys["k"]), how)

    kept = among(judged, "left_anti", rows)
    repeated = judged.where("stays")
    if not repeated.isEmpty():
        kept = kept.unionByName(among(repeated, "left_semi", rows).dropDuplicates(["_id", "_key"]))
    return kept.select(*[F.col(name).alias(c) for c, name in names.items()])
