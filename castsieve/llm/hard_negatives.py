"""Hard negatives of anchors by exact search in cover trees.

All rows are dealt to trees of about ``TREE_ROWS`` rows: pivots, chosen far apart in
a bounded sample, draw near rows together, and a pivot with more rows than a tree
holds has several trees.  Pivots only help the bounds; results are exact whatever
they are.  Anchors are dealt to turns of about ``TURN_ROWS``; every turn meets every
tree, one pair per group, so no task holds more than one tree and one turn.

First the positives of every anchor are found: each tree gives its best rows, the
best of all trees are kept.  Their scores open one window per positive, and the
trees are searched again for the best rows of other labels within the windows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import materialize, release
from .common import importable_on_executors
from .cover_tree import CoverTree
from .vector_codes import is_finite, matrix

# Rows per tree and anchors per turn, about.
TREE_ROWS = 2048
TURN_ROWS = 4096
# Rows that pivots are chosen from, and how many pivots there are at most.
SAMPLE = 2048
PIVOTS = 256


def hard_negatives(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    every: int = 50,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: int = 256,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    A score is the inner product of vectors with components floor(scale * x); higher
    scores come first, then smaller ids, null ids last.  Anchors are the rows whose
    id is divisible by ``every``.  An anchor's positives are its first rows of the
    same label; a positive's negatives are the first rows of other labels whose
    score lies within ``low`` to ``high`` hundredths of the positive's, so a
    negative positive score has none.  Where there are fewer rows, there are fewer
    results; a positive without negatives has no row.

    Rows without label, with a null vector or with a null or non-finite component
    take no part.  Rows are told apart by their place: a repeated row is another row
    and, if its id is divisible, another anchor.  Labels are equal if they are equal
    as strings.  Ids are integral, null ids no anchors.  Vectors need one length and,
    times ``scale``, components whose squares add up to 2^50 at most, else it is a
    ValueError.  Other columns are ignored, whatever their names.  An empty table
    gives an empty result.
    """
    importable_on_executors(vectors.sparkSession)
    rows, trees, count = _trees(vectors, id_column, vector, label, scale)
    result_schema = (
        "anchor long, anchor_id long, positive_id long, positive_row long, positive_score long, "
        "negative_id long, negative_row long, negative_score long"
    )
    anchors = rows.where(F.col("id") % every == 0).select("row", "id", "label", "q")
    turns = max(1, math.ceil(anchors.count() / TURN_ROWS))
    anchors = anchors.withColumn("turn", F.pmod(F.xxhash64("row"), F.lit(turns)).cast("int"))
    every_turn = trees.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))

    def meet(asked: DataFrame, find, schema: str) -> DataFrame:
        asked = asked.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
        left, right = (df.groupBy("tree", "turn") for df in (every_turn, asked))
        return left.cogroup(right).applyInArrow(find, schema)

    def first(found: DataFrame, number: int, by: list[str], score: str, other: str, row: str) -> DataFrame:
        order = [F.col(score).desc(), F.col(other).asc_nulls_last(), F.col(row)]
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
        return ranked.where(F.col("rank") <= number)

    def find_positives(tree: pa.Table, asked: pa.Table) -> pa.Table:
        schema = pa.schema([(c, pa.int64()) for c in ("anchor", "positive_id", "positive_row", "positive_score")])
        if not tree.num_rows or not asked.num_rows:
            return schema.empty_table()
        everything = np.full((asked.num_rows, 1), np.inf)
        held = _Held(tree, asked)
        found, score = held.search(-everything, everything, True, positives)
        a, _, k = np.nonzero(found >= 0)
        row = found[a, 0, k]
        columns = [asked["row"].take(pa.array(a)), held.ids.take(pa.array(row)), held.rows[row], score[a, 0, k]]
        return pa.Table.from_arrays([_whole(c) for c in columns], schema=schema)

    def find_negatives(tree: pa.Table, asked: pa.Table) -> pa.Table:
        schema = pa.schema([(part.split()[0], pa.int64()) for part in result_schema.split(", ")])
        if not tree.num_rows or not asked.num_rows:
            return schema.empty_table()
        scores = np.full((asked.num_rows, positives), -1)
        for i, own in enumerate(asked["positives"].to_pylist()):
            scores[i, : len(own)] = [p["positive_score"] for p in own]
        least, most = -(-low * scores // 100), high * scores // 100
        held = _Held(tree, asked)
        found, score = held.search(np.where(scores < 0, 1, least), np.where(scores < 0, 0, most), False, negatives)
        a, w, k = np.nonzero(found >= 0)
        row = found[a, w, k]
        chosen = asked["positives"].combine_chunks()
        at = pa.array(chosen.offsets.to_numpy()[a] + w)
        fields = {f.name: chosen.values.field(f.name).take(at) for f in chosen.type.value_type}
        columns = [asked["row"].take(pa.array(a)), asked["id"].take(pa.array(a))]
        columns += [fields[c] for c in ("positive_id", "positive_row", "positive_score")]
        columns += [held.ids.take(pa.array(row)), held.rows[row], score[a, w, k]]
        return pa.Table.from_arrays([_whole(c) for c in columns], schema=schema)

    found = meet(anchors, find_positives, "anchor long, positive_id long, positive_row long, positive_score long")
    best = first(found, positives, ["anchor"], "positive_score", "positive_id", "positive_row")
    listed = F.sort_array(F.collect_list(F.struct("rank", "positive_id", "positive_row", "positive_score")))
    best = materialize(best.groupBy(F.col("anchor").alias("row")).agg(listed.alias("positives")), "positives")
    found = meet(anchors.join(best, "row"), find_negatives, result_schema)
    by = ["anchor", "positive_row"]
    result = first(found, negatives, by, "negative_score", "negative_id", "negative_row").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
    result = materialize(result, "negatives")
    release(rows, trees, best)
    return result


class _Held:
    """One tree and the anchors of one turn, as arrays."""

    def __init__(self, tree: pa.Table, asked: pa.Table):
        one = tree.slice(0, 1)
        self.tree = CoverTree.read(one["tree_data"][0].as_py())
        self.rows, self.ids = (one[c].combine_chunks().flatten() for c in ("rows", "ids"))
        self.rows = self.rows.to_numpy()
        own = asked["label"].combine_chunks()
        both = pa.concat_arrays([one["labels"].combine_chunks().flatten(), own])
        codes = both.dictionary_encode().indices.to_numpy().astype(np.int64)
        self.labels, self.own = codes[: len(self.rows)], codes[len(self.rows) :]
        self.queries = matrix(asked["q"].combine_chunks(), 1)
        place = {row: k for k, row in enumerate(self.rows.tolist())}
        self.self_row = np.array([place.get(r, -1) for r in asked["row"].to_pylist()])

    def search(self, low, high, same_label: bool, k: int):
        return self.tree.search(self.queries, low, high, self.labels, self.own, same_label, self.self_row, k)


def _whole(column) -> pa.Array:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column if isinstance(column, pa.Array) else pa.array(column, pa.int64())


def _trees(vectors: DataFrame, id_column: str, vector: str, label: str, scale: int) -> tuple[DataFrame, DataFrame, int]:
    """The rows that take part, written; their trees, written; the number of trees."""
    spark = vectors.sparkSession
    rows = vectors.where(F.col(f"`{label}`").isNotNull() & is_finite(f"`{vector}`")).select(
        F.monotonically_increasing_id().alias("row"),
        F.col(f"`{id_column}`").cast("long").alias("id"),
        F.col(f"`{label}`").cast("string").alias("label"),
        F.col(f"`{vector}`").cast("array<double>").alias("vector"),
    )

    def whole_numbers(batches):
        for batch in batches:
            values = matrix(batch.column(3), scale) if len(set(batch.column(3).value_lengths().to_pylist())) < 2 else None
            if values is None or values.size and (values**2).sum(1).max() > 1 << 50:
                raise ValueError("vectors need one length and components within the documented bound")
            ends = np.arange(len(values) + 1, dtype=np.int32) * (values.shape[1] if len(values) else 0)
            q = pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], q], names=["row", "id", "label", "q"])

    rows = materialize(rows.mapInArrow(whole_numbers, "row long, id long, label string, q array<int>"), "vectors")
    n, shortest, longest = rows.agg(F.count("row"), F.min(F.size("q")), F.max(F.size("q"))).first()
    if shortest != longest:
        raise ValueError(f"vectors need one length: found {shortest} to {longest}")
    sample = rows.orderBy(F.xxhash64("id", "q"), "row").limit(SAMPLE).select("q").collect()
    pivots = _far_apart(np.array([r.q for r in sample], dtype=np.float64), min(PIVOTS, -(-n // (2 * TREE_ROWS))))

    def nearest(batches):
        for batch in batches:
            q = matrix(batch.column(3), 1)
            pivot = ((pivots**2).sum(1) / 2 - q @ pivots.T).argmin(1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot)], names=[*batch.schema.names, "pivot"])

    dealt = rows.mapInArrow(nearest, "row long, id long, label string, q array<int>, pivot int")
    sizes = {r.pivot: r["count"] for r in dealt.groupBy("pivot").count().collect()}
    parts = [-(-sizes.get(p, 0) // TREE_ROWS) for p in range(len(pivots))]
    before = np.cumsum([0, *parts]).tolist()
    # At most PIVOTS numbers each.
    table = [F.array(*[F.lit(int(x)) for x in numbers])[F.col("pivot")] for numbers in (before or [0], parts or [1])]
    dealt = dealt.withColumn("tree", table[0] + F.pmod(F.xxhash64("row"), F.greatest(table[1], F.lit(1))).cast("int"))

    def build(own: pa.Table) -> pa.Table:
        own = own.sort_by([("id", "ascending"), ("row", "ascending")])
        data = CoverTree.build(matrix(own["q"].combine_chunks(), 1)).written()
        columns = [pa.array([own["tree"][0].as_py()], pa.int32())]
        columns += [pa.array([own[c].to_pylist()], kind) for c, kind in _TREE_COLUMNS]
        return pa.Table.from_arrays([*columns, pa.array([data], pa.binary())], names=["tree", "rows", "ids", "labels", "tree_data"])

    schema = "tree int, rows array<long>, ids array<long>, labels array<string>, tree_data binary"
    trees = materialize(dealt.drop("pivot").groupBy("tree").applyInArrow(build, schema), "trees")
    return rows, trees, max(1, before[-1])


_TREE_COLUMNS = [("row", pa.list_(pa.int64())), ("id", pa.list_(pa.int64())), ("label", pa.list_(pa.string()))]


def _far_apart(sample: np.ndarray, number: int) -> np.ndarray:
    """Rows of the sample, each as far as can be from those before it."""
    chosen = [0] if len(sample) else []
    far = ((sample - sample[:1]) ** 2).sum(1) if len(sample) else np.zeros(0)
    while chosen and len(chosen) < number and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def comparison_sql() -> str:
    """The same with every anchor compared with every row; vectors have different ids."""
    return """
with v as (
    select vec_id, if(vec_id % 7 = 0, (label + 1) % 10, label) as label,
           [floor(256 * cast(x as double)) for x in embedding] as q
    from embeddings
    where label is not null and embedding is not null
      and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as materialized (
    select a.vec_id as anchor_id, v.vec_id, a.label = v.label as same,
           cast(list_inner_product(a.q, v.q) as bigint) as score
    from v as a, v where a.vec_id % 50 = 0 and a.vec_id <> v.vec_id),
p as (
    select anchor_id, vec_id as positive_id, score as positive_score from s where same
    qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, positive_score, vec_id as negative_id, score as negative_score,
       cast(row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as integer) as rank
from p join s using (anchor_id)
where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) <= 3
"""
