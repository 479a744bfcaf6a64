"""Near-duplicate vectors by a forest of random-projection trees.

A node of a tree splits its vectors by the projection on a random direction; vectors near the threshold go to both
sides (spill). The upper nodes take the median of a bounded sample as threshold, deeper ones the sample's overall
median, so that a tree can be as deep as the table asks for while its description stays small. Every vector goes to a
few leaves of every tree. Inside a leaf all vectors are compared in double precision, so no link below the threshold
is reported; a link is missed only if every tree separates its ends.

Equal vectors are compared once: a node is a distinct direction-and-length with its number of rows. Leaves of more
than ``block`` nodes are cut into blocks, and every pair of blocks is a task of its own, so no group is held whole.
Only counts and a spanning forest leave a task, never all pairs. A pair that shares several leaves counts in the first
one only: nodes carry the list of their leaves.

Only vectors of equal length can link, so every length that occurs has leaves of its own, and a forest fitted on its
own part of the sample if it has more rows than a leaf; the vectors of a rarer length are one leaf.

Vectors that are null, zero or hold null or non-finite components link with nothing. Rows with a null id are dropped, as
nothing could name them. Rows that repeat an id count as one vector each, whether their vectors are equal or not, and
get links and component of their own vector; the id appears once for every such row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellarline.llm.common import map_batches, stored
from cellarline.llm.graph import components

#: Expected number of sampled vectors that the thresholds are fitted on.
SAMPLE_ROWS = 20_000
#: Expected number of them, at least, of each length that needs a forest.
LENGTH_ROWS = 1_000
DIRECTIONS = 256


@dataclass(frozen=True)
class Forest:
    directions: np.ndarray  # size x DIRECTIONS
    medians: np.ndarray
    thresholds: tuple[dict[int, float], ...]  # per tree: node -> threshold where the sample gave one
    depth: int
    spill: float


def _direction(tree: int, node: np.ndarray | int) -> np.ndarray | int:
    """Which direction a node splits by; nodes are numbered as in a heap, from 1."""
    return (node * 2_654_435_761 + tree * 40_503 + (node >> 7) * 97) % DIRECTIONS


def fit_forest(sample: np.ndarray, trees: int, depth: int, spill: float, seed: int, least: int = 32) -> Forest:
    """Thresholds of the upper nodes from unit vectors."""
    directions = np.random.default_rng(seed).normal(size=(sample.shape[1], DIRECTIONS))
    directions /= np.linalg.norm(directions, axis=0)
    projected = sample @ directions
    medians = np.median(projected, axis=0) if len(sample) else np.zeros(DIRECTIONS)
    found = []
    for tree in range(trees):
        thresholds: dict[int, float] = {}
        open_nodes = [(1, np.arange(len(sample)))]
        for _ in range(depth):
            below = []
            for node, rows in open_nodes:
                if len(rows) < least:
                    continue
                values = projected[rows, _direction(tree, node)]
                thresholds[node] = cut = float(np.median(values))
                below += [(2 * node, rows[values <= cut]), (2 * node + 1, rows[values > cut])]
            open_nodes = below
        found.append(thresholds)
    return Forest(directions, medians, tuple(found), depth, spill)


def leaves_of(forest: Forest, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) pairs, sorted by row; a leaf is tree << 40 | node."""
    projected = unit @ forest.directions
    rows_out, leaves_out = [], []
    for tree, thresholds in enumerate(forest.thresholds):
        rows, nodes = np.arange(len(unit)), np.ones(len(unit), np.int64)
        for _ in range(forest.depth):
            which = _direction(tree, nodes)
            different, back = np.unique(nodes, return_inverse=True)
            given = np.array([thresholds.get(n, np.nan) for n in different.tolist()])[back]
            cut = np.where(np.isnan(given), forest.medians[which], given)
            value = projected[rows, which]
            low, high = value <= cut + forest.spill, value > cut - forest.spill
            rows = np.concatenate([rows[low], rows[high]])
            nodes = np.concatenate([2 * nodes[low], 2 * nodes[high] + 1])
        rows_out.append(rows)
        leaves_out.append(nodes | (tree << 40))
    rows, leaves = np.concatenate(rows_out), np.concatenate(leaves_out)
    order = np.lexsort((leaves, rows))
    return rows[order], leaves[order]


def unit_vectors(values: pa.Array, size: int) -> np.ndarray:
    """Doubles of unit length; the arrays must be clean and of one size."""
    x = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), size)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def compare(
    a: np.ndarray, b: np.ndarray | None, threshold: float, leaf: int, leaves_a: list, leaves_b: list | None
) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) with cosine >= ``threshold`` whose first common leaf is ``leaf``; without ``b`` all i < j of ``a``."""
    other = a if b is None else b
    found_i, found_j = [], []
    for start in range(0, len(a), 512):
        hit = a[start : start + 512] @ other.T >= threshold
        if b is None:
            hit &= np.arange(len(other))[None, :] > np.arange(start, start + len(hit))[:, None]
        i, j = np.nonzero(hit)
        found_i.append(i + start)
        found_j.append(j)
    i, j = np.concatenate(found_i), np.concatenate(found_j)
    # Only leaves that sort before this one can have claimed the pair.
    known: dict[int, int] = {}
    for one in leaves_a if leaves_b is None else [*leaves_a, *leaves_b]:
        for x in one:
            if x < leaf:
                known.setdefault(x, len(known))
    left = leaf_bits(leaves_a, known)
    right = left if leaves_b is None else leaf_bits(leaves_b, known)
    fresh = np.ones(len(i), bool)
    for word in range(left.shape[1]):
        fresh &= left[i, word] & right[j, word] == 0
    return i[fresh], j[fresh]


def leaf_bits(lists: list[list[int]], known: dict[int, int]) -> np.ndarray:
    """A row of bits for each list: which of the ``known`` leaves it has."""
    bits = np.zeros((len(lists), len(known) + 63 >> 6), np.uint64)
    for k, one in enumerate(lists):
        for x in one:
            if (at := known.get(x)) is not None:
                bits[k, at >> 6] |= np.uint64(1 << (at & 63))
    return bits


def spanning(i: np.ndarray, j: np.ndarray) -> list[int]:
    """Places of pairs that form a spanning forest."""
    parent: dict[int, int] = {}
    kept = []

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        a, b = root(a), root(b)
        if a != b:
            parent[b] = a
            kept.append(k)
    return kept


def near_vectors(
    vectors: DataFrame,
    *,
    threshold: float = 0.95,
    trees: int = 8,
    leaf_rows: int = 256,
    spill: float = 0.03,
    block: int = 2048,
    sample_rows: int = SAMPLE_ROWS,
    seed: int = 7,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``id``, ``n_links``, ``component`` of each row of ``vectors`` with an id."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    rows = rows.where("id IS NOT NULL")
    fine = "v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf')) AND exists(v, x -> x <> 0)"
    # One node for each different vector (0.0 and -0.0 are one), with a number of its own: an id can have several.
    clean = rows.where(fine).select("id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))
    nodes = clean.groupBy("v").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    total = nodes.count()
    if total == 0:
        return rows.select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component"))
    # There are at most total / leaf_rows lengths of more rows than a leaf.
    lengths = nodes.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("rows")).where(F.col("rows") > leaf_rows)
    large = {row["size"]: row["rows"] for row in lengths.collect()}
    forests = {}
    if large:
        every = [(size, max(1, min(total // sample_rows, count // LENGTH_ROWS))) for size, count in large.items()]
        taken = nodes.join(spark.createDataFrame(every, "size int, every bigint"), F.size("v") == F.col("size"))
        taken = taken.where(F.pmod(F.xxhash64("v"), F.col("every")) == 0)
        sampled = taken.select("size", "first", F.xxhash64("v").alias("h"), "v").toPandas().sort_values(["first", "h"])
        for size, count in large.items():
            same = sampled.loc[sampled["size"] == size, "v"].tolist()
            unit = unit_vectors(pa.array(same, pa.list_(pa.float64())), size)
            forests[size] = fit_forest(unit, trees, int(np.ceil(np.log2(count / leaf_rows))), spill, seed)
    shared = spark.sparkContext.broadcast(forests)

    def to_leaves(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, parts = batch.column("size").to_numpy(), []
        for size in np.unique(sizes).tolist():
            part = batch.filter(pa.array(sizes == size))
            if size in shared.value:
                at, leaves = leaves_of(shared.value[size], unit_vectors(part.column("v"), size))
            else:
                at = np.arange(part.num_rows)
                leaves = np.ones(part.num_rows, np.int64)
            ends = np.searchsorted(at, np.arange(part.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(leaves))
            parts.append(pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "leaves"]))
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    placed = map_batches(
        nodes.select(F.size("v").alias("size"), "node", "n", "v"),
        to_leaves,
        "size int, node bigint, n bigint, v array<double>, leaves array<bigint>",
    )
    placed = stored(placed, "leaves")
    # Leaves that are too large for one task; there are at most total x leaves per vector / block of them.
    counts = placed.select("size", F.explode("leaves").alias("leaf")).groupBy("size", "leaf").agg(F.count("*").alias("rows"))
    blocks = stored(counts.select("size", "leaf", F.ceil(F.col("rows") / block).cast("int").alias("blocks")).where("blocks > 1"), "large")
    dealt = placed.select("size", "node", "n", "v", "leaves", F.explode("leaves").alias("leaf")).join(blocks, ["size", "leaf"], "left")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    # The block meets itself and every other one: pair (p, q) with p <= q is one task's work.
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda k: F.struct(F.least(k, mine).alias("p"), F.greatest(k, mine).alias("q")),
    )
    one = F.array(F.struct(F.lit(0).alias("p"), F.lit(0).alias("q")))
    dealt = dealt.withColumn("pair", F.explode(F.when(F.col("blocks").isNull(), one).otherwise(pairs)))
    dealt = dealt.withColumn("side", F.when(F.col("blocks").isNull(), 0).otherwise(mine))

    def link(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, leaf, p, q = (k.as_py() for k in key)
        table = pa.Table.from_batches(list(batches)).combine_chunks().sort_by("node")
        if len(table) < 2:
            return
        x = unit_vectors(table["v"].combine_chunks(), size)
        names, n = table["node"].to_numpy(), table["n"].to_numpy()
        lists, side = table["leaves"].to_pylist(), table["side"].to_numpy()
        if p == q:
            i, j = compare(x, None, threshold, leaf, lists, None)
        else:
            left, right = np.flatnonzero(side == p), np.flatnonzero(side == q)
            i, j = compare(x[left], x[right], threshold, leaf, [lists[k] for k in left], [lists[k] for k in right])
            i, j = left[i], right[j]
        if not len(i):
            return
        links = np.bincount(i, n[j], len(x)) + np.bincount(j, n[i], len(x))
        tree = spanning(i, j)
        used = np.flatnonzero(links)
        node = np.concatenate([names[used], names[i[tree]]])
        to = np.concatenate([names[used], names[j[tree]]])
        count = np.concatenate([links[used].astype(np.int64), np.zeros(len(tree), np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(to), pa.array(count)], ["a", "b", "links"])

    packed = dealt.select("size", "leaf", "pair.p", "pair.q", "node", "n", "v", "leaves", "side")
    found = packed.groupBy("size", "leaf", "p", "q").applyInArrow(link, "a bigint, b bigint, links bigint")
    found = stored(found, "links")
    links = found.groupBy("a").agg(F.sum("links").alias("links"))
    reached = components(found.select("a", "b"))
    named = nodes.join(links, nodes["node"] == links["a"], "left").join(reached, nodes["node"] == reached["id"], "left")
    named = named.select(
        "v", "first", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("class")
    )
    named = stored(named, "vector-classes")
    smallest = named.groupBy("class").agg(F.min("first").alias("component"))
    named = named.join(smallest, "class").select(F.col("v").alias("_v"), "n_links", "component")
    keyed = rows.withColumn("k", F.when(F.expr(fine), F.transform("v", lambda x: x + F.lit(0.0))))
    joined = keyed.join(named, F.col("k") == F.col("_v"), "left")
    return joined.select(
        "id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "id").alias("component")
    )


def embedding_links(vectors: DataFrame) -> DataFrame:
    found = near_vectors(vectors)
    return found.select(
        F.col("id").alias("vec_id"),
        "n_links",
        F.col("component").alias("component_id"),
        (F.col("id") == F.col("component")).alias("kept"),
    )


#: Every pair by brute force, then the smallest id reachable.
SQL = """
WITH RECURSIVE clean AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM clean a JOIN clean b ON a.vec_id <> b.vec_id
  WHERE len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), classes AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), counted AS (
  SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN classes USING (vec_id) LEFT JOIN counted USING (vec_id)
"""
