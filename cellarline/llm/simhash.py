"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within distance r have a common variant within r/2 of both. A ball of radius 2 around 64 bits has
2,081 variants, so the fingerprint is first cut into blocks: of two halves, one differs in at most r/2 bits, and the
ball is drawn around that half (2 x 33 variants for r = 4). Every distinct fingerprint emits the variants of each block, they are
shuffled on the variant, and fingerprints that meet are verified over all bits. No link is lost for any ``blocks``.

Null and empty texts, and texts of blanks, have fingerprint zero and link like any other. Copies share a fingerprint
and are one node. Documents with a null id are left out of links and form a component of their own (null). Fingerprints are
linked, not ids: rows that repeat an id with different texts each belong to the group of their own text, and two groups
do not become one because an id is in both.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellarline.llm.common import doc_texts, map_batches, stored
from cellarline.llm.graph import components, forest

BITS = 64
SEED = 42


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """A hash of every run of ``shingle`` words; a shorter text is one shingle, a blank one has none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: str | None, shingle: int) -> int:
    return majority(shingle_hashes(text, shingle))


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    if not len(hashes):
        return 0
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``fp`` (the 64 bits as a long) of each row."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found.view(np.int64))], ["id", "fp"])

    texts = doc_texts(docs, id_col, text_col)
    return map_batches(texts, step, f"id {texts.schema['id'].dataType.simpleString()}, fp bigint")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of longs; counted unsigned, as numpy counts the bits of a negative number's absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def ball(width: int, reach: int) -> list[int]:
    """Masks of up to ``reach`` flipped bits, as signed longs."""
    masks = [sum(1 << k for k in bits) for n in range(reach + 1) for bits in combinations(range(width), n)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def layout(radius: int, blocks: int) -> tuple[int, list[tuple[int, int]]]:
    """Radius of the ball around a block, and the bits (first, end) of each block."""
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    return -(-(radius // blocks) // 2), list(zip(edges, edges[1:], strict=False))


def variants(found: DataFrame, radius: int, blocks: int, *more: str) -> DataFrame:
    """``block``, ``variant``, ``fp``: the ball around each block of each fingerprint; ``more`` columns come along."""
    (reach, bits), out = layout(radius, blocks), None
    for block, (low, high) in enumerate(bits):
        part = F.shiftrightunsigned("fp", low)
        if high - low < BITS:
            part = part.bitwiseAND(F.lit((1 << high - low) - 1))
        masks = F.array(*[F.lit(m).cast("long") for m in ball(high - low, reach)])
        rows = found.select(F.lit(block).alias("block"), part.alias("part"), F.explode(masks).alias("mask"), "fp", *more)
        rows = rows.select("block", F.col("part").bitwiseXOR(F.col("mask")).alias("variant"), "fp", *more)
        out = rows if out is None else out.union(rows)
    return out


def linked(found: DataFrame, radius: int, blocks: int = 2) -> DataFrame:
    """Edges ``a``, ``b`` between the different fingerprints in column ``fp``: a spanning forest of all links.

    The fingerprints of a variant are read in sorted order, a batch at a time. Only those of one variant are in
    memory, eight bytes each, and what a fingerprint reaches leaves the comparison.
    """
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        last = None

        def group(fps: np.ndarray) -> list[tuple[int, int]]:
            near = lambda k, others: distance(fps[others], fps[k]) <= radius
            return [(int(fps[i]), int(fps[j])) for i, j in forest(near, len(fps))]

        def out(edges: list[tuple[int, int]]) -> pa.RecordBatch:
            ends = np.array(edges, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy())], ["a", "b"])

        for batch in batches:
            block, variant, fps = (batch.column(k).to_numpy() for k in range(3))
            if not len(fps):
                continue
            new = np.flatnonzero((np.diff(variant) != 0) | (np.diff(block) != 0)) + 1
            starts = np.concatenate([[0], new, [len(fps)]])
            edges: list[tuple[int, int]] = []
            first = (block[0], variant[0])
            if held and first != last:
                edges += group(np.concatenate(held))
                held = []
            if held and len(starts) > 2:
                edges += group(np.concatenate([*held, fps[: starts[1]]]))
                held, begin = [], 1
            else:
                begin = 0 if len(starts) > 2 else len(starts) - 2
            sizes = np.diff(starts)
            pairs = np.flatnonzero(sizes[begin:-1] == 2) + begin
            i = starts[pairs]
            close = distance(fps[i], fps[i + 1]) <= radius
            edges += zip(fps[i[close]].tolist(), fps[i[close] + 1].tolist(), strict=True)
            for g in np.flatnonzero(sizes[begin:-1] > 2) + begin:
                edges += group(fps[starts[g] : starts[g + 1]])
            held.append(fps[starts[-2] :])
            last = (block[-1], variant[-1])
            if edges:
                yield out(edges)
        if held and (edges := group(np.concatenate(held))):
            yield out(edges)

    dealt = variants(found.select("fp"), radius, blocks).repartition("block", "variant")
    return dealt.sortWithinPartitions("block", "variant").mapInArrow(meet, "a bigint, b bigint").distinct()


def near_duplicates(
    docs: DataFrame,
    *,
    shingle: int = 5,
    radius: int = 4,
    blocks: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id``, ``fp``, ``component`` (smallest id reachable) of each row of ``docs``."""
    found = stored(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    # One node for each fingerprint, named by the fingerprint; copies need no links among themselves.
    nodes = stored(found.where("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("node")), "nodes")
    reached = components(linked(nodes, radius, blocks)).withColumnRenamed("id", "of")
    classed = nodes.join(reached, nodes["fp"] == reached["of"], "left")
    classed = stored(classed.select("fp", "node", F.coalesce("component", "fp").alias("class")), "classes")
    smallest = classed.groupBy("class").agg(F.min("node").alias("component"))
    named = classed.join(smallest, "class").select(F.col("fp").alias("_fp"), "component")
    joined = found.join(named, F.col("fp") == F.col("_fp"), "left")
    return joined.select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))


def shingle_sets(docs: DataFrame, shingle: int, id_col: str, text_col: str, whole: bool) -> DataFrame:
    """``id``, ``key`` (names the set of shingles), ``fp`` and ``n`` of that set; if ``whole``, the ``shingles`` too."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.unique(shingle_hashes(t, shingle)) for t in batch.column("text").to_pylist()]
        keys = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
        fps, n = np.array([majority(s) for s in sets], np.uint64).view(np.int64), np.array([len(s) for s in sets], np.int32)
        columns = {"id": batch.column("id"), "key": pa.array(keys), "fp": pa.array(fps), "n": pa.array(n)}
        if whole:
            ends = np.cumsum([0, *n]).astype(np.int32)
            columns["shingles"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    texts = doc_texts(docs, id_col, text_col)
    schema = f"id {texts.schema['id'].dataType.simpleString()}, key bigint, fp bigint, n int"
    return map_batches(texts, step, schema + ", shingles array<bigint>" * whole)


def candidates(nodes: DataFrame, radius: int, blocks: int, similarity: float) -> DataFrame:
    """Pairs ``a``, ``b`` of keys, each once, of ``nodes`` (``key``, ``fp``, ``n``, ``class``) that are of different
    classes, have fingerprints within ``radius`` and sizes that allow ``similarity``.

    Sets of that similarity differ in size by a factor of at most 1 / ``similarity``, so only nodes of one cell of
    sizes meet; those close below the end of a cell are in the next one too. A pair that meets under several variants
    counts under one of them.
    """
    reach, bits = layout(radius, blocks)
    scale = float(-4 * np.log(similarity)) if similarity < 1 else 1.0
    home = F.floor(F.log("n") / scale).cast("int")
    above = F.floor((F.log("n") - float(np.log(similarity))) / scale + 1e-9).cast("int")
    cells = nodes.where("n > 0").withColumn("cell", F.explode(F.array_distinct(F.array(home, above)))).withColumn("home", F.col("cell") == home)

    def first(block: int, variant: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether no earlier block brings the two together, and of this block's variants the present one is chosen."""
        part = lambda x, k: (x >> np.uint64(bits[k][0])) & np.uint64((1 << bits[k][1] - bits[k][0]) - 1)
        fresh = np.ones(len(a), bool)
        for k in range(block):
            fresh &= np.bitwise_count(part(a ^ b, k)) > 2 * reach
        chosen, differ = np.minimum(part(a, block), part(b, block)), part(a ^ b, block)
        half = np.bitwise_count(differ) // 2
        for step in range(reach):
            lowest = np.where(step < half, differ & (~differ + np.uint64(1)), np.uint64(0))
            chosen, differ = chosen ^ lowest, differ ^ lowest
        return fresh & (chosen.view(np.int64) == variant)

    def group(block: int, variant: int, key: np.ndarray, fp: np.ndarray, n: np.ndarray, of: np.ndarray, own: np.ndarray) -> np.ndarray:
        found, fp = [], fp.view(np.uint64)
        for start in range(0, len(fp), 512):
            i, j = np.nonzero(np.bitwise_count(fp[start : start + 512, None] ^ fp[None, start:]) <= radius)
            i, j = i[i < j] + start, j[i < j] + start
            good = (of[i] != of[j]) & (own[i] | own[j])
            good &= np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-6
            i, j = i[good], j[good]
            good = first(block, variant, fp[i], fp[j])
            found.append(np.column_stack([key[i[good]], key[j[good]]]))
        return np.concatenate(found)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
            block, variant, cell, *rest = (c.to_numpy() for c in table.columns)
            starts = np.flatnonzero(np.r_[True, (np.diff(block) != 0) | (np.diff(variant) != 0) | (np.diff(cell) != 0)])
            ends = np.append(starts[1:], len(block))
            for k in np.flatnonzero(ends - starts > 1).tolist():
                s, e = starts[k], ends[k]
                pairs = group(int(block[s]), int(variant[s]), *(c[s:e] for c in rest))
                if len(pairs):
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

        name = lambda batch, k: [batch.column(c)[k].as_py() for c in range(3)]
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            last = name(batch, batch.num_rows - 1)
            if name(held[0], 0) == last:
                continue
            # Only the last group can go on in the next batch.
            same = np.logical_and.reduce([batch.column(c).to_numpy() == v for c, v in enumerate(last)])
            begin = int(np.argmax(same))
            yield from out(pa.Table.from_batches([*held[:-1], batch.slice(0, begin)]))
            held = [batch.slice(begin)]
        if held:
            yield from out(pa.Table.from_batches(held))

    order = ("block", "variant", "cell")
    dealt = variants(cells, radius, blocks, "cell", "key", "n", "class", "home").select(*order, "key", "fp", "n", "class", "home")
    return dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(meet, "a bigint, b bigint")


def near_copies(
    docs: DataFrame,
    *,
    shingle: int = 5,
    similarity: float = 0.8,
    radius: int = 14,
    blocks: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id``, ``key``, ``component`` (smallest id reachable) of each row with an id.

    Links are pairs of sets of shingles with a Jaccard similarity of ``similarity``, counted exactly; fingerprints of
    the sets only retrieve them. Close fingerprints are linked and verified first, by a spanning forest, so that a
    group of near copies is one class before all pairs within ``radius`` of different classes are looked at. Null,
    empty and blank texts have the empty set and are copies of one another. Rows that repeat an id each belong to the
    group of their own text.
    """
    found = stored(shingle_sets(docs, shingle, id_col, text_col, False).where("id IS NOT NULL"), "sets")
    nodes = stored(found.groupBy("key").agg(F.min("id").alias("node"), F.first("fp").alias("fp"), F.first("n").alias("n")), "set-nodes")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        pairs = stored(pairs, f"{name}-pairs")
        wanted = stored(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct(), f"{name}-wanted")
        ids = wanted.join(nodes, "key").select(F.col("node").alias("_id")).distinct()
        texts = docs.join(ids, docs[id_col] == ids["_id"], "left_semi")
        whole = shingle_sets(texts, shingle, id_col, text_col, True).select("key", "shingles").join(wanted, "key", "left_semi")
        whole = stored(whole.dropDuplicates(["key"]), f"{name}-shingles")
        one = pairs.join(whole.select(F.col("key").alias("a"), F.col("shingles").alias("sa")), "a")
        both = one.join(whole.select(F.col("key").alias("b"), F.col("shingles").alias("sb")), "b")
        common = F.size(F.array_intersect("sa", "sb"))
        good = common >= F.lit(similarity) * (F.size("sa") + F.size("sb") - common) - 1e-9
        return stored(both.where(good).select("a", "b"), f"{name}-links")

    of = nodes.groupBy("fp").agg(F.min("key").alias("key"))
    edges = linked(of, min(radius, 6), 3)
    left = edges.join(of, edges["a"] == of["fp"]).select(F.col("key").alias("a"), "b")
    close = left.join(of, left["b"] == of["fp"]).select("a", F.col("key").alias("b"))
    close = verified(close, "close")
    reached = components(close)
    classes = nodes.join(reached, nodes["key"] == reached["id"], "left")
    classes = stored(classes.select("key", "fp", "n", F.coalesce("component", "key").alias("class")), "close-classes")
    far = verified(candidates(classes, radius, blocks, similarity), "far")
    named = nodes.join(components(close.union(far)), nodes["key"] == F.col("id"), "left").select(
        "key", "node", F.coalesce("component", "key").alias("class")
    )
    named = stored(named, "set-classes")
    smallest = named.groupBy("class").agg(F.min("node").alias("component"))
    return found.select("id", "key").join(named.join(smallest, "class").select("key", "component"), "key").select("id", "key", "component")


def simhash_digest(docs: DataFrame) -> DataFrame:
    """Fingerprints of 4-word shingles and components of links at 4 or fewer bits."""
    found = near_duplicates(docs, shingle=4, radius=4)
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )
