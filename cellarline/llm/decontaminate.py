"""Benchmark decontamination by spaced-seed hashing.

A document is contaminated by an item if somewhere ``overlap`` consecutive words of both (or all words of a shorter
item) stand side by side with at most a share of 1 - ``similarity`` replaced. Such windows are found by spaced seeds: the positions of a window are dealt into
errors + 2 classes, and every mask looks at two of them and ignores the others, so one of the masks is untouched by any
placement of the allowed errors. Hashes of the masked words of items and documents are joined, and every hit is
verified word by word over the whole window.

The items are taken in blocks of bounded size, each of which is broadcast and met by all documents in a pass; a
benchmark that grows makes more passes, not a larger broadcast. Words are lower-cased and lose punctuation at their
ends. Items of fewer than ``least_words`` words would match by chance and are not looked for. Null and empty texts and
null items match nothing; repeated rows are looked at one by one, and repeated items count as one each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellarline.llm.common import doc_texts, map_batches
from cellarline.llm.wordhash import NormalHasher, joined

OVERLAP = 13
SIMILARITY = 0.8
LEAST_WORDS = 8
#: Characters of benchmark text that are indexed and broadcast at once.
BLOCK_CHARS = 4 << 20


def allowed_errors(width: int, similarity: float) -> int:
    return width - -(-width * round(similarity * 1000) // 1000)


def masks(width: int, errors: int) -> list[list[int]]:
    """Positions each mask looks at. With any ``errors`` positions replaced one mask is left whole."""
    classes = errors + 2
    if errors == 0:
        return [list(range(width))]
    return [[k for k in range(width) if k % classes in pair] for pair in combinations(range(classes), 2)]


def masked(words: np.ndarray, width: int, mask: list[int]) -> np.ndarray:
    """Hash of the words under the mask for every window."""
    n = len(words) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in mask:
        out = (out ^ words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


@dataclass(frozen=True)
class Seeds:
    """Items of one window width: hashes under each mask, sorted, with the word each window begins at."""

    width: int
    errors: int
    words: np.ndarray
    item_of: np.ndarray  # of each word
    tables: tuple[tuple[np.ndarray, np.ndarray, np.ndarray], ...]  # filter, sorted hashes, begins


FILTER_BITS = 20


def place(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def index_items(texts: list[str | None], overlap: int, similarity: float, least_words: int) -> list[Seeds]:
    hasher, by_width = NormalHasher(), {}
    for k, text in enumerate(texts):
        words = hasher(text)
        if len(words) >= least_words:
            by_width.setdefault(min(len(words), overlap), []).append((k, words))
    out = []
    for width, items in sorted(by_width.items()):
        words = np.concatenate([w for _, w in items])
        owner = np.concatenate([np.full(len(w), k) for k, w in items])
        ends = np.cumsum([len(w) for _, w in items])
        last = np.repeat(ends, [len(w) for _, w in items])
        inside = np.flatnonzero(np.arange(len(words)) + width <= last)
        errors, tables = allowed_errors(width, similarity), []
        for mask in masks(width, errors):
            hashes = masked(words, width, mask)[inside]
            order = np.argsort(hashes, kind="stable")
            seen = np.zeros(1 << FILTER_BITS, bool)
            seen[place(hashes)] = True
            tables.append((seen, hashes[order], inside[order]))
        out.append(Seeds(width, errors, words, owner, tuple(tables)))
    return out


def overlaps(words: np.ndarray, ends: np.ndarray, starts: np.ndarray, seeds: Seeds) -> np.ndarray:
    """Rows (text, item, begin of the window in the joined words) of verified windows."""
    found = []
    steps = np.arange(seeds.width)
    for mask, (seen, hashes, begins) in zip(masks(seeds.width, seeds.errors), seeds.tables, strict=True):
        ours = masked(words, seeds.width, mask)
        at = np.flatnonzero(seen[place(ours)])
        low, high = np.searchsorted(hashes, ours[at], "left"), np.searchsorted(hashes, ours[at], "right")
        at, low, n = at[high > low], low[high > low], (high - low)[high > low]
        # A frequent seed can meet many places of the benchmark: the hits are verified some at a time.
        for part in range(0, len(at), 4096):
            a, lo, count = at[part : part + 4096], low[part : part + 4096], n[part : part + 4096]
            for many in np.split(np.arange(len(a)), np.flatnonzero(np.diff(np.cumsum(count) >> 20)) + 1):
                where = np.repeat(a[many], count[many])
                step = np.arange(len(where)) - np.repeat(np.cumsum(count[many]) - count[many], count[many])
                theirs = begins[np.repeat(lo[many], count[many]) + step]
                same = (words[where[:, None] + steps] == seeds.words[theirs[:, None] + steps]).sum(axis=1)
                good = same >= seeds.width - seeds.errors
                where, theirs = where[good], theirs[good]
                text = np.searchsorted(starts, where, "right") - 1
                inside = where + seeds.width <= ends[text]
                found.append(np.column_stack([text, seeds.item_of[theirs], where])[inside])
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)


def batch_overlaps(texts: list[str | None], index: list[Seeds]) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, first word, end) of every stretch of verified windows."""
    for first, words, starts, ends in joined(texts, OVERLAP):
        for seeds in index:
            if len(words) < seeds.width:
                continue
            last = None
            for text, item, begin in overlaps(words, ends, starts, seeds).tolist():
                begin -= int(starts[text])
                if last and last[0] == text + first and last[1] == item and begin <= last[3]:
                    last[3] = begin + seeds.width
                    continue
                if last:
                    yield tuple(last)
                last = [text + first, item, begin, begin + seeds.width]
            if last:
                yield tuple(last)


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_chars: int) -> Iterator[tuple[list, list]]:
    """(ids, texts) of the items, a bounded block after the other."""
    items = benchmark.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{text_col}`").alias("text")).where("text IS NOT NULL")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-size // block_chars)
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).collect()
        yield [row["item"] for row in rows], [row["text"] for row in rows]


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    overlap: int = OVERLAP,
    similarity: float = SIMILARITY,
    least_words: int = LEAST_WORDS,
    block_chars: int = BLOCK_CHARS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``id``, ``item``, ``start``, ``end``: stretches of a document's words that overlap with an item."""
    texts = doc_texts(docs, id_col, text_col)
    item_type = benchmark.schema[item_col].dataType
    schema = f"id {texts.schema['id'].dataType.simpleString()}, item {item_type.simpleString()}, start bigint, end bigint"
    spark, out = docs.sparkSession, None
    for ids, items in item_blocks(benchmark, item_col, item_text_col, block_chars):
        shared = spark.sparkContext.broadcast((ids, index_items(items, overlap, similarity, least_words)))

        def step(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch | None:
            names, index = shared.value
            found = list(batch_overlaps(batch.column("text").to_pylist(), index))
            if not found:
                return None
            at, item, start, end = zip(*found, strict=True)
            columns = [batch.column("id").take(pa.array(at)), pa.array([names[k] for k in item]), pa.array(start), pa.array(end)]
            return pa.RecordBatch.from_arrays(columns, ["id", "item", "start", "end"])

        part = map_batches(texts, step, schema)
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], schema) if out is None else out


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    overlap: int = OVERLAP,
    similarity: float = SIMILARITY,
    least_words: int = LEAST_WORDS,
    block_chars: int = BLOCK_CHARS,
    text_col: str = "text",
) -> DataFrame:
    """``docs`` without its contaminated rows; no shuffle, as every block of items filters what the last one left."""
    for _, items in item_blocks(benchmark, "item_id", "text", block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(index_items(items, overlap, similarity, least_words))

        def step(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            clean = np.ones(batch.num_rows, bool)
            clean[[text for text, _, _, _ in batch_overlaps(texts, shared.value)]] = False
            return batch.filter(pa.array(clean))

        docs = map_batches(docs, step, docs.schema)
    return docs


def contaminated_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contamination(docs, benchmark).select(
        F.col("id").alias("doc_id"), F.col("item").alias("item_id"), F.col("start").alias("first_word"), F.col("end").alias("end_word")
    )
