"""Removal of repeated passages by super-k-mer partitioning.

A window is ``window`` consecutive words of one document. Words covered by a window whose word sequence also starts in
a document with a smaller id are removed; windows are judged on the input.

The minimiser of a window is the smallest hash among its runs of ``anchor`` words. Consecutive windows with one
minimiser travel as one packed string to the minimiser's bucket, which is read in sorted order (minimiser, id): the
first document that has a window keeps it. Three things keep the shuffle small and even, none of them changes a result:

* Each task settles the windows that meet inside its own chunk, so copies of one passage leave it once.
* A first pass counts minimisers. Those of one document only can meet nothing and stay at home; they are told apart
  by a bit filter of fixed size (``filter_bits``, 2 MB at 24), which lets some through that need not travel.
* Minimisers of more than ``hot_rows`` places are dealt by whole windows instead (a second filter), so that a passage
  shared by a large part of all documents is spread over as many keys as there are windows around it.

Null and empty texts have no words. Rows with a null id keep all words and take none away. Rows that repeat an id are
compared with other ids only, each with its own text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellarline.llm.common import doc_texts, map_batches, stored

WINDOW = 50
ANCHOR = 8
#: Bytes of text handled at once inside a batch.
CHUNK = 8 << 20
SEED = 42
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Hasher:
    """Hash of each word of a document; words seen in a chunk are hashed once."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known, digest = self.known, xxhash.xxh64_intdigest
        for word in set(words).difference(known):
            known[word] = digest(word)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def minimisers(hashes: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """(first window, minimiser) of each run of windows that share one; ``hashes`` are those of the words."""
    n = len(hashes) - anchor + 1
    mixed = np.zeros(n, np.uint64)
    for k in range(anchor):
        mixed = mixed * MULTIPLIER + hashes[k : k + n]
    mixed ^= mixed >> np.uint64(31)
    mixed *= MULTIPLIER
    mixed ^= mixed >> np.uint64(29)
    least = np.lib.stride_tricks.sliding_window_view(mixed, window - anchor + 1).min(axis=1)
    first = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    return first, least[first]


def chunks(ids: list, texts: list[str | None], window: int) -> Iterator[list[tuple[int, bytes, list[bytes]]]]:
    """Groups of (id, text, words) of the documents that have a window, by size."""
    held, size = [], 0
    for key, text in zip(ids, texts, strict=True):
        if key is None or not text:
            continue
        data = text.encode()
        words = data.split()
        if len(words) < window:
            continue
        held.append((key, data, words))
        size += len(data)
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def merged(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching ranges as one."""
    out: list[list[int]] = []
    for start, end in sorted(places):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


class Bucket:
    """The windows of one minimiser, fed in the order of ids; tells which of a packed string's windows came before."""

    def __init__(self, window: int) -> None:
        self.window = window
        self.whole: dict[bytes, int] = {}
        self.first: dict[bytes, int] = {}

    def feed(self, key: int, packed: bytes) -> np.ndarray:
        """For each window, whether a document with a smaller id has it."""
        words = packed.split(b" ")
        n = len(words) - self.window + 1
        if self.whole.setdefault(packed, key) < key:
            return np.ones(n, bool)
        first, width = self.first, self.window
        return np.fromiter((first.setdefault(b" ".join(words[i : i + width]), key) < key for i in range(n)), bool, n)


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the stretches where ``mask`` holds."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def in_filter(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    mask = np.uint64(8 * len(bits) - 1)
    found = np.ones(len(hashes), bool)
    for shift in (0, 32):
        at = (hashes >> np.uint64(shift)) & mask
        found &= (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found


def filters(counted: DataFrame, filter_bits: int, hot_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit filters of the minimisers of several documents, and of those among them with many places.

    The bits are set by Spark; the driver gets at most 2**filter_bits / 64 words for each.
    """
    sums = counted.groupBy("minimiser").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
    shared = sums.where("lo < hi").select("minimiser", F.expr(f"n > {hot_rows}").alias("hot"))
    kinds = shared.select("minimiser", F.explode(F.when(F.col("hot"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("kind"))
    at = F.explode(F.array(*[F.shiftrightunsigned("minimiser", s).bitwiseAND(F.lit((1 << filter_bits) - 1)) for s in (0, 32)]))
    words = kinds.select("kind", at.alias("at")).groupBy("kind", F.shiftright("at", 6).alias("word"))
    table = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toPandas()
    out = []
    for kind in (0, 1):
        bits = np.zeros(1 << filter_bits - 6, np.int64)
        rows = table[table["kind"] == kind]
        bits[rows["word"].to_numpy()] = rows["bits"].to_numpy()
        out.append(bits.view(np.uint8))
    return out[0], out[1]


def repeated_ranges(
    texts: DataFrame, window: int, anchor: int, filter_bits: int, hot_rows: int
) -> DataFrame:
    """``id``, ``h`` (hash of the text), ``start``, ``end``: ranges of words covered by repeated windows."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found = []
        for group in chunks(batch.column("id").to_pylist(), batch.column("text").to_pylist(), window):
            hasher = Hasher()
            for key, _, words in group:
                values = np.unique(minimisers(hasher(words), window, anchor)[1])
                found.append((values, np.full(len(values), key)))
        if not found:
            return None
        values, keys = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(values, kind="stable")
        values, keys = values[order], keys[order]
        first = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1])
        columns = [
            values[first].view(np.int64),
            np.minimum.reduceat(keys, first),
            np.maximum.reduceat(keys, first),
            np.diff(np.append(first, len(values))),
        ]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["minimiser", "lo", "hi", "n"])

    counted = map_batches(texts, count, "minimiser bigint, lo bigint, hi bigint, n bigint")
    shared, hot = map(texts.sparkSession.sparkContext.broadcast, filters(counted, filter_bits, hot_rows))

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for group in chunks(batch.column("id").to_pylist(), batch.column("text").to_pylist(), window):
            yield from _settle_chunk(group, window, anchor, shared.value, hot.value)

    def cut_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from cut(batch)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, bucket = None, None
        for batch in batches:
            keys, ids, hs, starts, ends = (batch.column(k).to_numpy() for k in range(5))
            packed = batch.column("packed")
            found: list[tuple[int, int, int, int]] = []
            same = np.concatenate([keys[1:] == keys[:-1], [True]]) | np.concatenate([[True], keys[1:] == keys[:-1]])
            settled = packed.is_null().to_numpy(zero_copy_only=False)
            at = np.flatnonzero(settled)
            found += zip(ids[at].tolist(), hs[at].tolist(), starts[at].tolist(), ends[at].tolist(), strict=True)
            for k in np.flatnonzero(same & ~settled).tolist():
                if bucket is None or keys[k] != last:
                    last, bucket = keys[k], Bucket(window)
                begin = int(starts[k])
                for a, b in runs(bucket.feed(int(ids[k]), packed[k].as_py())):
                    found.append((int(ids[k]), int(hs[k]), begin + a, begin + b + window - 1))
            if found:
                columns = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", "h", "start", "end"])

    schema = "key bigint, id bigint, h bigint, start bigint, end bigint, packed binary"
    dealt = texts.mapInArrow(cut_all, schema).repartition("key").sortWithinPartitions("key", "id")
    return dealt.mapInArrow(meet, "id bigint, h bigint, start bigint, end bigint")


def _settle_chunk(
    group: list[tuple[int, bytes, list[bytes]]], window: int, anchor: int, shared: np.ndarray, hot: np.ndarray
) -> Iterator[pa.RecordBatch]:
    """Packed strings of the chunk's windows that may meet others, and ranges that were settled inside it.

    A settled range has no packed string; its key only spreads it.
    """
    hasher, place, minimiser, begin, end = Hasher(), [], [], [], []
    for k, (_, _, words) in enumerate(group):
        first, values = minimisers(hasher(words), window, anchor)
        last = np.append(first[1:], len(words) - window + 1)
        wanted = in_filter(shared, values)
        place.append(np.full(int(wanted.sum()), k))
        minimiser.append(values[wanted])
        begin.append(first[wanted])
        end.append(last[wanted])
    place, minimiser, begin, end = (np.concatenate(x) for x in (place, minimiser, begin, end))
    hashes = [xxhash.xxh64_intdigest(data, SEED) for _, data, _ in group]
    ids = np.array([key for key, _, _ in group])
    order = np.lexsort((begin, ids[place], minimiser))
    is_hot = in_filter(hot, minimiser)
    known: list[list[tuple[int, int]]] = [[] for _ in group]
    rows: list[tuple[int, int, int, int, int, bytes | None]] = []
    bucket, of = Bucket(window), None
    values = minimiser[order]
    alone = np.concatenate([[True], values[1:] != values[:-1]]) & np.concatenate([values[1:] != values[:-1], [True]])
    for k, single in zip(order.tolist(), alone.tolist(), strict=True):
        key, _, words = group[place[k]]
        a, b = int(begin[k]), int(end[k])
        packed = b" ".join(words[a : b + window - 1])
        left = [(a, b)]
        if not single:
            if minimiser[k] != of:
                bucket, of = Bucket(window), minimiser[k]
            before = bucket.feed(key, packed)
            known[place[k]] += [(a + x, a + y + window - 1) for x, y in runs(before)]
            left = [(a + x, a + y) for x, y in runs(~before)]
        h = hashes[place[k]]
        for x, y in left:
            if is_hot[k]:
                for i in range(x, y):
                    text = b" ".join(words[i : i + window])
                    rows.append((xxhash.xxh64_intdigest(text), key, h, i, i + 1, text))
            else:
                whole = packed if (x, y) == (a, b) else b" ".join(words[x : y + window - 1])
                rows.append((int(minimiser[k]), key, h, x, y, whole))
    for k, places in enumerate(known):
        for x, y in merged(places):
            rows.append((hashes[k] ^ x, group[k][0], hashes[k], x, y, None))
    for at in range(0, len(rows), 10_000):
        keys, owners, hs, starts, ends, packs = zip(*rows[at : at + 10_000], strict=True)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.array(keys, np.uint64).view(np.int64)),
                pa.array(owners, pa.int64()),
                pa.array(np.array(hs, np.uint64).view(np.int64)),
                pa.array(starts, pa.int64()),
                pa.array(ends, pa.int64()),
                pa.array(packs, pa.binary()),
            ],
            ["key", "id", "h", "start", "end", "packed"],
        )


def remove_repeats(
    docs: DataFrame,
    *,
    window: int = WINDOW,
    anchor: int = ANCHOR,
    filter_bits: int = 24,
    hot_rows: int = 1000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id``, ``n_words``, ``n_removed``, ``kept`` (the words that stay, joined by one space) of each row."""
    texts = doc_texts(docs, id_col, text_col).withColumn("id", F.col("id").cast("bigint"))
    found = repeated_ranges(texts, window, anchor, filter_bits, hot_rows)
    # The ranges of a document are as many as its length allows; they are written so that the join knows their size.
    by_doc = stored(found.groupBy("id", "h").agg(F.collect_list(F.struct("start", "end")).alias("ranges")), "ranges")
    by_doc = by_doc.select(F.col("id").alias("_id"), F.col("h").alias("_h"), "ranges")
    keyed = texts.withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = keyed.join(by_doc, (F.col("id") == F.col("_id")) & (F.col("h") == F.col("_h")), "left")

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, n_removed, kept = [], [], []
        for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
            words = (text or "").encode().split()
            removed, stay, at = 0, [], 0
            for start, end in merged([(r["start"], r["end"]) for r in ranges or ()]):
                stay += words[at:start]
                removed, at = removed + end - start, end
            stay += words[at:]
            n_words.append(len(words))
            n_removed.append(removed)
            kept.append(b" ".join(stay).decode())
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
            ["id", "n_words", "n_removed", "kept"],
        )

    return map_batches(
        joined.select("id", "text", "ranges"), keep, "id bigint, n_words bigint, n_removed bigint, kept string"
    )


def substring_digest(docs: DataFrame) -> DataFrame:
    found = remove_repeats(docs)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: The same by plain SQL: every window as a string, the smallest document of each, and the words left uncovered.
SQL = """
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), places AS (
  SELECT doc_id, words, unnest(range(0, greatest(len(words) - 49, 0))) AS pos FROM split
), windows AS (
  SELECT doc_id, pos, array_to_string(words[pos + 1 : pos + 50], ' ') AS seq FROM places
), firsts AS (
  SELECT seq, min(doc_id) AS first_id FROM windows GROUP BY seq
), covered AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + 50)) AS word
  FROM windows JOIN firsts USING (seq) WHERE first_id < doc_id
), gone AS (
  SELECT doc_id, list(word) AS removed FROM covered GROUP BY doc_id
), left_over AS (
  SELECT split.doc_id, len(words) AS n_words, coalesce(len(removed), 0) AS n_removed,
         list_filter(words, lambda w, i: NOT list_contains(coalesce(removed, []), i - 1)) AS kept
  FROM split LEFT JOIN gone ON split.doc_id = gone.doc_id
)
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed,
       sha256(array_to_string(kept, ' ')) AS kept_sha256
FROM left_over
"""
