"""Collocations by SON partitioning: phrases that are frequent in some shard, then counted exactly over all.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends and into words at blanks, and written as chunks
of one language. Chunks are dealt into ``shards``. A phrase with ``least`` occurrences in a language has, in at least one
shard, its proportional part of them (``least`` x words of the shard / words of the language, rounded up). So:

1. Every shard is mined completely: the phrases of each chunk travel as hashes with their counts, in packed rows, to
   the bucket of their hash (32 bits of it remain there), where they are summed by shard and held against the shard's
   own support.
2. What is frequent in any shard is the union; each bucket answers every chunk with those of its hashes that are in it
   and whose sum over all shards reaches ``least``.
3. The chunks count these phrases by their words, and Spark adds up: exact counts, whatever the hashes did. A clash can
   only make a further candidate, never lose one.

The number of buckets follows the words of the language, so a bucket has a bounded number of words. Nothing is broadcast
but the sizes of the shards, and no task sees more than a chunk with its answers or a bucket.

A null language is ``und``, a null text empty; ids play no part, so null or repeated ids and rows count as they stand.
Texts longer than a chunk are cut between words, with the next words as context, so that no phrase is lost or doubled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellarline.llm.common import stored

UNKNOWN = "und"
LONGEST, LEAST, SHARDS = 3, 10, 4
#: Bytes of text in a chunk, and of all chunks that a task holds open.
CHUNK, OPEN = 4 << 20, 32 << 20
#: Words of a language for each of its buckets.
BUCKET_WORDS = 1 << 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Marks a word that stands in a chunk as context only; texts have it as a line end, so no word begins with it.
CONTEXT = b"\x0b"
TOKEN = re.compile(rb"\n|[^ \n]+")


def _table() -> bytes:
    table = bytearray(bytes(range(256)).lower())
    for mark in b".,;:!?\n\x0b\x0c\r":
        table[mark] = ord("\n")
    table[ord("\t")] = ord(" ")
    return bytes(table)


NORMAL = _table()


def normal(text: str | None) -> bytes:
    """The text with words apart by blanks and pieces by line feeds."""
    return (text or "").encode().translate(NORMAL)


def cut_text(data: bytes, longest: int) -> Iterator[tuple[bytes, bytes]]:
    """(text, context behind it) of parts of at most about a chunk."""
    at = 0
    while len(data) - at > CHUNK:
        end = data.rfind(b"\n", at, at + CHUNK)
        if end > at:
            yield data[at:end], b""
            at = end + 1
            continue
        end = data.rfind(b" ", at, at + CHUNK)
        if end <= at and (found := re.compile(rb"[ \n]").search(data, at + CHUNK)):
            end = found.start()
        if end <= at:
            break
        context = []
        for token in TOKEN.finditer(data, end):
            if token[0] == b"\n" or len(context) == longest - 1:
                break
            context.append(b" " + CONTEXT + token[0])
        yield data[at:end], b"".join(context)
        at = end
    yield data[at:], b""


def chunks_of(docs: DataFrame, lang_col: str, text_col: str, longest: int) -> DataFrame:
    """``lang``, ``words``, ``data``: normal text in chunks of one language."""
    lang = F.coalesce(F.col(f"`{lang_col}`"), F.lit(UNKNOWN))
    texts = docs.select(lang.alias("lang"), F.col(f"`{text_col}`").alias("text")).where("text <> ''")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        words: dict[str, int] = {}

        def out(lang: str) -> pa.RecordBatch:
            sizes.pop(lang)
            columns = [pa.array([lang]), pa.array([words.pop(lang)], pa.int64()), pa.array([b"\n".join(held.pop(lang))], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["lang", "words", "data"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                for part, context in cut_text(normal(text.as_py()), longest):
                    if sizes.get(lang, 0) + len(part) > CHUNK and lang in held:
                        yield out(lang)
                    held.setdefault(lang, []).append(part + context)
                    sizes[lang] = sizes.get(lang, 0) + len(part)
                    words[lang] = words.get(lang, 0) + len(part.split())
                    if sum(sizes.values()) > OPEN:
                        yield out(max(sizes, key=sizes.get))
        for lang in list(held):
            yield out(lang)

    return texts.mapInArrow(cut, "lang string, words bigint, data binary")


class Words:
    """A chunk as numbers: the different words, which of them stands where, and where phrases may begin."""

    def __init__(self, data: bytes) -> None:
        tokens = data.replace(b"\n", b" \n ").split(b" ")
        index = {word: k for k, word in enumerate(dict.fromkeys(tokens))}
        places = np.fromiter(map(index.__getitem__, tokens), np.int64, len(tokens))
        self.places = places[places != index.get(b"", -1)]
        self.words = [w[1:] if w.startswith(CONTEXT) else w for w in index]
        context = np.fromiter((w.startswith(CONTEXT) for w in index), bool, len(index))
        inside = self.places != index.get(b"\n", -1)
        #: starts[m-1]: does a phrase of m words begin here?
        self.begin, self.inside = inside & ~context[self.places], inside

    def starts(self, longest: int) -> Iterator[np.ndarray]:
        """For 1 to ``longest`` words, where in ``places`` a phrase of so many begins."""
        ok = self.begin
        yield np.flatnonzero(ok)
        for m in range(1, longest):
            ok = ok[:-1] & self.inside[m:]
            yield np.flatnonzero(ok)

    def hashes(self, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For 1 to ``longest`` words, the places of phrases and their hashes."""
        of_word = np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, len(self.words))
        own = of_word[self.places]
        mixed = np.zeros(len(own), np.uint64)
        for m, at in enumerate(self.starts(longest)):
            mixed = (mixed[: len(mixed) - (1 if m else 0)] ^ own[m:]) * MULTIPLIER
            mixed ^= mixed >> np.uint64(29)
            yield at, mixed[at]


def keys_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket << 32 | code: the upper half of a hash gives the bucket, the lower half is the code inside it."""
    low, high = np.uint64(0xFFFFFFFF), np.uint64(32)
    return ((hashes >> high) * np.uint64(buckets) >> high << high) | (hashes & low)


def packed_keys(data: bytes, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The different keys of a chunk's phrases, rising, and how often each occurs."""
    every = np.concatenate([h for _, h in Words(data).hashes(longest)])
    keys, counts = np.unique(keys_of(every, buckets), return_counts=True)
    return keys, counts.astype(np.uint32)


def mined(chunks: DataFrame, longest: int) -> DataFrame:
    """``lang``, ``bucket``, ``shard``, ``support``, ``chunk``, ``codes``, ``counts``: packed rows of every chunk."""

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                buckets = batch.column("buckets")[row].as_py()
                keys, counts = packed_keys(batch.column("data")[row].as_py(), longest, buckets)
                begin = np.searchsorted(keys, np.arange(buckets, dtype=np.uint64) << np.uint64(32)).tolist()
                ranges = [(b, x, y) for b, (x, y) in enumerate(zip(begin, [*begin[1:], len(keys)], strict=True)) if x < y]
                if not ranges:
                    continue
                codes = keys.astype(np.uint32)
                same = batch.select(["lang", "shard", "support", "chunk"]).take(pa.array([row] * len(ranges)))
                columns = [
                    pa.array([b for b, _, _ in ranges], pa.int64()),
                    pa.array([codes[x:y].tobytes() for _, x, y in ranges], pa.binary()),
                    pa.array([counts[x:y].tobytes() for _, x, y in ranges], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays([*same.columns, *columns], [*same.schema.names, "bucket", "codes", "counts"])

    schema = "lang string, shard int, support bigint, chunk bigint, bucket bigint, codes binary, counts binary"
    return chunks.mapInArrow(mine, schema)


def locally_frequent(rows: DataFrame, least: int) -> DataFrame:
    """``chunk``, ``bucket``, ``found``: of each chunk's codes those that reach the support of any shard.

    A bucket sees the counts of all shards; what stays below ``least`` in their sum is no candidate either.
    """

    def find(table: pa.Table) -> pa.Table:
        codes = [np.frombuffer(x, np.uint32) for x in table.column("codes").to_pylist()]
        counts = [np.frombuffer(x, np.uint32) for x in table.column("counts").to_pylist()]
        shard, support = table.column("shard").to_numpy(), table.column("support").to_numpy()

        def summed(own: list[int]) -> tuple[np.ndarray, np.ndarray]:
            c, n = np.concatenate([codes[k] for k in own]), np.concatenate([counts[k] for k in own])
            order = np.argsort(c, kind="stable")
            c, n = c[order], n[order]
            first = np.concatenate([[0], np.flatnonzero(c[1:] != c[:-1]) + 1])
            return c[first], np.add.reduceat(n.astype(np.int64), first)

        union = []
        for number in np.unique(shard).tolist():
            own = np.flatnonzero(shard == number).tolist()
            c, n = summed(own)
            union.append(c[n >= support[own[0]]])
        c, n = summed(range(len(codes)))
        wanted = np.intersect1d(np.concatenate(union), c[n >= least])
        found = pa.array([own[_among(own, wanted)].tobytes() for own in codes], pa.binary())
        answers = pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "found": found})
        return answers.filter(pc.greater(pc.binary_length(found), 0))

    return rows.groupBy("lang", "bucket").applyInArrow(find, "chunk bigint, bucket bigint, found binary")


def _among(values: np.ndarray, rising: np.ndarray) -> np.ndarray:
    if not len(rising):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(rising, values), len(rising) - 1)
    return rising[at] == values


def counted(chunks: DataFrame, answers: DataFrame, longest: int) -> DataFrame:
    """``lang``, ``size``, ``phrase``, ``n`` of the candidates in each chunk, by their words."""

    def count(own: pa.Table, found: pa.Table) -> pa.Table:
        empty = pa.table({"lang": pa.array([], pa.string()), "size": pa.array([], pa.int32()), "phrase": pa.array([], pa.string()), "n": pa.array([], pa.int64())})
        if not own.num_rows or not found.num_rows:
            return empty
        pairs = zip(found.column("bucket").to_pylist(), found.column("found").to_pylist(), strict=True)
        wanted = np.sort(np.concatenate([np.frombuffer(x, np.uint32).astype(np.uint64) | np.uint64(b << 32) for b, x in pairs]))
        chunk, buckets = Words(own.column("data")[0].as_py()), own.column("buckets")[0].as_py()
        words, tables = pa.array(chunk.words, pa.binary()), []
        for m, (at, hashes) in enumerate(chunk.hashes(longest), start=1):
            at = at[_among(keys_of(hashes, buckets), wanted)]
            if not len(at):
                continue
            # Numbers of the phrases, exact: those of one word less and the next word make the next.
            code = chunk.places[at]
            for k in range(1, m):
                code = np.unique(code, return_inverse=True)[1] * len(words) + chunk.places[at + k]
            _, first, n = np.unique(code, return_index=True, return_counts=True)
            parts = [words.take(pa.array(chunk.places[at[first] + k])) for k in range(m)]
            phrase = parts[0] if m == 1 else pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary()))
            tables.append(pa.table({"size": pa.array(np.full(len(first), m, np.int32)), "phrase": phrase.cast(pa.string()), "n": pa.array(n.astype(np.int64))}))
        if not tables:
            return empty
        table = pa.concat_tables(tables)
        lang = pa.array([own.column("lang")[0].as_py()] * table.num_rows, pa.string())
        return table.add_column(0, "lang", lang)

    both = chunks.select("chunk", "lang", "buckets", "data").groupBy("chunk").cogroup(answers.groupBy("chunk"))
    found = both.applyInArrow(count, "lang string, size int, phrase string, n bigint")
    return found.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))


def frequent_phrases(
    docs: DataFrame, *, longest: int = LONGEST, least: int = LEAST, shards: int = SHARDS, lang_col: str = "lang", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(``lang``, ``size``, ``phrase``, ``n``) of words and phrases with at least ``least`` occurrences; ``lang``, ``words``."""
    chunks = stored(chunks_of(docs, lang_col, text_col, longest).withColumn("chunk", F.monotonically_increasing_id()), "chunks")
    chunks = chunks.withColumn("shard", F.pmod(F.xxhash64("chunk"), F.lit(shards)).cast("int"))
    by_shard = chunks.groupBy("lang", "shard").agg(F.sum("words").alias("own"))
    by_lang = by_shard.groupBy(F.col("lang").alias("of")).agg(F.sum("own").alias("all"))
    # Rounded up, and at least one; in decimals, so that no product overflows.
    share = F.expr(f"cast(ceil(cast({least} as decimal(10,0)) * cast(own as decimal(19,0)) / cast(greatest(all, 1) as decimal(19,0))) as bigint)")
    buckets = F.floor(F.col("all") / BUCKET_WORDS) + 1
    sizes = by_shard.join(by_lang, F.col("lang") == F.col("of")).select(
        F.col("lang").alias("of"), F.col("shard").alias("of_shard"), "all", F.greatest(share, F.lit(1)).alias("support"), buckets.alias("buckets")
    )
    sizes = stored(sizes, "shards")
    known = chunks.join(sizes, (F.col("lang") == F.col("of")) & (F.col("shard") == F.col("of_shard")))
    answers = locally_frequent(mined(known.select("chunk", "lang", "shard", "support", "buckets", "data"), longest), least)
    found = counted(known, answers, longest).where(F.col("n") >= least)
    totals = sizes.select(F.col("of").alias("lang"), F.col("all").alias("words")).distinct()
    return stored(found, "phrases"), totals


def part(start: Column, size: Column) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), start, size), " ")


def collocations(counts: DataFrame, *, scale: int = 1_000_000, contained: int = 50) -> DataFrame:
    """``lang``, ``phrase``, ``a``, ``l``, ``r``, ``score`` of the phrases in ``counts`` that no longer one contains.

    The lowest of the cuts counts. A phrase goes if a longer one around it has at least ``contained`` percent of its count.
    """
    phrases = counts.where("size > 1").select("lang", "size", "phrase", F.col("n").alias("a"))
    k = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    cuts = phrases.select("lang", "phrase", "a", "size", k)
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    of = lambda name, n: counts.select(F.col("lang").alias(f"{n}_lang"), F.col("phrase").alias(f"{n}_part"), F.col("n").alias(n))
    left, right = of("first", "l"), of("rest", "r")
    cuts = cuts.join(left, (F.col("lang") == F.col("l_lang")) & (F.col("first") == F.col("l_part"))).drop("l_lang", "l_part", "first")
    cuts = cuts.join(right, (F.col("lang") == F.col("r_lang")) & (F.col("rest") == F.col("r_part"))).drop("r_lang", "r_part", "rest")
    wide = lambda c: f"cast({c} as decimal(19,0))"
    score = F.expr(f"(cast({scale} as decimal(10,0)) * {wide('a')} * {wide('a')}) div ({wide('l')} * {wide('r')})")
    best = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("m"))

    size = F.col("size")
    inner = F.explode(F.sequence(F.lit(2), size - 1)).alias("inner")
    spans = phrases.where("size > 2").select("lang", "phrase", "a", "size", inner)
    spans = spans.withColumn("start", F.explode(F.sequence(F.lit(1), size - F.col("inner") + 1)))
    around = spans.groupBy(F.col("lang").alias("of"), part(F.col("start"), F.col("inner")).alias("within")).agg(F.max("a").alias("longer"))
    kept = best.join(around, (F.col("lang") == F.col("of")) & (F.col("phrase") == F.col("within")), "left")
    kept = kept.where(F.col("longer").isNull() | (100 * F.col("longer") < contained * F.col("a")))
    return kept.select("lang", "phrase", "a", "m.l", "m.r", "m.score")


def best_of_each(df: DataFrame, group: str, order: list[Column], limit: int, per_task: int = 200_000) -> DataFrame:
    """The first ``limit`` rows of each group with their ``rank``; large groups are thinned in salted parts first."""
    largest = df.groupBy(group).count().agg(F.max("count").alias("n")).first()["n"] or 0
    while largest > per_task:
        parts = -(-largest // per_task)
        salt = F.pmod(F.xxhash64(*df.columns), F.lit(parts))
        ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(group, salt).orderBy(*order)))
        df = ranked.where(F.col("rank") <= limit).drop("rank")
        if parts * limit >= largest:
            break
        largest = parts * limit
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= limit)


def collocation_digest(docs: DataFrame, limit: int = 2000) -> DataFrame:
    counts, totals = frequent_phrases(docs)
    found = stored(collocations(counts), "collocations")
    top = best_of_each(found, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], limit)
    n = totals.select(F.col("lang").alias("of"), F.col("words").alias("n"))
    return top.join(n, F.col("lang") == F.col("of")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same by counting every phrase.
SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, 1 AS size, unnest(w) AS phrase FROM words
  UNION ALL
  SELECT lang, 2, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) FROM words
  UNION ALL
  SELECT lang, 3, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) FROM words
), counts AS (
  SELECT lang, size, phrase, count(*) AS n FROM grams GROUP BY ALL HAVING count(*) >= 10
), totals AS (
  SELECT lang, count(*) AS n FROM grams WHERE size = 1 GROUP BY lang
), cuts AS (
  SELECT lang, phrase, size, n AS a, k, string_split(phrase, ' ') AS w
  FROM (SELECT *, unnest(range(1, size)) AS k FROM counts WHERE size > 1)
), scored AS (
  SELECT c.lang, c.phrase, c.size, c.a, c.k, f.n AS l, s.n AS r,
         (1000000::HUGEINT * c.a * c.a) // (f.n::HUGEINT * s.n) AS score
  FROM cuts c
  JOIN counts f ON f.lang = c.lang AND f.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN counts s ON s.lang = c.lang AND s.phrase = array_to_string(c.w[c.k + 1:], ' ')
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), around AS (
  SELECT lang, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS phrase,
         n AS longer
  FROM counts WHERE size = 3
), kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM around x WHERE x.lang = b.lang AND x.phrase = b.phrase AND 100 * x.longer >= 50 * b.a)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, totals.n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
