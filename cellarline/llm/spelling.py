"""Spelling variants: words at one edit, found by a relational walk through a trie.

The words are counted by Spark and laid out as a trie in a distributed table of edges (node, label, child). The frontier
holds states (word, position, node, edits); level by level it is joined with the edges of that depth. A state without an
edit follows every edge of its node: its own one, or another at the price of the edit (replaced, inserted or deleted
there). A state with one edit follows only the edge that spells its word. Where a word ends in a state with one edit, or
one character before that in a state without, the two words are neighbours.

Three things bound the walk, and none loses a neighbour:

* Of two words at one edit, the common start or the common end has at least half of the word. The walk goes over words
  from both ends and starts at the node in the middle, behind which a trie branches little.
* An edge carries the first characters of the edges behind it; states that no edge continues are dropped before they
  are dealt.
* Labels are one character for words of up to ``LEVELS`` characters, and twice as many at each doubling, so that a word
  of any length has at most ``LEVELS`` levels. A word looks into the tries of the lengths it can become.

Nodes are named by a 64-bit hash of what they spell; neighbours are verified on the words, so a clash adds nothing.

A null text has no runs, a null id reads as empty. Repeated ids and rows count as often as they stand there.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellarline.llm.common import doc_texts, stored
from cellarline.sources.storage import require_shared_dir

LEVELS = 32
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: One in so many runs loses a character, by its hash.
NOISE = 97
#: Different words a task holds before it passes their counts on.
MOST_HELD = 1 << 20


def word_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", noise: int = NOISE, least: int = LEAST_LENGTH) -> DataFrame:
    """``word``, ``n`` of the lower-cased runs of letters with at least ``least`` characters, all texts together."""
    run = re.compile(f"[a-zÀ-ÿ]{{{least},}}")
    texts = doc_texts(docs, id_col, text_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            columns = [pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["word", "n"])

        for batch in batches:
            for key, text in zip(batch.column("id"), batch.column("text"), strict=True):
                if not text.is_valid:
                    continue
                key = key.as_py()
                start = zlib.crc32(f"{'' if key is None else key}:".encode())
                # Bytes are lower-cased in ASCII only.
                for word, n in Counter(run.findall(text.as_py().encode().lower().decode())).items():
                    h = zlib.crc32(word.encode(), start)
                    if noise and h % noise == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    total[word] += n
                if len(total) > MOST_HELD:
                    yield out()
                    total.clear()
        if total:
            yield out()

    return texts.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def label_width(length: Column) -> Column:
    """Characters of a label in the trie for words of ``length``: 1, or the power of two that gives at most LEVELS levels."""
    blocks = F.floor((length - 1) / LEVELS)
    return F.when(length <= LEVELS, 1).otherwise(F.call_function("shiftleft", F.lit(1), F.length(F.bin(blocks)))).cast("int")


def node_of(word: Column, end: Column) -> Column:
    return F.xxhash64("side", "width", F.substring(word, F.lit(1), end))


def sides(words: DataFrame) -> DataFrame:
    """``side``, ``s`` (the word, or from its end), ``m`` (its length) and all columns of ``words``."""
    both = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("word").alias("s")), F.struct(F.lit(1).alias("side"), F.reverse("word").alias("s"))))
    return words.select("*", both.alias("b")).select("word", "n", "b.side", "b.s", F.length("word").alias("m"))


def by_depth(df: DataFrame, name: str):
    """``df`` written by ``depth``; gives a function that reads one depth."""
    spark = df.sparkSession
    path = f"{require_shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy("depth").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    return lambda depth: table.where(F.col("depth") == depth).drop("depth")


def trie_edges(words: DataFrame) -> DataFrame:
    """``depth``, ``node``, ``label``, ``child``, ``ahead`` (first characters behind the child), ``full``, ``full_n``.

    ``full`` is the word that ends at the child, if any.
    """
    steps = sides(words).withColumn("width", label_width(F.col("m")))
    steps = steps.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("m") - 1, F.col("width"))))
    s, at, behind = F.col("s"), F.col("at"), F.col("at") + F.col("width")
    ends = behind >= F.col("m")
    rows = steps.select(
        F.floor(at / F.col("width")).cast("int").alias("depth"),
        node_of(s, at).alias("node"),
        F.substring(s, at + 1, F.col("width")).alias("label"),
        node_of(s, behind).alias("child"),
        F.when(ends, F.struct(F.col("word").alias("full"), F.col("n").alias("full_n"))).alias("end"),
    )
    edges = stored(rows.groupBy("depth", "node", "label", "child").agg(F.max("end").alias("end")), "trie")
    heads = edges.groupBy(F.col("node").alias("of")).agg(F.array_join(F.collect_set(F.substring("label", 1, 1)), "").alias("ahead"))
    found = edges.join(heads, F.col("child") == F.col("of"), "left")
    return found.select("depth", "node", "label", "child", F.coalesce("ahead", F.lit("")).alias("ahead"), "end.full", "end.full_n")


def starts(words: DataFrame) -> DataFrame:
    """States in the middle of every word, from both ends, for each trie that can hold a neighbour."""
    m = F.col("m")
    widths = F.array_distinct(F.array(label_width(m - 1), label_width(m), label_width(m + 1)))
    states = sides(words).withColumn("width", F.explode(widths))
    states = states.withColumn("depth", F.floor(F.floor(m / 2) / F.col("width")).cast("int"))
    states = states.withColumn("pos", F.col("depth") * F.col("width"))
    return states.select("depth", "side", "s", "width", "pos", node_of(F.col("s"), F.col("pos")).alias("node"), F.lit(0).alias("edits"))


def next_states(states: DataFrame, edges: DataFrame) -> DataFrame:
    """What the ``states`` of one depth become over the ``edges`` of that depth; ``alive`` if an edge continues them."""
    s, pos, m = F.col("s"), F.col("pos"), F.length("s")
    part = lambda size: F.substring(s, pos + 1, size)
    fresh, edited = states.where("edits = 0"), states.where("edits = 1")

    own = part(F.col("width"))
    spelled = edited.withColumn("own", own).withColumnRenamed("node", "here")
    along = spelled.join(edges, (F.col("here") == F.col("node")) & (F.col("own") == F.col("label")))
    along = along.select("side", "s", "width", (pos + F.length("label")).alias("pos"), F.col("child").alias("node"), "edits", "ahead", "full", "full_n")

    size = F.length("label")
    one_edit = lambda end: (pos + end <= m) & (F.levenshtein(F.col("label"), part(end), 1) == 1)
    to = lambda end, edits: F.struct((pos + end).cast("int").alias("pos"), F.lit(edits).alias("edits"))
    same = F.col("label") == part(size)
    ways = F.when(same, F.array(to(size, 0))).otherwise(F.array(*[F.when(one_edit(end), to(end, 1)) for end in (size, size - 1, size + 1)]))
    away = fresh.withColumnRenamed("node", "here").join(edges, F.col("here") == F.col("node"))
    away = away.withColumn("way", F.explode(F.filter(ways, lambda w: w.isNotNull())))
    away = away.select("side", "s", "width", "way.pos", F.col("child").alias("node"), "way.edits", "ahead", "full", "full_n")

    found = along.unionByName(away)
    hit = ((F.col("edits") == 1) & (pos == m)) | ((F.col("edits") == 0) & (pos == m - 1))
    spells = (pos < m) & F.contains("ahead", part(F.lit(1)))
    alive = F.when(F.col("edits") == 0, (F.col("ahead") != "") & (pos <= m)).otherwise(spells)
    found = found.withColumn("alive", alive).withColumn("full", F.when(hit, F.col("full"))).drop("ahead")
    return found.where("alive OR full IS NOT NULL")


def neighbours(words: DataFrame) -> DataFrame:
    """``word``, ``near``, ``near_n``: all ordered pairs of ``words`` (``word``, ``n``) at exactly one edit."""
    edges_at, starts_at = by_depth(trie_edges(words), "trie-edges"), by_depth(starts(words), "trie-starts")
    deepest = words.agg(F.max(F.length("word")).alias("m")).first()["m"] or 0
    levels, frontier = [], None
    for depth in range(min(deepest, LEVELS) + 1):
        states = starts_at(depth)
        if frontier is not None:
            states = states.unionByName(frontier)
        level = stored(next_states(states, edges_at(depth)), "trie-level")
        levels.append(level.where("full IS NOT NULL"))
        frontier = level.where("alive").drop("alive", "full", "full_n")
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    word = F.when(F.col("side") == 1, F.reverse("s")).otherwise(F.col("s")).alias("word")
    pairs = found.select(word, F.col("full").alias("near"), F.col("full_n").alias("near_n")).distinct()
    return pairs.where(F.levenshtein("word", "near", 1) == 1)


def roots(forms: DataFrame) -> DataFrame:
    """``word``, ``root`` where following ``form`` (of larger count each time, so without a circle) ends."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    # Each round doubles the way that is gone; counts at least double at each step, so 64 steps are the longest way.
    for _ in range(7):
        onward = now.select(F.col("word").alias("mid"), F.col("root").alias("further"))
        step = now.join(onward, F.col("root") == F.col("mid"), "left")
        step = stored(step.select("word", F.coalesce("further", "root").alias("root"), F.col("mid").isNotNull().alias("moved")), "roots")
        now = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    return now


def spelling_variants(words: DataFrame) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n``, ``root`` of each row of ``words`` (``word``, ``n``; no repeats)."""
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    near = neighbours(words).groupBy(F.col("word").alias("of")).agg(F.count("*").alias("n_near"), best)
    joined = words.join(near, F.col("word") == F.col("of"), "left")
    is_form = -F.col("best.less") >= 2 * F.col("n")
    found = joined.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.near")).alias("form"),
        F.when(is_form, -F.col("best.less")).alias("form_n"),
    )
    found = stored(found, "forms")
    ends = roots(found.where("form IS NOT NULL")).withColumnRenamed("word", "of")
    return found.join(ends, F.col("word") == F.col("of"), "left").select("*", F.coalesce("root", "word").alias("_root")).drop("of", "root").withColumnRenamed("_root", "root")


def spelling_digest(docs: DataFrame) -> DataFrame:
    words = stored(word_counts(docs).where(F.col("n") >= LEAST_COUNT), "words")
    return spelling_variants(words).select("word", "form", "root", "n", "n_near", "form_n")
