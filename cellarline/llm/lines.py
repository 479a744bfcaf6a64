"""Line dedup by an exact set-similarity join; DataFrame operations only.

Lines end at a line feed, their tokens are the distinct words. A line is removed if an earlier line, by (id, number of
the line), has a Jaccard similarity of at least ``similarity``; lines are judged on the input, so an earlier line that
is itself removed still counts. Lines without words are never compared and stay.

Tokens are put in order of rarity. Counting goes into a table of fixed size by token hash, so the order needs no
dictionary that grows with the corpus; the hash settles ties. Any total order keeps the prefix filter exact. Lines
with equal sets are one before the join, named by a 64-bit hash of the set. Sets meet on the tokens of their prefixes;
of two similar ones the smaller shares a token of its index prefix, about half as long, with the prefix of the larger.
Pairs pass the length and positional filters and one on signatures of 64 bits, for long lines 128, which no similar
pair fails. Only then are the tokens of both sides fetched and the similarity is checked on integers.

One earlier match settles a line. So each set first meets the earliest set of each of its prefix tokens that more than
FEW sets have, which is linear in the postings and settles all but a few members of a group of like lines; the join of
all sets leaves out the pairs of settled ones. Tokens of at most FEW sets need no such step. In the join, tokens meet
within classes of size.

Null and empty texts have no lines to compare and come back as they are. Rows with a null id keep all lines and take
none away. Rows that repeat an id share their places, and the later line of two with one place is not removed for it.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

from cellarline.llm.common import doc_texts, free_name, stored

#: Blanks that are not the one that words are split at; a line feed ends a line.
OTHER_BLANKS = "\t\x0b\f\r"
#: Places of the table of token counts, a rank of 7 bits each, and the bits of a token's hash behind its rank in a key.
PLACES = 1 << 16
HASH_BITS = 56
#: Parts in which the tokens are shuffled, one by one, so that not all postings lie on disk at once.
ROUNDS = 2
#: Most names of sets that are broadcast to fetch their tokens (32 MB); beyond, the documents are joined.
BROADCAST_SETS = 1 << 22
#: Hashes hardly repeat, so a dictionary of them is only tried and given up.
HASHES = ("prefix.list.element", "k", "set", "lh", "sig", "half")
stored_hashes = partial(stored, options={f"parquet.enable.dictionary#{column}": "false" for column in HASHES})
#: Most bits of a set's number that is packed from the id of its document and the number of its line.
NUMBER_BITS = 62
#: A token of at most so many sets has no hub: its pairs are at most FEW / 2 for each of its postings.
FEW = 32
#: Most hubs that are broadcast (about 40 MB); beyond, the postings are shuffled to them.
BROADCAST_HUBS = 1 << 19


def exploded(docs: DataFrame) -> DataFrame:
    """``id``, ``line_no``, ``line`` of the lines of documents that have an id."""
    return docs.where("id IS NOT NULL").select("id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def plain(line: Column) -> Column:
    """The line with spaces as its only blanks: splitting at one character is much faster than at a class of them."""
    # Four searches for a byte take a quarter of the time of one for a class of characters.
    any_other = reduce(Column.__or__, [F.contains(line, F.lit(blank)) for blank in OTHER_BLANKS])
    return F.when(any_other, F.translate(line, OTHER_BLANKS, " " * len(OTHER_BLANKS))).otherwise(line)


def token_set(line: Column) -> Column:
    """Hashes of the line's distinct tokens."""
    hashes = F.transform(F.split(plain(line), " "), lambda w: F.xxhash64(w))
    return F.array_remove(F.array_distinct(hashes), F.xxhash64(F.lit("")))


def rarity_ranks(docs: DataFrame) -> Column:
    """Array with a rank for each place, growing with the logarithm of its count.

    All words are counted by Spark; the driver gets one row for each of the PLACES.
    """
    # Lines need not be told apart here.
    texts = docs.where("id IS NOT NULL").select(F.replace(plain(F.col("text")), F.lit("\n"), F.lit(" ")).alias("text"))
    words = texts.select(F.explode(F.split("text", " ")).alias("w")).where("w <> ''")
    place = F.xxhash64("w").bitwiseAND(F.lit(PLACES - 1)).alias("place")
    counts = words.groupBy(place).agg(F.count("*").alias("n")).collect()
    mean = max(1.0, sum(row["n"] for row in counts) / PLACES)
    ranks = [0] * PLACES
    for row in counts:
        ranks[row["place"]] = min(127, max(0, int(8 * math.log2(4 * row["n"] / mean))))
    # Spark folds this into one array value; of bytes, it stays in the processor's cache.
    return F.split(F.lit(",".join(map(str, ranks))), ",").cast("array<tinyint>")


def by_rarity(tokens: Column, ranks: Column) -> Column:
    """The tokens as longs in order of rarity: rank, then hash."""
    # Every place has a rank. Said so, the longs are sorted as such and not as objects.
    rank = lambda h: F.coalesce(F.get(ranks, h.bitwiseAND(F.lit(PLACES - 1)).cast("int")), F.lit(0).cast("tinyint"))
    key = lambda h: F.shiftleft(rank(h).cast("long"), HASH_BITS).bitwiseOR(h.bitwiseAND(F.lit((1 << HASH_BITS) - 1)))
    return F.sort_array(F.transform(tokens, key))


def signature(tokens: Column, counts: Callable[[Column], Column] = lambda h: F.lit(1).cast("long")) -> Column:
    """64 bits, each the parity of the tokens that hash to it: two sets differ in at least as many tokens as bits.

    Only tokens are in it whose ``counts`` is 1 and not 0.
    """
    bit = lambda h: F.call_function("shiftleft", counts(h), h.bitwiseAND(F.lit(63)).cast("int"))
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda bits, h: bits.bitwiseXOR(bit(h)))


#: The signature of a set and, if it has over LONG tokens, that of half of them by hash (otherwise 0). The XOR of both
#: is that of the other half: by 64 bits alone, any two sets of a hundred tokens pass for similar.
SIGS = ("sig", "half")
LONG = 64


def signatures(tokens: Column) -> list[Column]:
    """The SIGS."""
    half = signature(tokens, lambda h: F.shiftright(h, 6).bitwiseAND(F.lit(1)))
    return [signature(tokens).alias("sig"), F.when(F.size(tokens) > LONG, half).otherwise(F.lit(0).cast("long")).alias("half")]


def apart(a: str, b: str) -> Column:
    """Bits in which the signatures of two postings differ: at most the tokens in which the sets do."""
    both_long = f"abs({a}.size) > {LONG} AND abs({b}.size) > {LONG}"
    halves = f"bit_count({a}.half ^ {b}.half) + bit_count({a}.sig ^ {b}.sig ^ {a}.half ^ {b}.half)"
    return F.expr(f"IF({both_long}, {halves}, bit_count({a}.sig ^ {b}.sig))")


#: Words of the wide signature, for lines so long that the others tell nothing.
WIDE = 8


def wide_signature(tokens: Column) -> Column:
    """A signature of WIDE x 64 bits, as an array."""
    own = lambda w: F.filter(tokens, lambda h: F.shiftright(h, 6).bitwiseAND(F.lit(WIDE - 1)) == w)
    return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(WIDE - 1).cast("long")), lambda w: signature(own(w)))


def with_prefix(lines: DataFrame, ranks: Column, permille: int) -> DataFrame:
    """``k`` (names the set), ``size``, the SIGS and ``prefix`` in place of the ``tokens``; size 0 if there are none.

    The prefix is empty if only an equal set is similar.
    """
    size = F.size("tokens").cast("long")
    ordered = lines.withColumn("size", size).withColumn("ordered", by_rarity(F.col("tokens"), ranks))
    prefix_end = F.expr(f"IF(size * {1000 - permille} < {permille}, 0, cast(size - ({permille} * size + 999) div 1000 + 1 as int))")
    # 31 bits of the hash do for meeting: who meets by chance fails the check.
    short = lambda t: t.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")
    return ordered.select(
        *[c for c in lines.columns if c != "tokens"],
        F.xxhash64("ordered").alias("k"),
        "size",
        *signatures(F.col("tokens")),
        F.transform(F.slice("ordered", 1, prefix_end), short).alias("prefix"),
    )


def index_end(size: str, permille: int) -> str:
    """Length of the index prefix: of two similar sets, it is enough for the smaller one (or either of two equal size)."""
    return f"({size} - ({2 * permille} * {size} + {999 + permille}) div {1000 + permille} + 1)"


def may_be_similar(permille: int, a: str, b: str) -> Column:
    """The length, positional and signature filters on two postings."""
    size, other = f"abs({a}.size)", f"abs({b}.size)"
    length = F.expr(f"1000 * {size} >= {permille} * {other} AND 1000 * {other} >= {permille} * {size}")
    # The least overlap is permille * (sum of sizes) / (1000 + permille), rounded up; many pairs pass here, so no divisions.
    enough = lambda most: most * (1000 + permille) >= F.expr(f"{permille} * ({size} + {other})")
    rest = F.least(F.expr(f"{size} - {a}.at"), F.expr(f"{other} - {b}.at"))
    return length & enough(F.shiftright(F.expr(f"{size} + {other}") - apart(a, b), 1)) & enough(rest)


def postings(sets: DataFrame) -> DataFrame:
    """``k``, ``size``, the SIGS, and ``at``, ``token`` of each prefix token of the ``sets``."""
    return sets.select("k", "size", *SIGS, F.posexplode("prefix").alias("at", "token"))


def hubs_of(sets: DataFrame) -> DataFrame:
    """The posting of the first set of each prefix token that over FEW sets have; its token is named ``of``."""
    # A smallest number needs no sort of the postings, as a smallest struct does; the rest of the hub's posting is looked up.
    by_token = sets.select("k", F.explode("prefix").alias("token")).groupBy("token").agg(F.min("k").alias("first"), F.count("*").alias("n"))
    heavy = stored(by_token.where(F.col("n") > FEW).select(F.col("token").alias("of"), "first"), "heavy-tokens")
    heavy = F.broadcast(heavy) if heavy.count() <= BROADCAST_HUBS else heavy
    at = F.array_position("prefix", F.col("of")).cast("int") - 1
    return stored(sets.join(heavy, F.col("k") == F.col("first")).select("of", "k", "size", *SIGS, at.alias("at")), "hubs")


def hub_pairs(sets: DataFrame, permille: int) -> DataFrame:
    """Pairs ``k``, ``k2``: each set beside the hubs of its prefix tokens. Linear in the postings."""
    hubs, posts = hubs_of(sets), postings(sets)
    meet = (F.col("m.token") == F.col("h.of")) & (F.col("m.k") != F.col("h.k")) & may_be_similar(permille, "m", "h")
    pairs = lambda posts, hubs: posts.alias("m").join(hubs.alias("h"), meet).select(F.col("h.k").alias("k"), F.col("m.k").alias("k2")).distinct()
    if hubs.count() <= BROADCAST_HUBS:
        return pairs(posts, F.broadcast(hubs))
    return in_rounds(posts, lambda part: pairs(part, hubs), "hub-rounds")


def size_class(size: str) -> Column:
    """Two classes between a power of two and the next; any rule would do by which the larger has no smaller class."""
    return F.floor(2 * F.log2(F.expr(size))).cast("int")


def open_pairs(posts: DataFrame, permille: int) -> DataFrame:
    """Pairs ``k``, ``k2`` (with ``apart``) of sets that share a prefix token and pass the filters; the later one is open.

    A set that is not open has its size below 0. The smaller one, by size and ``k``, comes with its index prefix only.
    """
    # The smaller one looks into each class that has sizes which the length and positional filters let pass.
    most = f"least(1000 * abs(size) div {permille}, ((abs(size) - at) * {1000 + permille}) div {permille} - abs(size))"
    classes = F.sequence(size_class("abs(size)"), size_class(f"greatest(abs(size), {most})"))
    meeting = lambda size: (F.col("token").cast("long") * 64 + size).alias("meeting")
    index = posts.where(F.expr(f"at < {index_end('abs(size)', permille)}")).withColumn("class", F.explode(classes))
    a = index.select("k", "size", *SIGS, "at", meeting(F.col("class"))).alias("a")
    b = posts.select("k", "size", *SIGS, "at", meeting(size_class("abs(size)"))).alias("b")
    smaller = F.expr("abs(a.size) < abs(b.size) OR abs(a.size) = abs(b.size) AND a.k < b.k")
    open_later = F.expr("IF(a.k < b.k, b.size, a.size) > 0")
    found = a.join(b, (F.col("a.meeting") == F.col("b.meeting")) & smaller & may_be_similar(permille, "a", "b") & open_later)
    return found.select(F.least("a.k", "b.k").alias("k"), F.greatest("a.k", "b.k").alias("k2"), apart("a", "b").alias("apart")).distinct()


def in_rounds(posts: DataFrame, pairs_of: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """The pairs of all postings, made from those of one part of the tokens after the other."""
    parts = [stored(pairs_of(posts.where(F.pmod("token", F.lit(ROUNDS)) == part)), f"{name}-part-{part}") for part in range(ROUNDS)]
    return stored(reduce(DataFrame.union, parts).distinct(), name)


def tokens_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``k``, ``tokens`` of the ``wanted`` sets (``k``, and ``id``, ``line_no``, ``lh`` of the first line that has it).

    The lines are found by their hash, from a pass over all lines that cuts up only those, or in the documents.
    """
    if wanted.count() <= BROADCAST_SETS:
        hashes = F.broadcast(wanted.select("k", F.col("lh").alias("of")))
        lines = exploded(docs).select("line").join(hashes, F.xxhash64("line") == F.col("of"))
        found = lines.groupBy("k").agg(F.first("line").alias("line"))
        return found.select("k", token_set(F.col("line")).alias("tokens"))
    placed = wanted.groupBy(F.col("id").alias("wid")).agg(F.collect_list(F.struct("line_no", "k", "lh")).alias("wanted"))
    line = F.explode(F.transform("wanted", lambda w: F.struct(w["k"].alias("k"), w["lh"].alias("lh"), F.get(F.split("text", "\n"), w["line_no"]).alias("line"))))
    found = docs.join(placed, F.col("id") == F.col("wid")).select(line.alias("l")).select("l.*").where(F.xxhash64("line") == F.col("lh"))
    return found.select("k", token_set(F.col("line")).alias("tokens")).dropDuplicates(["k"])


def close_enough(pairs: DataFrame, wide: DataFrame, permille: int) -> DataFrame:
    """The ``pairs`` that the wide signatures do not rule out."""
    ours, theirs = wide.withColumnsRenamed({"n": "n1", "w": "w1"}), wide.withColumnsRenamed({"k": "g", "n": "n2", "w": "w2"})
    both = pairs.join(ours, "k").join(theirs, F.col("k2") == F.col("g"))
    least = F.expr(f"({permille} * (n1 + n2) + {999 + permille}) div {1000 + permille}")
    apart = F.expr("aggregate(zip_with(w1, w2, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")
    return both.where(apart <= F.col("n1") + F.col("n2") - 2 * least).select("k", "k2")


def alike(pairs: DataFrame, sets: DataFrame, permille: int) -> DataFrame:
    """``k2`` of the ``pairs`` (``k``, ``k2``) whose sets reach the similarity."""
    ours, theirs = sets.withColumnRenamed("tokens", "t1"), sets.withColumnsRenamed({"k": "g", "tokens": "t2"})
    both = pairs.join(ours, "k").join(theirs, F.col("k2") == F.col("g"))
    common = F.size(F.array_intersect("t1", "t2"))
    return both.where(1000 * common >= permille * (F.size("t1") + F.size("t2") - common)).select("k2").distinct()


def numbered(docs: DataFrame, lines: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``sets`` with ``k``, a number that grows with ``id`` and ``line_no``.

    Whole-numbered ids that do not repeat and the number of the line are packed into one long if they fit; otherwise
    the sets are sorted.
    """
    if docs.schema["id"].dataType in (LongType(), IntegerType()):
        # Decimals, because the difference of two longs may be none.
        span = (F.max("id").cast("decimal(20)") - F.min("id").cast("decimal(20)")).alias("span")
        ends = lines.agg(F.min("id").alias("least"), span, F.max("line_no").alias("last")).first()
        bits = int(ends["last"] or 0).bit_length()
        if ends["least"] is not None and int(ends["span"]).bit_length() + bits <= NUMBER_BITS and not docs.where("id IS NOT NULL").groupBy("id").count().where("count > 1").take(1):
            number = F.shiftleft(F.col("id").cast("long") - F.lit(ends["least"]), bits)
            return sets.withColumn("k", number.bitwiseOR(F.col("line_no").cast("long")))
    return sets.orderBy("id", "line_no").withColumn("k", F.monotonically_increasing_id())


def removed_lines(docs: DataFrame, similarity: float) -> DataFrame:
    """``id``, ``line_no``, ``lh`` (hash of the line) of lines that repeat an earlier one."""
    permille = round(similarity * 1000)
    if not 0 < permille <= 1000:
        raise ValueError("similarity is above 0 and at most 1")
    keyed = exploded(docs).select("id", "line_no", F.xxhash64("line").alias("lh"), token_set(F.col("line")).alias("tokens"))
    # Filtered behind the write: before it, the filter would make every set of tokens a second time.
    lines = stored_hashes(with_prefix(keyed, rarity_ranks(docs), permille), "lines").where("size > 0")
    first = F.min(F.struct("id", "line_no", "lh")).alias("first")
    sets = lines.groupBy("k").agg(first, (F.count("*") > 1).alias("several"), *[F.first(c).alias(c) for c in ("size", *SIGS, "prefix")])
    # From here on a set is named by a number that grows with the place of its first line.
    sets = sets.select(F.col("k").alias("set"), "first.*", "size", *SIGS, "several", "prefix")
    sets = stored_hashes(numbered(docs, lines, sets), "line-sets")
    firsts = sets.select("k", "id", "line_no", "lh")

    def fetched(pairs: DataFrame, name: str) -> DataFrame:
        names = pairs.select("k").union(pairs.select("k2")).distinct()
        names = F.broadcast(names) if 2 * pairs.count() <= BROADCAST_SETS else names
        wanted = stored(firsts.join(names, "k"), f"{name}-wanted")
        return stored(tokens_of(docs, wanted), f"{name}-tokens")

    # First every set beside the first one of each of its common tokens: what matches there needs no other match, so a group of
    # thousands of like lines is settled by as many pairs as it has members, and not by all pairs.
    near_hubs = stored(hub_pairs(sets.select("k", "size", *SIGS, "prefix"), permille), "hub-pairs")
    at_hubs = stored(alike(near_hubs, fetched(near_hubs, "hubs"), permille), "matched-at-hubs")

    # What is settled stays as the earlier line of others.
    settled = sets.join(at_hubs.withColumnRenamed("k2", "done"), F.col("k") == F.col("done"), "left")
    signed = F.when(F.col("done").isNull(), F.col("size")).otherwise(-F.col("size")).alias("size")
    pairs = in_rounds(postings(settled.select("k", signed, *SIGS, "prefix")), lambda posts: open_pairs(posts, permille), "line-pairs")
    tokens = fetched(pairs, "pairs")
    # One earlier match is enough: the likeliest is looked at first, the others only where it fails.
    likeliest = pairs.groupBy("k2").agg(F.min(F.struct("apart", "k")).alias("m")).select("m.k", "k2")
    at_once = stored(alike(likeliest, tokens, permille), "matched-lines")
    rest = stored(pairs.select("k", "k2").join(at_once, "k2", "left_anti"), "rest-pairs")
    needed = tokens.join(rest.select("k").union(rest.select("k2")).distinct(), "k", "left_semi")
    wide = stored(needed.select("k", F.size("tokens").cast("long").alias("n"), wide_signature(F.col("tokens")).alias("w")), "wide")
    left = stored(close_enough(rest, wide, permille), "left-pairs")
    matched = at_hubs.union(at_once).union(alike(left, tokens, permille)).select(F.col("k2").alias("of"), F.lit(True).alias("matched"))
    # A line that has a set of its own and no match stays.
    fate = sets.select("set", "k", "id", "line_no", "several").join(matched, F.col("k") == F.col("of"), "left").where("several OR matched")
    fate = stored(fate.select(F.col("set").alias("k"), "id", "line_no", F.coalesce("matched", F.lit(False)).alias("matched")), "line-fate")
    fate = fate.select(F.col("k").alias("g"), F.col("id").alias("id1"), F.col("line_no").alias("line1"), "matched")
    later = F.struct("id", "line_no") > F.struct("id1", "line1")
    return lines.select("id", "line_no", "lh", "k").join(fate, F.col("k") == F.col("g")).where(F.col("matched") | later).select("id", "line_no", "lh")


def dedup_lines(docs: DataFrame, *, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated lines taken out of its text, and the columns ``_lines`` and ``_lines_removed``.

    A column of the documents that has one of these names stays; the new one gets an underscore more.
    """
    texts = doc_texts(docs, id_col, text_col)
    found = removed_lines(texts, similarity)
    count, removed_count = (free_name(docs.columns, name) for name in ("_lines", "_lines_removed"))
    gone, gone_id = (free_name([*docs.columns, count, removed_count], name) for name in ("_gone", "_gone_id"))
    # As many as a document has lines.
    by_doc = stored(found.groupBy(F.col("id").alias(gone_id)).agg(F.collect_set(F.struct("line_no", "lh")).alias(gone)), "removed-lines")
    lines = F.split(F.col(f"`{text_col}`"), "\n")
    joined = docs.join(by_doc, F.col(f"`{id_col}`") == F.col(gone_id), "left")
    rest = F.filter(lines, lambda line, n: ~F.array_contains(gone, F.struct(n.alias("line_no"), F.xxhash64(line).alias("lh"))))
    stay = free_name([*docs.columns, count, removed_count, gone, gone_id], "_stay")
    joined = joined.select(*[F.col(f"`{c}`") for c in docs.columns], gone, F.size(lines).alias(count), F.when(F.col(gone).isNotNull(), rest).alias(stay))
    return joined.select(
        *[F.col(f"`{c}`") for c in docs.columns if c != text_col],
        F.when(F.col(gone).isNull(), F.col(f"`{text_col}`")).otherwise(F.array_join(stay, "\n")).alias(text_col),
        F.when(F.col(f"`{text_col}`").isNull(), 0).otherwise(F.col(count)).cast("long").alias(count),
        F.when(F.col(gone).isNull(), 0).otherwise(F.col(count) - F.size(stay)).cast("long").alias(removed_count),
    ).select(*[F.col(f"`{c}`") for c in docs.columns], count, removed_count)


def line_digest(docs: DataFrame) -> DataFrame:
    found = dedup_lines(docs.select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.col("_lines").alias("n_lines"),
        F.col("_lines_removed").alias("n_removed"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


#: The same by counting the common words of every pair of different lines.
SQL = """
WITH split AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS line_no
  FROM documents WHERE doc_id IS NOT NULL
), sets AS (
  SELECT doc_id, line_no, list_sort(list_distinct(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+'))) AS words FROM split
), firsts AS (
  SELECT words, len(words) AS n, min((doc_id, line_no)) AS place, row_number() OVER () AS k
  FROM sets WHERE len(words) > 0 GROUP BY words
), posts AS (
  SELECT k, n, place, unnest(words) AS word FROM firsts
), common AS (
  SELECT b.k, a.n AS n1, b.n AS n2, count(*) AS c FROM posts a JOIN posts b ON a.word = b.word AND a.place < b.place
  GROUP BY a.k, b.k, a.n, b.n
), matched AS (
  SELECT DISTINCT k FROM common WHERE 1000 * c >= 800 * (n1 + n2 - c)
), gone AS (
  SELECT DISTINCT doc_id, line_no FROM sets JOIN firsts USING (words)
  WHERE (doc_id, line_no) > place OR k IN (SELECT k FROM matched)
), kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM split ANTI JOIN gone USING (doc_id, line_no)
  GROUP BY doc_id
), counted AS (
  SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(kept.text, '')) END AS kept_sha256
FROM documents d LEFT JOIN kept ON d.doc_id = kept.doc_id LEFT JOIN counted ON d.doc_id = counted.doc_id
"""
