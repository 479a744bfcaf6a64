"""Packing of tokenised documents into sequences of at most ``size`` tokens by the sum-of-squares rule.

A document is its token ids and an end id. One longer than ``size`` is cut from its end, so that only its first piece is
shorter than ``size``. A piece goes into that open sequence with room for it by which the sum, over all residual gaps, of
the squared number of open sequences with that gap becomes smallest; ties go to the smallest gap. Pieces are placed in
order of falling length. A sequence is opened only where no open one has room: opening wherever it lowers the squares
took 1 to 4 % more sequences, this rule about as many as best fit in falling order.

The rule is sequential, so pieces are dealt by a hash of their row number into shards of about ``per_shard`` pieces, and
each is packed by one task that holds lengths only. A shard ends with a few open sequences whatever its size. Tokens are
written once and are not moved by the packing; ``sequences`` brings them together.

Null and empty texts are just the end id. Rows with a null id, repeated ids and repeated rows are documents of their
own. Strings of special tokens in a text are ordinary text. Long texts are encoded in parts, cut where no token can
reach across.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cellarline.llm.common import doc_texts, stored

SIZE, END = 1024, 2
PER_SHARD = 1 << 17
#: Characters of a text that are encoded at once.
PART = 1 << 20
#: Between a letter or digit, one blank and a letter or digit, every tokenizer of this pattern cuts before the blank.
SAFE = re.compile(r"[A-Za-z0-9](?= [A-Za-z0-9])")

_encoders: dict[int, tiktoken.Encoding] = {}


def byte_of_character() -> dict[str, int]:
    """The character by which byte-level vocabularies write each byte: itself if it shows, else the next one from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def ranks_of(path: str) -> dict[bytes, int]:
    """Bytes and id of every ordinary token of a byte-level tokenizer file; ids are in the order of merges."""
    tokenizer, byte_of = Tokenizer.from_file(path), byte_of_character()
    special = tokenizer.get_added_tokens_decoder()
    words = tokenizer.get_vocab(with_added_tokens=False)
    return {bytes(byte_of[c] for c in word): k for word, k in words.items() if k not in special}


def encoder(ranks: dict[bytes, int]) -> tiktoken.Encoding:
    """One encoder for each vocabulary and worker; it encodes several times faster than the library of the file."""
    key = hash(frozenset(ranks.items()))
    if key not in _encoders:
        _encoders[key] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def parts_of(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PART and (cut := SAFE.search(text, at + PART)):
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:]


def piece_starts(count: int, size: int) -> np.ndarray:
    """Where the pieces of ``count`` tokens begin."""
    if count <= size:
        return np.zeros(1, np.int64)
    first = count % size
    return np.concatenate([np.zeros(1 if first else 0, np.int64), np.arange(first, count, size)])


def pieces_of(docs: DataFrame, path: str, size: int, end: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``piece``, ``start``, ``length``, ``tokens`` (little-endian, 4 bytes each) of every document."""
    texts = doc_texts(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(ranks_of(path))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared.value).encode_ordinary
        for batch in batches:
            rows, numbers, starts, lengths, tokens = [], [], [], [], []
            for row, text in enumerate(batch.column("text")):
                ids = [np.array(encode(part), "<u4") for part in parts_of(text.as_py() or "")]
                data = np.concatenate([*ids, np.array([end], "<u4")])
                begin = piece_starts(len(data), size)
                for number, (a, b) in enumerate(zip(begin.tolist(), [*begin[1:].tolist(), len(data)], strict=True)):
                    rows.append(row)
                    numbers.append(number)
                    starts.append(a)
                    lengths.append(b - a)
                    tokens.append(data[a:b].tobytes())
            if rows:
                columns = [pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(tokens, pa.binary())]
                names = ["id", "piece", "start", "length", "tokens"]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows)), *columns], names)

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(cut, f"id {kind}, piece int, start bigint, length bigint, tokens binary")


def sum_of_squares(lengths: list[int], size: int) -> list[list[int]]:
    """Sequences, as lists of places in ``lengths``, filled in the given order."""
    count = np.zeros(size + 1, np.int64)  # of open sequences by gap; full ones are not open
    open_by_gap: list[list[int]] = [[] for _ in range(size + 1)]
    sequences: list[list[int]] = []
    never = np.iinfo(np.int64).max
    for place, length in enumerate(lengths):
        grown = 2 * count[: size - length + 1] + 1
        grown[0] = 0
        # (n+1)^2 - n^2 for the gap that comes, (n-1)^2 - n^2 for the one that goes.
        change = np.where(count[length:] > 0, grown - 2 * count[length:] + 1, never)
        left = int(change.argmin())
        if change[left] < never:
            at = open_by_gap[left + length].pop()
            count[left + length] -= 1
            sequences[at].append(place)
        else:
            at, left = len(sequences), size - length
            sequences.append([place])
        if left:
            count[left] += 1
            open_by_gap[left].append(at)
    return sequences


def packed(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Sequences of all places, longest pieces first."""
    order = np.argsort(-lengths, kind="stable")
    return [order[s].tolist() for s in sum_of_squares(lengths[order].tolist(), size)]


def placed(pieces: DataFrame, size: int = SIZE, per_shard: int = PER_SHARD) -> DataFrame:
    """``pieces`` (with ``row``, a number of their own, and ``length``) with ``sequence_id`` and ``offset``."""
    shards = max(1, -(-pieces.count() // per_shard))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))

    def place(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("row")
        lengths = table.column("length").to_numpy()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for number, members in enumerate(packed(lengths, size)):
            sequence[members] = number
            offset[members] = np.cumsum(lengths[members]) - lengths[members]
        sequence += table.column("shard")[0].as_py() << 32
        return table.drop_columns(["shard"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return dealt.groupBy("shard").applyInArrow(place, pieces.schema.add("sequence_id", "long").add("offset", "long"))


def written_pieces(
    docs: DataFrame, path: str | None = None, *, size: int = SIZE, end: int = END, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``pieces_of`` the documents, written with a ``row`` number for each."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    return stored(pieces_of(docs, path, size, end, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "pieces")


def sequences(pieces: DataFrame, places: DataFrame) -> DataFrame:
    """``sequence_id``, ``length``, ``tokens``, ``parts`` (id, piece, offset, length) of every packed sequence."""
    both = pieces.select("row", "tokens").join(places.select("row", "id", "piece", "length", "sequence_id", "offset"), "row")
    parts = F.sort_array(F.collect_list(F.struct("offset", "id", "piece", "length", "tokens"))).alias("parts")
    found = both.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts)
    tokens = F.aggregate("parts", F.lit(b""), lambda all_, part: F.concat(all_, part["tokens"])).alias("tokens")
    without = F.transform("parts", lambda p: F.struct(p["id"].alias("id"), p["piece"].alias("piece"), p["offset"].alias("offset"), p["length"].alias("length")))
    return found.select("sequence_id", "length", tokens, without.alias("parts"))


def packed_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    pieces = written_pieces(docs, path)
    light = pieces.select("row", "id", "piece", "start", "length", F.crc32("tokens").alias("ids_crc32"))
    found = placed(light)
    return found.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
