"""SentencePiece encoding and decoding with a relational lattice of words.

Text becomes units that no piece reaches across: a run of word marks with what follows it, and control characters by
themselves. The units that make up most of a corpus are few: the ``frequent`` most used ones are encoded as a lattice by
Spark. Their bounded substrings are exploded and equi-joined to the piece table, the edges are grouped by unit, and a
higher-order ``aggregate`` folds over them. Their ids are a table of bounded size, which is broadcast. Other units are
rare, each is met a few times only: they are encoded by the same rule inside the task that meets them, as dealing every
rare word of a corpus to a lattice and back took more shuffle and time than the text itself.

For a unigram model the rule is Viterbi. A model of the BPE type is defined by merges in the order of scores, which the
best path does not reproduce; for it the fold merges over the same edges, so that ids are those of the model's own
library.

Null texts have null ids and null decoded text; empty texts have no ids. Rows with a null id and repeated rows are
encoded like others. Characters outside the pieces are encoded as their bytes (or as unknown, if the model has no
bytes). Encoding then decoding gives the text back, except that the word mark reads as a blank.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellarline.llm.common import doc_texts, map_batches, stored

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNIGRAM, BPE = 1, 2
#: Units of the broadcast table, and the most characters of one.
FREQUENT_UNITS, FREQUENT_CHARS = 1 << 17, 64
#: Most pieces of a model; the piece table is broadcast.
MOST_PIECES = 1 << 20


@dataclass(frozen=True)
class Model:
    kind: int
    pieces: dict[str, tuple[int, float]]  # normal pieces: id and score
    bytes: tuple[int, ...]  # ids of the 256 byte pieces, or none
    unknown: int
    unknown_score: float
    texts: tuple[str, ...]  # what every id reads as, but for bytes beyond ASCII
    high_byte: np.ndarray  # of every id: is it such a byte?
    dummy_prefix: bool
    scored: dict[str, float]  # normal pieces: score

    @property
    def longest(self) -> int:
        return max(map(len, self.pieces), default=1)


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, data[at : at + size]
            at += size


def load_model(path: str = MODEL_FILE) -> Model:
    """The model file; pieces are read through the public library, its settings from the message around them."""
    with open(path, "rb") as file:
        data = file.read()
    processor = sentencepiece.SentencePieceProcessor(model_proto=data)
    size = processor.get_piece_size()
    if size > MOST_PIECES:
        raise ValueError("the model has too many pieces to broadcast")
    message = dict(fields(data))
    trainer, normalizer = dict(fields(message.get(2, b""))), dict(fields(message.get(3, b"")))
    if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1):
        raise ValueError("only models that keep the text as it is are supported")
    texts = [processor.id_to_piece(k) for k in range(size)]
    special = [processor.is_control(k) or processor.is_unknown(k) or processor.is_byte(k) for k in range(size)]
    used = [k for k in range(size) if not special[k] and not processor.is_unused(k)]
    pieces = {texts[k]: (k, processor.get_score(k)) for k in used}
    if any(len(piece) > 1 and re.search(f"[^{MARK}]{MARK}|[{CUT}]", piece) for piece in pieces):
        raise ValueError("the model has pieces that reach across words")
    of_byte = {texts[k]: k for k in range(size) if processor.is_byte(k)}
    byte_ids = tuple(of_byte[f"<0x{b:02X}>"] for b in range(256)) if len(of_byte) == 256 else ()
    lowest = min((score for _, score in pieces.values()), default=0.0)
    shown = ["" if processor.is_control(k) else " ⁇ " if processor.is_unknown(k) else texts[k] for k in range(size)]
    shown = [text.replace(MARK, " ") for text in shown]
    for byte, k in enumerate(byte_ids[:128]):
        shown[k] = chr(byte)
    high = np.zeros(size, bool)
    high[list(byte_ids[128:])] = True
    return Model(
        trainer.get(3, UNIGRAM), pieces, byte_ids, processor.unk_id(), lowest - 10.0, tuple(shown), high, bool(normalizer.get(3, 1)), {p: s for p, (_, s) in pieces.items()}
    )


#: Control characters but the carriage return, which some pieces hold: each is a unit.
CUT = "\x00-\x0c\x0e-\x1f"
UNITS = re.compile(f"[{CUT}]|{MARK}*[^{MARK}{CUT}]+|{MARK}+")


#: Characters up to which a list is faster than a heap.
SHORT = 64


def units_of(text: str, model: Model) -> list[str]:
    if not text:
        return []
    return UNITS.findall((MARK if model.dummy_prefix else "") + text.replace(" ", MARK))


# The fold over a unit's edges


def unit_ids(unit: Column, edges: Column, model: Model) -> Column:
    """Ids of a unit. ``edges`` maps start x 64 + length to (score, id); starts count from 1."""
    n = F.length(unit)
    edge = lambda start, end: F.try_element_at(edges, start * 64 + (end - start))
    # A lambda has no local names: binding a value is a transform over an array of it.
    bind = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    if model.kind == BPE:

        def merge(cuts: Column, _: Column) -> Column:
            joins = F.transform(
                F.sequence(F.lit(2), F.size(cuts) - 1),
                lambda i: F.struct(
                    edge(F.element_at(cuts, i - 1), F.element_at(cuts, i + 1))["score"].alias("score"),
                    (-F.element_at(cuts, i)).alias("place"),
                ),
            )
            best = F.array_max(F.filter(joins, lambda j: j["score"].isNotNull()))
            merged = lambda b: F.when(b.isNull(), cuts).otherwise(F.filter(cuts, lambda x: x != -b["place"]))
            return F.when(F.size(cuts) < 3, cuts).otherwise(bind(best, merged))

        cuts = F.aggregate(F.sequence(F.lit(1), n), F.sequence(F.lit(1), n + 1), merge)
    else:
        first = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("start")))

        def extend(best: Column, end: Column) -> Column:
            def path(start: Column) -> Column:
                own = F.coalesce(edge(start, end)["score"], F.when(end - start == 1, F.lit(model.unknown_score)))
                return F.struct((F.element_at(best, start)["score"] + own).alias("score"), start.alias("start"))

            paths = F.transform(F.sequence(F.greatest(F.lit(1), end - model.longest), end - 1), path)
            return F.concat(best, F.array(F.array_max(F.filter(paths, lambda p: p["score"].isNotNull()))))

        table = F.aggregate(F.sequence(F.lit(2), n + 1), first, extend)

        def back(cuts: Column, _: Column) -> Column:
            head = F.element_at(cuts, 1)
            return F.when(head == 1, cuts).otherwise(F.concat(F.array(F.element_at(table, head)["start"]), cuts))

        cuts = F.aggregate(F.sequence(F.lit(1), n), F.array(n + 1), back)

    def ids(start: Column, end: Column) -> Column:
        if not model.bytes:
            return F.array(F.coalesce(edge(start, end)["id"], F.lit(model.unknown)))
        code = F.hex(F.encode(F.substring(unit, start, F.lit(1)), "UTF-8"))
        table = F.array(*[F.lit(k) for k in model.bytes])
        digits = F.sequence(F.lit(1), F.length(code), F.lit(2))
        fallback = F.transform(digits, lambda k: F.get(table, F.conv(F.substring(code, k, F.lit(2)), 16, 10).cast("int")))
        return F.when(edge(start, end)["id"].isNull(), fallback).otherwise(F.array(edge(start, end)["id"]))

    places = lambda b: F.transform(F.sequence(F.lit(1), F.size(b) - 1), lambda i: ids(F.element_at(b, i), F.element_at(b, i + 1)))  # noqa: E731, E501
    return F.flatten(bind(cuts, places))


def merged_pieces(unit: str, scored: dict[str, float]) -> list[str]:
    """Pieces of a short unit: the best adjacent pair, the leftmost of equals, is merged until none is a piece."""
    none, score_of = float("-inf"), scored.get
    parts = list(unit)
    scores = [score_of(unit[k : k + 2], none) for k in range(len(unit) - 1)]
    while scores and (best := max(scores)) != none:
        k = scores.index(best)
        parts[k] += parts.pop(k + 1)
        del scores[k]
        if k:
            scores[k - 1] = score_of(parts[k - 1] + parts[k], none)
        if k < len(scores):
            scores[k] = score_of(parts[k] + parts[k + 1], none)
    return parts


class Merges:
    """The merges of a BPE model as sorted arrays, applied to many short units at once.

    A symbol is a piece or a character of one. Every round merges, in each unit that has a pair which makes a piece, the
    best one, the leftmost of equals; only the two pairs beside it are looked up again.
    """

    def __init__(self, model: Model) -> None:
        chars = sorted({c for piece in model.pieces for c in piece}.difference(model.pieces))
        first = len(model.texts)
        self.symbols = {piece: k for piece, (k, _) in model.pieces.items()} | {c: first + k for k, c in enumerate(chars)}
        self.pieces, self.size = first, first + len(chars)
        order = {score: rank for rank, score in enumerate(sorted({score for _, score in model.pieces.values()}, reverse=True))}
        halves = sorted(
            (self.symbols[piece[:cut]] * self.size + self.symbols[piece[cut:]], order[score], k)
            for piece, (k, score) in model.pieces.items()
            for cut in range(1, len(piece))
            if piece[:cut] in self.symbols and piece[cut:] in self.symbols
        )
        self.none = len(order)
        self.keys = np.array([key for key, _, _ in halves] or [-1], np.int64)
        self.ranks = np.array([rank for _, rank, _ in halves] or [self.none], np.int32)
        self.made = np.array([k for _, _, k in halves] or [0], np.int32)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's score, 0 for the best; ``none`` for what is no pair."""
        key = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], self.none)

    def piece_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What each pair makes; all must be pairs."""
        return self.made[np.searchsorted(self.keys, left.astype(np.int64) * self.size + right)]

    def apply(self, units: list[str]) -> list[np.ndarray | None]:
        """Ids of the units' pieces; None for a unit with a character that is no piece, or one that is too long."""
        out: list[np.ndarray | None] = [None] * len(units)
        by_width: dict[int, list[int]] = {}
        for k, unit in enumerate(units):
            if 0 < len(unit) <= SHORT:
                by_width.setdefault(len(unit), []).append(k)
        for width, places in by_width.items():
            for begin in range(0, len(places), 1 << 15):
                part = places[begin : begin + (1 << 15)]
                for k, ids in zip(part, self._merged([units[k] for k in part], width), strict=True):
                    out[k] = ids
        return out

    def _merged(self, units: list[str], width: int) -> list[np.ndarray | None]:
        # One column more than the units are wide, which stays empty. Empty is -2, an unknown character -1.
        symbols = np.full((len(units), width + 1), -2, np.int32)
        get = self.symbols.get
        symbols[:, :-1] = np.fromiter((get(c, -1) for unit in units for c in unit), np.int32, len(units) * width).reshape(-1, width)
        ranks = self.look_up(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(-1, width).astype(np.int32)
        rows, done, left = np.arange(len(units)), np.full_like(symbols, -2), width
        while len(rows):
            best = ranks.argmin(axis=1)
            at = np.arange(len(rows))
            more = ranks[at, best] < self.none
            if not more.all():
                done[rows[~more], : left + 1] = symbols[~more]
                rows, best, symbols, ranks = rows[more], best[more], symbols[more], ranks[more]
                at = np.arange(len(rows))
                if not len(rows):
                    break
            symbols[at, best] = self.piece_of(symbols[at, best], symbols[at, best + 1])
            # What stands behind the merged pair moves up by one; each unit has lost one symbol.
            keep = np.ones(symbols.shape, bool)
            keep[at, best + 1] = False
            symbols = symbols[keep].reshape(len(rows), left)
            keep = keep[:, 1:]
            ranks = ranks[keep].reshape(len(rows), left - 1)
            left -= 1
            if not left:
                break
            here = np.minimum(best, left - 1)
            beside = np.maximum(best - 1, 0)
            last = best == left
            ranks[at, here] = np.where(last, ranks[at, here], self.look_up(symbols[at, here], symbols[at, np.minimum(here + 1, left)]))
            ranks[at, beside] = np.where(best > 0, self.look_up(symbols[at, beside], symbols[at, beside + 1]), ranks[at, beside])
        counts = (done != -2).sum(axis=1)
        known = ((done == -2) | ((done >= 0) & (done < self.pieces))).all(axis=1)
        flat, ends = done[done != -2].astype(np.int32), np.cumsum(counts)
        return [flat[e - n : e] if ok else None for e, n, ok in zip(ends.tolist(), counts.tolist(), known.tolist(), strict=True)]


def rare_ids(unit: str, model: Model) -> list[int]:
    """The same for one unit inside a task: merges by a heap, or the best path over an array."""
    n, pieces = len(unit), model.pieces
    cuts = list(range(n + 1))
    if model.kind == BPE and n <= SHORT:
        return ids_of(merged_pieces(unit, model.scored), model)
    if model.kind == BPE:
        after, before = list(range(1, n + 2)), list(range(-1, n))
        gone, heap = [False] * (n + 1), []

        def offer(middle: int) -> None:
            left, right = before[middle], after[middle]
            if 0 < middle < n and right <= n and (found := pieces.get(unit[left:right])):
                heapq.heappush(heap, (-found[1], left, middle, right))

        for middle in range(1, n):
            offer(middle)
        while heap:
            _, left, middle, right = heapq.heappop(heap)
            if gone[middle] or gone[left] or gone[right] or before[middle] != left or after[middle] != right:
                continue
            gone[middle] = True
            after[left], before[right] = right, left
            offer(left)
            offer(right)
        cuts = [k for k in cuts if not gone[k]]
    else:
        score, start = [0.0] + [-np.inf] * n, [0] * (n + 1)
        for end in range(1, n + 1):
            for begin in range(max(0, end - model.longest), end):
                own = pieces.get(unit[begin:end], (0, model.unknown_score if end - begin == 1 else -np.inf))[1]
                if score[begin] + own >= score[end]:
                    score[end], start[end] = score[begin] + own, begin
        cuts = [n]
        while cuts[-1]:
            cuts.append(start[cuts[-1]])
        cuts.reverse()
    return ids_of([unit[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], model)


def ids_of(parts: list[str], model: Model) -> list[int]:
    out: list[int] = []
    for part in parts:
        if found := model.pieces.get(part):
            out.append(found[0])
        elif model.bytes:
            out += [model.bytes[x] for x in part.encode()]
        else:
            out.append(model.unknown)
    return out


def lattice_ids(units: DataFrame, model: Model) -> DataFrame:
    """``unit``, ``ids`` of the different units in ``units``."""
    spark = units.sparkSession
    rows = [(piece, k, score) for piece, (k, score) in model.pieces.items()]
    names = ("piece", "id", "score")
    table = spark.createDataFrame(pa.table({n: list(v) for n, v in zip(names, zip(*rows, strict=True), strict=True)}))
    table = table.select("piece", F.col("id").cast("int").alias("id"), "score")
    starts = units.select("unit", F.explode(F.sequence(F.lit(1), F.length("unit"))).alias("start"))
    most = F.least(F.lit(model.longest), F.length("unit") - F.col("start") + 1)
    spans = starts.withColumn("size", F.explode(F.sequence(F.lit(1), most)))
    spans = spans.withColumn("span", F.substring("unit", F.col("start"), F.col("size")))
    # One span of each unit stays without a match, so that a unit of unknown characters is not lost.
    found = spans.join(F.broadcast(table), F.col("span") == F.col("piece"), "left")
    found = found.where(F.col("id").isNotNull() | ((F.col("start") == 1) & (F.col("size") == 1)))
    edge = F.struct((F.col("start") * 64 + F.col("size")).alias("key"), F.struct("score", "id").alias("value"))
    edges = found.groupBy("unit").agg(F.map_from_entries(F.collect_list(F.when(F.col("id").isNotNull(), edge))).alias("edges"))
    return edges.select("unit", unit_ids(F.col("unit"), F.col("edges"), model).alias("ids"))


# Documents


def frequent_units(texts: DataFrame, model: Model, most: int) -> DataFrame:
    """``unit`` of about the ``most`` most used units; every task names its own favourites, so what it sends is bounded."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                total.update(units_of(text or "", shared.value))
            if len(total) > 8 * most:
                total = Counter(dict(total.most_common(2 * most)))
        favourites = [(u, n) for u, n in total.most_common(2 * most) if n > 1 and len(u) <= FREQUENT_CHARS]
        for at in range(0, len(favourites), 10_000):
            units, counts = zip(*favourites[at : at + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(units), pa.array(counts)], ["unit", "n"])

    counts = texts.select("text").mapInArrow(count, "unit string, n bigint").groupBy("unit").agg(F.sum("n").alias("n"))
    return counts.orderBy(F.desc("n"), "unit").limit(most).select("unit")


def encode(
    docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT_UNITS
) -> DataFrame:
    """``id``, ``ids`` (array), ``decoded`` of each row of ``docs``."""
    texts = doc_texts(docs, id_col, text_col)
    context = docs.sparkSession.sparkContext
    top = stored(frequent_units(texts, model, frequent), "units")
    known = lattice_ids(top.repartition("unit"), model).toPandas()
    table = dict(zip(known["unit"], map(list, known["ids"]), strict=True))
    shared, encoded = context.broadcast(model), context.broadcast(table)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        model, table, rare = shared.value, encoded.value, {}
        sizes, tokens, decoded = [], [], []
        texts = batch.column("text").to_pylist()
        merges, ahead = merges_of(shared.value), 0
        for at, text in enumerate(texts):
            if at >= ahead:
                # The new units of the next texts, merged together.
                chars, new, waiting = 0, set(), []
                while ahead < len(texts) and chars < AHEAD:
                    chars += len(texts[ahead] or "")
                    waiting.append(units_of(texts[ahead] or "", model))
                    new.update(waiting[-1])
                    ahead += 1
                waiting.reverse()
                if len(rare) > MOST_HELD:
                    rare.clear()
                left = []
                for unit in new.difference(rare):
                    if (ids := table.get(unit)) is None:
                        left.append(unit)
                    else:
                        rare[unit] = ids
                for unit, ids in zip(left, merges.apply(left) if merges else [None] * len(left), strict=True):
                    rare[unit] = rare_ids(unit, model) if ids is None else ids.tolist()
            units = waiting.pop()
            ids = np.fromiter(chain.from_iterable(map(rare.__getitem__, units)), np.int32)
            tokens.append(ids)
            sizes.append(len(ids))
            decoded.append(None if text is None else decode_ids(ids, model))
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        nulls = pa.array([text is None for text in texts])
        lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(tokens)), mask=nulls)
        return pa.RecordBatch.from_arrays([batch.column("id"), lists, pa.array(decoded, pa.string())], ["id", "ids", "decoded"])

    kind = texts.schema["id"].dataType.simpleString()
    return map_batches(texts, step, f"id {kind}, ids array<int>, decoded string")


#: Units whose ids a task keeps while it goes through a batch, and characters of the texts whose new units it merges together.
MOST_HELD, AHEAD = 1 << 19, 4 << 20
_merges: dict[int, Merges] = {}


def merges_of(model: Model) -> Merges | None:
    """The merges of a BPE model, laid out once in each worker."""
    if model.kind != BPE:
        return None
    if id(model) not in _merges:
        _merges.clear()
        _merges[id(model)] = Merges(model)
    return _merges[id(model)]


def decode_ids(ids: np.ndarray, model: Model) -> str:
    """The text of ids: pieces with marks as blanks, bytes as UTF-8, without the blank that encoding put in front."""
    if not model.high_byte[ids].any():
        # ASCII bytes stand for themselves.
        text = "".join(map(model.texts.__getitem__, ids.tolist()))
        return text[1:] if model.dummy_prefix and text.startswith(" ") else text
    texts, byte_of = model.texts, {k: b for b, k in enumerate(model.bytes)}
    out: list[str] = []
    held = bytearray()
    for k in ids.tolist():
        if k in byte_of:
            held.append(byte_of[k])
            continue
        if held:
            out.append(held.decode("utf-8", "replace"))
            held.clear()
        out.append(texts[k])
    if held:
        out.append(held.decode("utf-8", "replace"))
    text = "".join(out)
    return text[1:] if model.dummy_prefix and text.startswith(" ") else text


def encoded_documents(docs: DataFrame, path: str = MODEL_FILE) -> DataFrame:
    found = encode(docs, load_model(path))
    return found.select(F.col("id").alias("doc_id"), F.size("ids").cast("bigint").alias("n_tokens"), "ids", "decoded")
