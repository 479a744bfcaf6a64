"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts are taken over all training rows by Spark; what the driver gets is one row per language and n-gram bucket,
so its size is languages x buckets whatever the corpus. The matrix of log probabilities is broadcast and documents
are scored in batches with numpy.

A text that is null or has no letter (Unicode category L; digits, fractions and numerals are none) gets ``und`` with score 0; so does every text if there are no training rows.
Training rows without a language or text are left out. Ties go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellarline.llm.common import doc_texts, map_batches

UNKNOWN = "und"
#: Characters handled at once; bounds the arrays of a batch.
CHUNK = 1 << 20
#: Largest matrix (languages x buckets) that is gathered and broadcast: 32 M doubles are 256 MB.
LARGEST_MATRIX = 1 << 25


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    log_prob: np.ndarray  # buckets x languages
    log_prior: np.ndarray
    orders: tuple[int, ...]


def gram_buckets(texts: list[str], orders: tuple[int, ...], bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, buckets, place of each text's first bucket) for groups of texts; whole texts, lower-cased.

    A text is set between blanks, so that n-grams see where it begins and ends, and none spans two texts. A text of more
    than CHUNK characters comes in parts, each a group under the text's own number, that together have its n-grams.
    """
    at, longest = 0, max(orders)
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK):
            size += len(texts[end])
            end += 1
        framed = [f" {text.lower()} " for text in texts[at:end]]
        for begin in range(0, max(map(len, framed)) if end == at + 1 else 1, CHUNK):
            buckets, starts, filled = [], [], 0
            for text in framed:
                # All n-grams that begin in this part; those of other parts begin elsewhere.
                own = min(CHUNK, len(text) - begin) if end == at + 1 else len(text)
                part = text[begin : begin + own + longest - 1]
                codes = np.frombuffer(part.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
                starts.append(filled)
                for order in orders:
                    n = min(own, len(codes) - order + 1)
                    if n <= 0:
                        continue
                    mixed = np.full(n, order, np.uint64)
                    for k in range(order):
                        mixed = (mixed ^ codes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
                        mixed ^= mixed >> np.uint64(32)
                    buckets.append((mixed & np.uint64((1 << bits) - 1)).astype(np.int64))
                    filled += n
            if filled:
                yield at, np.concatenate(buckets), np.array(starts)
        at = end


def learn(
    rows: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    orders: tuple[int, ...] = (1, 2, 3),
    bits: int = 15,
    smoothing: float = 0.5,
) -> Model:
    """A model of all ``rows``; ``bits`` gives 2**bits buckets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        documents: dict[str, int] = {}
        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                documents[lang] = documents.get(lang, 0) + len(texts)
                total = totals.setdefault(lang, np.zeros(1 << bits, np.int64))
                for _, buckets, _ in gram_buckets(texts, orders, bits):
                    total += np.bincount(buckets, minlength=1 << bits)
        for lang, total in totals.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * (len(used) + 1)),
                    pa.array(np.append(used, -1).astype(np.int32)),
                    pa.array(np.append(total[used], documents[lang])),
                ],
                ["lang", "bucket", "n"],
            )

    known = rows.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text")).dropna()
    counts = known.mapInArrow(count, "lang string, bucket int, n bigint")
    sums = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = sums.limit(LARGEST_MATRIX + 1).toPandas()
    if len(table) > LARGEST_MATRIX:
        raise ValueError("too many languages for this number of buckets: lower bits")
    languages = tuple(sorted(table["lang"].unique()))
    column = table["lang"].map({lang: k for k, lang in enumerate(languages)}).to_numpy(int)
    grams = (table["bucket"] >= 0).to_numpy(bool)
    counted = np.zeros((1 << bits, len(languages)))
    counted[table["bucket"].to_numpy()[grams], column[grams]] = table["n"].to_numpy()[grams]
    documents = np.zeros(len(languages))
    documents[column[~grams]] = table["n"].to_numpy()[~grams]
    smooth = counted + smoothing
    prior = np.log(documents / documents.sum()) if len(languages) else documents
    return Model(languages, np.log(smooth / smooth.sum(axis=0)), prior, orders)


def score_texts(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and its posterior probability for each text."""
    bits = int(model.log_prob.shape[0]).bit_length() - 1
    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    places = [k for k, text in enumerate(texts) if text and any(map(str.isalpha, text))] if model.languages else []
    lettered = [texts[k] for k in places]
    total = np.zeros((len(lettered), len(model.languages))) + model.log_prior
    for first, buckets, starts in gram_buckets(lettered, model.orders, bits):
        # The parts of a long text add up; a matrix of a part's n-grams by languages is all that is held.
        total[first : first + len(starts)] += np.add.reduceat(model.log_prob[buckets], starts, axis=0)
    if len(lettered):
        best = total.argmax(axis=1)
        chance = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        for k, place in enumerate(places):
            names[place], scores[place] = model.languages[best[k]], chance[k]
    return names, scores


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``lang_pred``, ``score`` of each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, scores = score_texts(shared.value, batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(names, pa.string()), pa.array(scores)], ["id", "lang_pred", "score"]
        )

    texts = doc_texts(docs, id_col, text_col)
    return map_batches(texts, step, f"id {texts.schema['id'].dataType.simpleString()}, lang_pred string, score double")


def held_out_languages(docs: DataFrame, parts: int = 5, held: int = 0) -> DataFrame:
    """Predictions for all documents; those whose crc32 of the id leaves ``held`` take no part in learning."""
    out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(parts)) == held
    model = learn(docs.where(~F.coalesce(out, F.lit(True))))
    found = identify(docs, model)
    out = F.pmod(F.crc32(F.col("id").cast("string")), F.lit(parts)) == held
    return found.select(
        F.col("id").alias("doc_id"), F.coalesce(out, F.lit(True)).alias("held_out"), "lang_pred", "score"
    )
