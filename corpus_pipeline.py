"""A corpus pipeline of five stages over ``documents``; each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarline.llm import decontaminate, lines, pieces, quality, simhash
from cellarline.llm.common import free_name, read, stored

#: The SimHash operator's own shingle length and largest distance, as in ``op6_simhash``.
SHINGLE, BITS = 4, 4


def columns_of(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{name}`") for name in docs.columns]


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it is fitted on the labelled ones among ``docs``."""
    model, name = quality.fit(docs, read(spark, sf_dir, "labels")), free_name(docs.columns, "_score")
    return quality.score(docs, model, name=name).where(F.col(name) >= 0.5).select(*columns_of(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat an earlier one; ``n_chars`` is that of the new text."""
    found = lines.dedup_lines(docs, similarity=0.8).select(*columns_of(docs))
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints link at BITS or fewer bits, the first by id; rows without an id stay.

    Rows are told apart by a number that is written with them: of rows that repeat an id each goes with the group of its
    own text, and of equal rows one stays. Null, empty and blank texts are copies of one another.
    """
    row = free_name(docs.columns, "_row")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    named = numbered.where("doc_id IS NOT NULL").select(F.col(row).alias("row"), "doc_id", "text")
    found = simhash.near_duplicates(named, shingle=SHINGLE, radius=BITS, id_col="row")
    placed = stored(named.select("row", "doc_id").join(found.select(F.col("id").alias("of"), "component"), F.col("row") == F.col("of")), "placed")
    first = placed.groupBy("component").agg(F.min(F.struct("doc_id", "row")).alias("first")).select("first.row")
    copies = stored(placed.select("row").join(first, "row", "left_anti").withColumnRenamed("row", "_copy"), "copies")
    return numbered.join(copies, numbered[row] == copies["_copy"], "left_anti").select(*columns_of(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of ``benchmark``."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` and the text decoded from them, of every document."""
    return pieces.encoded_documents(docs)


STAGES = [
    ("quality classifier", classify_quality),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding and decoding", encode),
]

#: The classifier is fitted by iteration and the encoder folds over words: SQL cannot say either.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
