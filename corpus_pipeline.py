"""A corpus pipeline: documents in, token digests out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs.  All but the last return the columns of documents.  The last adds place, a row's position in the mix.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewindow.llm import bpe, mixing, quality, simhash, substring
from tidewindow.llm.names import spare
from tidewindow.runtime import Scratch, settings

#: A document stays from this score of the quality classifier on.
QUALITY = 0.7


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; without labels of both kinds it raises."""
    settings(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    if labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").select("quality").distinct().count() < 2:
        raise ValueError("no labels to learn quality from")
    weights = quality.fit(spark, docs, labels, "quality", 4, 2)
    (score,) = spare(docs, "score")
    return quality.with_score(docs, weights, score).filter(F.col(score) >= QUALITY).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one of smallest id."""
    settings(spark)
    return simhash.one_of_each(docs, Scratch(spark, "near"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document holds go from the text."""
    settings(spark)
    return substring.remove_repeats(docs, Scratch(spark, "repeats"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix: files by name, rows within them."""
    settings(spark)
    return mixing.in_mixed_order(docs, Scratch(spark, "mix"), mixing.tempered(mixing.source_counts(docs)))


def with_position(docs: DataFrame, name: str) -> DataFrame:
    """A column that counts the rows of a table from 0: files by name, rows within them."""
    file, start, at = spare(docs, "file", "start", "at")
    try:
        rows = docs.select("*", F.col("_metadata.file_name").alias(file), F.col("_metadata.row_index").alias(at))
        found = rows.groupBy(file).count().collect()
    except AnalysisException:  # not a table of files: the order it has
        return docs.withColumn(name, F.monotonically_increasing_id())
    starts, n = [], 0
    for r in sorted(found, key=lambda r: (len(r[0]), r[0])):  # part-100000 is after part-99999
        starts.append((r[0], n))
        n += r["count"]
    starts = docs.sparkSession.createDataFrame(starts, f"{file} string, {start} long")
    return rows.join(F.broadcast(starts), file).select(*docs.columns, (F.col(start) + F.col(at)).alias(name))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document, decoded again as proof, and its place in the mix."""
    settings(spark)
    (place,) = spare(docs, "place")
    return bpe.public_codec(spark).digests(with_position(docs, place), "doc_id", "source", place).withColumnRenamed(place, "place")


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeats),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

#: The stages have no SQL form: a trained classifier, XXH64 and BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage in the order of the mix."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs.orderBy("place").drop("place")
