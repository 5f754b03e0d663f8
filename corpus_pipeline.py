"""From raw documents to encoded training data: quality, recurring lines, near-duplicates, mixture, pieces.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; between stages rows are written as
Parquet and read again. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoquill.llm import line_dedup, mixing, piece_lattice, quality_classifier, simhash
from genoquill.llm.common import made, materialize, release, table

#: Near-duplicates share 0.8 of their shingles of five words or more; see simhash.SIMILARITY.
SHINGLE = 5
MOST_REPEATS = 2.0
#: A line of WORDS words or more; shorter ones are never judged by line dedup.
WORDS = line_dedup.LEAST_WORDS
_LINE = rf"(?m)^[\x20\x09\x0B-\x0D]*(?:[^\x20\x09-\x0D]+[\x20\x09\x0B-\x0D]+){{{WORDS - 1}}}[^\x20\x09-\x0D]"
#: Segmentations of each text that are searched.
BEST = 4


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest-neighbour classifier takes for good."""
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates stay in one document only; documents of which only fragments of fewer than WORDS words a line are left go."""
    left = line_dedup.drop_copies(docs)
    changed = F.col("n_dropped") > 0
    out = left.where(~changed | F.col("text").rlike(_LINE))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id."""
    return simhash.keep_one(docs, width=SHINGLE)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at tempered weights: every document once or more, none more than MOST_REPEATS times."""
    return mixing.mix(docs, repeats=MOST_REPEATS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, and of each document the ids, their number and score of the best segmentation, and the scores of the BEST best."""
    found = piece_lattice.encode_rows(docs.select("doc_id", "source", "text"), n=BEST)
    return found.select("doc_id", "source", F.size("ids").cast("long").alias("n_pieces"), "ids", "score", "scores", "lossless")


STAGES = [("quality classifier", quality), ("line dedup", lines), ("SimHash near-dedup", near_duplicates), ("mixing sources", mixture), ("SentencePiece encoding", pieces)]

#: SQL has neither XXH64 nor the decomposition that the first stage needs; tests hold near-dedup against all pairs and the other stages against what they must keep.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on documents; what a stage wrote beside its result is removed when the result is written."""
    docs = table(spark, sf_dir, "documents")
    before = made()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(spark, docs, since=before)
    return STAGES[-1][1](spark, docs, sf_dir)
