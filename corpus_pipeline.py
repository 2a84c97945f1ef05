"""Training-corpus pipeline over ``documents``: each stage reads what the one before it wrote.

quality classifier -> SimHash near-dedup -> substring dedup -> mixing -> pieces.
All stages but the last return the columns of ``documents``.

Cases, in every stage: columns other than those of ``documents`` are not read,
so clashing names do no harm; texts are read whole, whatever their length; an
empty table gives an empty result.  Null, empty and wordless texts are scored
like any text by the first stage, are copies of each other in the second, stay
as they are in the third, and have size 0, so the mix takes none of them.  Rows
without an id, and rows that share one, are told apart by their texts; repeated
rows are copies of each other.  Ties go to the smaller id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from geoloom.llm.common import materialize, table
from geoloom.llm.mixing import sample_mixture
from geoloom.llm.pieces import encode_decode
from geoloom.llm.quality import keep_good
from geoloom.llm.queries import piece_model
from geoloom.llm.simhash import keep_one
from geoloom.llm.substrings import dedup_substrings

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more; it is fitted on ``labels``, fold 1 of 3 held out."""
    return keep_good(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), modulus=3, held=1, cut=0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id.

    Near copies agree in 0.8 or more of 256 fingerprint bits over shingles of
    five words.  A radius of 51 is beyond the pigeonhole, so buckets are keyed
    by sampled bits: a link at distance 39 (what a similarity of 0.8 on
    shingles comes to) is found with probability 0.9999, one at the very edge,
    51, with 0.98, and groups of copies have many.  Rows without an id and rows
    that share one are told apart by their texts.
    """
    return keep_one(docs.select(*COLUMNS), shingle=5, radius=51, seeds=(42, 43), wide=True, tables=128, key_bits=16)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of windows of 50 that a document with a smaller id has; emptied documents go."""
    kept = dedup_substrings(docs.select(*COLUMNS), length=PASSAGE_WORDS, keep=("doc_id", "lang", "source", "n_chars"))
    changed = F.col("n_removed") > 0
    kept = kept.where(~changed | (F.col("n_words") > F.col("n_removed")))
    return kept.select("doc_id", F.col("deduped").alias("text"), "lang", "source", F.when(changed, F.length("deduped")).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by weights 1, 2, 3, repeating, each up to three times its size; repeated documents are repeated rows."""
    return sample_mixture(docs.select(*COLUMNS), max_epochs=3.0)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, and the decoded text."""
    coded = encode_decode(docs.select(*COLUMNS), piece_model(), keep=("doc_id", "lang", "source"))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


#: Words of a passage whose repetition is removed in the pipeline.
PASSAGE_WORDS = 50

STAGES = [
    ("quality", drop_low_quality),
    ("near_copies", drop_near_copies),
    ("passages", drop_repeated_passages),
    ("mixing", mix),
    ("pieces", to_pieces),
]

#: The classifier and XXH64 fingerprints have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
