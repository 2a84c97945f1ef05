"""The thin ``opN_<name>`` queries: whole tables in, contract columns out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from geoloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geoloom.llm.mixing import mix_sources

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mix_sources(docs, max_epochs=3.0)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("extra")).alias("taken"))


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query
def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geoloom.llm.pieces import encode_decode

    coded = encode_decode(table(spark, sf_dir, "documents"), piece_model())
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        "agrees",
    )


@query
def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geoloom.llm.pages import main_text

    found = main_text(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


@query
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geoloom.llm.language import identify

    return identify(table(spark, sf_dir, "documents"), modulus=4, held=2)


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geoloom.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), modulus=3, held=1, cut=0.7)


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geoloom.llm.quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), modulus=3, held=1, cut=0.5)


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geoloom.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geoloom.llm.substrings import dedup_substrings

    found = dedup_substrings(table(spark, sf_dir, "documents"), length=13)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op7_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geoloom.llm.setjoin import set_keys
    from geoloom.llm.spotsigs import fingerprint_edits

    def digest(column: str):  # of the ascending signatures, without a string of each
        return F.concat(F.hex(F.size(column)), F.lit("-"), *[F.lower(F.lpad(F.hex(h), 16, "0")) for h in set_keys(column)])

    found = fingerprint_edits(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", "edited_sha256", digest("signatures").alias("fingerprint"), digest("edited_signatures").alias("edited_fingerprint"), "near_edited", "near_next")


@query
def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geoloom.llm.topk import scaled, top_k

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", scaled(F.col("embedding"), 64).alias("v"))
    return top_k(vectors, F.col("vec_id") % 20 == 0, k=20)
