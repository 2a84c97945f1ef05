"""Bounded samples of labelled rows to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from geoloom.llm.common import fold_of


def sample_labelled(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, rows_a_class: int, bytes_a_class: int | None = None) -> DataFrame:
    """(doc_id, text, label, weight) of at most about ``rows_a_class`` rows, and ``bytes_a_class`` bytes of text, of either class outside the held-out fold.

    Classes are sampled at rates of their own; ``weight`` is one over the rate,
    so that weighted classes have the shares that they have among all labels.

    Rows are chosen by hash of their id, so the same ones on every run and
    wherever they lie.  The chosen ids are bounded and go out as a broadcast.
    Where a document has several labels the largest counts.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id"), modulus) != held))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    rates = {value: min(1.0, rows_a_class / n) for value, n in totals.items()}

    def sample(rates: dict) -> DataFrame:
        share = F.lit(1.0)
        for value, rate in rates.items():
            share = F.when(F.col("label") == value, rate).otherwise(share)
        rated = known.withColumn("weight", 1 / share)
        chosen = rated.where(F.pmod(F.xxhash64(F.lit(5), F.col("doc_id")), F.lit(1 << 20)) < share * F.lit(1 << 20))
        return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # about rows_a_class ids of each class

    if bytes_a_class:
        sizes = sample(rates).groupBy("label").agg(F.sum(F.octet_length("text")).alias("n")).collect()
        for r in sizes:
            rates[r["label"]] *= min(1.0, bytes_a_class / max(r["n"] or 0, 1))
    return sample(rates)
