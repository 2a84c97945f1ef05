"""Mixing sources to target weights by capped water-filling.

Every source has a weight and a cap of ``max_epochs`` times its own size.
The budget is shared by weight; what exceeds a cap is shared again by weight
among the sources below theirs until no target is above its cap.  The fixed
point of that process has a closed form: with sources in order of the level
``cap / weight`` at which they fill up, the common level is the first
``(budget - caps before) / (weights from here on)`` that does not overfill the
source it stands at.  It needs sorted running sums over one row a source only.

Inside a source the target is ``floor(target / size)`` whole repetitions of
every document; the words that remain go to documents in a seeded order, whole
again, up to the one document at the edge, which is repeated in part.  The
edge is found by running sums over hash buckets, pre-aggregated on the map
side, so no task holds a source, however large.

Cases: a null text has size 0; a null source is a source of its own and sorts
last; sources of size 0 get target 0; rows that share an id are drawn by their
texts; equal rows are told apart by nothing and stand side by side in the
order; texts of any length are counted whole; columns of the input that are
named like an added one give way to it in ``mix_sources``, and all columns
come back from ``sample_mixture``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from geoloom.llm.common import SPACE, WORD, attach, materialize

#: Hash buckets a source is cut into to find the edge of its fractional repetition.
BUCKETS = 4096
SEED = 17
#: What ``mix_sources`` adds.
ADDED = ("size", "source_size", "target", "whole", "extra")


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, text: Column, seed: int) -> Column:
    """The seeded place of a document in its source: 32 hex digits; texts of one id (or of none) spread alike."""
    own = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), own).cast("binary"))


def cyclic_weights(sources: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Weights ``cycle``, repeating, to the sources in code point order, null last."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    values = F.array(*[F.lit(x) for x in cycle])
    return sources.select("source", F.get(values, F.pmod(place, F.lit(len(cycle)))).alias("weight"))


def water_fill(sized: DataFrame, max_epochs: float, budget: float | None = None) -> DataFrame:
    """(source, weight, source_size) -> the same with ``target``; one row a source."""
    every = Window.partitionBy()
    order = Window.orderBy("level", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    total = F.lit(float(budget)) if budget is not None else F.sum("source_size").over(every).cast("double")
    w = F.when(F.col("weight") > 0, F.col("weight"))
    filled = (
        sized.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("level", F.coalesce(F.try_divide(F.col("cap"), w), F.lit(float("inf"))))
        .withColumn("share", F.try_divide(total - F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.sum(w).over(onward).cast("double")))
        .withColumn("common", F.min(F.when(F.col("share") <= F.col("level"), F.struct("level", F.coalesce("source", F.lit("")), "share"))).over(every)["share"])
    )
    open_target = F.least(F.col("cap"), F.col("common") * w)
    return filled.select("source", "weight", "source_size", F.when(w.isNull(), 0.0).otherwise(F.coalesce(open_target, F.col("cap"))).alias("target"))


def plan_mix(docs: DataFrame, weights=cyclic_weights, max_epochs: float = 3.0, budget: float | None = None, seed: int = SEED):
    """Per source: size, target, whole repetitions, and the bucket and words where the fractional one ends."""
    counted = docs.select("source", word_count(F.col("text")).alias("size"), draw(F.col("doc_id"), F.col("text"), seed).alias("drawn"))
    by_bucket = materialize(
        counted.groupBy("source", F.conv(F.substring("drawn", 1, 3), 16, 10).cast("int").alias("bucket")).agg(F.sum("size").alias("words")), "mix-buckets"
    )
    sources = by_bucket.groupBy("source").agg(F.sum("words").alias("source_size"))
    weighted = weights(sources).withColumnRenamed("source", "__s")
    sized = sources.join(weighted, sources["source"].eqNullSafe(weighted["__s"]), "left").select("source", "source_size", F.coalesce("weight", F.lit(0)).alias("weight"))
    filled = water_fill(sized, max_epochs, budget)
    epochs = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size").cast("double"))), F.lit(0)).cast("long")
    filled = filled.withColumn("whole", epochs)
    filled = filled.withColumn("rest", F.floor(F.col("target") - F.col("whole") * F.col("source_size") + F.lit(0.5)).cast("long"))
    one_row = materialize(filled, "mix-sources")
    n = one_row.count()
    running = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
    placed = attach(by_bucket.withColumn("upto", running), one_row, "source", n)
    edge = placed.where(F.col("upto") > F.col("rest")).groupBy("source").agg(F.min(F.struct("bucket", (F.col("rest") - F.col("upto") + F.col("words")).alias("left"))).alias("edge"))
    edge = edge.withColumnRenamed("source", "__s")
    plan = one_row.join(edge, one_row["source"].eqNullSafe(edge["__s"]), "left").select(
        "source", "source_size", "target", "whole", F.coalesce(F.col("edge.bucket"), F.lit(BUCKETS)).alias("edge_bucket"), F.coalesce(F.col("edge.left"), F.lit(0)).alias("edge_words")
    )
    return materialize(plan, "mix-plan"), n


def mix_sources(docs: DataFrame, weights=cyclic_weights, max_epochs: float = 3.0, budget: float | None = None, seed: int = SEED) -> DataFrame:
    """Columns of ``docs`` plus size, source_size, target, whole (repetitions) and extra (words of the fractional one)."""
    plan, n = plan_mix(docs, weights, max_epochs, budget, seed)
    names = [c for c in docs.columns if c not in ADDED]
    inner = docs.select(*names, draw(F.col("doc_id"), F.col("text"), seed).alias("__drawn")).withColumn("__bucket", F.conv(F.substring("__drawn", 1, 3), 16, 10).cast("int"))
    plan = plan.select(F.col("source"), *[F.col(c).alias(f"__{c}") for c in plan.columns if c != "source"])
    placed = attach(inner, plan, "source", n).withColumn("__size", word_count(F.col("text")))
    out = [*names, F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__whole").alias("whole")]
    clear = placed.where(F.col("__bucket") != F.col("__edge_bucket")).select(*out, F.when(F.col("__bucket") < F.col("__edge_bucket"), F.col("__size")).otherwise(F.lit(0)).cast("long").alias("extra"))
    upto = F.sum("__size").over(Window.partitionBy("source").orderBy("__drawn", "doc_id", "__size").rowsBetween(Window.unboundedPreceding, 0))
    extra = F.least(F.greatest(F.col("__edge_words") - F.col("__upto") + F.col("__size"), F.lit(0)), F.col("__size"))
    at_edge = placed.where(F.col("__bucket") == F.col("__edge_bucket")).withColumn("__upto", upto).select(*out, extra.cast("long").alias("extra"))
    return clear.unionByName(at_edge)


def sample_mixture(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus itself: each document as often as the mix takes it, columns of ``docs``.

    A fractional repetition is a row with the document's leading ``extra``
    words; ``n_chars`` follows the text where the column is there.
    """
    apart = {c: f"__own_{c}" for c in docs.columns if c in ADDED}
    mixed = mix_sources(docs.withColumnsRenamed(apart), **how)
    whole = F.col("whole") + F.when((F.col("extra") == F.col("size")) & (F.col("size") > 0), 1).otherwise(0)
    part = (F.col("extra") > 0) & (F.col("extra") < F.col("size"))
    cut = F.when(part, F.array_join(F.slice(F.split(F.regexp_replace("text", f"^{SPACE}", ""), SPACE), 1, F.col("extra").cast("int")), " "))
    texts = F.concat(F.array_repeat(F.col("text"), whole.cast("int")), F.when(part, F.array(cut)).otherwise(F.array().cast("array<string>")))
    out = mixed.withColumn("text", F.explode(texts))
    return out.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(apart.get(c, c)).alias(c) for c in docs.columns])
