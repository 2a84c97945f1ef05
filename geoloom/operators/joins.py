"""Join shapes of panel analytics, all as equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def pairs_on_date(panel: DataFrame, extra_keys: tuple[str, ...] = (), ordered: bool = False) -> DataFrame:
    """(id_1, id_2, keys, date, x, y) on common dates: id_1 < id_2, or both orders.

    The rows of a date (one an indicator) meet in one sorted list, whose pairs
    are spelled out row by row: the panel is read and shuffled once, and what a
    task holds is a list, not its pairs.
    """
    keys = [*extra_keys, "date"]
    met = panel.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("indicator_id").alias("id"), F.col("value").alias("v")))).alias("m"))
    first = met.select(*keys, "m", F.posexplode("m").alias("at", "a"))
    rest = F.col("m") if ordered else F.slice("m", F.col("at") + 2, F.size("m"))
    both = first.select(*keys, "a", F.explode(rest).alias("b"))
    both = both.select(*keys, F.col("a.id").alias("id_1"), F.col("b.id").alias("id_2"), F.col("a.v").alias("x"), F.col("b.v").alias("y"))
    return both.where(F.col("id_1") != F.col("id_2") if ordered else F.col("id_1") < F.col("id_2"))


def lagged_pairs(panel: DataFrame, max_lag: int, ordered: bool = False) -> DataFrame:
    """(id_1, id_2, lag, x, y): y lies ``lag`` common dates after x, for lags -max_lag..max_lag; lag > 0: the first leads.

    Dates are numbered within the pair after the join, so gaps do not shift
    anything, and the lags are read off a window: no lag table is joined.
    """
    w = Window.partitionBy("id_1", "id_2").orderBy("date")
    both = pairs_on_date(panel, ordered=ordered).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    name = lambda k: f"__lag_{k + max_lag}"
    span = range(-max_lag, max_lag + 1)
    shifted = both.withColumns({name(k): (F.lead("y", k) if k >= 0 else F.lag("y", -k)).over(w) for k in span})
    lags = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(name(k)).alias("y")) for k in span])
    return shifted.select("id_1", "id_2", "date", "x", F.explode(lags).alias("l")).select("id_1", "id_2", "date", "x", F.col("l.lag").alias("lag"), F.col("l.y").alias("y"))


def common_dates(panel: DataFrame) -> DataFrame:
    """Rows of dates that every indicator has."""
    n = panel.agg(F.count_distinct("indicator_id").alias("n"))
    dates = panel.where(F.col("value").isNotNull()).groupBy("date").agg(F.count_distinct("indicator_id").alias("k"))
    full = dates.join(F.broadcast(n), F.col("k") == F.col("n")).select("date")  # n is one row
    return panel.join(full, "date", "left_semi")


def among(panel: DataFrame, ids: DataFrame, key: str = "indicator_id") -> DataFrame:
    return panel.join(ids.select(key).distinct(), key, "left_semi")


def not_among(panel: DataFrame, ids: DataFrame, key: str = "indicator_id") -> DataFrame:
    return panel.join(ids.select(key).distinct(), key, "left_anti")


def nearest_within(left: DataFrame, right: DataFrame, days: int = 30, by: tuple[str, ...] = ()) -> DataFrame:
    """Each left row with the right row nearest in date within +-days (the earlier on ties); left rows without one keep nulls.

    Right dates are dealt to buckets of ``days`` and each left row looks into
    three of them, so this is an equi-join whatever the sizes.
    """
    bucket = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / F.lit(days))
    names = [c for c in right.columns if c not in (*by, "date")]
    r = right.select(*by, F.col("date").alias("match_date"), *[F.col(c).alias(f"match_{c}") for c in names], bucket("date").alias("__b"))
    keyed = left.withColumn("__row", F.monotonically_increasing_id())
    look = keyed.select("__row", *by, F.col("date").alias("__d"), F.explode(F.sequence(bucket("date") - 1, bucket("date") + 1)).alias("__b"))
    near = look.join(r, [*by, "__b"]).where(F.abs(F.datediff("match_date", "__d")) <= days)
    best = near.groupBy("__row").agg(F.min_by(F.struct("match_date", *[f"match_{c}" for c in names]), F.struct(F.abs(F.datediff("match_date", "__d")), "match_date")).alias("m"))
    return keyed.join(best, "__row", "left").select(*left.columns, "m.*")


def first_before(events: DataFrame, signals: DataFrame, lookback: int = 60) -> DataFrame:
    """For each event (event_id, date): the first signal date within ``lookback`` days before it, and the lead in days.

    Signals are dealt to buckets of ``lookback`` days.
    """
    bucket = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / F.lit(lookback))
    s = signals.select(F.col("date").alias("signal_date"), bucket("date").alias("__b")).distinct()
    e = events.select("event_id", "date", F.explode(F.array(bucket("date") - 1, bucket("date"))).alias("__b"))
    hit = e.join(s, "__b").where((F.col("signal_date") <= F.col("date")) & (F.datediff("date", "signal_date") <= lookback))
    first = hit.groupBy("event_id").agg(F.min("signal_date").alias("first_signal"))
    return events.join(first, "event_id", "left").withColumn("lead_days", F.datediff("date", "first_signal"))


def align_states(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two (date, state) series on the dates that both have."""
    return a.select("date", F.col("state").alias("state_a")).join(b.select("date", F.col("state").alias("state_b")), "date", "full").where(F.col("state_a").isNotNull() & F.col("state_b").isNotNull())


def left_join_counts(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``right`` per key of ``left``; keys without any count 0."""
    return left.join(right.groupBy(*on).agg(F.count("*").alias("n")), on, "left").withColumn("n", F.coalesce("n", F.lit(0)))
