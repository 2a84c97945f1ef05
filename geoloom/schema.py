"""Table schemas of the data model, and the check against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, DateType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType, TimestampType

_S, _D, _T, _F, _I, _L, _B = StringType(), DateType(), TimestampType(), DoubleType(), IntegerType(), LongType(), BooleanType()


def _struct(*fields: tuple) -> StructType:
    return StructType([StructField(n, t, True) for n, t in fields])


PANEL = _struct(("indicator_id", _S), ("date", _D), ("value", _F))
PANEL_FULL = _struct(("indicator_id", _S), ("date", _D), ("value", _F), ("source", _S), ("frequency", _S), ("cleaning_method", _S), ("fetched_at", _T), ("cleaned_at", _T), ("run_id", _S))
DESCRIPTORS = _struct(("indicator_id", _S), ("window_start", _D), ("window_end", _D), ("dimension", _S), ("value", _F), ("run_id", _S))
PAIR_DESCRIPTORS = _struct(("indicator_id_1", _S), ("indicator_id_2", _S), ("window_start", _D), ("window_end", _D), ("dimension", _S), ("value", _F), ("p_value", _F), ("run_id", _S))
COHORT_DESCRIPTORS = _struct(("cohort_id", _S), ("indicator_id", _S), ("component", _I), ("window_start", _D), ("window_end", _D), ("dimension", _S), ("value", _F), ("run_id", _S))
STATES = _struct(("indicator_id", _S), ("date", _D), ("state", _I), ("probability", _F), ("run_id", _S))
WAVELETS = _struct(("indicator_id", _S), ("window_start", _D), ("window_end", _D), ("scale", _F), ("energy", _F), ("run_id", _S))
CORRELATIONS = _struct(("id_1", _S), ("id_2", _S), ("window_start", _D), ("window_end", _D), ("corr", _F), ("n_obs", _L), ("run_id", _S))
PROFILE = _struct(("indicator_id", _S), ("first_date", _D), ("last_date", _D), ("n_obs", _L), ("span_days", _I), ("mean_interval", _F), ("median_interval", _F), ("frequency", _S), ("is_irregular", _B))
VECTORS = _struct(("indicator_id", _S), ("window_start", _D), ("window_end", _D), ("vector", ArrayType(_F)), ("coverage", _F), ("confidence", _F))
STATE_VECTORS = _struct(("indicator_id", _S), ("window_start", _D), ("window_end", _D), ("components", MapType(_S, MapType(_S, _F))))
RUNS = _struct(("run_id", _S), ("phase", _S), ("step", _S), ("status", _S), ("started_at", _T), ("ended_at", _T), ("detail", _S))
SKIPS = _struct(("run_id", _S), ("operator", _S), ("entity", _S), ("reason", _S))
LOCK = _struct(("run_id", _S), ("locked_at", _T), ("digest", _S), ("n_rows", _L))
EVENTS = _struct(("time", _T), ("latitude", _F), ("longitude", _F), ("depth", _F), ("mag", _F))


class SchemaMismatch(ValueError):
    pass


def require(df: DataFrame, schema: StructType) -> DataFrame:
    """``df`` if it has the schema's columns with its types, in any order; else SchemaMismatch."""
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f"{f.name}: {f.dataType.simpleString()} wanted, {have[f.name].simpleString() if f.name in have else 'nothing'} found" for f in schema if have.get(f.name) != f.dataType]
    if wrong:
        raise SchemaMismatch("; ".join(wrong))
    return df.select([f.name for f in schema])
