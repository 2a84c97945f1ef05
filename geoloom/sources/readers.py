"""Readers: files of panels and of the public data services, all to long panels.

Network access is the caller's; these parse what was fetched.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from geoloom.operators.panel import epiweek_to_date, fill_both_ways, to_long
from geoloom.schema import PANEL

DATE_NAMES = ("date", "time", "timestamp", "datetime", "day", "period", "observation_date")
ID_NAMES = ("indicator_id", "indicator", "id", "series", "series_id", "ticker", "symbol", "name")
VALUE_NAMES = ("value", "val", "close", "price", "obs_value", "observation")


class SourceError(ValueError):
    pass


def _lower(df: DataFrame) -> DataFrame:
    return df.select([F.col(f"`{c}`").alias(c.strip().lower()) for c in df.columns])


def panel_parquet(spark: SparkSession, path: str, ids=None, start=None, end=None) -> DataFrame:
    """Columnar panel; filters reach the scan."""
    from geoloom.operators.panel import select_panel

    return select_panel(spark.read.parquet(path).select("indicator_id", "date", "value"), ids, start, end)


def csv_wide(spark: SparkSession, path: str) -> DataFrame:
    """First column dates, others numeric series: columns without a number go, gaps are filled forward, then backward."""
    if not path.endswith((".csv", ".csv.gz")):
        raise SourceError(f"not a csv file: {path}")
    raw = spark.read.csv(path, header=True)
    first, *values = raw.columns
    typed = raw.select(F.expr(f"try_cast(`{first}` AS date)").alias("date"), *[F.expr(f"try_cast(`{c}` AS double)").alias(c.strip()) for c in values])
    present = typed.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in typed.columns[1:]]).first().asDict()
    kept = [c for c, n in present.items() if n]
    if not kept:
        raise SourceError("no numeric column")
    return fill_both_ways(to_long(typed.select("date", *[F.col(f"`{c}`") for c in kept])))


def detect_layout(columns: list[str], numeric_share: float) -> str:
    """long if an id and a value column are there, wide if most other columns are numbers."""
    names = [c.strip().lower() for c in columns]
    if any(n in names for n in ID_NAMES) and any(n in names for n in VALUE_NAMES):
        return "long"
    return "wide" if numeric_share >= 0.8 else "unknown"


def csv_any(spark: SparkSession, path: str) -> DataFrame:
    """Long or wide csv, detected by column names (whatever their case) and the share of numeric columns, to a panel; series of a wide one keep their names."""
    given = spark.read.csv(path, header=True)
    raw, names = _lower(given), {c.strip().lower(): c.strip() for c in given.columns}
    date = next((c for c in raw.columns if c in DATE_NAMES), raw.columns[0])
    others = [c for c in raw.columns if c != date]
    numeric = raw.agg(*[F.avg(F.expr(f"CASE WHEN `{c}` IS NOT NULL THEN CAST(try_cast(`{c}` AS double) IS NOT NULL AS int) END")).alias(c) for c in others]).first()
    share = sum((numeric[c] or 0) > 0.8 for c in others) / max(len(others), 1)
    layout = detect_layout(raw.columns, share)
    when = F.expr(f"try_cast(`{date}` AS date)").alias("date")
    if layout == "long":
        i = next(c for c in raw.columns if c in ID_NAMES)
        v = next(c for c in raw.columns if c in VALUE_NAMES)
        out = raw.select(F.col(i).alias("indicator_id"), when, F.expr(f"try_cast(`{v}` AS double)").alias("value"))
    elif layout == "wide":
        out = to_long(raw.select(when, *[F.expr(f"try_cast(`{c}` AS double)").alias(names[c]) for c in others if (numeric[c] or 0) > 0]))
    else:
        raise SourceError(f"no layout fits {raw.columns}")
    return out.where(F.col("date").isNotNull() & F.col("value").isNotNull())


def registry_views(panel: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(indicator_id, n_obs, first, last, frequency by density) and the panel with an observation number."""
    g = panel.groupBy("indicator_id").agg(F.count("*").alias("n_obs"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    density = F.try_divide(F.col("n_obs").cast("double"), F.datediff("last_date", "first_date") + F.lit(1.0))
    frequency = F.when(density > 0.5, "daily").when(density > 0.1, "weekly").when(density > 0.025, "monthly").when(density > 0.008, "quarterly").otherwise("annual")
    return g.withColumn("frequency", frequency), panel.withColumn("obs", F.row_number().over(Window.partitionBy("indicator_id").orderBy("date")))


# ---- services


def observations_json(spark: SparkSession, path: str, indicator_id: str) -> DataFrame:
    """{"observations": [{"date", "value"}]} with "." for missing."""
    raw = spark.read.schema("observations array<struct<date: string, value: string>>").option("multiLine", True).json(path)
    rows = raw.select(F.explode("observations").alias("o"))
    return rows.select(F.lit(indicator_id).alias("indicator_id"), F.to_date("o.date").alias("date"), F.expr("try_cast(o.value AS double)").alias("value")).where("value IS NOT NULL")


def prices_json(spark: SparkSession, path: str, indicator_id: str, field: str = "adjClose") -> DataFrame:
    """[{"date", "close", "adjClose", ...}]."""
    raw = spark.read.schema(f"date string, `{field}` double").option("multiLine", True).json(path)
    return raw.select(F.lit(indicator_id).alias("indicator_id"), F.to_date(F.substring("date", 1, 10)).alias("date"), F.col(field).alias("value")).where("value IS NOT NULL")


def quakes_csv(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Catalogue files fetched in pieces; the same (time, latitude, longitude, mag) counts once."""
    raw = spark.read.csv(paths, header=True)
    typed = raw.select(F.to_timestamp("time").alias("time"), *[F.expr(f"try_cast({c} AS double)").alias(c) for c in ("latitude", "longitude", "depth", "mag")])
    return typed.where("time IS NOT NULL AND mag IS NOT NULL").dropDuplicates(["time", "latitude", "longitude", "mag"])


def regions_csv(spark: SparkSession, path: str, column: str, regions: list[str] | None = None, region_col: str = "location") -> DataFrame:
    """One column of a wide table by region and date; indicator ids are <column>_<region>."""
    raw = spark.read.csv(path, header=True).select(region_col, "date", column)
    if regions:
        raw = raw.where(F.col(region_col).isin(regions))
    return raw.select(F.concat_ws("_", F.lit(column), F.col(region_col)).alias("indicator_id"), F.to_date("date").alias("date"), F.expr(f"try_cast(`{column}` AS double)").alias("value")).where("value IS NOT NULL")


def epiweek_json(spark: SparkSession, path: str, field: str = "wili") -> DataFrame:
    """{"epidata": [{"region", "epiweek", field}]}; the first row of a week counts."""
    raw = spark.read.schema(f"epidata array<struct<region: string, epiweek: int, `{field}`: double>>").option("multiLine", True).json(path)
    rows = raw.select(F.posexplode("epidata").alias("at", "e"))
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("e.region", "e.epiweek").orderBy("at"))).where("n = 1")
    return first.select(F.concat_ws("_", F.lit(field), F.col("e.region")).alias("indicator_id"), epiweek_to_date(F.col("e.epiweek")).alias("date"), F.col(f"e.{field}").alias("value")).where("value IS NOT NULL")


def year_by_month(spark: SparkSession, path: str, indicator_id: str, low: float | None = -99.0, high: float | None = 999.0, separator: str = r"\s+", missing: str | None = None) -> DataFrame:
    """Lines of a year and twelve values; values at or beyond the sentinels (None: no sentinel on that side) and those written as ``missing`` are missing, other lines are skipped."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), separator).alias("p")).where((F.size("p") >= 13) & F.get("p", F.lit(0)).rlike(r"^\d{4}$"))
    rows = parts.select(F.get("p", F.lit(0)).cast("int").alias("y"), F.posexplode(F.slice("p", 2, 12)).alias("m", "v"))
    value: Column = F.expr("try_cast(v AS double)")
    if missing:
        value = F.when(F.col("v") != missing, value)
    out = rows.select(F.lit(indicator_id).alias("indicator_id"), F.make_date("y", F.col("m") + 1, F.lit(1)).alias("date"), value.alias("value")).where("value IS NOT NULL")
    if low is not None:
        out = out.where(F.col("value") > low)
    return out if high is None else out.where(F.col("value") < high)


def anomalies_csv(spark: SparkSession, path: str, indicator_id: str, scale: float = 1.0) -> DataFrame:
    """Year,Jan..Dec with *** for missing, after any title lines."""
    parts = spark.read.text(path).select(F.split("value", ",").alias("p")).where((F.size("p") >= 13) & F.get("p", F.lit(0)).rlike(r"^\d{4}$"))
    rows = parts.select(F.get("p", F.lit(0)).cast("int").alias("y"), F.posexplode(F.slice("p", 2, 12)).alias("m", "v"))
    return rows.select(F.lit(indicator_id).alias("indicator_id"), F.make_date("y", F.col("m") + 1, F.lit(1)).alias("date"), (F.expr("try_cast(trim(v) AS double)") * scale).alias("value")).where("value IS NOT NULL")


#: Overlapping three-month seasons -> the month in the middle.  Fixed values.
SEASONS = dict(zip("DJF JFM FMA MAM AMJ MJJ JJA JAS ASO SON OND NDJ".split(), range(1, 13)))


def seasonal_text(spark: SparkSession, path: str, indicator_id: str, column: int = 3) -> DataFrame:
    """Lines "SEAS YEAR ... value"."""
    months = F.create_map(*[F.lit(x) for kv in SEASONS.items() for x in kv])
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).where(F.get("p", F.lit(0)).isin(list(SEASONS)))
    return parts.select(F.lit(indicator_id).alias("indicator_id"), F.make_date(F.get("p", F.lit(1)).cast("int"), F.element_at(months, F.get("p", F.lit(0))), F.lit(1)).alias("date"), F.get("p", F.lit(column)).try_cast("double").alias("value")).where("value IS NOT NULL")


def decimal_dates(spark: SparkSession, path: str, indicator_id: str, date_cols: tuple[int, ...], value_col: int, separator: str = r"\s+", comment: str = "#", negative_missing: bool = True) -> DataFrame:
    """Lines "year month [day] ... value", comments skipped, negative sentinels dropped."""
    parts = spark.read.text(path).where(~F.col("value").startswith(comment)).select(F.split(F.trim("value"), separator).alias("p")).where(F.size("p") > value_col)
    at = lambda k: F.get("p", F.lit(k)).try_cast("int")
    date = F.make_date(at(date_cols[0]), at(date_cols[1]), at(date_cols[2]) if len(date_cols) > 2 else F.lit(1))
    out = parts.select(F.lit(indicator_id).alias("indicator_id"), date.alias("date"), F.get("p", F.lit(value_col)).try_cast("double").alias("value")).where("value IS NOT NULL AND date IS NOT NULL")
    return out.where("value >= 0") if negative_missing else out


def streamflow_json(spark: SparkSession, path: str, indicator_id: str) -> DataFrame:
    """{"value": {"timeSeries": [{"values": [{"value": [{"value", "dateTime"}]}]}]}}; negative is missing."""
    raw = spark.read.schema("value struct<timeSeries: array<struct<values: array<struct<value: array<struct<value: string, dateTime: string>>>>>>>").option("multiLine", True).json(path)
    rows = raw.select(F.explode("value.timeSeries").alias("t")).select(F.explode("t.values").alias("v")).select(F.explode("v.value").alias("o"))
    return rows.select(F.lit(indicator_id).alias("indicator_id"), F.to_date(F.substring("o.dateTime", 1, 10)).alias("date"), F.expr("try_cast(o.value AS double)").alias("value")).where("value >= 0")


# ---- registry and configuration


def yaml_file(path: str) -> dict:
    import yaml

    return yaml.safe_load(Path(path).read_text()) or {}


def indicator_registry(spark: SparkSession, path: str) -> DataFrame:
    """A YAML list (or mapping) of indicators: id, source, category, frequency."""
    content = yaml_file(path)
    items = content.get("indicators", content)
    if isinstance(items, dict):
        items = [{"id": k, **(v or {})} for k, v in items.items()]
    rows = [(str(i.get("id")), i.get("source"), i.get("category"), i.get("frequency"), i.get("name")) for i in items]
    return spark.createDataFrame(rows, "indicator_id string, source string, category string, frequency string, name string")


class Config:
    """Nested settings read once a path."""

    _read: dict[str, dict] = {}

    def __init__(self, path: str):
        self.data = self._read.setdefault(path, yaml_file(path))

    def get(self, *keys, default=None):
        at = self.data
        for k in keys:
            if not isinstance(at, dict) or k not in at:
                return default
            at = at[k]
        return at


def ingest(spark: SparkSession, jobs: dict, clean=None, path: str | None = None) -> tuple[DataFrame | None, DataFrame]:
    """Run readers {indicator_id: callable}, isolating failures: the panels that could be read, and (indicator_id, status, detail).

    Every panel is read to its end before it counts.  With ``path`` it is
    written there and replaces what the folder holds of its indicators; without,
    the readers run again when the result is used.
    """
    from geoloom.sources.writers import replace_partitions

    out, log, good = None, [], []
    for name, read in jobs.items():
        try:
            got = read()
            got = (clean(got) if clean else got).select(*PANEL.fieldNames())
            if path:
                replace_partitions(got.withColumn("indicator_id", F.lit(name)), path, ["indicator_id"])
            else:
                got.write.format("noop").mode("overwrite").save()
                out = got if out is None else out.unionByName(got)
            good.append(name)
            log.append((name, "ok", None))
        except Exception as e:  # one source's failure is reported, the others go on
            log.append((name, "failed", f"{type(e).__name__}: {e}"[:200]))
    if path and good:
        kinds = {f.name: f.dataType.simpleString() for f in PANEL}
        columns = [c for c in PANEL.fieldNames() if c != "indicator_id"] + ["indicator_id"]
        out = spark.read.schema(", ".join(f"{c} {kinds[c]}" for c in columns)).parquet(path).select(*PANEL.fieldNames())
    return out, spark.createDataFrame(log, "indicator_id string, status string, detail string")


class Fetched:
    """Files fetched from a service, kept for ``hours``: ``get`` calls ``fetch`` only when its copy is missing or older."""

    def __init__(self, folder: str, hours: float = 24.0):
        self.folder, self.hours = Path(folder), hours

    def get(self, name: str, fetch) -> str:
        import time

        at = self.folder / name
        if not at.exists() or time.time() - at.stat().st_mtime > 3600 * self.hours:
            at.parent.mkdir(parents=True, exist_ok=True)
            part = at.with_suffix(at.suffix + ".part")
            part.write_bytes(fetch())
            part.replace(at)
        return str(at)
