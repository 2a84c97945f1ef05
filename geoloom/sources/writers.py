"""Sinks: replace, upsert, append, exports, reports, run manifests and the lock."""

from __future__ import annotations

import hashlib
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def replace_partitions(df: DataFrame, path: str, keys: list[str]) -> None:
    """Only partitions that occur in ``df`` are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], stamp: str | None = None) -> DataFrame:
    """Rows of both; for a key the new row (or the latest by ``stamp``) wins.  Write the result elsewhere, then swap."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    order = [F.col(stamp).desc_nulls_last()] if stamp else []
    w = Window.partitionBy(*keys).orderBy(*order, F.desc("__new"))
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__new")


def valid_only(descriptors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Finite descriptors, and the count of skipped ones a dimension."""
    bad = F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))
    return descriptors.where(~F.coalesce(bad, F.lit(True))), descriptors.where(F.coalesce(bad, F.lit(True))).groupBy("dimension").agg(F.count("*").alias("n_skipped"))


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


# ---- reports


def text_report(title: str, metrics: dict[str, dict]) -> str:
    """Engine sections of name: value lines."""
    lines = ["=" * 60, title, "=" * 60]
    for engine, found in metrics.items():
        lines += ["", engine.upper(), "-" * 40]
        lines += [f"  {k}: {v:.4f}" if isinstance(v, float) else f"  {k}: {v}" for k, v in found.items()]
    return "\n".join(lines)


def markdown_report(title: str, tables: dict[str, DataFrame], limit: int = 50) -> tuple[str, str]:
    """Markdown of small tables (a report's limit of rows each) and its SHA-256."""
    out = [f"# {title}"]
    for name, df in tables.items():
        rows = df.limit(limit).collect()
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows]
    text = "\n".join(out) + "\n"
    return text, hashlib.sha256(text.encode()).hexdigest()


def plot_frame(panel: DataFrame, ids: list[str]) -> DataFrame:
    """Wide, ordered rows ready for a plotting tool."""
    from geoloom.operators.panel import to_wide

    return to_wide(panel, ids).orderBy("date")


# ---- runs and lock


def table_digest(df: DataFrame) -> tuple[str, int]:
    """A digest that doesn't depend on row order, and the rows: sums of row hashes."""
    h = F.xxhash64(*df.columns)
    r = df.agg(F.sum(h.cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).first()
    return hashlib.sha256(f"{r['s']}|{r['n']}|{df.schema.simpleString()}".encode()).hexdigest(), r["n"]


class LockedError(RuntimeError):
    pass


class RunManifest:
    """Steps of a run as Parquet rows; ``lock`` freezes a table, ``check`` refuses changes to it."""

    def __init__(self, spark: SparkSession, path: str, run_id: str):
        self.spark, self.path, self.run_id = spark, path.rstrip("/"), run_id

    def record(self, step: str, status: str, detail: str = "") -> None:
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        row = [(self.run_id, step, status, now, detail)]
        self.spark.createDataFrame(row, "run_id string, step string, status string, at timestamp, detail string").coalesce(1).write.mode("append").parquet(f"{self.path}/steps")

    def steps(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/steps").where(F.col("run_id") == self.run_id)

    def lock(self, name: str, df: DataFrame) -> str:
        digest, n = table_digest(df)
        self.spark.createDataFrame([(self.run_id, name, digest, n)], "run_id string, name string, digest string, n_rows long").coalesce(1).write.mode("append").parquet(f"{self.path}/locks")
        return digest

    def check(self, name: str, df: DataFrame) -> None:
        rows = self.spark.read.parquet(f"{self.path}/locks").where((F.col("run_id") == self.run_id) & (F.col("name") == name)).collect()
        if rows and table_digest(df)[0] not in {r["digest"] for r in rows}:
            raise LockedError(f"{name} is locked by run {self.run_id} and differs")

    def run(self, steps: dict) -> list[str]:
        """Ordered steps; stops at the first failure, which is recorded."""
        done = []
        for name, f in steps.items():
            try:
                f()
            except Exception as e:
                self.record(name, "failed", f"{type(e).__name__}: {e}"[:200])
                raise
            self.record(name, "ok")
            done.append(name)
        return done
