"""Report sink (S10): write a result as JSON lines or Parquet, read it back typed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FORMATS = ("json", "parquet", "csv")


def write_report(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> str:
    """Write ``df`` to ``path``; the API shipped rows as JSON, so JSON is the default.

    Writing is distributed: every task writes its own part file."""
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format {fmt!r}")
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", "true")
    w.save(path)
    return path


def read_report(spark: SparkSession, path: str, schema, fmt: str = "json") -> DataFrame:
    r = spark.read.schema(schema).format(fmt)
    if fmt == "csv":
        r = r.option("header", "true")
    return r.load(path)
