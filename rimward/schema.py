"""The tables that operators take, checked and brought to one form.

nodes: sample_id, node_id and coordinates x, y[, z] as doubles. edges: sample_id, src, dst. A missing sample_id
is one sample named ``all``. Many samples run side by side in one job; ids are unique within a sample.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ONE_SAMPLE = "all"


def axes(df: DataFrame) -> list[str]:
    return [c for c in ("x", "y", "z") if c in df.columns]


def with_sample(df: DataFrame) -> DataFrame:
    if "sample_id" in df.columns:
        return df.withColumn("sample_id", F.col("sample_id").cast("string"))
    return df.withColumn("sample_id", F.lit(ONE_SAMPLE))


def as_nodes(df: DataFrame, allowed: tuple[int, ...] = (2, 3), message: str = "Coordinates must be Nx2 or Nx3.") -> DataFrame:
    if "node_id" not in df.columns or len(axes(df)) not in allowed:
        raise ValueError(message)
    return with_sample(df).select("sample_id", F.col("node_id").cast("long"), *[F.col(a).cast("double") for a in axes(df)])
