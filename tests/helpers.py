"""Frames from arrays, and back."""

import numpy as np


def nodes(spark, points, sample="all"):
    rows = [(sample, i, *map(float, p)) for i, p in enumerate(points)]
    axes = ["x", "y", "z"][: len(points[0])] if len(points) else ["x", "y"]
    return spark.createDataFrame(rows, "sample_id string, node_id long, " + ", ".join(f"{a} double" for a in axes))


def values(df, name):
    """The column in order of node_id."""
    return np.array([r[name] for r in df.orderBy("node_id").collect()], dtype=float)


def pairs(df):
    return {(r["src"], r["dst"]) for r in df.collect()}
