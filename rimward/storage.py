"""Intermediate tables in the folder that the driver and the executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.rimward.tables"


def tables_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that's unset, the warehouse, or in local mode a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_KEY, None)
    if named is None:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        named = tempfile.mkdtemp(prefix="rimward-tables-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/rimward_tables"
        spark.conf.set(_KEY, named)
    return named


def stored(df: DataFrame, label: str, replaces: DataFrame | None = None) -> DataFrame:
    """``df`` written as Parquet and read back: its lineage is cut, and a lost executor costs no earlier stage.

    ``replaces`` is a stored table that nothing reads any more, an earlier round of an iteration say; its files are deleted once the new ones are written.
    """
    spark = df.sparkSession
    path = f"{tables_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if replaces is not None:
        dropped(replaces)
    out = spark.read.schema(df.schema).parquet(path)
    out._rimward_path = path  # where ``dropped`` finds it
    return out


def dropped(table: DataFrame) -> None:
    """Delete the files of a stored table; other frames are left alone."""
    path = getattr(table, "_rimward_path", None)
    if path is not None:
        jvm, conf = table.sparkSession._jvm, table.sparkSession._jsparkSession.sessionState().newHadoopConf()
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
