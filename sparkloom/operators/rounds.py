"""Cutting the lineage between the rounds of a loop."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

_own: dict[str, str] = {}


def settle(df: DataFrame) -> DataFrame:
    """df written as Parquet in the session's shared folder (on a local master its own where none is named, as in tests) and read again."""
    spark = df.sparkSession
    named = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not named and app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="sparkloom-rounds-")
    path = f"{(named or _own[app]).rstrip('/')}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)
