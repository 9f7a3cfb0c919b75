"""Tables between the rounds of an iteration, in the folder that the executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from weftline.session import shared_dir


def spool(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table of its own: lineage ends there, and a lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
