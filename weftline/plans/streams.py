"""The streaming form of cycle metrics."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans.registry import query
from weftline.session import shared_dir
from weftline.streaming import cycles
from weftline.streaming.incremental import IncrementalTable


@query("SELECT day(ts) AS cycle, event_type AS rel_type, count(*) AS n, round(avg(value / 500.0), 10) AS mean, round(max(value / 500.0), 10) AS high, count(*) FILTER (value / 500.0 >= 0.9) AS excellent FROM events GROUP BY 1, 2")
def cycle_metrics_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = cycles.read_events(spark, sf_dir).select("ts", F.col("event_type").alias("rel_type"), (F.col("value") / 500.0).alias("confidence"))
    token = uuid.uuid4().hex
    out = cycles.run_once(cycles.windowed_metrics(events), f"cycles_{token}", f"{shared_dir(spark)}/stream-{token}")
    return out.withColumns({"mean": F.round("mean", 10), "high": F.round("high", 10)})


@query("""SELECT 'd' || doc_id AS path, CAST(length(content) - length(replace(content, chr(10), '')) + 1 AS INT) AS n_lines, length(content) AS n_chars, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS batch
FROM (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'TODO' ELSE '' END AS content FROM documents WHERE doc_id % 7 <> 0)""")
def incremental_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: all of them first, then a third changed, some the same again, some deleted."""
    base = f"{shared_dir(spark)}/incremental-{uuid.uuid4().hex}"
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), "text")
    later = F.when(F.col("doc_id") % 7 == 0, None).when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\nTODO"))).otherwise(F.col("text"))

    def analyse(files: DataFrame) -> DataFrame:
        return files.select("path", F.size(F.split("content", "\n", -1)).alias("n_lines"), F.length("content").cast("long").alias("n_chars"))

    table = IncrementalTable(spark, f"{base}/table", analyse, "path string, n_lines int, n_chars long").create()
    for seq, versions in enumerate((d.select("path", F.col("text").alias("content")), d.where("doc_id % 7 = 0 OR doc_id % 3 = 0 OR doc_id % 5 = 0").select("path", later.alias("content")))):
        versions.withColumn("seq", F.lit(seq).cast("long")).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema("path string, content string, seq long").parquet(f"{base}/in")
        table.follow(stream, f"{base}/checkpoint").awaitTermination()
    return table.facts()
