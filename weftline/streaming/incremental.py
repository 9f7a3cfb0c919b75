"""Analysis that is carried on as files change: only what has a new content hash is analysed again.

A table is two Parquet folders, ``files`` (path, hash, seq, gone) and ``facts`` (path and the columns of the analysis),
with a partition for each micro-batch that holds that batch's changes alone. A batch is computed from the batches
before it and written over whatever stands under its number, so running it again, after a crash or twice, gives the
same table. Of a path's versions the one of the highest ``seq`` counts, whenever it comes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

Analysis = Callable[[DataFrame], DataFrame]
FILES = "path string, hash string, seq long, gone boolean"
#: The partition that a new table starts with; no batch has this number.
START = -1


class IncrementalTable:
    """``analyse`` takes (path, content) and gives rows with a ``path``; its schema is ``facts``."""

    def __init__(self, spark: SparkSession, folder: str, analyse: Analysis, facts: str):
        self.spark, self.folder, self.analyse = spark, folder.rstrip("/"), analyse
        self.schemas = {"files": StructType.fromDDL(FILES), "facts": StructType.fromDDL(facts)}

    def create(self) -> IncrementalTable:
        """An empty table, unless there is one."""
        for name, schema in self.schemas.items():
            self.spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.folder}/{name}/batch={START}")
        return self

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schemas[name].fields, *StructType.fromDDL("batch long").fields])).option("basePath", f"{self.folder}/{name}").parquet(f"{self.folder}/{name}")

    def files(self, before: int | None = None) -> DataFrame:
        """path, hash, seq, gone, batch: the latest version of each path, as of all batches before the given one."""
        rows = self._read("files")
        rows = rows if before is None else rows.where(F.col("batch") < before)
        latest = F.max_by(F.struct("hash", "seq", "gone", "batch"), F.struct("seq", "batch"))
        return rows.groupBy("path").agg(latest.alias("v")).select("path", "v.*")

    def facts(self) -> DataFrame:
        """The analysis of all files that are there, with the batch that made it."""
        now = self.files().where("NOT gone").select(F.col("path").alias("p"), F.col("batch").alias("b"))
        rows = self._read("facts")
        return rows.join(now, (rows["path"] == now["p"]) & (rows["batch"] == now["b"]), "left_semi")

    def upsert(self, versions: DataFrame, batch: int) -> None:
        """versions: path, content (null: deleted), seq. What is no news leaves no row."""
        newest = versions.where("path IS NOT NULL").groupBy("path").agg(F.max_by(F.struct("content", "seq"), F.struct("seq", F.col("content").isNotNull(), "content")).alias("v")).select("path", "v.content", "v.seq")
        own = newest.withColumn("hash", F.sha2("content", 256))
        known = self.files(before=batch).select(F.col("path").alias("p"), F.col("hash").alias("old"), F.col("seq").alias("old_seq"), F.col("gone").alias("old_gone"))
        j = own.join(known, F.col("path") == F.col("p"), "left")
        late = F.col("old_seq").isNotNull() & (F.col("seq") < F.col("old_seq"))
        same = F.when(F.col("content").isNull(), F.coalesce("old_gone", F.lit(True))).otherwise(F.coalesce((F.col("old") == F.col("hash")) & ~F.col("old_gone"), F.lit(False)))
        news = j.where(~late & ~same).select("path", "content", "hash", F.col("seq").cast("long").alias("seq"), F.col("content").isNull().alias("gone"))
        facts = self.analyse(news.where("NOT gone").select("path", "content")).select(self.schemas["facts"].names)
        facts.write.mode("overwrite").parquet(f"{self.folder}/facts/batch={batch}")
        news.select("path", "hash", "seq", "gone").write.mode("overwrite").parquet(f"{self.folder}/files/batch={batch}")

    def follow(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Takes in all that the stream has now."""
        return stream.writeStream.foreachBatch(lambda rows, batch: self.upsert(rows, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
