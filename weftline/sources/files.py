"""Files of a project as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, FloatType, IntegerType, LongType, StringType, StructField, StructType

KEY_MAP = StructType([StructField("key", StringType()), StructField("path", StringType()), StructField("parent_path", StringType()), StructField("tier", IntegerType()), StructField("is_dir", BooleanType())])
TOKEN_METADATA = StructType([StructField("path", StringType()), StructField("ses_tokens", LongType()), StructField("full_tokens", LongType()), StructField("tokens", LongType())])
VECTORS = StructType([StructField("path", StringType()), StructField("vector", ArrayType(FloatType()))])


def is_binary(content: Column) -> Column:
    """A NUL among the first 1024 bytes."""
    return F.contains(F.substring(content, 1, 1024), F.lit(bytearray(b"\0")))


def read_text(spark: SparkSession, path: str, glob: str = "*", largest: int = 10 << 20) -> DataFrame:
    """path, content: every text file below ``path``; binary and oversized files are left out, bad UTF-8 is replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    kept = files.where((F.col("length") <= largest) & ~F.coalesce(is_binary(F.col("content")), F.lit(False)))
    return kept.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"), F.col("modificationTime").alias("modified"))


def key_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(KEY_MAP).json(path)


def token_metadata(spark: SparkSession, path: str) -> DataFrame:
    """path, ses_tokens, full_tokens; the older single count fills what is missing."""
    t = spark.read.schema(TOKEN_METADATA).json(path)
    return t.select("path", F.coalesce("ses_tokens", "tokens").alias("ses_tokens"), F.coalesce("full_tokens", "tokens").alias("full_tokens"))


def vectors(spark: SparkSession, path: str, dimension: int) -> DataFrame:
    """path, vector of the right dimension."""
    return spark.read.schema(VECTORS).parquet(path).where(F.size("vector") == dimension)


def strip_json_comments(text: Column) -> Column:
    """Drops // and /* */ comments outside strings, and commas before a closing bracket."""
    plain = F.regexp_replace(text, r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*[\s\S]*?\*/', "$1")
    return F.regexp_replace(plain, r",(\s*[}\]])", "$1")


def linter_unused(reports: DataFrame) -> DataFrame:
    """file, line, message of diagnostics that name something never read. reports: content (JSON after any preamble)."""
    schema = "generalDiagnostics array<struct<file:string,message:string,range:struct<start:struct<line:int>>>>"
    body = F.regexp_extract("content", r"(?s)(\{.*)", 1)
    d = reports.select(F.explode(F.from_json(body, schema)["generalDiagnostics"]).alias("d"))
    return d.where(F.col("d.message").contains("is not accessed")).select("d.file", (F.col("d.range.start.line") + 1).alias("line"), "d.message")
