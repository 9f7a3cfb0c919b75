"""Files read by Python, a few at a time and over all tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
#: Files whose rows a worker holds at once, and characters after which it holds no more.
FILES, CHARS = 64, 1 << 20

Read = Callable[[str, str | None], list[tuple]]


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all shuffle partitions: rows that take long to read for their size would else share a few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def pieces(batches: Iterator[pa.RecordBatch], read: Read, schema: str) -> Iterator[pa.RecordBatch]:
    """The rows that ``read`` gives for each (path, content), in batches of a bounded number of files."""
    fields = pa.schema([(name, TYPES[kind]) for name, kind in (x.split() for x in schema.split(", "))])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    for b in batches:
        rows, files, chars = [], 0, 0
        for i in range(b.num_rows):
            content = b.column(1)[i].as_py()
            rows += read(b.column(0)[i].as_py(), content)
            files, chars = files + 1, chars + len(content or "")
            if files == FILES or chars >= CHARS:
                yield batch(rows)
                rows, files, chars = [], 0, 0
        yield batch(rows)


def rows_of(files: DataFrame, read: Read, schema: str, dealt: bool = False) -> DataFrame:
    """path, content -> the rows of ``schema`` that ``read`` gives for each file. Files that are ``dealt`` to all tasks already are read where they are."""
    files = files.select("path", "content")
    return (files if dealt else spread(files)).mapInArrow(lambda batches: pieces(batches, read, schema), schema)
