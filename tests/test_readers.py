"""Files are read a few at a time, and by all tasks."""

import pyarrow as pa

from weftline.operators import readers, scopes, scripts, symbols


def test_a_batch_is_never_read_whole():
    read = []
    batch = pa.RecordBatch.from_arrays([pa.array([f"/{i}.py" for i in range(1000)]), pa.array(["x"] * 1000)], ["path", "content"])
    out = readers.pieces(iter([batch]), lambda p, c: read.append(p) or [(p, len(c))], "path string, n int")
    assert next(out).num_rows == len(read) == readers.FILES
    assert readers.FILES + sum(x.num_rows for x in out) == 1000


def test_files_of_one_partition_are_read_by_all_tasks(spark):
    files = spark.createDataFrame([(f"/a/{i}.{x}", "import b\n") for i in range(40) for x in ("py", "ts")], "path string, content string").coalesce(1)
    for found in (symbols.python_symbols(files.where("path LIKE '%py'")), scopes.imported(files), scripts.facts(files)):
        assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
