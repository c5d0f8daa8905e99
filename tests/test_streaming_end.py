"""A stream that is run to its end gives every row once, also over several calls, and raises what makes it fail."""

import pytest
from pyspark.sql import functions as F

from lodepath.streaming.jobs import run_to_end


def test_later_calls_go_on(spark, tmp_path):
    src, folder = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(10).write.parquet(src)
    stream = spark.readStream.schema("id bigint").parquet(src)
    assert run_to_end(stream, "append", folder).count() == 10
    spark.range(10, 15).write.mode("append").parquet(src)
    assert sorted(r.id for r in run_to_end(stream, "append", folder).collect()) == list(range(15))
    assert run_to_end(stream, "append", folder).count() == 15
    total = run_to_end(stream.groupBy().agg(F.sum("id").alias("s")), "complete", str(tmp_path / "sum"))
    assert [r.s for r in total.collect()] == [105]


def test_empty_and_failing(spark, tmp_path):
    src = str(tmp_path / "none")
    spark.range(0).write.parquet(src)
    stream = spark.readStream.schema("id bigint").parquet(src)
    assert run_to_end(stream, "append", str(tmp_path / "a")).count() == 0
    spark.range(3).write.mode("append").parquet(src)
    with pytest.raises(Exception):
        run_to_end(stream.select(F.raise_error(F.lit("no")).alias("id")), "append", str(tmp_path / "b"))
