"""Folding a stream of values into a table."""

from pyspark.sql import functions as F

from graphloom.operators import entities as E
from graphloom.streaming import fold_stream, folded

SCHEMA = "elem string, property string, v int"


def test_folded(spark):
    state = spark.createDataFrame([("a", "P", 1), ("b", "P", -1), ("c", "P", -1)], SCHEMA)
    batch = spark.createDataFrame([("a", "P", 0), ("b", "P", 5), ("b", "P", 3), ("d", "P", -1), ("e", "P", 7)], SCHEMA)
    once = folded(state, batch)
    want = [("a", "P", 1), ("b", "P", 3), ("c", "P", -1), ("d", "P", -1), ("e", "P", 7)]
    assert sorted(map(tuple, once.collect())) == want == sorted(map(tuple, folded(once, batch).collect()))


def test_stream(spark, tmp_path):
    spark.createDataFrame([("a", "P", -1), ("b", "P", 2)], SCHEMA).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    fold_stream(source, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([("a", "P", 4), ("b", "P", 9)], SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
    fold_stream(source, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out" / "version=1")).collect())) == [("a", "P", 4), ("b", "P", 2)]


def test_sets_of_types(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), (["*"], ["b", "c"])], "x array<string>, y array<string>")
    assert [tuple(r) for r in df.select(E.union_types(F.col("x"), F.col("y")), E.common_types(F.col("x"), F.col("y"))).collect()] == [(["a", "b", "c"], ["b"]), (["*", "b", "c"], ["b", "c"])]
