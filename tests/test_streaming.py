from faultline.operators import files
from faultline.sources import bridge
from faultline.streaming import increments
from tests.oracle import SF, lines


def test_batches_add_up_to_the_whole(spark, tmp_path):
    whole = bridge.history(spark, SF)
    whole.repartition(3).write.parquet(f"file://{tmp_path}/history")
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/history")
    query = increments.append(stream, f"file://{tmp_path}/partials", bridge.PATTERNS)
    query.awaitTermination(120)
    got = increments.metrics(spark, f"file://{tmp_path}/partials").toPandas()
    expected = files.metrics(whole, bridge.PATTERNS).drop("last_modified_iso", "file_size").toPandas()
    assert len(got) and sorted(got.columns) == sorted(expected.columns) and lines(got) == lines(expected)
