"""Results of streams may be as long as their input."""

from skyfold.plans import products


def test_result_of_a_stream_does_not_lie_on_the_driver(spark):
    got = products.streaming_sessions(spark, "/root/testdata/sf0.001")
    assert got.inputFiles() and got.count() > 0
    assert sum(r.n for r in got.collect()) == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
