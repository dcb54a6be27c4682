"""State that a stream carries from batch to batch."""

from strandwise.streaming.align import CarriedStats


def test_state_outlives_the_driver_object(spark, tmp_path):
    schema = "orient int, low int, high int, avg double, std double, failed boolean"
    batch = lambda *rows: spark.createDataFrame(list(rows), schema)
    first, second, both = (1, 10, 90, 50.0, 5.0), (2, 1, 9, 5.0, 1.0), (1, 11, 91, 51.0, 6.0)
    folder = f"file://{tmp_path}/sizes"
    assert CarriedStats(folder).update(batch((*first, False), (*second, True)), 0) == [first]
    later = batch((*both, True), (*second, False))
    assert CarriedStats(folder).update(later, 1) == [first, second]
    assert CarriedStats(folder).update(batch((*both, False), (*second, True)), 2) == [both, second]
    # batch 1 again, as after a failure: its own predecessor counts, not what came later
    assert CarriedStats(folder).update(later, 1) == [first, second]


def test_first_batch_without_sizes(spark, tmp_path):
    none = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, True)], "orient int, low int, high int, avg double, std double, failed boolean")
    carried = CarriedStats(f"file://{tmp_path}/sizes")
    assert carried.update(none, 0) == [] == carried.update(none, 1)
