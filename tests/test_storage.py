import os

from pyspark.sql import functions as F

from spreadgraph import storage


def files(spark):
    return set(os.listdir(storage.checkpoint_root(spark).removeprefix("file://")))


def test_a_scope_deletes_what_was_kept_inside_only(spark):
    outer = storage.keep(spark.range(5), "outer")
    before = files(spark)
    with storage.scope():
        inner = storage.keep(spark.range(7), "inner")
        with storage.scope():
            assert storage.keep(spark.range(3), "innermost").count() == 3
        assert inner.count() == 7 and len(files(spark)) == len(before) + 1
    assert files(spark) == before
    assert outer.agg(F.sum("id")).first()[0] == 10
    storage.release(outer)


def test_a_scope_ends_on_errors_and_bears_releases_inside(spark):
    outer = storage.keep(spark.range(5), "outer")
    before = files(spark)
    try:
        with storage.scope():
            storage.keep(spark.range(2), "inner")
            storage.release(outer)
            raise KeyError
    except KeyError:
        pass
    assert len(files(spark)) == len(before) - 1
    with storage.scope():
        pass


def test_shipping_lowers_long_batches_and_leaves_short_ones(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(name)
    try:
        for given, then in (("10000", str(storage.ARROW_ROWS)), ("16", "16")):
            spark.conf.set(name, given)
            storage.ship(spark)
            assert spark.conf.get(name) == then
    finally:
        spark.conf.set(name, held)
