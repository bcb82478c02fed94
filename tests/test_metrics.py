import importlib.util

import pytest
from pyspark.sql import functions as F

from millrace import metrics
from millrace.plans import Dataset
from millrace.sinks import LanceSink


def test_observed_and_counters(spark):
    df, seen = metrics.observed(spark.range(10), total=F.sum("id"))
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"total": 45}
    c = metrics.Counters(spark, "n")
    c.log_throughput("n", 3)
    assert c.values() == {"n": 3}
    assert metrics.shard_counts(spark.range(4).withColumn("__shard_id", F.lit("a"))).first()["rows"] == 4
    with pytest.raises(ValueError):
        metrics.gpu(0)


def test_metrics_with_labels(spark):
    m = metrics.Metrics(spark, bounds=(1, 4))

    def look(batches):
        for b in batches:
            for x in b.column(0).to_pylist():
                m.log_throughput("rows", 2, even=x % 2 == 0)
                m.log_histogram("size", x)
            yield b

    assert spark.range(7).mapInArrow(look, "id long").count() == 7
    assert (m.counter("rows", even=True), m.counter("rows", even=False), m.counter("rows")) == (8, 6, 0)
    assert m.histogram("size") == {"count": 7, "sum": 21, "min": 0, "max": 6, "buckets": {1: 2, 4: 3, float("inf"): 2}}
    assert m.histogram("other")["count"] == 0
    m.log_gauges({"held": 3.0, "free": 5.0}, disk="a")
    m.log_gauge("held", 2.0, disk="a")
    assert (m.gauge("held", disk="a"), m.gauge("free", disk="a"), m.gauge("held")) == (2.0, 5.0, None)
    with pytest.raises(ValueError):
        metrics.Metrics(spark, bounds=(2, 1))


def test_lance_needs_its_library(spark):
    if importlib.util.find_spec("lance"):
        pytest.skip("installed")
    with pytest.raises(ImportError, match="lance"):
        Dataset(spark.range(1)).write_lance("x").launch_local("x")
    with pytest.raises(ValueError):
        LanceSink("x", "other").write(spark.range(1))
