"""How many rows an action sends through shuffles, for tests of how work grows."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager


@contextmanager
def no_broadcast(spark):
    """Joins as on tables too large to send to every task."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _sent(spark) -> int:
    jvm, store = spark.sparkContext._jvm, spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    no_shares = spark.sparkContext._gateway.new_array(jvm.double, 0)
    stages = store.stageList(jvm.java.util.ArrayList(), False, False, no_shares, jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def shuffled_rows(spark, act: Callable[[], object]) -> int:
    with no_broadcast(spark):
        before = _sent(spark)
        act()
        return _sent(spark) - before
