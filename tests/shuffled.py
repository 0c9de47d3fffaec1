"""Bytes that jobs of a test shuffle, as Spark counts them."""


def shuffled_bytes(spark) -> int:
    """Bytes written to shuffles by all stages of the session so far."""
    sc = spark.sparkContext
    jvm, store = sc._jvm, sc._jsc.sc().statusStore()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    none = jvm.java.util.ArrayList()
    stages = store.stageList(none, False, False, sc._gateway.new_array(jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))
