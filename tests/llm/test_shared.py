from __future__ import annotations

import gc
import time

from offerscope.llm.shared import written


def test_driver_gives_garbage_back_between_jobs(spark, monkeypatch):
    heap, new = spark._jvm.java.lang.Runtime.getRuntime(), spark.sparkContext._gateway.new_array
    held = []
    while heap.totalMemory() <= 0.7 * heap.maxMemory() and len(held) << 22 < heap.maxMemory():
        held.append(new(spark._jvm.long, 1 << 19))
    held.clear()
    gc.collect()
    time.sleep(3)  # the JVM lets go of what Python held in a thread of its own
    before = heap.totalMemory()
    monkeypatch.setattr(spark.sparkContext, "_offerscope_collects", 0, raising=False)
    assert written(spark.range(10).toDF("x"), "small").count() == 10
    assert heap.totalMemory() < 0.9 * before
    waits = spark.sparkContext._offerscope_collects
    assert waits > time.monotonic() - 60
    monkeypatch.setattr(spark.sparkContext, "_offerscope_collects", time.monotonic() + 600)
    old = [b for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName()]
    count = sum(b.getCollectionCount() for b in old)
    written(spark.range(10).toDF("x"), "small")
    assert sum(b.getCollectionCount() for b in old) == count
