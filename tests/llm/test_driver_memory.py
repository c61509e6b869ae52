"""Memory that the driver's JVM has freed goes back to the machine when a table is saved."""

from __future__ import annotations

import re
import sys
from pathlib import Path

import pytest

from facteng.llm.common import Scratch


def _resident(spark) -> float:
    pid = spark.sparkContext._jvm.java.lang.ProcessHandle.current().pid()
    return int(re.search(r"RssAnon:\s+(\d+)", Path(f"/proc/{pid}/status").read_text())[1]) / 1024


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_saving_gives_freed_native_memory_back(spark):
    platform = spark.sparkContext._jvm.org.apache.spark.unsafe.Platform
    size, scratch = 100_000, Scratch(spark, "freed")
    scratch.save(spark.range(10))  # what the first save compiles and loads
    held = []
    for _ in range(1600):
        held.append(platform.allocateMemory(size))
        platform.setMemory(held[-1], 1, size)
    for x in held[:-1]:  # the last one stays, so the C library doesn't shrink its heap by itself
        platform.freeMemory(x)
    full = _resident(spark)
    scratch.save(spark.range(10))
    left = _resident(spark)
    platform.freeMemory(held[-1])
    assert left < full - 100, (full, left)
