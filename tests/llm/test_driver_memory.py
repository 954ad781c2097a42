"""What stays out of the driver: rows to fit on, tables of literals, and memory that is free."""

import gc
import re
import time
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from twinsieve.llm import fm_quality, line_dedup
from twinsieve.llm.common import Scratch


def test_plan_of_probes_is_one_constant(spark):
    rows = spark.range(60).select((F.col("id") % 2 == 0).alias("w"), F.col("id").cast("int").alias("n"))
    planned = rows.select("w", "n", line_dedup.plan_of(F.col("w"), F.col("n")).alias("p"))
    for r in planned.where("w and n > 7").collect():
        n = r["n"] if r["n"] < line_dedup.THREE + line_dedup.MOST else r["n"] + line_dedup.STEP * 2
        assert [tuple(x) for x in r["p"]] == line_dedup.probes(n, True)


def test_rows_of_a_fit_do_not_come_to_the_driver(spark, monkeypatch):
    texts = ["good plain words here", "bad $$$ ### junk"]
    docs = spark.createDataFrame([(k, texts[k % 2] + f" {k}") for k in range(80)], "doc_id long, text string")
    labels = docs.select("doc_id", (1 - F.col("doc_id") % 2).cast("int").alias("quality"))
    monkeypatch.setattr(type(docs), "toArrow", lambda self: 1 / 0)
    m = fm_quality.fit(docs, labels)
    assert m.w.shape == (len(m.v),) and m.v.shape[1] == fm_quality.FACTORS and np.abs(m.w).max() > 0
    assert fm_quality.fit(docs, labels.limit(0)).w0 > 20


def test_free_memory_beside_the_heap_goes_back_after_a_table(spark):
    jvm = spark._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()
    held = lambda: sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text()))) / 1024
    scratch = Scratch(spark)
    scratch.write(spark.range(10))
    buffers = [jvm.java.nio.ByteBuffer.allocateDirect(65536) for _ in range(2400)]
    # the last one stays, so that what is free before it is not at the end of the C library's memory
    buffers = buffers[-1:]
    for _ in range(2):
        gc.collect()
        jvm.System.gc()
        time.sleep(1)
    before = held()
    scratch.write(spark.range(10))
    assert before - held() > 100
    assert buffers
