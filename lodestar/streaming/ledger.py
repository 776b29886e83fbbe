"""Streaming twins of the event operators: windows, and a dispatch and completion ledger."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(events: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Count and sum of values for each window and type; runs on batches and on streams alike."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp"))
    w = w.withWatermark("ts", late) if events.isStreaming else w
    out = w.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def run_available(spark: SparkSession, path: str, schema, make: Callable[[DataFrame], DataFrame], mode: str = "complete") -> DataFrame:
    """Drive make() over all files of a path as a stream and return what its sink holds in the end."""
    name, check = f"stream_{uuid.uuid4().hex}", tempfile.mkdtemp()
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder, glob = (path, "*") if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory() else path.rsplit("/", 1)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", glob).parquet(folder)
    q = make(source).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", check).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
        shutil.rmtree(check, ignore_errors=True)
    return spark.table(name)


LEDGER = "entity long, dispatched long, completed long, failed long, orphans long"


def _account(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    d, c, f, o = state.get if state.exists else (0, 0, 0, 0)
    open_ = d - c - f
    for pdf in batches:
        for kind in pdf.sort_values(["ts", "event_id"])["event_type"]:
            if kind == "click":
                d, open_ = d + 1, open_ + 1
            elif kind in ("purchase", "error"):
                if open_ <= 0:
                    o += 1
                elif kind == "purchase":
                    c, open_ = c + 1, open_ - 1
                else:
                    f, open_ = f + 1, open_ - 1
    state.update((d, c, f, o))
    yield pd.DataFrame({"entity": [key[0]], "dispatched": [d], "completed": [c], "failed": [f], "orphans": [o]})


def ledger(events: DataFrame) -> DataFrame:
    """Per user: dispatches (click), completions (purchase) and failures (error) of open dispatches,
    and outcomes without one. State is four counts an entity."""
    return events.select("event_id", "ts", "user_id", "event_type").groupBy("user_id").applyInPandasWithState(_account, LEDGER, "d long, c long, f long, o long", "update", GroupStateTimeout.NoTimeout)
