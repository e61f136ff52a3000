"""Windows, sessions, deduplication, upserts and stateful recurrences on streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.sources.sinks import overwrite_partitions, partitions
from tessera.sources.storage import durable, durable_folder


def work_folder(spark: SparkSession) -> str:
    """A new folder under the one that the cluster shares."""
    return f"{durable_folder(spark)}/stream-{uuid4().hex}"


def read_files(spark: SparkSession, path: str, files_at_once: int = 8) -> DataFrame:
    """A stream of Parquet files, with the schema they have now. The path is given as a pattern, which may name one file
    as well as a folder."""
    pattern = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_at_once).parquet(pattern)


def event_time(df: DataFrame, ts: str, late: str) -> DataFrame:
    """ts as a timestamp with a watermark; timestamps without a zone are taken in the session's."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def _just_before(df: DataFrame, ts: str, late: str | None) -> DataFrame:
    """end_, a microsecond before ts: windows are left-closed, so those of it are right-closed in ts. On a stream, late gives
    it a watermark of its own."""
    moved = df.withColumn("end_", F.col(ts) - F.expr("INTERVAL 1 MICROSECOND"))
    return moved.withWatermark("end_", late) if late and df.isStreaming else moved


def tumbling(df: DataFrame, keys: Sequence[str], ts: str, width: str, aggs: Sequence[Column], late: str | None = None) -> DataFrame:
    """Right-closed windows: a moment that ends a window belongs to it. t is the window's end."""
    return sliding(df, keys, ts, width, width, aggs, late)


def sliding(df: DataFrame, keys: Sequence[str], ts: str, width: str, step: str, aggs: Sequence[Column], late: str | None = None) -> DataFrame:
    """Right-closed windows of `width` that end every `step`."""
    return _just_before(df, ts, late).groupBy(*keys, F.window("end_", width, step).alias("w_")).agg(*aggs).withColumn("t", F.col("w_.end")).drop("w_")


def sessions(df: DataFrame, keys: Sequence[str], ts: str, gap: str | Column, aggs: Sequence[Column]) -> DataFrame:
    return df.groupBy(*keys, F.session_window(ts, gap).alias("w_")).agg(*aggs).withColumns({"t0": F.col("w_.start"), "t1": F.col("w_.end")}).drop("w_")


def first_of(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row of each key, for as long as the watermark keeps it."""
    return df.dropDuplicatesWithinWatermark(list(keys)) if df.isStreaming else df.dropDuplicates(list(keys))


def upsert(spark: SparkSession, path: str, keys: Sequence[str], order: str, parts: int = 16) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: keeps under `path` the row of each key with the greatest `order`, in `parts` partitions by a hash of
    the key. A batch rewrites the partitions that it has keys of, and no others. A batch that comes again changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        new = batch.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
        touched = [r[0] for r in new.select("part").distinct().collect()]  # at most `parts`
        known = spark.read.parquet(path) if partitions(spark, path, "part") else None
        both = new if known is None else new.unionByName(known.where(F.col("part").isin(touched)).select(new.columns))
        rest = [c for c in new.columns if c not in keys]
        best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("b")).select(*keys, "b.*").select(new.columns)
        # what is read must stand elsewhere before its partitions are replaced
        overwrite_partitions(durable(best), path, ["part"])

    return write


def wetness(df: DataFrame, keys: Sequence[str], ts: str, value: str, memory_h: float) -> DataFrame:
    """Exponentially fading store of each key, carried from batch to batch: one row per key and trigger, with the time
    and the store after its newest reading. Readings older than the state are folded in at their age."""
    kinds = dict(df.dtypes)

    def update(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, store = state.get if state.exists else (None, 0.0)
        for pdf in frames:
            t = pdf[ts].astype("int64").to_numpy() / (1e9 if str(pdf[ts].dtype).endswith("[ns]") or "[ns" in str(pdf[ts].dtype) else 1e6)
            v = pdf[value].to_numpy(float)
            newest = max(float(t.max()), at if at is not None else -np.inf)
            store = store * (np.exp((at - newest) / 3600 / memory_h) if at is not None else 0.0) + float((v * np.exp((t - newest) / 3600 / memory_h)).sum())
            at = newest
        state.update((at, store))
        yield pd.DataFrame({**{k: [x] for k, x in zip(keys, key, strict=True)}, "at": [at], "store": [store]})

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    return df.select(*keys, ts, value).groupBy(*keys).applyInPandasWithState(update, f"{schema}, at double, store double", "at double, store double", "update", GroupStateTimeout.NoTimeout)


def run_once(df: DataFrame, mode: str, path: str | None = None, write: Callable[[DataFrame, int], None] | None = None) -> str:
    """Runs a stream over all that is there and stops; gives the folder of its output. Append goes to files; other modes
    write one folder for each batch (v=N), the last of which holds what a complete result is."""
    folder = path or work_folder(df.sparkSession)
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}-state").trigger(availableNow=True)
    if mode == "append" and write is None:
        q = writer.format("parquet").option("path", folder).start()
    else:
        q = writer.foreachBatch(write or (lambda b, n: b.write.mode("overwrite").parquet(f"{folder}/v={n}"))).start()
    q.awaitTermination()
    return folder


def last_batch(spark: SparkSession, folder: str) -> DataFrame:
    df = spark.read.parquet(folder)
    newest = df.agg(F.max("v")).first()[0]
    return df.where(F.col("v") == newest).drop("v")


def cycle(df: DataFrame, step: Callable[[DataFrame, int], None], every: str, checkpoint: str):
    """The production cycle: one micro-batch each `every`, handed to `step`."""
    return df.writeStream.trigger(processingTime=every).option("checkpointLocation", checkpoint).foreachBatch(step).start()
