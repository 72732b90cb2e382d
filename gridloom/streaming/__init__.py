"""Event control on streams; the batch forms give the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridloom.operators import relational as R


def debounce(events: DataFrame, key: str, ts: str, gap: str, value: str, watermark: str | None = None) -> DataFrame:
    """Events of a key with less than `gap` between neighbours become one, with the last value (of several at one time the greatest):
    key, started, n, value."""
    if watermark is not None:
        events = events.withWatermark(ts, watermark)
    grouped = events.groupBy(key, F.session_window(ts, gap).alias("w"))
    return grouped.agg(F.min(ts).alias("started"), F.count("*").alias("n"), F.max_by(value, F.struct(ts, value)).alias(value)).drop("w")


def _passed(key: str, ts: str, value: str, wait: np.int64, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and time, those that pass. What the last row of a batch leaves behind holds for the next one."""
    last_key, last = None, None
    for batch in batches:
        keys, at, keep = batch.column(key).to_pylist(), batch.column("__at").to_pylist(), []
        for k, (this, t) in enumerate(zip(keys, at, strict=True)):
            if last is None or this != last_key or t - last >= wait:
                keep.append(k)
                last_key, last = this, t
        yield batch.select([key, ts, value]).take(pa.array(keep, pa.int64())).rename_columns([key, "first_ts", value])


def throttle(events: DataFrame, key: str, ts: str, every: str, value: str, watermark: str | None = None) -> DataFrame:
    """Events that pass, with their key, time (first_ts) and value: the first of a key, then each that comes `every` or more after the
    last one that passed. Events without a time are dropped; of events at one time that of the least value counts.

    A table is dealt by key, sorted, and read through in batches: no group is held in memory. A stream keeps the time of the last
    event that passed for each key, for good; its batches are sorted, so events that come late to a batch count from there on."""
    wait = pd.Timedelta(every).value // 1000
    out = T.StructType([events.schema[key], T.StructField("first_ts", events.schema[ts].dataType), events.schema[value]])
    if not events.isStreaming:
        sorted_rows = events.where(F.col(ts).isNotNull()).select(key, ts, value, F.unix_micros(F.col(ts).cast("timestamp")).alias("__at")).repartition(key).sortWithinPartitions(key, "__at", value)
        return sorted_rows.mapInArrow(lambda batches: _passed(key, ts, value, wait, batches), out)
    if watermark is not None:
        events = events.withWatermark(ts, watermark)

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, keep = (state.get[0] if state.exists else None), []
        rows = pd.concat(parts).sort_values([ts, value])
        for n, t in enumerate(rows[ts].astype("datetime64[us]").astype("int64")):
            if last is None or t - last >= wait:
                keep.append(n)
                last = t
        state.update((last,))
        yield rows.iloc[keep][[key, ts, value]].rename(columns={ts: "first_ts"})

    timed = events.where(F.col(ts).isNotNull()).select(key, ts, value)
    return timed.groupBy(key).applyInPandasWithState(step, out, "last long", "append", GroupStateTimeout.NoTimeout)


def event_records(events: DataFrame, map_id: str, event: str, seq: str = "seq", layer_id: str = "layer_id", group: str = "grp") -> DataFrame:
    """What a map says about an event on a layer: input (its name: map, category and event) and record (JSON: id, nonce, group unless
    it is null, lat and lng unless null). The nonce is a hash of the event's number, so equal events differ and reruns agree."""
    fields = F.struct(F.col(layer_id).alias("id"), F.abs(F.xxhash64(seq)).alias(".nonce"), F.col(group).alias("group"), "lat", "lng")
    return events.select(seq, F.concat(F.lit(f"{map_id}_"), "category", F.lit(f"_{event}")).alias("input"), F.to_json(fields).alias("record"))


def latest(events: DataFrame, key: str, ts: str, columns: list[str]) -> DataFrame:
    """The newest value of each column by key: what a pending update holds when it is carried out."""
    return events.groupBy(key).agg(*(F.max_by(c, ts).alias(c) for c in columns))


def pending_calls(calls: DataFrame, key: str, order: str, call: str) -> DataFrame:
    """Calls waiting for a key, as one array in their order."""
    return calls.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, call))), lambda x: x[call]).alias("calls"))


def after_ready(events: DataFrame, ready: DataFrame, key: str, ts: str) -> DataFrame:
    """Events from the moment on at which their key is ready; earlier ones are dropped."""
    first = ready.groupBy(key).agg(F.min(ts).alias("__ready"))
    return events.join(first, key).where(F.col(ts) >= F.col("__ready")).drop("__ready")


def chunks(rows: DataFrame, order: list, size: int) -> DataFrame:
    """Adds batch: the number of the group of `size` rows that a row falls into."""
    return R.number_all(rows, *order, name="__k").withColumn("batch", R.chunk_of(F.col("__k"), size)).drop("__k")
