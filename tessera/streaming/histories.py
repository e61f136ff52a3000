"""The recent readings of each key, carried from batch to batch: merged, bounded in age, and dropped when a key falls silent."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HOUR = 3_600_000_000  # microseconds
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rate(times: Sequence[int], values: Sequence[float], back: int, least: int) -> float | None:
    """Change per hour from the last reading at or before (newest - back), or the first, to the newest; None if they are less than
    `least` apart. times: microseconds, rising."""
    before = [k for k, t in enumerate(times) if t <= times[-1] - back]
    k = before[-1] if before else 0
    return (values[-1] - values[k]) / (times[-1] - times[k]) * HOUR if times[-1] - times[k] >= least and times[-1] > times[k] else None


class History(StatefulProcessor):
    """State: the newest moment, and for each hour that is kept its newest reading (of readings at one moment the greatest). So the
    result does not depend on how readings fall into batches, nor on repeated ones. All of it is one value, of at most `keep` hours,
    as each question to the state store is a message of its own, which costs more than what it brings. Rows come and go as rows: most
    keys have few in a batch, for which a table each would be dear."""

    def __init__(self, keys: Sequence[str], keep: int, series: int, back: int) -> None:
        self.keys, self.keep, self.series, self.back = list(keys), keep, series, back

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "newest long, t array<long>, v array<double>")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        state = self.held.get()
        newest, got = (state[0], {t // HOUR: (t, v) for t, v in zip(state[1], state[2], strict=True)}) if state else (None, {})
        for r in rows:
            t, v = r["t__"], r["v__"]
            got[t // HOUR] = max(got.get(t // HOUR, (t, v)), (t, v))
        top = max([t for t, _ in got.values()] + ([newest] if newest is not None else []))
        held = [got[hour] for hour in sorted(got) if hour > top // HOUR - self.keep]
        if newest is None or top // HOUR > newest // HOUR:
            for at in list(self.handle.listTimers()) if state else ():
                self.handle.deleteTimer(at)
            self.handle.registerTimer((top // HOUR + self.keep) * HOUR // 1000)  # a silent key is forgotten
        self.held.update((top, [t for t, _ in held], [v for _, v in held]))
        yield self.row(key, held, False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        _, times, values = self.held.get()
        self.held.clear()
        yield self.row(key, list(zip(times, values, strict=True)), True)

    def row(self, key: Any, held: list[tuple[int, float]], gone: bool) -> Row:
        times, values = zip(*(x for x in held if x[0] // HOUR > held[-1][0] // HOUR - self.series), strict=True)
        change = rate(times, values, self.back * HOUR, HOUR)
        series = [Row(t=t, v=v) for t, v in zip(times, values, strict=True)]
        return Row(**dict(zip(self.keys, key, strict=True)), at=held[-1][0], n=len(held), last=held[-1][1], rate=change, series=series, gone=gone)

    def close(self) -> None:
        pass


def histories(df: DataFrame, keys: Sequence[str], ts: str, value: str, keep: int = 48, series: int = 12, back: int = 3) -> DataFrame:
    """For each key with new readings in a batch: at (microseconds of its newest reading), n (hours kept), last, rate (an hour's change),
    series (t, v of the last `series` hours) and gone. An hour counts by its newest reading; hours that are `keep` or more before the
    newest are dropped. When the watermark has passed a key's newest hour by `keep` hours, its state goes, with a last row in
    which gone is true. df: a stream with a watermark on ts. Readings that are null, or of a null time, are left out."""
    kinds = dict(df.dtypes)
    rows = df.where(F.col(ts).isNotNull() & F.col(value).isNotNull()).select(*keys, ts, F.unix_micros(ts).alias("t__"), F.col(value).cast("double").alias("v__"))
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", at long, n int, last double, rate double, series array<struct<t:long,v:double>>, gone boolean"
    return rows.groupBy(*keys).transformWithState(History(keys, keep, series, back), schema, "Update", "EventTime")


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams that start here keep their state in RocksDB, which states with timers and maps need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
